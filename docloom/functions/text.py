"""Column functions over text, paths, lists and metadata: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the metadata tools' language, wider than Java's \s.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def trim_to_word(c: Column, most: int, look_back: int = 50) -> Column:
    """At most `most` characters; cut at the last blank, newline or tab if one stands in the last `look_back` of them."""
    cut = F.substring(c, 1, most)
    keep = max(0, most - look_back)
    tail = F.substring(cut, keep + 1, look_back)
    head = rstrip(F.concat(F.substring(cut, 1, keep), F.regexp_extract(tail, r"(?s)^(.*)[ \n\t]", 1)))
    return F.when(F.length(c) <= most, c).when(tail.rlike(r"[ \n\t]"), head).otherwise(rstrip(cut))


def semilist(items: Column) -> Column:
    """An array as `;a;b;`: no semicolons inside, no empties, distinct, in code point order."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: strip(F.replace(x, F.lit(";"), F.lit("")))), lambda x: x != "")))
    return F.when(F.size(clean) > 0, F.concat(F.lit(";"), F.array_join(clean, ";"), F.lit(";"))).otherwise("")


def from_semilist(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "")


def languages(c: Column) -> Column:
    """Sorted distinct codes of a list parted by plus, comma or semicolon."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[+,;]"), strip), lambda x: x != "")))


def normal_path(c: Column) -> Column:
    """Trimmed, forward slashes, lower-case drive letter, no slash at the end, a lone dot as empty."""
    slashed = F.translate(strip(c), "\\", "/")
    drive = F.when(slashed.rlike("^[A-Za-z]:"), F.concat(F.lower(F.substring(slashed, 1, 1)), F.substring(slashed, 2, 1 << 30))).otherwise(slashed)
    bare = F.regexp_replace(drive, "/+$", "")
    return F.when(bare == ".", "").otherwise(bare)


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    """The lower-case extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]*)$", 1))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def under(path: Column, top: str) -> Column:
    """The path itself or below it, letters of either case below it."""
    return (path == top) | F.lower(path).startswith(top.lower() + "/")


def moved(path: Column, source: str, target: str) -> Column:
    return F.when(under(path, source), F.concat(F.lit(target), F.substring(path, len(source) + 1, 1 << 30))).otherwise(path)


def slug(c: Column, most: int = 120) -> Column:
    """Characters that file names cannot hold become blanks, runs of white space one; trimmed, then cut to `most`."""
    return F.substring(strip(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]', " "), f"{SPACE}+", " ")), 1, most)


def smart_name(date: Column, sender: Column, topic: Column, summary: Column, suffix: Column) -> Column:
    """`date - sender - topic.ext`, empty parts left out, untitled if none is left. A missing topic is the summary's first
    six words, or untitled if there is no summary either."""
    full = lambda c: F.nullif(c, F.lit(""))
    words = F.array_join(F.slice(F.filter(F.split(summary, f"{SPACE}+"), lambda x: x != ""), 1, 6), " ")
    subject = F.coalesce(full(topic), F.when(full(summary).isNotNull(), words), F.lit("untitled"))
    parts = F.filter(F.array(*(slug(F.coalesce(c, F.lit(""))) for c in (date, sender, subject))), lambda x: x != "")
    base = F.when(F.size(parts) > 0, F.array_join(parts, " - ")).otherwise("untitled")
    return F.concat(base, F.lit("."), F.regexp_replace(suffix, r"^\.+", ""))


def parties(c: Column) -> Column:
    """Names parted by comma, semicolon, slash, ` and ` or ` & `; what holds nothing else is one name."""
    names = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;/]| and | & "), strip), lambda x: x != "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(names) == 0, F.array(strip(c))).otherwise(names)


def like_below(path: str) -> str:
    """A LIKE pattern, escaped by a backslash, for what lies below a path."""
    return path.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "/%"


def iso_seconds(epoch: Column) -> Column:
    """Seconds since 1970 as an ISO time in UTC, to the second."""
    return F.date_format(F.timestamp_seconds(F.floor(epoch)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_now(clock: Column | None = None, micro: bool = False) -> Column:
    """The time (a clock's, for tests) as an ISO time in UTC."""
    return F.date_format(clock if clock is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss" + (".SSSSSS" if micro else "") + "'Z'")


def minutes_seconds(seconds: Column) -> Column:
    """`3m 07s`."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%dm %02ds", F.floor(whole / 60), F.pmod(whole, F.lit(60)))


def relative(path: Column, root: str) -> Column:
    """The path below root, or as it is outside."""
    plain = normal_path(path)
    return F.when(plain == root, ".").when(plain.startswith(root + "/"), F.substring(plain, len(root) + 2, 1 << 30)).otherwise(plain)


def lenient_list(c: Column) -> Column:
    """A list written as a semicolon list, a JSON array or one value."""
    raw = strip(F.coalesce(c, F.lit("")))
    return F.when(raw == "", F.array().cast("array<string>")).when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))).when(raw.contains(";"), F.filter(F.transform(F.split(raw, ";"), strip), lambda x: x != "")).otherwise(F.array(raw))


def holds(semilist_column: Column, item: str) -> Column:
    """Whether a semicolon list has the item."""
    return F.array_contains(from_semilist(semilist_column), item)


def spoken(c: Column) -> Column:
    """Language list; none if it is missing or says unknown; what holds separators alone is one name."""
    names = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,+;]"), strip), lambda x: x != "")
    none = (F.coalesce(c, F.lit("")) == "") | (F.lower(c) == "unknown")
    return F.when(none, F.array().cast("array<string>")).when(F.size(names) == 0, F.array(strip(c))).otherwise(names)


def confidence(c: Column) -> Column:
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(low.isin("low", "medium", "high", "confirmed"), low).otherwise("low")


def gershayim(c: Column) -> Column:
    """A double quote next to a Hebrew letter becomes the Hebrew sign."""
    return F.regexp_replace(c, "(?<=[\u0590-\u05ff])\"|\"(?=[\u0590-\u05ff])", "\u05f4")


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def json_map(c: Column) -> Column:
    """A JSON object as a string map; anything else as an empty one."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


#: First bytes of binary formats.
SIGNATURES = (b"%PDF-", b"\x89PNG\r\n\x1a\n", b"GIF87a", b"GIF89a", b"\xff\xd8\xff", b"PK\x03\x04", b"BM")


def garbled(raw: Column, text: Column) -> Column:
    """Binary or broken text: a known signature, a NUL, over 1 % replacement or over 5 % control characters."""
    starts = F.lit(False)
    for s in SIGNATURES:
        starts = starts | F.startswith(raw, F.lit(s))
    n = F.greatest(F.length(text), F.lit(1))
    odd = F.length(F.regexp_replace(text, "[^\ufffd]", ""))
    control = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    return F.coalesce(F.octet_length(raw) > 0, F.lit(False)) & (starts | F.contains(raw, F.lit(b"\x00")) | (odd / n > 0.01) | (control / n > 0.05))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, never under zero, milliseconds to the nearest, halves to even."""
    ms = F.greatest(F.bround(seconds * 1000, 0).cast("long"), F.lit(0))
    part = lambda div, mod: F.pmod(F.floor(ms / div), F.lit(mod))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))


def srt_words(c: Column) -> Column:
    """Subtitle text without numbers, times and markup."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^\d+$") & ~x.contains("-->"))
    plain = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"<[^>]*>|\{[^}]*\}", ""))), lambda x: x != "")
    return F.array_join(plain, " ")


#: Extension and media type.
MEDIA = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".bmp": "image/bmp",
    ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp", ".heic": "image/heic", ".heif": "image/heif",
    ".html": "text/html", ".htm": "text/html", ".epub": "application/epub+zip", ".txt": "text/plain",
    ".md": "text/markdown", ".markdown": "text/markdown", ".csv": "text/csv", ".log": "text/plain",
    ".json": "application/json", ".xml": "application/xml", ".yaml": "application/x-yaml", ".yml": "application/x-yaml",
    ".amr": "audio/amr", ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".wav": "audio/wav", ".ogg": "audio/ogg",
    ".opus": "audio/opus", ".flac": "audio/flac", ".aac": "audio/aac", ".mp4": "video/mp4", ".mkv": "video/x-matroska",
    ".mov": "video/quicktime", ".avi": "video/x-msvideo", ".webm": "video/webm", ".wmv": "video/x-ms-wmv",
    ".flv": "video/x-flv", ".m4v": "video/mp4",
}
IMAGES = tuple(k for k, v in MEDIA.items() if v.startswith("image/"))
AUDIO = tuple(k for k, v in MEDIA.items() if v.startswith("audio/"))
VIDEO = tuple(k for k, v in MEDIA.items() if v.startswith("video/"))


def media_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MEDIA.items() for x in pair))
    return F.coalesce(F.element_at(table, suffix_of(path)), F.lit("application/octet-stream"))


#: First characters of embedded metadata packets, and keys that are never kept.
PACKETS = ("<?xpacket", "<x:xmpmeta", "<rdf:RDF")
SKIPPED = ("icc_profile", "exif", "photoshop", "XML:com.adobe.xmp", "dpi", "jfif", "jfif_version", "jfif_density", "jfif_unit")


def clean_text(v: Column, most: int = 200) -> Column:
    """A trimmed value, clipped with an ellipsis; null if it is empty, a packet or holds a NUL."""
    plain = strip(v)
    packet = plain.startswith(PACKETS[0]) | plain.startswith(PACKETS[1]) | plain.startswith(PACKETS[2])
    return F.when((plain != "") & ~plain.contains("\x00") & ~packet, F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("…"))).otherwise(plain))


def metadata_clean(m: Column, most: int = 200) -> Column:
    """A map of strings without the values that clean_text drops."""
    return F.map_filter(F.transform_values(m, lambda k, v: clean_text(v, most)), lambda k, v: v.isNotNull())


def metadata_collect(m: Column, prefix: str, skip: tuple[str, ...] = SKIPPED) -> Column:
    return F.transform_keys(F.map_filter(metadata_clean(m), lambda k, v: ~k.isin(*skip) if skip else F.lit(True)), lambda k, v: F.concat(F.lit(prefix), k))


def metadata_values(raw: Column, most: int = 200, items: int = 20) -> Column:
    """A JSON object of embedded metadata as key to cleaned value, the values as JSON: strings as clean_text has them, numbers
    and booleans as they are, lists cleaned item by item and cut to `items` with an ellipsis, objects and nulls dropped."""
    text = lambda v: F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>")[0]
    as_json = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)

    def scalar(v: Column) -> Column:
        return F.when(v.startswith('"'), F.when(clean_text(text(v), most).isNotNull(), as_json(clean_text(text(v), most)))).when((v != "null") & ~v.startswith("{") & ~v.startswith("["), v)

    def listed(v: Column) -> Column:
        parts = F.transform(F.try_variant_get(F.try_parse_json(v), "$", "array<variant>"), lambda x: F.to_json(x))
        kept = F.filter(F.transform(parts, scalar), lambda x: x.isNotNull())
        short = F.when(F.size(kept) > items, F.concat(F.slice(kept, 1, items), F.array(F.lit('"…"')))).otherwise(kept)
        return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(short, ","), F.lit("]")))

    pairs = F.transform_values(F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>"), lambda k, v: F.to_json(v))
    return F.map_filter(F.transform_values(pairs, lambda k, v: F.when(v.startswith("["), listed(v)).otherwise(scalar(v))), lambda k, v: v.isNotNull())
