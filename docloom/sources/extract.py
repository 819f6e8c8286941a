"""Text and metadata out of files: a registry of extractors by media type, with the standard library alone.

An extractor takes bytes and returns (text parts, metadata). Bytes that it cannot read raise ExtractError, which becomes
an error code in the row; nothing is raised out of a task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources import media

Extracted = tuple[list[str], dict[str, str]]
SHAPE = "sections array<string>, metadata map<string,string>, error string"


class ExtractError(Exception):
    """Bytes that are not what their type says."""


class EncryptedError(ExtractError):
    """Bytes that a password locks."""


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def html_lang(html: Column) -> Column:
    return F.regexp_extract(html, r'(?i)<html[^>]*\slang="([^"]*)"', 1)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.meta: dict[str, str] = {}
        self.skip, self.in_title = 0, False

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        self.in_title = tag == "title"
        if tag == "html" and given.get("lang"):
            self.meta["lang"] = given["lang"]
        if tag == "meta" and given.get("content"):
            name = given.get("name") or given.get("property") or given.get("http-equiv")
            if name:
                self.meta.setdefault(name, given["content"])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript") and self.skip:
            self.skip -= 1
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.meta["title"] = (self.meta.get("title", "") + data).strip()
        elif not self.skip and data.strip():
            self.parts.append(data.strip())


def read_html(raw: bytes) -> Extracted:
    reader = _Reader()
    reader.feed(raw.decode("utf-8", "replace"))
    return ["\n".join(reader.parts)], reader.meta


def read_text(raw: bytes) -> Extracted:
    text = raw.decode("utf-8", "replace")
    odd = sum(ord(c) < 32 and c not in "\t\n\r" for c in text)
    if raw.startswith(T.SIGNATURES) or b"\x00" in raw or text.count("\ufffd") > 0.01 * len(text) or odd > 0.05 * len(text):
        raise ExtractError("garbled")
    return [text], {}


def read_unknown(raw: bytes) -> Extracted:
    """The first 8192 bytes, if they look like text."""
    try:
        return read_text(raw[:8192])
    except ExtractError:
        return [], {}


def _open(raw: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise ExtractError("corrupt") from e


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(z.read(name))
    except (KeyError, ElementTree.ParseError) as e:
        raise ExtractError("corrupt") from e


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in z.namelist():
        return {}
    return {_local(e): e.text.strip() for e in _xml(z, "docProps/core.xml") if e.text and e.text.strip()}


def _paragraphs(root: ElementTree.Element) -> list[str]:
    out = ["".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in root.iter() if _local(p) == "p"]
    return [p for p in out if p.strip()]


def read_docx(raw: bytes) -> Extracted:
    z = _open(raw)
    return ["\n".join(_paragraphs(_xml(z, "word/document.xml")))], _core(z)


def _numbered(z: zipfile.ZipFile, prefix: str) -> list[str]:
    names = [n for n in z.namelist() if n.startswith(prefix) and n.endswith(".xml") and n[len(prefix) : -4].isdigit()]
    return sorted(names, key=lambda n: int(n[len(prefix) : -4]))


def read_pptx(raw: bytes) -> Extracted:
    z = _open(raw)
    return ["\n".join(_paragraphs(_xml(z, n))) for n in _numbered(z, "ppt/slides/slide")], _core(z)


def read_xlsx(raw: bytes, most: int = 1500) -> Extracted:
    """A part for each sheet, cells of a row joined by tabs, until a sheet has `most` characters."""
    z = _open(raw)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _xml(z, "xl/sharedStrings.xml")]
    sheets = []
    for name in _numbered(z, "xl/worksheets/sheet"):
        rows, size = [], 0
        for row in (e for e in _xml(z, name).iter() if _local(e) == "row"):
            cells = []
            for c in row:
                value = next((v.text or "" for v in c.iter() if _local(v) in ("v", "t")), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
            rows.append("\t".join(cells))
            size += len(rows[-1]) + 1
            if size >= most:
                break
        sheets.append("\n".join(rows))
    return sheets, _core(z)


def read_epub(raw: bytes) -> Extracted:
    """A part for each chapter in reading order, and the Dublin Core fields."""
    z = _open(raw)
    rootfile = next((e for e in _xml(z, "META-INF/container.xml").iter() if _local(e) == "rootfile"), None)
    if rootfile is None:
        raise ExtractError("corrupt")
    path = rootfile.get("full-path", "")
    package, base = _xml(z, path), path.rpartition("/")[0]
    items = {e.get("id"): e.get("href") for e in package.iter() if _local(e) == "item"}
    meta = {_local(e): e.text.strip() for e in package.iter() if e.tag.startswith("{http://purl.org/dc/elements/1.1/}") and e.text}
    parts = []
    for ref in (e.get("idref") for e in package.iter() if _local(e) == "itemref"):
        name = f"{base}/{items.get(ref)}" if base else items.get(ref)
        if name in z.namelist():
            parts.append(read_html(z.read(name))[0][0])
    return parts, meta


def read_pdf(raw: bytes) -> Extracted:
    from docloom.sources.pdf import read

    return read(raw)


#: Extractors by media type; others can be registered (recognition and speech engines come in this way).
REGISTRY: dict[str, Callable[[bytes], Extracted]] = {
    "application/pdf": read_pdf,
    "text/html": read_html,
    T.MEDIA[".docx"]: read_docx,
    T.MEDIA[".xlsx"]: read_xlsx,
    T.MEDIA[".pptx"]: read_pptx,
    "application/epub+zip": read_epub,
    **{t: media.image_reader() for t in ("image/jpeg", "image/png", "image/gif", "image/bmp", "image/tiff", "image/webp")},
    **{T.MEDIA[k]: media.audio_reader() for k in T.AUDIO},
    **{t: read_text for t in ("text/plain", "text/markdown", "text/csv", "application/json", "application/xml", "application/x-yaml")},
}


def sniffed(raw: bytes) -> str:
    """A media type from the content."""
    if raw.startswith(b"%PDF-"):
        return "application/pdf"
    if raw.startswith(b"PK\x03\x04"):
        names = _open(raw).namelist() if zipfile.is_zipfile(io.BytesIO(raw)) else []
        for mark, suffix in (("word/", ".docx"), ("xl/", ".xlsx"), ("ppt/", ".pptx"), ("META-INF/container.xml", ".epub")):
            if any(n.startswith(mark) for n in names):
                return T.MEDIA[suffix]
    if raw.lstrip()[:15].lower().startswith((b"<!doctype html", b"<html")):
        return "text/html"
    return "text/plain"


def extract_one(mime: str, raw: bytes, registry: dict[str, Callable[[bytes], Extracted]]) -> tuple[list[str], dict[str, str], str | None]:
    """By the stated type, else by the content's, else as unknown bytes."""
    error = None
    for kind in dict.fromkeys((mime, sniffed(raw))):
        if kind in registry:
            try:
                return *registry[kind](raw), None
            except EncryptedError as e:
                return [], {}, f"encrypted: {e}"
            except ExtractError as e:
                error = f"extract_failed: {e}"
            except Exception as e:  # an extractor's own failure is the row's, not the task's
                error = f"extract_failed: {type(e).__name__}"
    parts, meta = read_unknown(raw)
    return parts, meta, None if parts else error or "extract_failed: unsupported"


def extracted(files: DataFrame, registry: dict[str, Callable[[bytes], Extracted]] | None = None) -> DataFrame:
    """path, sections, metadata and error of binary files (path, content)."""
    use = {**REGISTRY, **(registry or {})}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [extract_one(m, bytes(c or b""), use) for m, c in zip(frame["mime"], frame["content"])]
            yield pd.DataFrame({"path": frame["path"], "sections": [r[0] for r in rows], "metadata": [r[1] for r in rows], "error": [r[2] for r in rows]})

    return files.select("path", T.media_type(F.col("path")).alias("mime"), "content").mapInPandas(run, f"path string, {SHAPE}")


def html_meta(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The key column, name and content of every meta tag that names its content."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    value = lambda n: F.regexp_extract("tag", rf'(?is)\s(?:{n})\s*=\s*"([^"]*)"', 1)
    return pages.select(key, F.explode(tags).alias("tag")).select(key, value("name|property|http-equiv").alias("name"), value("content").alias("content")).filter("name <> '' and content <> ''")


def html_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, lang, text and number of meta fields of each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [read_html((h or "").encode()) for h in frame[html]]
            yield pd.DataFrame({key: frame[key], "title": [m.get("title", "") for _, m in rows], "lang": [m.get("lang", "") for _, m in rows], "text": [p[0] for p, _ in rows], "n_meta": [len(m) for _, m in rows]})

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, title string, lang string, text string, n_meta long")


def tree(spark: SparkSession, root: str, dirs: DataFrame | None = None) -> DataFrame:
    """Files below root but dot files and those in opaque directories, by name or by mode in `dirs`; content is read only
    where it is selected. Sort by lower-case path where the order matters."""
    from docloom.operators.directories import OPAQUE_NAMES
    from docloom.operators.queue import ancestors

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parents = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    closed = F.exists(parents, lambda p: F.lower(p).isin(*OPAQUE_NAMES))
    kept = files.filter(~T.name_of(F.col("path")).startswith(".") & ~closed)
    if dirs is None:
        return kept
    # directories that a user closed are named relative to the root
    base = F.lit(re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/")
    rel = F.replace(F.regexp_replace("path", r"^\w+:/*", "/"), base, F.lit(""))
    above = kept.select("path", F.explode(ancestors(rel)).alias("__dir")).join(dirs.filter("mode = 'opaque'").select(F.col("path").alias("__dir")), "__dir", "left_semi")
    return kept.join(above.select("path").distinct(), "path", "left_anti")
