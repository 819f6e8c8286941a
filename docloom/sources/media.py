"""Facts and tags that image and audio files carry about themselves, with the standard library alone.

Images (JPEG, PNG, GIF, BMP, TIFF, WebP) give their dimensions, colour mode, format, comments (`info_`) and EXIF fields
(`exif_`, those of the position `exif_GPS_`); audio (WAV, FLAC, MP3, Ogg, MP4) gives length, rate, channels and tags
(`audio_`). Values are strings; lists are JSON arrays. What recognition or speech engines read comes in through
`image_reader` and `audio_reader`; without one a file has no text. Offsets that only locate other fields are left out.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

from docloom.functions import text as T

Facts = dict[str, object]
MOST, ITEMS = 200, 20

#: Names of EXIF tags, of the position's tags, and sizes of the field types.
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution",
    0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer", 0x0213: "YCbCrPositioning",
    0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings",
    0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal",
    0x9012: "OffsetTimeDigitized", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue",
    0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource",
    0x9209: "Flash", 0x920A: "FocalLength", 0x9286: "UserComment", 0x9290: "SubsecTime", 0x9291: "SubsecTimeOriginal",
    0x9292: "SubsecTimeDigitized", 0xA000: "FlashPixVersion", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight",
    0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit", 0xA217: "SensingMethod",
    0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm",
    0xA406: "SceneCaptureType", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber",
    0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber",
}
POSITION = {
    0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude",
    7: "GPSTimeStamp", 8: "GPSSatellites", 9: "GPSStatus", 10: "GPSMeasureMode", 11: "GPSDOP", 12: "GPSSpeedRef", 13: "GPSSpeed",
    14: "GPSTrackRef", 15: "GPSTrack", 16: "GPSImgDirectionRef", 17: "GPSImgDirection", 18: "GPSMapDatum", 29: "GPSDateStamp",
}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NUMBERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def cleaned(v: object) -> object | None:
    """A value fit to be shown: text trimmed and clipped; null if it is empty, a packet or holds a NUL; lists item by item."""
    if isinstance(v, bytes):
        v = v.decode("utf-8", "ignore")
    if isinstance(v, (list, tuple)):
        kept = [c for c in map(cleaned, v) if c is not None]
        return (kept[:ITEMS] + ["…"] if len(kept) > ITEMS else kept) or None
    if not isinstance(v, str):
        return v
    v = v.strip()
    if not v or "\x00" in v or v.startswith(T.PACKETS):
        return None
    return v[:MOST] + "…" if len(v) > MOST else v


def flat(facts: Facts, prefix: str = "") -> dict[str, str]:
    """Facts as strings under a prefix, without keys that are never kept."""
    kept = {k: cleaned(v) for k, v in facts.items() if k not in T.SKIPPED}
    return {prefix + k: json.dumps(v, ensure_ascii=False) if isinstance(v, list) else str(v) for k, v in kept.items() if v is not None}


# EXIF


def _directory(data: bytes, at: int, order: str) -> dict[int, object]:
    """The fields of the directory at an offset, by tag; those that point outside the data are left out."""
    if not 0 < at <= len(data) - 2:
        return {}
    fields: dict[int, object] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        place = at + 2 + 12 * k
        if place + 12 > len(data):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", data, place)
        size = SIZES.get(kind, 0) * n
        start = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        if not size or start + size > len(data):
            continue
        if kind == 2:
            fields[tag] = data[start : start + n].split(b"\x00")[0].decode("utf-8", "replace")
        elif kind == 7:
            fields[tag] = data[start : start + n]
        else:
            if kind in (5, 10):
                pairs = struct.iter_unpack(order + ("II" if kind == 5 else "ii"), data[start : start + size])
                values = [a / b if b else float("nan") for a, b in pairs]
            else:
                values = list(struct.unpack_from(f"{order}{n}{NUMBERS[kind]}", data, start))
            fields[tag] = values[0] if n == 1 else values
    return fields


def _order(data: bytes) -> str | None:
    return {b"II*\x00": "<", b"MM\x00*": ">"}.get(data[:4])


def exif(data: bytes) -> Facts:
    """Fields of a TIFF block by name: its own, those of its sub-directory that it lacks, and those of the position."""
    order = _order(data)
    if order is None or len(data) < 8:
        return {}
    first = _directory(data, struct.unpack_from(order + "I", data, 4)[0], order)
    pointer = lambda tag: first[tag] if isinstance(first.get(tag), int) else 0
    named = lambda fields, table, mark: {table.get(t, f"{mark}tag_{t}"): v for t, v in fields.items() if t not in (0x8769, 0x8825, 0xA005)}
    inner, place = _directory(data, pointer(0x8769), order), _directory(data, pointer(0x8825), order)
    return named(inner, TAGS, "") | named(first, TAGS, "") | {f"GPS_{k}": v for k, v in named(place, POSITION, "gps_").items()}


# images: (format, mode, width, height, frames, info, TIFF block)


def _jpeg(raw: bytes) -> tuple:
    at, size, mode, info, block = 2, None, "", {}, b""
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        kind = raw[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:
            at += 1 if kind == 0xFF else 2
            continue
        if kind in (0xD9, 0xDA):
            break
        length = struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + length]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
            height, width, parts = struct.unpack_from(">HHB", body, 1)
            size, mode = (width, height), {1: "L", 3: "RGB", 4: "CMYK"}.get(parts, "")
            if kind == 0xC2:
                info["progressive"] = 1
        elif kind == 0xFE:
            info["comment"] = body
        elif kind == 0xE1 and body.startswith(b"Exif\x00\x00"):
            block = body[6:]
        at += 2 + length
    if size is None:
        raise ValueError("no frame")
    return "JPEG", mode, *size, 1, info, block


def _chunks(raw: bytes, at: int, order: str, head: str) -> Iterator[tuple[bytes, bytes]]:
    """Names and bodies of chunks: length first (PNG) or name first, padded to even lengths (RIFF)."""
    while at + 8 <= len(raw):
        a, b = struct.unpack_from(order + head, raw, at)
        name, length = (b, a) if isinstance(a, int) else (a, b)
        yield name, raw[at + 8 : at + 8 + length]
        at += 8 + length + (4 if order == ">" else length & 1)


def _png(raw: bytes) -> tuple:
    info, block, head = {}, b"", None
    for name, body in _chunks(raw, 8, ">", "I4s"):
        if name == b"IHDR":
            head = struct.unpack_from(">IIBB", body)
        elif name == b"tEXt" and b"\x00" in body:
            key, value = body.split(b"\x00", 1)
            info[key.decode("latin-1")] = value.decode("latin-1")
        elif name == b"zTXt" and b"\x00" in body:
            key, value = body.split(b"\x00", 1)
            info[key.decode("latin-1")] = zlib.decompress(value[1:]).decode("latin-1")
        elif name == b"iTXt" and body.count(b"\x00") >= 2:
            key, rest = body.split(b"\x00", 1)
            value = rest[2:].split(b"\x00", 2)[-1]
            info[key.decode("latin-1")] = (zlib.decompress(value) if rest[:1] == b"\x01" else value).decode("utf-8", "replace")
        elif name == b"gAMA" and len(body) == 4:
            info["gamma"] = struct.unpack(">I", body)[0] / 100000
        elif name == b"eXIf":
            block = body
    width, height, depth, colour = head
    mode = {0: "1" if depth == 1 else "I;16" if depth == 16 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(colour, "")
    return "PNG", mode, width, height, 1, info, block


def _gif(raw: bytes) -> tuple:
    width, height, flags, background = struct.unpack_from("<HHBB", raw, 6)
    info: Facts = {"version": raw[:6].decode(), "background": background}
    at, frames = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(raw) and raw[at]:
            parts.append(raw[at + 1 : at + 1 + raw[at]])
            at += 1 + raw[at]
        return b"".join(parts), at + 1

    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            label = raw[at + 1]
            body, at = blocks(at + 2)
            if label == 0xFE:
                info["comment"] = body
            elif label == 0xF9 and len(body) >= 3 and not frames and body[1:3] != b"\x00\x00":
                info["duration"] = struct.unpack_from("<H", body, 1)[0] * 10
            elif label == 0xFF and body.startswith(b"NETSCAPE2.0\x01"):
                info["loop"] = struct.unpack_from("<H", body, 12)[0]
        elif raw[at] == 0x2C:
            local = raw[at + 9]
            frames += 1
            _, at = blocks(at + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            break
    return "GIF", "P", width, height, max(frames, 1), info, b""


def _bmp(raw: bytes) -> tuple:
    width, height, _, bits = struct.unpack_from("<iiHH", raw, 18)
    return "BMP", {1: "1", 4: "P", 8: "P", 32: "RGBA"}.get(bits, "RGB"), width, abs(height), 1, {}, b""


def _tiff(raw: bytes) -> tuple:
    order, at, frames, seen = _order(raw), struct.unpack_from(_order(raw) + "I", raw, 4)[0], 0, set()
    fields = _directory(raw, at, order)
    while 0 < at <= len(raw) - 2 and at not in seen:
        seen.add(at)
        frames += 1
        after = at + 2 + 12 * struct.unpack_from(order + "H", raw, at)[0]
        at = struct.unpack_from(order + "I", raw, after)[0] if after + 4 <= len(raw) else 0
    samples, bits = fields.get(277, 1), fields.get(258, 1)
    shade = fields.get(262)
    mode = "RGBA" if shade == 2 and samples == 4 else {2: "RGB", 3: "P", 5: "CMYK", 6: "RGB"}.get(shade, "1" if bits == 1 else "L")
    return "TIFF", mode, fields[256], fields[257], max(frames, 1), {}, raw


def _webp(raw: bytes) -> tuple:
    size, mode, block = None, "RGB", b""
    for name, body in _chunks(raw, 12, "<", "4sI"):
        if name == b"VP8X" and len(body) >= 10:
            size = tuple(1 + int.from_bytes(body[k : k + 3], "little") for k in (4, 7))
            mode = "RGBA" if body[0] & 0x10 else "RGB"
        elif name == b"VP8 " and size is None:
            size = tuple(x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
        elif name == b"VP8L" and size is None:
            bits = struct.unpack_from("<I", body, 1)[0]
            size, mode = ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1), "RGBA" if bits >> 28 & 1 else "RGB"
        elif name == b"EXIF":
            block = body.removeprefix(b"Exif\x00\x00")
    return "WEBP", mode, *size, 1, {}, block


def _image(raw: bytes) -> tuple:
    if raw.startswith(b"\xff\xd8\xff"):
        return _jpeg(raw)
    if raw.startswith(b"\x89PNG\r\n\x1a\n"):
        return _png(raw)
    if raw.startswith((b"GIF87a", b"GIF89a")):
        return _gif(raw)
    if raw.startswith(b"BM"):
        return _bmp(raw)
    if _order(raw):
        return _tiff(raw)
    if raw.startswith(b"RIFF") and raw[8:12] == b"WEBP":
        return _webp(raw)
    raise ValueError("no known image")


def image_reader(recognise: Callable[[bytes, int], str] | None = None) -> Callable[[bytes], tuple[list[str], dict[str, str]]]:
    """An extractor of images: a part for each frame, with what the engine reads in it (bytes and the frame's number)."""

    def read(raw: bytes) -> tuple[list[str], dict[str, str]]:
        from docloom.sources.extract import ExtractError

        try:
            kind, mode, width, height, frames, info, block = _image(raw)
        except (ValueError, TypeError, KeyError, IndexError, struct.error, zlib.error) as e:
            raise ExtractError("corrupt") from e
        meta = flat(info, "info_") | {"dimensions": f"{width}x{height}", "color_mode": mode, "pil_format": kind} | flat(exif(block), "exif_")
        return [recognise(raw, k) if recognise else "" for k in range(frames)], meta

    return read


# audio: facts and tags


def _wav(raw: bytes) -> Facts:
    out: Facts = {}
    rate = 0
    for name, body in _chunks(raw, 12, "<", "4sI"):
        if name == b"fmt " and len(body) >= 16:
            _, channels, sample_rate, rate, _, bits = struct.unpack_from("<HHIIHH", body)
            out |= {"bitrate": rate * 8, "sample_rate": sample_rate, "channels": channels, "bits_per_sample": bits}
        elif name == b"data" and rate:
            out = {"length": len(body) / rate} | out
        elif name == b"LIST" and body.startswith(b"INFO"):
            out |= {k.decode("latin-1"): v.rstrip(b"\x00") for k, v in _chunks(body, 4, "<", "4sI")}
    return out


def _comments(body: bytes) -> Facts:
    """Vorbis comments: lower-case keys, a list where a key comes twice."""
    at = 4 + struct.unpack_from("<I", body)[0]
    n, at, found = struct.unpack_from("<I", body, at)[0], at + 4, {}
    for _ in range(n):
        length = struct.unpack_from("<I", body, at)[0]
        key, _, value = body[at + 4 : at + 4 + length].decode("utf-8", "replace").partition("=")
        found.setdefault(key.lower(), []).append(value)
        at += 4 + length
    return {k: v[0] if len(v) == 1 else v for k, v in found.items()}


def _flac(raw: bytes) -> Facts:
    out, at, last = {}, 4, False
    while not last and at + 4 <= len(raw):
        last, kind, length = bool(raw[at] & 0x80), raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
        body = raw[at + 4 : at + 4 + length]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            rate, samples = packed >> 44, packed & (1 << 36) - 1
            out |= {"length": samples / rate, "sample_rate": rate, "channels": (packed >> 41 & 7) + 1, "bits_per_sample": (packed >> 36 & 31) + 1}
        elif kind == 4:
            out |= _comments(body)
        at += 4 + length
    if out.get("length"):
        out["bitrate"] = int((len(raw) - at) * 8 / out["length"])
    return out


def _ogg(raw: bytes) -> Facts:
    """The first two packets of the first stream, and the last page's position."""
    pages, at = [], 0
    while at + 27 <= len(raw) and raw[at : at + 4] == b"OggS":
        lengths = raw[at + 27 : at + 27 + raw[at + 26]]
        start = at + 27 + len(lengths)
        pages.append((raw[at + 14 : at + 18], struct.unpack_from("<q", raw, at + 6)[0], lengths, start))
        at = start + sum(lengths)
    own = [p for p in pages if p[0] == pages[0][0]]
    packets, part = [], b""
    for _, _, lengths, start in own:
        for n in lengths:
            part, start = part + raw[start : start + n], start + n
            if n < 255:
                packets.append(part)
                part = b""
        if len(packets) > 1:
            break
    head, notes = packets[:2]
    end = max(p[1] for p in own)
    if head.startswith(b"OpusHead"):
        skip = struct.unpack_from("<H", head, 10)[0]
        return {"length": (end - skip) / 48000, "channels": head[9]} | _comments(notes[8:])
    channels, rate = struct.unpack_from("<BI", head, 11)
    return {"length": end / rate, "sample_rate": rate, "channels": channels} | _comments(notes[7:])


#: kbit/s by layer III index for MPEG 1 and 2, and sample rates of MPEG 1.
KBITS = ((0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))
RATES = (44100, 48000, 32000)


def _id3(raw: bytes) -> tuple[Facts, int]:
    """Text frames of an ID3v2.3 or 2.4 tag, each a list, and where the sound begins."""
    if raw[:3] != b"ID3":
        return {}, 0
    seven = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, out = 10 + seven(raw[6:10]), 10, {}
    while at + 10 <= min(end, len(raw)) and raw[at]:
        name = raw[at : at + 4].decode("latin-1")
        size = seven(raw[at + 4 : at + 8]) if raw[3] == 4 else int.from_bytes(raw[at + 4 : at + 8], "big")
        body = raw[at + 10 : at + 10 + size]
        if name.startswith("T") and body:
            code = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3]
            parts = body[1:].decode(code, "replace").rstrip("\x00").split("\x00")
            if name == "TXXX":
                name, parts = f"TXXX:{parts[0]}", [p.lstrip("\ufeff") for p in parts[1:]]
            out[name] = parts
        at += 10 + size
    return out, end


def _mp3(raw: bytes) -> Facts:
    tags, start = _id3(raw)
    at = re.compile(rb"\xff[\xf2\xf3\xfa\xfb]").search(raw, start)
    if at is None:
        raise ValueError("no frame")
    at = at.start()
    one = raw[at + 1] >> 3 & 3 == 3
    half = 1 if one else 2
    kbits, rate = KBITS[half - 1][raw[at + 2] >> 4], RATES[raw[at + 2] >> 2 & 3] // half
    channels = 1 if raw[at + 3] >> 6 == 3 else 2
    side = at + 4 + ((17 if channels == 1 else 32) if one else (9 if channels == 1 else 17))
    size = len(raw) - at - (128 if raw[-128:-125] == b"TAG" else 0)
    length = size * 8 / (kbits * 1000)
    if raw[side : side + 4] in (b"Xing", b"Info") and struct.unpack_from(">I", raw, side + 4)[0] & 1:
        length = struct.unpack_from(">I", raw, side + 8)[0] * (1152 // half) / rate
    return {"length": length, "bitrate": int(size * 8 / length), "sample_rate": rate, "channels": channels} | tags


def _mp4(raw: bytes) -> Facts:
    out: Facts = {}

    def walk(at: int, end: int, path: tuple[bytes, ...]) -> None:
        while at + 8 <= end:
            size, name = struct.unpack_from(">I4s", raw, at)
            head = 8
            if size == 1:
                size, head = struct.unpack_from(">Q", raw, at + 8)[0], 16
            stop = min(end, at + size) if size else end
            if stop < at + head:
                return
            body = at + head
            if name == b"mvhd":
                scale, units = struct.unpack_from(">IQ" if raw[body] else ">II", raw, body + (20 if raw[body] else 12))
                out["length"] = units / scale
            elif name == b"mp4a" and path[-1:] == (b"stsd",):
                channels, bits, _, _, rate = struct.unpack_from(">HHHHH", raw, body + 16)
                out.update(channels=channels, bits_per_sample=bits, sample_rate=rate, codec="mp4a")
            elif path[-1:] == (b"ilst",) and raw[body + 4 : body + 8] == b"data" and raw[body + 11] == 1:
                out[name.decode("latin-1")] = raw[body + 16 : body + struct.unpack_from(">I", raw, body)[0]]
            elif name in (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"ilst"):
                walk(body, stop, (*path, name))
            elif name in (b"stsd", b"meta"):
                walk(body + (8 if name == b"stsd" else 4), stop, (*path, name))
            at = stop

    walk(0, len(raw), ())
    return out


def _audio(raw: bytes) -> Facts:
    if raw.startswith(b"RIFF") and raw[8:12] == b"WAVE":
        return _wav(raw)
    if raw.startswith(b"fLaC"):
        return _flac(raw)
    if raw.startswith(b"OggS"):
        return _ogg(raw)
    if raw[4:8] == b"ftyp":
        return _mp4(raw)
    return _mp3(raw)


def audio_facts(raw: bytes) -> dict[str, str]:
    """Length, rates, channels and tags under `audio_`; empty where the container is unknown or broken, as zeros are."""
    try:
        found = _audio(raw)
    except (ValueError, TypeError, KeyError, IndexError, ZeroDivisionError, struct.error):
        return {}
    return flat({k: v for k, v in found.items() if v != 0}, "audio_")


def audio_reader(transcribe: Callable[[bytes, dict[str, str]], str] | None = None) -> Callable[[bytes], tuple[list[str], dict[str, str]]]:
    """An extractor of audio: its facts and, with an engine, one part of what is said (bytes and the facts)."""

    def read(raw: bytes) -> tuple[list[str], dict[str, str]]:
        meta = audio_facts(raw)
        if transcribe is None:
            return [""], meta | {"asr_status": "unavailable"}
        said = transcribe(raw, meta)
        return [said], meta

    return read
