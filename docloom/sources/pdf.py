"""Text and metadata of PDF files, with the standard library alone.

Covers what most documents need: classic and compressed objects, Flate streams, page order by the page tree, text operators
with literal and hexadecimal strings, ToUnicode maps of fonts, the information dictionary and the XMP packet. A locked
file is an error of its own; a page whose fonts have no map gives the bytes as Latin-1.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflate(body: bytes, data: bytes) -> bytes:
    if b"FlateDecode" not in body:
        return data
    engine = zlib.decompressobj()
    try:
        return engine.decompress(data)
    except zlib.error:
        return b""


def _objects(raw: bytes) -> dict[int, tuple[bytes, bytes]]:
    """Number to (dictionary, decoded stream); later versions of an object replace earlier ones."""
    out: dict[int, tuple[bytes, bytes]] = {}
    marks = list(_OBJECT.finditer(raw))
    for k, m in enumerate(marks):
        end = raw.find(b"endobj", m.end())
        body = raw[m.end() : end if end >= 0 else len(raw)]
        s = _STREAM.search(body)
        if not s:
            out[int(m[1])] = (body, b"")
            continue
        head = body[: s.start()]
        length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
        begin = m.end() + s.end()
        stop = begin + int(length[1]) if length else raw.find(b"endstream", begin)
        out[int(m[1])] = (head, _inflate(head, raw[begin:stop]))
    for head, data in list(out.values()):  # objects within a stream
        first, n = re.search(rb"/First\s+(\d+)", head), re.search(rb"/N\s+(\d+)", head)
        if b"/ObjStm" in head and first and n:
            numbers = [int(x) for x in data[: int(first[1])].split()[: 2 * int(n[1])]]
            places = numbers[1::2] + [len(data)]
            for k, number in enumerate(numbers[::2]):
                out.setdefault(number, (data[int(first[1]) + places[k] : int(first[1]) + places[k + 1]], b""))
    return out


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, b"" if x in (b"\n", b"\r") else x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, token[1:-1], flags=re.S)


def _text(b: bytes) -> str:
    if b[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return b.decode("utf-16", "replace")
    return b.decode("latin-1")


def _unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and code to text, of a ToUnicode map."""
    hexes = lambda x: [bytes.fromhex(re.sub(rb"\s", b"", h).decode()) for h in re.findall(rb"<([0-9A-Fa-f\s]*)>", x)]
    table: dict[int, str] = {}
    width = 1
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        pairs = hexes(part)
        for code, to in zip(pairs[::2], pairs[1::2]):
            table[int.from_bytes(code)] = to.decode("utf-16-be", "replace")
            width = max(width, len(code))
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for line in re.finditer(rb"<([^>]*)>\s*<([^>]*)>\s*(<[^>]*>|\[[^\]]*\])", part):
            lo, hi = (bytes.fromhex(re.sub(rb"\s", b"", line[k]).decode()) for k in (1, 2))
            width = max(width, len(lo))
            targets = hexes(line[3])
            for k in range(min(int.from_bytes(hi) - int.from_bytes(lo) + 1, 65536)):
                if line[3][:1] == b"[":
                    value = targets[k].decode("utf-16-be", "replace") if k < len(targets) else ""
                else:
                    value = targets[0][:-2].decode("utf-16-be", "replace") + chr(min(int.from_bytes(targets[0][-2:]) + k, 0x10FFFF))
                table[int.from_bytes(lo) + k] = value
    return width, table


def _shown(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    out: list[str] = []
    stack: list[bytes] = []
    font: tuple[int, dict[int, str]] | None = None

    def show(b: bytes) -> None:
        if font and font[1]:
            w = font[0]
            out.append("".join(font[1].get(int.from_bytes(b[k : k + w]), "") for k in range(0, len(b), w)))
        else:
            out.append(_text(b))

    def newline() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/+-.0123456789":
            stack.append(t)
            continue
        if t == b"Tf" and len(stack) >= 2:
            font = fonts.get(stack[-2])
        elif t in (b"Tj", b"'", b'"') and stack:
            if t != b"Tj":
                newline()
            if stack[-1][:1] in b"(<":
                show(_literal(stack[-1]))
        elif t == b"TJ":
            for x in stack:
                if x[:1] in b"(<":
                    show(_literal(x))
                elif x[:1] in b"-0123456789" and x.lstrip(b"-").replace(b".", b"", 1).isdigit() and float(x) < -200 and out and out[-1] != " ":
                    out.append(" ")  # a wide gap between glyphs
        elif t in (b"T*", b"ET") or (t in (b"Td", b"TD") and len(stack) >= 2 and stack[-1].strip(b"-+.0")):
            newline()
        elif t in (b"Td", b"TD", b"Tm") and out and out[-1] not in (" ", "\n"):
            out.append(" " if t != b"Tm" else "\n")
        stack = []
    lines = "".join(out).split("\n")
    return "\n".join(x.strip() for x in lines if x.strip())


def read(raw: bytes) -> tuple[list[str], dict[str, str]]:
    """Text of each page, and the information dictionary's and XMP packet's fields."""
    from docloom.sources.extract import EncryptedError, ExtractError

    if not raw.lstrip().startswith(b"%PDF-"):
        raise ExtractError("corrupt")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
        raise EncryptedError("pdf_encrypted")
    objects = _objects(raw)
    if not objects:
        raise ExtractError("corrupt")
    dictionary = lambda n: objects.get(n, (b"", b""))[0]

    def kids(number: int, seen: set[int]) -> list[int]:
        if number in seen:
            return []
        seen.add(number)
        body = dictionary(number)
        inner = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if inner:
            return [p for m in _REF.finditer(inner[1]) for p in kids(int(m[1]), seen)]
        return [number] if re.search(rb"/Type\s*/Page\b(?!s)", body) else []

    roots = [n for n, (b, _) in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]
    pages = [p for r in roots for p in kids(r, set())] or sorted(n for n, (b, _) in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", b))

    def resources(number: int, depth: int = 0) -> bytes:
        body = dictionary(number)
        at = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", body)
        if at:
            return dictionary(int(at[1]))
        if b"/Resources" in body or depth > 20:
            return body
        up = re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", body)
        return resources(int(up[1]), depth + 1) if up else body

    def fonts(number: int) -> dict[bytes, tuple[int, dict[int, str]]]:
        body = resources(number)
        at = re.search(rb"/Font\s+(\d+)\s+\d+\s+R", body)
        block = dictionary(int(at[1])) if at else (re.search(rb"/Font\s*<<(.*?)>>", body, re.S) or [b"", b""])[1]
        out = {}
        for m in re.finditer(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", block):
            to = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", dictionary(int(m[2])))
            if to:
                out[m[1]] = _unicode_map(objects.get(int(to[1]), (b"", b""))[1])
        return out

    parts = []
    for p in pages:
        at = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", dictionary(p), re.S)
        content = b"\n".join(objects.get(int(m[1]), (b"", b""))[1] for m in _REF.finditer(at[1])) if at else b""
        parts.append(_shown(content, fonts(p)))
    meta: dict[str, str] = {}
    info = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", raw)
    block = dictionary(int(info[1])) if info else b"".join(b for b, _ in objects.values() if b"/Info" in b)
    for m in re.finditer(rb"/([A-Za-z]+)\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", block, re.S):
        value = _text(_literal(m[2])).strip()
        if value:
            meta[m[1].decode()] = value
    for _, data in objects.values():
        if b"<x:xmpmeta" in data or b"<rdf:RDF" in data:
            for m in re.finditer(rb"<(dc|xmp|xmpMM|pdf|photoshop):(\w+)[^>]*>(.*?)</\1:\2>", data, re.S):
                text = re.sub(rb"<[^>]*>", b" ", m[3]).decode("utf-8", "replace")
                if text.strip():
                    meta.setdefault(f"{m[1].decode()}:{m[2].decode()}", " ".join(text.split()))
    return parts, meta
