"""The PDF reader on files made here."""

import zlib

import pytest

from docloom.sources import extract


def made(pages, info=b"", extra=b"", trailer=b""):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = []
    for k, content in enumerate(pages):
        n = 10 + 2 * k
        kids.append(b"%d 0 R" % n)
        packed = zlib.compress(content)
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 5 0 R >> >> >>" % (n + 1)
        objects[n + 1] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed)
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(reversed(kids)))
    objects[5] = b"<< /Type /Font /Subtype /Type1 " + extra + b">>"
    objects[6] = b"<< " + info + b" >>"
    objects[7] = b"<< /Length 99 >>\nstream\n" + b"1 beginbfchar <01> <05D0> endbfchar 1 beginbfrange <02> <04> <0041> endbfrange".ljust(99) + b"\nendstream"
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items()))
    return b"%PDF-1.4\n" + body + b"trailer << /Root 1 0 R /Info 6 0 R " + trailer + b">>\n%%EOF"


def test_pages_in_tree_order_with_fields():
    raw = made([rb"BT /F1 12 Tf (second \(page\)) Tj ET", b"BT (Hel) Tj (lo) Tj 0 -14 Td [(wor) -20 (ld) -300 (again)] TJ T* <6869> Tj ET"], rb"/Title (A \(b\)) /Author <FEFF05D0>")
    parts, meta = extract.read_pdf(raw)
    assert parts == ["Hello\nworld again\nhi", "second (page)"]
    assert meta == {"Title": "A (b)", "Author": "א"}


def test_font_maps():
    raw = made([b"BT /F1 9 Tf <010203> Tj ET"], extra=b"/ToUnicode 7 0 R ")
    assert extract.read_pdf(raw)[0] == ["אAB"]


def test_locked_and_broken():
    with pytest.raises(extract.EncryptedError):
        extract.read_pdf(made([b""], trailer=b"/Encrypt 9 0 R "))
    assert extract.extract_one("application/pdf", made([b""], trailer=b"/Encrypt 9 0 R "), extract.REGISTRY)[2] == "encrypted: pdf_encrypted"
    assert extract.extract_one("application/pdf", b"%PDF-1.4 nothing", extract.REGISTRY)[2].startswith("extract_failed")
    assert extract.read_pdf(made([]))[0] == []
