"""The image and audio readers on files made here."""

import struct
import wave
import io
import zlib

import pytest

from docloom.sources import extract, media


def tiff_block(order, fields, extra=b""):
    """A TIFF block of one directory; fields are (tag, kind, n, four value bytes)."""
    mark = b"II*\x00" if order == "<" else b"MM\x00*"
    body = b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in fields)
    return mark + struct.pack(order + "IH", 8, len(fields)) + body + b"\x00" * 4 + extra


def jpeg(block=b"", comment=b""):
    out = b"\xff\xd8"
    for kind, body in ((0xE0, b"JFIF\x00\x01\x02\x01\x00\x48\x00\x48\x00\x00"), (0xE1, b"Exif\x00\x00" + block), (0xFE, comment), (0xC0, b"\x08" + struct.pack(">HHB", 30, 40, 3) + b"\x00" * 9)):
        out += bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body
    return out + b"\xff\xda\x00\x02data\xff\xd9"


@pytest.mark.parametrize("order", "<>")
def test_jpeg_fields(order):
    end = 8 + 2 + 5 * 12 + 4
    extra = b"Cam era\x00" + struct.pack(order + "H", 2) + struct.pack(order + "HHIHH", 0x8827, 3, 1, 200, 0) + struct.pack(order + "HHI", 0x829A, 5, 1)
    rational = end + 8 + 2 + 24 + 4
    extra += struct.pack(order + "I", rational) + b"\x00" * 4 + struct.pack(order + "II", 1, 4)
    gps = rational + 8
    extra += struct.pack(order + "H", 2) + struct.pack(order + "HHI", 1, 2, 2) + b"N\x00\x00\x00" + struct.pack(order + "HHII", 2, 5, 3, gps + 30) + b"\x00" * 4
    extra += struct.pack(order + "6I", 52, 1, 30, 1, 3, 2)
    block = tiff_block(order, [
        (0x0110, 2, 8, struct.pack(order + "I", end)), (0x0112, 3, 1, struct.pack(order + "HH", 6, 0)), (0x8769, 4, 1, struct.pack(order + "I", end + 8)),
        (0x8825, 4, 1, struct.pack(order + "I", gps)), (0x9999, 3, 1, struct.pack(order + "HH", 7, 0)),
    ], extra)
    parts, meta = media.image_reader()(jpeg(block, b" seen \xd7\x90"))
    assert parts == [""]
    assert meta == {
        "dimensions": "40x30", "color_mode": "RGB", "pil_format": "JPEG", "info_comment": "seen א", "exif_Model": "Cam era", "exif_Orientation": "6",
        "exif_ISOSpeedRatings": "200", "exif_ExposureTime": "0.25", "exif_tag_39321": "7", "exif_GPS_GPSLatitudeRef": "N", "exif_GPS_GPSLatitude": "[52.0, 30.0, 1.5]",
    }


def test_png_texts():
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\x00" * 4
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBB", 5, 6, 8, 6) + b"\x00" * 3) + chunk(b"tEXt", b"Title\x00a") + chunk(b"zTXt", b"Long\x00\x00" + zlib.compress(b"b" * 300))
    raw += chunk(b"iTXt", b"Wide\x00\x00\x00he\x00\x00" + "א".encode()) + chunk(b"tEXt", b"dpi\x0072") + chunk(b"IEND", b"")
    assert media.image_reader()(raw)[1] == {"info_Title": "a", "info_Long": "b" * 200 + "…", "info_Wide": "א", "dimensions": "5x6", "color_mode": "RGBA", "pil_format": "PNG"}


def test_frames_go_to_the_engine():
    frame = b"\x21\xf9\x04\x00\x0a\x00\x00\x00" + b"\x2c" + b"\x00" * 9 + b"\x02\x01\x00\x00"
    raw = b"GIF89a" + struct.pack("<HHBBB", 3, 4, 0x80, 0, 0) + b"\x00" * 6 + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x05\x00\x00" + frame * 3 + b"\x21\xfe\x02hi\x00" + b";"
    parts, meta = media.image_reader(lambda raw, k: f"page {k}")(raw)
    assert parts == ["page 0", "page 1", "page 2"]
    assert meta == {"info_version": "GIF89a", "info_background": "0", "info_loop": "5", "info_duration": "100", "info_comment": "hi", "dimensions": "3x4", "color_mode": "P", "pil_format": "GIF"}


def test_tiff_bmp_webp():
    page = tiff_block("<", [(256, 3, 1, b"\x07\x00\x00\x00"), (257, 3, 1, b"\x08\x00\x00\x00"), (262, 3, 1, b"\x02\x00\x00\x00")])
    parts, meta = media.image_reader()(page)
    assert len(parts) == 1 and meta["dimensions"] == "7x8" and meta["color_mode"] == "RGB"
    loop = page[:-4] + struct.pack("<I", 8)
    assert len(media.image_reader()(loop)[0]) == 1
    bmp = b"BM" + b"\x00" * 16 + struct.pack("<iiHH", 9, -10, 1, 24) + b"\x00" * 20
    assert media.image_reader()(bmp)[1]["dimensions"] == "9x10"
    body = b"VP8X" + struct.pack("<I", 10) + b"\x10\x00\x00\x00" + (10).to_bytes(3, "little") + (11).to_bytes(3, "little")
    assert media.image_reader()(b"RIFF\x00\x00\x00\x00WEBP" + body)[1] == {"dimensions": "11x12", "color_mode": "RGBA", "pil_format": "WEBP"}


@pytest.mark.parametrize("raw", [b"", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF89a", b"BM", b"II*\x00", b"RIFF\x00\x00\x00\x00WEBP", b"\xff\xd8\xff\xe1\x00\x04ab"])
def test_broken_images_are_errors_of_their_rows(raw):
    parts, meta, error = extract.extract_one("image/png", raw, extract.REGISTRY)
    assert error is None or error.startswith("extract_failed")
    with pytest.raises(extract.ExtractError):
        media.image_reader()(raw)


def test_every_cut_of_a_file_is_read_or_refused():
    whole = jpeg(tiff_block("<", [(0x0112, 3, 1, b"\x06\x00\x00\x00")]), b"c")
    for k in range(len(whole)):
        try:
            media.image_reader()(whole[:k])
        except extract.ExtractError:
            pass
        assert isinstance(media.audio_facts(whole[:k]), dict)


def test_wav():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes(b"\x00" * 4 * 4000)
    assert media.audio_facts(out.getvalue()) == {"audio_length": "0.5", "audio_bitrate": "256000", "audio_sample_rate": "8000", "audio_channels": "2", "audio_bits_per_sample": "16"}


def comments(*pairs):
    return struct.pack("<I", 1) + b"v" + struct.pack("<I", len(pairs)) + b"".join(struct.pack("<I", len(p)) + p for p in pairs)


def test_flac_and_ogg():
    notes = comments(b"TITLE=One", b"artist=A", b"ARTIST=B")
    packed = (44100 << 44 | 1 << 41 | 15 << 36 | 88200).to_bytes(8, "big")
    raw = b"fLaC" + b"\x00\x00\x00\x22" + b"\x00" * 10 + packed + b"\x00" * 16 + b"\x84" + len(notes).to_bytes(3, "big") + notes + b"\x00" * 1000
    got = media.audio_facts(raw)
    assert got == {"audio_length": "2.0", "audio_sample_rate": "44100", "audio_channels": "2", "audio_bits_per_sample": "16", "audio_title": "One", "audio_artist": '["A", "B"]', "audio_bitrate": "4000"}

    def page(position, *packets):
        lengths = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
        return b"OggS\x00\x00" + struct.pack("<qIIIB", position, 1, 0, 0, len(lengths)) + lengths + b"".join(packets)

    head = b"OpusHead\x01\x01" + struct.pack("<H", 480) + b"\x00" * 7
    raw = page(0, head) + page(0, b"OpusTags" + comments(b"title=" + b"x" * 150, b"album=" + b"y" * 150)) + page(48480, b"sound")
    assert media.audio_facts(raw) == {"audio_length": "1.0", "audio_channels": "1", "audio_title": "x" * 150, "audio_album": "y" * 150}
    assert media.audio_facts(b"OggS") == {}


def test_mp3():
    text = lambda name, body: name + len(body).to_bytes(4, "big") + b"\x00\x00" + body
    frames = text(b"TIT2", b"\x01" + "שיר".encode("utf-16")) + text(b"TPE1", b"\x00A\x00B") + text(b"TXXX", b"\x03key\x00value") + text(b"APIC", b"\x00")
    tag = b"ID3\x03\x00\x00" + bytes((0, 0, len(frames) + 10 >> 7, len(frames) + 10 & 127)) + frames + b"\x00" * 10
    sound = b"\xff\xfb\x90\x00" + b"\x00" * 15996
    got = media.audio_facts(tag + sound)
    assert got == {"audio_length": "1.0", "audio_bitrate": "128000", "audio_sample_rate": "44100", "audio_channels": "2", "audio_TIT2": '["שיר"]', "audio_TPE1": '["A", "B"]', "audio_TXXX:key": '["value"]'}
    counted = b"\xff\xfb\x90\x00" + b"\x00" * 32 + b"Xing" + struct.pack(">II", 1, 1225) + b"\x00" * 1000
    assert media.audio_facts(counted)["audio_length"] == "32.0"
    assert media.audio_facts(b"no sound") == {}


def test_mp4():
    box = lambda name, *inner: struct.pack(">I", 8 + sum(map(len, inner))) + name + b"".join(inner)
    entry = box(b"mp4a", b"\x00" * 16 + struct.pack(">HHHHHH", 2, 16, 0, 0, 48000, 0))
    track = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", b"\x00" * 8, entry)))))
    tags = box(b"udta", box(b"meta", b"\x00" * 4, box(b"ilst", box(b"\xa9nam", box(b"data", b"\x00\x00\x00\x01\x00\x00\x00\x00Song")))))
    raw = box(b"ftyp", b"M4A ") + box(b"moov", box(b"mvhd", b"\x00" * 12, struct.pack(">II", 1000, 2500)), track, tags)
    assert media.audio_facts(raw) == {"audio_length": "2.5", "audio_channels": "2", "audio_bits_per_sample": "16", "audio_sample_rate": "48000", "audio_codec": "mp4a", "audio_©nam": "Song"}


def test_speech_engine():
    assert media.audio_reader()(b"")[1] == {"asr_status": "unavailable"}
    assert media.audio_reader(lambda raw, facts: f"{len(raw)} bytes")(b"abc") == (["3 bytes"], {})
