"""PDF and legacy Word files, made here, through the readers; damaged ones give an error row."""

import struct
import zlib

import pytest

from maskloom.sources import doc, pdf
from maskloom.sources.files import read_blocks

# ---- PDF


def stream(told, body, flate=True):
    body = zlib.compress(body) if flate else body
    return b"<< %s %s /Length %d >>\nstream\n%s\nendstream" % (told, b"/Filter /FlateDecode" if flate else b"", len(body), body)


def made_pdf(objects, packed=(), trailer=b"/Root 1 0 R"):
    """objects: by number; those in packed stand in an object stream."""
    out, places = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n", {}
    objects = dict(objects)
    if packed:
        bodies = [objects.pop(n) for n in packed]
        head = b" ".join(b"%d %d" % (n, sum(len(b) + 1 for b in bodies[:i])) for i, n in enumerate(packed)) + b" "
        objects[max(objects) + 50] = stream(b"/Type /ObjStm /N %d /First %d" % (len(packed), len(head)), head + b"\n".join(bodies))
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    return out + b"trailer << /Size %d %s >>\nstartxref\n0\n%%%%EOF\n" % (max(places) + 1, trailer)


CMAP = b"""/CIDInit /ProcSet findresource begin 12 dict begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <041A> <0002> <043B> endbfchar 2 beginbfrange <0010> <0012> <0430> <0020> <0021> [<0444> <D83DDE00>] endbfrange endcmap"""
PIXELS = bytes(range(12))
JPEG = b"\xff\xd8\xff\xe0made up\xff\xd9"


def sample(packed=()):
    first = b"""BT /F1 12 Tf 72 700 Td (Hello \\(plain\\) w\\366rld) Tj 0 -14 Td [(Sec) -20 (ond) -300 (line)] TJ T* ET
    BT /F2 9 Tf 1 0 0 1 72 600 Tm <000100020010> Tj 30 0 Td <00200021> Tj ET q 10 0 0 10 0 0 cm /Im1 Do Q /Fm1 Do"""
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources 9 0 R >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R /Resources << /Font << /F1 10 0 R >> >> >>",
        5: stream(b"", first), 6: stream(b"", b"BT /F1 10 Tf 14 TL 50 500 Td (One) Tj (Two) ' ET % end", flate=False),
        9: b"<< /Font << /F1 10 0 R /F2 11 0 R >> /XObject << /Im1 13 0 R /Im2 14 0 R /Fm1 15 0 R >> >>",
        10: b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>", 11: b"<< /Type /Font /Subtype /Type0 /ToUnicode 12 0 R >>", 12: stream(b"", CMAP),
        13: stream(b"/Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB", PIXELS),
        14: b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (len(JPEG), JPEG),
        15: stream(b"/Type /XObject /Subtype /Form /BBox [0 0 9 9]", b"BT /F1 8 Tf 5 5 Td (In a form) Tj ET"),
    }
    return made_pdf(objects, packed)


@pytest.mark.parametrize("packed", [(), (1, 2, 3, 4, 9, 10, 11)])
def test_pdf_lines_and_images(packed):
    (lines, images), (more, none) = pdf.pages(sample(packed))
    assert lines == ["Hello (plain) wörld", "Second line", "Кла ф😀", "In a form"] and more == ["One", "Two"] and none == []
    (png, ext), (jpeg, ext2) = images
    assert (ext, ext2, jpeg) == ("png", "jpeg", JPEG) and png.startswith(b"\x89PNG")
    at = png.index(b"IDAT")
    assert zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]]) == b"\0" + PIXELS[:6] + b"\0" + PIXELS[6:]


def test_pdf_without_a_trailer_is_read():
    whole = sample()
    assert [lines for lines, _ in pdf.pages(whole[: whole.rindex(b"trailer")])][1] == ["One", "Two"]


@pytest.mark.parametrize("data", [b"", b"no pdf", sample()[:60], made_pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< >>"}, trailer=b"/Root 1 0 R /Encrypt 3 0 R")])
def test_damaged_pdf_is_an_error(data):
    with pytest.raises(ValueError):
        list(pdf.pages(data))


# ---- legacy Word


def made_doc(pieces, sector=512, small=False):
    """pieces: (text, compressed). A compound file with a Word document; small streams go through the inner one."""
    body, entries = b"", []
    base = 0x200 if small else 0x1000
    for text, compressed in pieces:
        entries.append((len(text), (base + len(body)) * 2 | 0x40000000 if compressed else base + len(body)))
        body += text.encode("cp1252") if compressed else text.encode("utf-16-le")
    n = sum(k for k, _ in entries)
    ends = [sum(k for k, _ in entries[:i]) for i in range(len(entries) + 1)]
    plc = struct.pack(f"<{len(ends)}i", *ends) + b"".join(struct.pack("<HIH", 0, fc, 0) for _, fc in entries)
    clx = b"\x01\x03\x00abc" + b"\x02" + struct.pack("<I", len(plc)) + plc
    fib = bytearray(base)
    struct.pack_into("<H", fib, 0, 0xA5EC)
    struct.pack_into("<H", fib, 0x0A, 0x200)
    struct.pack_into("<i", fib, 0x4C, n)
    struct.pack_into("<II", fib, 0x1A2, 16, len(clx))
    table = bytes(16) + clx
    streams = {"WordDocument": bytes(fib) + body, "1Table": table if small else table.ljust(5000, b"\0")}
    fat, sectors = [], []

    def put(data):
        first = len(sectors)
        parts = [data[i : i + sector].ljust(sector, b"\0") for i in range(0, len(data), sector)] or [bytes(sector)]
        for k, p in enumerate(parts):
            sectors.append(p)
            fat.append(first + k + 1 if k + 1 < len(parts) else 0xFFFFFFFE)
        return first

    entry = lambda name, kind, first, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind) + bytes(49) + struct.pack("<II", first, size) + bytes(4)
    if small:
        inner, mini, placed = b"", [], {}
        for name, data in streams.items():
            placed[name] = len(mini)
            k = -(-len(data) // 64)
            mini += [*range(len(mini) + 1, len(mini) + k), 0xFFFFFFFE]
            inner += data.ljust(64 * k, b"\0")
        root, mini_first = put(inner), put(struct.pack(f"<{len(mini)}I", *mini).ljust(sector, b"\xff"))
        listed = entry("Root Entry", 5, root, len(inner)) + b"".join(entry(x, 2, placed[x], len(d)) for x, d in streams.items())
    else:
        placed = {name: put(data) for name, data in streams.items()}
        mini_first = 0xFFFFFFFE
        listed = entry("Root Entry", 5, 0xFFFFFFFE, 0) + b"".join(entry(x, 2, placed[x], len(d)) for x, d in streams.items())
    directory = put(listed.ljust(-(-len(listed) // sector) * sector, b"\0"))
    n_fat = -(-(len(fat) + 2) // (sector // 4))
    fat_at = [len(sectors) + i for i in range(n_fat)]
    fat += [0xFFFFFFFD] * n_fat
    packed = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * sector, b"\xff")
    sectors += [packed[i * sector : (i + 1) * sector] for i in range(n_fat)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, sector.bit_length() - 1, 6) + bytes(10)
    head += struct.pack("<IIIIIIII", n_fat, directory, 0, 4096, mini_first, int(small), 0xFFFFFFFE, 0) + struct.pack("<109I", *(fat_at + [0xFFFFFFFF] * (109 - n_fat)))
    return head.ljust(512, b"\0") + b"".join(sectors)


PIECES = [("First paragraph\rCaf\xe9 ", True), ("и по-русски\r\x13 HYPERLINK x \x14link\x15 here\r", False), ("\r \rA\x07B c\x07\x07D\x07\x07last\x0bline\r", True)]
WANT = ["First paragraph", "Café и по-русски", "link here", "|A|B c|", "|D|", "last line"]


@pytest.mark.parametrize("small", [False, True])
def test_doc_paragraphs(small):
    assert list(doc.paragraphs(made_doc(PIECES, small=small))) == WANT


def test_long_doc():
    texts = [f"Абзац {i} " + "x" * (i % 90) for i in range(20_000)]
    assert list(doc.paragraphs(made_doc([("\r".join(texts) + "\r", False)]))) == [t.strip() for t in texts]


@pytest.mark.parametrize("data", [b"", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", made_doc(PIECES)[:2000]])
def test_damaged_doc_is_an_error(data):
    with pytest.raises(Exception):
        list(doc.paragraphs(data))


def test_files_become_blocks(spark):
    files = [("/in/a.pdf", sample()), ("/in/b.doc", made_doc(PIECES)), ("/in/c.pdf", sample()[:60]), ("/in/d.doc", b"x")]
    rows = read_blocks(spark.createDataFrame(files, "path string, content binary")).collect()
    by = lambda p: sorted((r for r in rows if r.path == p), key=lambda r: r.block_index or 0)
    assert [(r.kind, r.text) for r in by("/in/b.doc")] == [("text", t) for t in WANT]
    assert [r.kind for r in by("/in/a.pdf")] == ["text"] * 4 + ["image"] * 2 + ["text"] * 2 and [r.asset.src_page for r in by("/in/a.pdf") if r.asset] == [1, 1]
    assert all(len(by(p)) == 1 and by(p)[0].error for p in ("/in/c.pdf", "/in/d.doc"))
