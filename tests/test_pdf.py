"""PDF files made by hand: fonts, filters, forms, object streams, outlines, damage."""

import base64
import zlib

import pytest

from kbspark.sources import files, pdf


def made(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R") -> bytes:
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer\n<<" + trailer + b">>\nstartxref\n0\n%%EOF\n"


def stream(data: bytes, head: bytes = b"") -> bytes:
    return b"<</Length %d %s>>\nstream\n%s\nendstream" % (len(data), head, data)


FONT = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"


def paged(*contents: bytes, extra: dict[int, bytes] | None = None, root: bytes = b"", font: bytes = FONT) -> bytes:
    """Pages 10, 12, ... with their contents at 11, 13, ..., below one node that holds the font."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    objects = {1: b"<</Type/Catalog/Pages 2 0 R" + root + b">>", 2: b"<</Type/Pages/Kids[" + kids + b"]/MediaBox[0 0 600 800]/Resources<</Font<</F1 3 0 R>>/XObject<</X 5 0 R>>>>>>", 3: font}
    for i, c in enumerate(contents):
        objects |= {10 + 2 * i: b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * i), 11 + 2 * i: c}
    return made(objects | (extra or {}))


def test_values():
    data = rb"<</A[1 -.5 true null 2 0 R]/B#20c(a\(b\)\051\n(c)\
d)%x" + b"\n/C<4 1 4>>>"
    assert pdf.value(data)[0] == {"A": [1, -0.5, True, None, pdf.Ref(2, 0)], "B c": b"a(b))\n(c)d", "C": b"A@"}
    for broken in (b"", b"(a", b"[1", b"<</A"):
        with pytest.raises(EOFError):
            pdf.value(broken)


def test_text_operators():
    page = b"BT /F1 10 Tf 50 700 Td (Hello) Tj 100 0 Td (there) Tj 0 -20 TD (next) Tj T* [(kern)-30(ed)-600(word)] TJ (quoted) ' ET BI /W 1 ID (no) Tj EI BT 1 0 0 1 50 100 Tm (last) Tj ET"
    assert [x.text for x in pdf.page_lines(paged(stream(page)))[0]] == ["Hello there", "next", "kerned word", "quoted", "last"]
    first = pdf.page_lines(paged(stream(page)))[0][0]
    assert (first.x0, first.top, first.size) == (50, 100, 10)
    scaled = pdf.page_lines(paged(stream(b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 5 Td (x) Tj ET Q BT /F1 8 Tf (y) Tj ET")))[0]
    assert [(x.x0, x.top, x.size) for x in scaled] == [(20, 770, 20), (0, 800, 8)]
    assert pdf.page_lines(paged(stream(b"Tj ET 5 Tf BT /F9 3 Tf (no font) Tj /F1 3 Tf Tj [ (open) Tj"))) == [[]]


@pytest.mark.parametrize("name, packed", [
    (b"/FlateDecode", zlib.compress), (b"/Fl", zlib.compress), (b"/ASCIIHexDecode", lambda d: d.hex().encode() + b">"), (b"/ASCII85Decode", lambda d: base64.a85encode(d) + b"~>"),
    (b"[/A85 /Fl]", lambda d: base64.a85encode(zlib.compress(d)) + b"~>"), (b"/RunLengthDecode", lambda d: b"".join(bytes([len(d[i : i + 100]) - 1]) + d[i : i + 100] for i in range(0, len(d), 100)) + b"\x80"),
])
def test_filters(name, packed):
    page = b"BT /F1 10 Tf " + b"".join(b"1 0 0 1 0 %d Tm (line %d) Tj " % (700 - 12 * i, i) for i in range(20)) + b"ET"
    assert pdf.pdf_text(paged(stream(packed(page), b"/Filter " + name))) == "\n".join(f"line {i}" for i in range(20))


def lzw(data: bytes) -> bytes:
    """Plain encoder: a clear code first, then the longest known words."""
    table, bits, n, width = {bytes([i]): i for i in range(256)}, 0, 0, 9

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width

    put(256)
    size, word = 258, b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = size
        size += 1
        width = max(9, size.bit_length())
        word = c
    put(table[word])
    size += 1
    width = max(9, size.bit_length())
    put(257)
    return (bits << -n % 8).to_bytes((n + 7) // 8, "big")


def test_lzw():
    data = b"".join(b"%d-%d " % (i, i * i) for i in range(400))
    assert pdf._expanded(lzw(data), 1) == data
    with pytest.raises(ValueError):
        pdf._expanded(b"\xff\xff\xff", 1)


def test_predictors():
    rows = [bytes([1, 2, 3, 4]), bytes([5, 7, 9, 200])]
    up = b"\x02" + rows[0] + b"\x02" + bytes((b - a) & 255 for a, b in zip(*rows))
    left = b"".join(b"\x01" + bytes((r[k] - (r[k - 1] if k else 0)) & 255 for k in range(4)) for r in rows)
    for packed in (up, left, b"\0" + rows[0] + b"\0" + rows[1]):
        assert pdf._unpredicted(packed, {"Predictor": 12, "Columns": 4}) == b"".join(rows)


def test_fonts():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <4E2D> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079>] endbfrange"
    wide = b"<</Subtype/Type0/Encoding/Identity-H/DescendantFonts[<</DW 500/W[1[900 800] 16 18 400]>>]/ToUnicode 5 0 R>>"
    page = stream(b"BT /F1 10 Tf <00010002001000110012002000210099> Tj ET")
    line = pdf.page_lines(paged(page, font=wide, extra={5: stream(cmap)}))[0][0]
    assert line.text == "中fiabcxy" and line.x1 == pytest.approx(9 + 8 + 3 * 4 + 3 * 5)
    named = b"<</Subtype/Type1/Encoding<</Differences[65/eacute/fi/uni20AC 97/odd/Zcaron.sc]>>>>"
    assert pdf.pdf_text(paged(stream(b"BT /F1 10 Tf (ABCDabz) Tj ET"), font=named)) == "éfi€DŽz"
    assert pdf.pdf_text(paged(stream(b"BT /F1 10 Tf (caf\\351 \\200) Tj ET"))) == "café €"


def test_forms_and_structure():
    form = stream(b"BT /F1 10 Tf (in a form) Tj ET /X Do", b"/Type/XObject/Subtype/Form/Matrix[1 0 0 1 0 500]/Resources<</Font<</F1 3 0 R>>/XObject<</X 5 0 R>>>>")
    assert pdf.pdf_text(paged(stream(b"/X Do"), extra={5: form})) == "in a form"
    text = lambda s: stream(b"BT /F1 10 Tf (" + s + b") Tj ET")
    assert pdf.pdf_text(paged(text(b"one"), text(b""), stream(b"x", b"/Filter/JPXDecode"), text(b"two"))) == "one\n\ntwo"
    later = paged(text(b"old")) + b"11 0 obj\n" + text(b"new") + b"\nendobj\n"
    assert pdf.pdf_text(later) == "new"
    # objects and root in compressed streams, contents of unknown length
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Kids[4 0 R 2 0 R]>>"), (3, FONT), (4, b"<</Type/Page/Contents[6 0 R]/Resources<</Font<</F1 3 0 R>>>>>>")]
    places, at = b"", 0
    for n, x in inner:
        places += b"%d %d " % (n, at)
        at += len(x) + 1
    packed = zlib.compress(places + b" ".join(x for _, x in inner))
    data = b"%%PDF-1.5\n6 0 obj\n<</Length 99 0 R>>stream\nBT /F1 9 Tf (deep) Tj ET\nendstream endobj\n7 0 obj\n%s\nendobj\n8 0 obj\n%s\nendobj\n" % (stream(packed, b"/Type/ObjStm/Filter/FlateDecode/N 4/First %d" % len(places)), stream(b"", b"/Type/XRef/Root 1 0 R"))
    assert pdf.pdf_text(data) == "deep"


def test_outlines():
    items = {
        20: b"<</First 21 0 R>>", 21: b"<</Title(One)/Dest[10 0 R/Fit]/First 22 0 R/Next 23 0 R>>", 22: b"<</Title<FEFF4E2D>/A<</S/GoTo/D(here)>>/Next 25 0 R>>",
        23: b"<</Title(Two)/Dest/old/Next 24 0 R>>", 24: b"<</Title(Nowhere)/A<</S/URI>>/Next 21 0 R>>", 25: b"<</Title(By number)/Dest[1/Fit]>>", 26: b"<</Kids[<</Names[(here)<</D[12 0 R/Fit]>>]>>]>>",
    }
    data = paged(stream(b""), stream(b""), extra=items, root=b"/Outlines 20 0 R/Dests<</old[12 0 R/Fit]>>/Names<</Dests 26 0 R>>")
    assert pdf.pdf_outline(data) == [("One", 0, 1), ("中", 1, 2), ("By number", 1, 2), ("Two", 0, 2), ("Nowhere", 0, 0)]
    assert pdf.pdf_outline(b"no") == [] and pdf.pdf_outline(paged(stream(b""))) == []


def test_damage():
    whole = paged(stream(zlib.compress(b"BT /F1 10 Tf (text) Tj ET"), b"/Filter/FlateDecode"))
    for broken in (b"", b"%PDF", b"1 0 obj", made({1: b"<</Type/Catalog>>"}), made({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"[1"}, b"/Root 1 0 R/Encrypt 9 0 R"), b"[" * 5000, b"1 0 obj " + b"[" * 5000):
        with pytest.raises(ValueError):
            pdf.pdf_text(broken)
    for cut in range(0, len(whole), 7):
        try:
            assert pdf.pdf_text(whole[:cut]) in ("", "text")
        except files.UNREADABLE:
            pass


def test_tables(spark):
    page = b"BT /F1 20 Tf 50 700 Td (1. Part) Tj /F1 10 Tf 0 -30 Td (body text) Tj 0 -12 Td (more) Tj /F1 16 Tf 0 -30 Td (Loose title) Tj /F1 10 Tf 0 -12 Td (end) Tj ET"
    data = paged(stream(page), extra={20: b"<</First 21 0 R>>", 21: b"<</Title(Part)/Dest[10 0 R/Fit]/Next 22 0 R>>", 22: b"<</Title(Absent)/Dest[10 0 R/Fit]>>"}, root=b"/Outlines 20 0 R")
    from kbspark.operators import ingest

    df = spark.createDataFrame([("a.pdf", data), ("b.pdf", b"%PDF"), ("c.pdf", None)], "path string, content binary")
    boxes, outlines = pdf.boxes(df), pdf.outlines(df)
    assert [(r.page, r.seq, r.top, r.size, r.text) for r in boxes.orderBy("seq").collect()][:2] == [(1, 0, 100, 20, "1. Part"), (1, 1, 130, 10, "body text")]
    assert [tuple(r) for r in outlines.orderBy("ord").collect()] == [("a.pdf", 0, "Part", 0, 1), ("a.pdf", 1, "Absent", 0, 1)]
    got = ingest.pdf_sections(boxes, outlines).orderBy("page", "top", "text").collect()
    assert [(r.kind, r.level, r.text, r.source) for r in got] == [("heading", 0, "Absent", "outline"), ("heading", 0, "Part", "outline"), ("paragraph", None, "body text", "box"), ("paragraph", None, "more", "box"), ("heading", 0, "Loose title", "box"), ("paragraph", None, "end", "box")]
    assert got[0].top == -1 and got[1].top == 100
