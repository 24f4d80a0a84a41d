import zlib

import pytest

from quire.sources import files, pdf


def build(pages, outline=(), packed=False, title=None):
    """A PDF file of pages given as programs; fonts F1 (plain) and F2 (two bytes a letter, with a map to Unicode)."""
    objects = {}
    kids = []
    cmap = b"1 beginbfchar <0001> <7B2C> endbfchar 2 beginbfrange <0002> <0003> <4E00> <0004> <0005> [<7AE0> <0041>] endbfrange"
    objects[3] = b"<< /Type /Font /Subtype /TrueType /BaseFont /Some#2DBold /FirstChar 65 /Widths [600 700] >>"
    objects[4] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Wide /ToUnicode 5 0 R >>"
    objects[5] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    n = 10
    for program in pages:
        body = zlib.compress(program)
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (n + 1)
        objects[n + 1] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(body), body)
        kids.append(n)
        n += 2
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    root = b"<< /Type /Catalog /Pages 2 0 R"
    if outline:
        root += b" /Outlines 6 0 R /Names << /Dests << /Kids [7 0 R] >> >>"
        objects[6] = b"<< /First %d 0 R >>" % n
        objects[7] = b"<< /Names [(last) [%d 0 R /Fit]] >>" % kids[-1]
        for k, (said, to) in enumerate(outline):
            following = b" /Next %d 0 R" % (n + k + 1) if k + 1 < len(outline) else b""
            where = b"/Dest [%d 0 R /XYZ 0 0 0]" % kids[to] if isinstance(to, int) else b"/A << /S /GoTo /D (%s) >>" % to.encode()
            objects[n + k] = b"<< /Title <FEFF%s> %s%s >>" % (said.encode("utf-16-be").hex().encode(), where, following)
    objects[1] = root + b" >>"
    out = b"%PDF-1.7\n% a comment\n"
    if packed:  # all but streams in one compressed object
        plain = {k: v for k, v in objects.items() if b"stream" not in v}
        heads, bodies, at = b"", b"", 0
        for k, v in plain.items():
            heads += b"%d %d " % (k, at)
            bodies += v + b" "
            at = len(bodies)
        body = zlib.compress(heads + bodies)
        out += b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (len(plain), len(heads), len(body), body)
        objects = {k: v for k, v in objects.items() if k not in plain}
    for k, v in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    info = b" /Info << /Title (%s) >>" % title if title else b""
    return out + b"trailer << /Root 1 0 R%s >>\n%%%%EOF" % info


PAGE = rb"BT /F1 20 Tf 1 0 0 1 72 700 Tm (Chapter 1 A\(b\)\101) Tj /F1 10 Tf 0 -30 Td [(AB) -300 (C)] TJ 12 TL T* (next) Tj ET q 2 0 0 2 0 0 cm BT /F2 9 Tf 36 100 Td <0001000200040005> Tj ET Q"


@pytest.mark.parametrize("packed", [False, True])
def test_items(packed):
    p = pdf.Pdf(build([PAGE, b"BT /F1 11 Tf 72 700 Td (two) ' ET"], packed=packed, title=b"A title"))
    got = list(p.items(p.pages[0][1]))
    assert [(g[0], g[1], g[2], g[5]) for g in got] == [("Chapter 1 A(b)A", 72, 700, 20), ("AB C", 72, 670, 10), ("next", 72, 658, 10), ("第一章A", 72, 200, 18)]
    assert got[0][4] == "Some-Bold" and got[1][3] == pytest.approx((0.6 + 0.7 + 0.3 + 0.5) * 10)
    assert [i[0] for i in p.items(p.pages[1][1])] == ["two"] and p.title() == "A title" and len(p.pages) == 2


def test_outline():
    p = pdf.Pdf(build([PAGE, PAGE, PAGE], [("第一章 绪论", 1), ("Chapter 2", "last"), ("nowhere", "gone")]))
    assert list(p.outline()) == [("第一章 绪论", 2), ("Chapter 2", 3)]


def test_broken_files():
    with pytest.raises(ValueError, match="not a PDF"):
        pdf.Pdf(b"hello")
    with pytest.raises(ValueError, match="encrypted"):
        pdf.Pdf(build([PAGE]).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 8 0 R"))
    assert pdf.Pdf(b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [2 0 R] >> endobj").pages == []
    cut = build([PAGE])
    for k in range(0, len(cut), 7):
        pdf.Pdf(cut[: max(9, k)])


def test_chapters_of_a_file(spark, tmp_path):
    body = b" ".join(b"(Body line %d of the page.) Tj 0 -14 Td" % k for k in range(20))
    page = lambda head: b"BT /F1 18 Tf 72 720 Td (" + head + b") Tj 0 -40 Td /F1 10 Tf " + body + b" ET"
    (tmp_path / "book.pdf").write_bytes(build([page(b"Preface"), page(b"Chapter 1 Cells"), page(b"Chapter 2 Blood")], [("Chapter 1 Cells", 1), ("Chapter 2 Blood", 2)]))
    found = files.read_files(spark, str(tmp_path / "book.pdf"))
    got = files.pdf_chapters(pdf.text_items(found)).orderBy("segment").collect()
    assert [(r["title"], r["page_start"], r["page_end"]) for r in got] == [("全文", 1, 1), ("Chapter 1 Cells", 2, 2), ("Chapter 2 Blood", 3, 3)]
    assert [(r["title"], r["page"], r["pages"]) for r in pdf.outlines(found).orderBy("page").collect()] == [("Chapter 1 Cells", 2, 3), ("Chapter 2 Blood", 3, 3)]
    assert pdf.titles(found).first()["pages"] == 3
    assert files.pdf_titles(pdf.text_items(found)).first()["title"] == "Preface"
    (tmp_path / "plain.pdf").write_bytes(build([page(b"Chapter 9 Alone")]))
    both = files.read_files(spark, str(tmp_path / "*.pdf"))
    cut = files.pdf_chapters(pdf.text_items(both), pdf.outlines(both)).orderBy("doc", "segment").collect()
    assert [(r["doc"][-8:-4], r["title"], r["page_start"], r["page_end"], r["content"].count("Body line")) for r in cut] == [
        ("book", "前置内容", 1, 1, 17), ("book", "Chapter 1 Cells", 2, 2, 17), ("book", "Chapter 2 Blood", 3, 3, 17), ("lain", "Chapter 9 Alone", 1, 1, 20)
    ]
