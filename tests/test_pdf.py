"""Pages of PDF files: plain and compressed objects, updates, damage, and what pages inherit."""

import zlib

import pytest
from pyspark.sql import functions as F

from quire.sources import pdf, tables


def told(data):
    return [tuple(map(int, p)) for p in pdf.File(data).pages()]


def wanted(n, turned=90):
    return [(500 if k % 5 == 0 else 600, 800, turned if k // 5 % 2 else 0) for k in range(n)]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("n", [0, 1, 5, 6, 23, 300])
def test_trees(packed, n):
    whole = pdf.made(n, packed, 90)
    assert told(whole) == wanted(n)
    assert told(whole[: whole.rindex(b"startxref")]) == wanted(n)
    assert told(whole.replace(b"startxref\n", b"startxref\n9")) == wanted(n)
    assert told(b"junk before\n" + whole) == wanted(n)


def test_updates_and_cycles():
    base = pdf.made(3, False)
    at = len(base)
    new = base + b"4 0 obj\n<< /Type /Page /Parent 3 0 R /MediaBox [0 0 10 20.5] /Rotate -90 >>\nendobj\n"
    table = len(new)
    old = int(base[base.rindex(b"startxref") + 9 :].split()[0])
    new += b"xref\n4 1\n%010d 00000 n \ntrailer\n<< /Size 7 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, old, table)
    assert told(new) == [(10, 20, 270), (600, 800, 0), (600, 800, 0)]
    ring = base.replace(b"/Kids [4 0 R 5 0 R 6 0 R]", b"/Kids [4 0 R 3 0 R 2 0 R]")
    assert told(ring) == [(500, 800, 0)]


def test_no_pages(spark):
    locked = b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 9 0 R >>\nendobj\ntrailer\n<< /Root 1 0 R /Encrypt 5 0 R >>\n"
    bomb = pdf.made(2, True).replace(b"/N 4", b"/N 9999999")
    files = [("a.pdf", pdf.made(7, True)), ("b.pdf", b""), ("c.pdf", None), ("d.pdf", locked), ("e.pdf", b"%PDF /Type /Page >> [[[[" + b"[" * 5000), ("f.pdf", zlib.compress(b"x")), ("g.pdf", bomb)]
    df = spark.createDataFrame([(k, "pdf", None, 1, v) for k, v in files], "path string, kind string, error string, length long, content binary")
    got = {r["path"]: (r["n_pages"], r["error"]) for r in tables.opened(df).collect()}
    assert got["a.pdf"] == (7, None) and got["b.pdf"] == (0, "no pages") and got["c.pdf"] == (0, "no pages") and got["d.pdf"] == (0, "encrypted") and got["e.pdf"] == (1, None) and got["f.pdf"] == (0, "no pages")
    rows = pdf.pages(df.withColumn("page", F.lit("clash"))).where("path = 'a.pdf'").sort("page").collect()
    assert [(r["page"], r["n_pages"], r["width"]) for r in rows] == [(k, 7, 500.0 if k % 5 == 0 else 600.0) for k in range(7)]


def test_calls_a_page():
    """A page takes few calls, whatever stands in its object."""
    import sys

    calls = [0]
    data = pdf.made(200, False)
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event == "call")))
    try:
        n = len(list(pdf.File(data).pages()))
    finally:
        sys.setprofile(None)
    assert n == 200 and calls[0] < 20 * n


def test_values():
    deep = b"[" * 65 + b"]" * 65
    assert pdf.value(deep, 0)[1] == len(deep)
    with pytest.raises(pdf.Damaged):
        pdf.value(b"[" + deep + b"]", 0)
    for bad in (b"<< /A >>", b"[ >>", b"<< ]", b">>", b"", b"% /A", b"{", b"(a"):
        with pytest.raises(pdf.Damaged):
            pdf.value(bad, 0)
    assert pdf.value(b"<< /A%x /B\n(a(b)\\)c) /B#41 [1 0 R 1 0 Rx -3.5 <41>]>> z", 0) == ({b"/A": b"a(b)\\)c", b"/BA": [pdf.Ref(1), 1, 0, b"Rx", -3.5, b"41"]}, 53)
