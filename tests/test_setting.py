"""Type set in its space, colours of paper and ink, what tells two texts apart."""

import random

import numpy as np
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import colours, geometry
from quire.operators.reconcile import difference


def plain_lines(text, width):
    """Lines character by character."""
    lines, at, words = 1, 0.0, text.split(" ")
    for k, w in enumerate(words):
        size = sum(map(geometry.char_width, w))
        if k and at and at + 2 + size <= width:
            at += 2 + size
        elif size <= width:
            lines, at = lines + (at > 0), size
        else:
            lines, at = lines + (at > 0), 0
            for c in map(geometry.char_width, w):
                lines, at = (lines, at + c) if not at or at + c <= width else (lines + 1, c)
    return lines


def test_lines():
    r = random.Random(8)
    for _ in range(400):
        text = " ".join("".join(r.choice("abiMW中.É") for _ in range(r.choice([1, 2, 5, 9, 30]))) for _ in range(r.randrange(1, 25)))
        width = r.choice([1, 7, 8, 9, 16, 33.5, 60, 200, 5000])
        assert geometry.Setter(text).lines(width) == plain_lines(text, width), (text, width)


def test_sizes_are_found_by_halving(monkeypatch):
    """The size of the plain way down, in a few tries, and lines over those that fit are not counted."""
    r, tried, whole = random.Random(4), [], geometry.Setter.lines
    monkeypatch.setattr(geometry.Setter, "lines", lambda self, *a: tried.append(whole(self, *a)) or tried[-1])
    for n in [*range(0, 60), 20_000]:
        setter = geometry.Setter(" ".join("".join(r.choice("abiMW中.É") for _ in range(r.choice([1, 2, 5, 30]))) for _ in range(n)))
        size, width, room = r.choice([5.0, 12.0, 30.0, 90.0]), r.uniform(20, 500), r.uniform(1, 400)
        plain = max(6.5, min(72.0, size))
        while plain > 6.5 and whole(setter, width * 8 / plain) * plain * geometry.LINE > room:
            plain = max(6.5, plain - max(0.5, plain * 0.08))
        tried.clear()
        assert geometry.fitted(setter, size, width, room) == (plain, whole(setter, width * 8 / plain))
        assert len(tried) <= 8
    assert len([n for n in tried if n > 1000]) <= 1


def test_refit(spark):
    rows = [(1, "short", 12.0, 100.0, 20.0, 0.0), (2, "word " * 40, 12.0, 100.0, 20.0, 500.0), (3, "word " * 400, 72.5, 100.0, 20.0, 0.0), (4, None, 12.0, 100.0, 1.0, -5.0), (5, "  ", 99.0, 10.0, 100.0, 0.0), (6, "W" * 50, 10.0, 1.0, 1.0, 1.0), (7, "word " * 40, 12.0, 100.0, 20.0, 60.0)]
    df = spark.createDataFrame(rows, "id int, text string, size double, w double, h double, room double")
    got = {r["id"]: (round(r["r"]["size"], 4), r["r"]["n_lines"]) for r in df.select("id", geometry.refit(F.col("text"), F.col("size"), F.col("w"), F.col("h"), F.col("room")).alias("r")).collect()}
    assert got[1] == (12.0, 1) and got[2] == (12.0, 14) and got[3][0] == 6.5 and got[5] == (72.0, 1) and got[6] == (6.5, 50)
    assert got[4][0] == 6.5
    size = 12.0
    while geometry.Setter(("word " * 40).strip()).lines(800 / size) * size * geometry.LINE > 80:
        size = max(6.5, size - max(0.5, size * 0.08))
    assert 6.5 < got[7][0] < 12 and got[7][0] == round(size, 4)


def test_colours(spark):
    page = np.full((300, 200, 3), 250, np.uint8)
    page[50:60, 20:120] = 30  # ink
    page[60:62, 20:120] = 140  # its soft edge
    page[200:, :] = (10, 20, 90)
    image = page.tobytes()
    boxes = [(1, 0, 0, 200, 150), (2, 0, 210, 200, 300), (3, 0, 0, 1, 1), (4, -50, -9, 999, 40), (5, 150, 100, 120, 90)]
    df = spark.createDataFrame([(*b, image) for b in boxes] + [(6, 0, 0, 9, 9, None), (7, 0, 0, 9, 9, b"short")], "id int, x0 int, y0 int, x1 int, y1 int, image binary")
    got = {r["id"]: ([round(v * 255) for v in r["c"]["paper"]], [round(v * 255) for v in r["c"]["ink"]]) for r in df.select("id", colours.sample(F.col("image"), F.lit(200), F.lit(300), *[F.col(k) for k in ("x0", "y0", "x1", "y1")]).alias("c")).collect()}
    white, black = [255] * 3, [0] * 3
    assert got == {1: ([250] * 3, [30] * 3), 2: ([10, 20, 90], white), 3: (white, black), 4: ([250] * 3, black), 5: (white, black), 6: (white, black), 7: (white, black)}


def test_differing(spark):
    r = random.Random(4)
    rows = [("".join(r.choice("ab é") for _ in range(r.randrange(0, 12))), "".join(r.choice("ab é") for _ in range(r.randrange(0, 12)))) for _ in range(300)] + [("x" * 200_000, "x" * 100_000 + "y" + "x" * 100_000), ("", ""), ("same", "same"), ("aa", "aaa")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.differing(F.col("a"), F.col("b")).alias("d"), T.quoted_difference(F.col("a"), F.col("b")).alias("q")).collect()
    for x in got:
        a, b = x["a"], x["b"]
        head = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        tail = next((i for i, (p, q) in enumerate(zip(a[head:][::-1], b[head:][::-1], strict=False)) if p != q), min(len(a), len(b)) - head)
        assert (x["d"]["left"], x["d"]["right"]) == (a[head : len(a) - tail], b[head : len(b) - tail])
        assert x["q"] == difference(a, b)
