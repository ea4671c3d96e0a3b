"""Alignment against the full table: random pages, long readings, and the table's conversations."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import reconcile
from quire.operators.reconcile import FLOOR, GAP, MERGED, text_similarity
from quire.plans import queries

SF = os.environ.get("QUIRE_TEST_SF", "/root/testdata/sf0.001")
WORDS = "the quick brown fox jumps over lazy dog seven wizards quietly box many jars red ink near old stone bridges".split()


def full(left, right):
    """The whole table, every move scored."""
    rows, cols = len(left), len(right)
    best, came = {(0, 0): 0.0}, {}
    for i in range(rows + 1):
        for j in range(cols + 1):
            moves = [(1, 0), (0, 1), *((1, k) for k in range(1, MERGED + 1)), *((k, 1) for k in range(2, MERGED + 1))]
            for a, b in moves:
                if a > i or b > j:
                    continue
                earned = text_similarity("".join(left[i - a : i])[:2000], "".join(right[j - b : j])[:2000]) - FLOOR if a and b else GAP
                if (i, j) not in came or best[i - a, j - b] + earned > best[i, j]:
                    best[i, j], came[i, j] = best[i - a, j - b] + earned, (a, b)
    out, i, j = [], rows, cols
    while i or j:
        a, b = came[i, j]
        s = text_similarity("".join(left[i - a : i])[:2000], "".join(right[j - b : j])[:2000]) if a and b else 0.0
        out.append((range(i - a, i), range(j - b, j), s))
        i, j = i - a, j - b
    return out[::-1]


def sentence(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 14))) + r.choice([". ", ""])


def other_reading(r, texts):
    out = []
    for x in texts:
        k = r.random()
        if k < 0.1:
            continue
        if k < 0.2:
            out.append(sentence(r))
        if k < 0.5:
            x = "".join(c if r.random() > 0.05 else r.choice("xyz") for c in x)
        if k > 0.8 and out:
            out[-1] += x
        elif k > 0.7:
            out += [x[: len(x) // 2], x[len(x) // 2 :]]
        else:
            out.append(x)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_random_pages(seed):
    r = random.Random(seed)
    left = [sentence(r) for _ in range(r.randrange(0, 11))]
    right = [sentence(r) for _ in range(r.randrange(0, 9))] if seed % 5 == 0 else other_reading(r, left)
    if seed % 7 == 0:
        left, right = left + left[:2], [*right, "", ""]
    assert reconcile.align_texts(left, right) == full(left, right)


def test_long_readings_take_few_cells():
    r = random.Random(3)
    left = [" ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(8)) for _ in range(150)]
    right = [x for i, t in enumerate(left) if i % 40 for x in ([t] if i % 9 else [t[:20], t[20:]])]
    assert reconcile.align_texts(left[:40], right[:42]) == full(left[:40], right[:42])
    table = reconcile._Aligner(left, right)
    least, _ = table.run(float("-inf"), reconcile._band(left, right))
    best, came = table.run(least, None)
    assert best == least and len(came) < len(left) * len(right) / 8


def test_one_against_many():
    six = ["One of the six sentences here. ", "Another one of them follows. ", "The third is short. ", "A fourth one goes on for longer. ", "And the fifth. ", "The last one of all ends it."]
    for a, b in ((["".join(six)], six), (six, ["".join(six)])):
        assert reconcile.align_texts(a, b) == [(range(len(a)), range(len(b)), 1.0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_conversations(spark):
    got = {}
    for r in queries.align_conversations(spark, SF).collect():
        got.setdefault(r["conv_id"], []).append((r["pair"], r["left_text"], r["right_text"], r["n_left"], r["n_right"], round(r["similarity"], 9)))
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").sort("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append(r["text"])
    assert got.keys() == turns.keys()
    for c in sorted(turns)[:25]:
        cut = [x for t in turns[c] for x in t.split("\n")]
        want = [(n, "".join(turns[c][i] for i in p), "".join(cut[j] for j in q), len(p), len(q), round(s, 9)) for n, (p, q, s) in enumerate(full(turns[c], cut))]
        assert sorted(got[c]) == want
    assert any(x[4] > 1 for rows in got.values() for x in rows)


def test_texts_longer_than_what_is_compared():
    r = random.Random(5)
    left = ["".join(sentence(r) for _ in range(n)) for n in (1, 60, 2, 50)] + ["", "short"]
    right = [x[i : i + 700] for x in left for i in range(0, len(x) or 1, 700)] + ["é" * 2100]
    assert reconcile.align_texts(left, right) == full(left, right)
    assert reconcile.align_texts(right, left) == full(right, left)


def test_a_text_and_its_parts_take_one_pass(monkeypatch):
    """The characters that distances step over: a text meets one to eight others in one pass, and is not read again for each."""
    r = random.Random(7)
    left = ["".join(r.choice("etaoin shrdlu") for _ in range(400)) for _ in range(8)]
    right = ["".join(c if r.random() > 0.3 else r.choice("xyz") for c in t[i : i + 50]) for t in left for i in range(0, 400, 50)]
    steps = []
    whole = reconcile._distance
    monkeypatch.setattr(reconcile, "_distance", lambda a, b: steps.append(max(len(a), len(b))) or whole(a, b))
    table = reconcile._Aligner(left, right)
    table.run(table.run(float("-inf"), reconcile._band(left, right))[0], None)
    assert sum(steps) < 20_000


def test_groups_are_spread_over_tasks(spark):
    rows = [(g, i, t) for g in range(40) for i, t in enumerate(("a few words", "and some more"))]
    a, b = (spark.createDataFrame(rows, "g int, ord int, text string") for _ in range(2))
    assert reconcile.align(a, b, ["g"]).select(F.spark_partition_id()).distinct().count() > 1


def test_tables_are_aligned_by_whole_texts(spark):
    """What differs beyond the first two thousand characters counts, in one text and in several joined."""
    r = random.Random(9)
    a, b, c = ("".join(sentence(r) for _ in range(120)) for _ in range(3))
    left = [a[:2100] + b[:2000], c[:3000]]
    right = [a[:2100] + "#" * 2000, c[:700], c[700:1500], c[1500:2300]]
    t = [spark.createDataFrame([(1, i, x) for i, x in enumerate(side)], "g int, ord int, text string") for side in (left, right)]
    got = [(x["n_left"], x["n_right"], x["similarity"]) for x in reconcile.align(*t, ["g"]).sort("pair").collect()]
    distance = lambda x, y: 1 - reconcile._distance(x, y) / max(len(x), len(y))
    assert got == [(1, 1, distance(left[0], right[0])), (1, 3, distance(left[1], c[:2300]))] and 0.4 < got[0][2] < 0.6


@pytest.mark.parametrize("seed", range(6))
def test_whole_texts_against_the_full_table(seed):
    """Whole texts of several thousand characters, against every move scored on whole texts."""
    r = random.Random(100 + seed)
    left = ["".join(sentence(r) for _ in range(n)) for n in (1, 60, 70, 2, 50)] + ["", "short"]
    right = other_reading(r, left) if seed % 2 else [x[i : i + 900] for x in left for i in range(0, len(x) or 1, 900)]
    whole = {}

    def similar(x, y):
        if (x, y) not in whole:
            whole[x, y] = float(x == y) if not x or not y or x == y else 1 - reconcile._distance(x, y) / max(len(x), len(y))
        return whole[x, y]

    best, came = {(0, 0): 0.0}, {}
    for i in range(len(left) + 1):
        for j in range(len(right) + 1):
            for a, b in [(1, 0), (0, 1), *((1, k) for k in range(1, MERGED + 1)), *((k, 1) for k in range(2, MERGED + 1))]:
                if a <= i and b <= j:
                    earned = similar("".join(left[i - a : i]), "".join(right[j - b : j])) - FLOOR if a and b else GAP
                    if (i, j) not in came or best[i - a, j - b] + earned > best[i, j]:
                        best[i, j], came[i, j] = best[i - a, j - b] + earned, (a, b)
    want, i, j = [], len(left), len(right)
    while i or j:
        a, b = came[i, j]
        want.append((range(i - a, i), range(j - b, j), similar("".join(left[i - a : i]), "".join(right[j - b : j])) if a and b else 0.0))
        i, j = i - a, j - b
    assert reconcile.align_texts(left, right, reconcile.WHOLE) == want[::-1]
