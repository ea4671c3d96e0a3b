"""Near-duplicate texts of a group, by both ways, against comparing all of them in order."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import repeats
from quire.operators.reconcile import text_similarity

ROWS = "doc string, page int, ord int, text string"


def edited(r, t, share):
    out = list(t)
    for _ in range(int(len(t) * share)):
        at, what = r.randrange(len(out) + 1), r.choice("xé ")
        out[at : at + r.choice([0, 1])] = [what] if r.random() < 0.7 else []
    return "".join(out)


def rows(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé. ") for _ in range(n)) for n in (0, 1, 5, 9, 10, 11, 12, 18, 19, 20, 28, 29, 50, 63, 64, 65, 99, 100, 200, 700, 1999, 2300)]
    out = []
    for doc in ("a", "b", None):
        for page in (0, 1, None):
            for n in range(70):
                t = r.choice(base)
                out.append((doc, page, r.choice([n, n, 7]), r.choice([t, edited(r, t, 0.02), edited(r, t, 0.09), edited(r, t, 0.12), None if n % 20 == 0 else t[:2000]])))
    return out + out[:30]


def plain(given):
    import hashlib

    groups = {}
    for doc, page, n, t in given:
        t = t or ""
        groups.setdefault((doc, page), set()).add((n, hashlib.md5(t[:2000].encode()).hexdigest(), t))
    out = []
    for key, texts in groups.items():
        first = {}
        for n, i, t in texts:
            first[i] = min(first.get(i, (n, t)), (n, t))
        kept = []
        for n, _, t in sorted((n, i, t) for i, (n, t) in first.items()):
            if not any(text_similarity(k, t) > 0.9 for _, k in kept):
                kept.append((n, t))
        out += [(*key, *k) for k in kept]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [0, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_kept_first(spark, seed, small):
    given = rows(seed)
    df = spark.createDataFrame(given, ROWS).withColumns({"id": F.lit("clash"), "place": F.lit(1), "n": F.lit(2), "a": F.lit(3)})
    got = sorted(map(tuple, repeats.kept_first(df, ["doc", "page"], small=small).collect()), key=repr)
    assert got == plain(given)


def test_kept_first_of_nothing(spark):
    assert repeats.kept_first(spark.createDataFrame([], ROWS), ["doc", "page"]).collect() == []


def test_chains_are_settled_in_order(spark):
    """a is like b and b like c, but a not like c: c stays, since b went."""
    a = "0123456789" * 10
    b, c = "#" * 6 + a[6:], "#" * 12 + a[12:]
    df = spark.createDataFrame([("d", 0, i, t) for i, t in enumerate((a, b, c))], ROWS)
    for small in (0, 9):
        assert sorted(r["ord"] for r in repeats.kept_first(df, ["doc", "page"], small=small).collect()) == [0, 2]


def test_unlike_texts_need_no_distance(monkeypatch):
    """Only texts that share most of their pieces are compared, and none that are similar is missed."""
    r, worked = random.Random(12), []
    monkeypatch.setattr(repeats, "text_similarity", lambda a, b: worked.append(1) or text_similarity(a, b))
    base = ["".join(r.choice("etaoin shrdlu") for _ in range(n)) for n in (0, 4, 9, 10, 11, 19, 20, 21, 49, 50, 51, 100, 101, 300, 300, 300)]
    texts = base + [edited(r, t, s) for t in base for s in (0.02, 0.07, 0.09, 0.1, 0.11, 0.15) for _ in range(6)]
    pairs = [(a, b) for a in base for b in texts]
    assert [repeats.repeats_one([a], b) for a, b in pairs] == [text_similarity(a, b) > 0.9 for a, b in pairs]
    worked.clear()
    assert not repeats.repeats_one([t for t in base if len(t) == 300][:2], "".join(r.choice("etaoin shrdlu") for _ in range(300))) and not worked


def test_groups_stay_together_where_a_join_becomes_a_broadcast(spark):
    """The join with the large groups is planned by shuffle and becomes a broadcast as it runs; small groups stay in one task each."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        r = random.Random(4)
        base = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1500)) for _ in range(40)]
        given = [(f"d{d}", 0, i, "#" * i + t[i:]) for d, t in enumerate(base) for i in range(3)] + [("large", 0, i, f"{i}" * 9) for i in range(9)]
        got = sorted(map(tuple, repeats.kept_first(spark.createDataFrame(given, ROWS), ["doc", "page"], small=5).collect()), key=repr)
        assert got == plain(given) and len(got) == 49
    finally:
        for k in held:
            spark.conf.unset(k)
