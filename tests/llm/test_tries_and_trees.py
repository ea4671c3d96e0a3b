"""Prefix trie, Merkle manifest and token counts against plain versions and SQL, with nulls, ties, repeats and long texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from quire.llm import merkle, tokens, trie

TURNS = "conv_id long, turn long, role string, text string"


def answered(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_sql(sql, **tables):
    db = duckdb.connect()
    for name, frame in tables.items():
        db.register(name, frame)
    return sorted(((tuple(None if pd.isna(v) else v for v in r)) for r in db.sql(sql).fetchall()), key=repr)


# --- prefix trie -----------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [v[3:] for v in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        base, h = c - (abs(c) % 5) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        kids = [x for x in below if len(x) == len(k) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids), leaves, saved, digest))
    return sorted(out, key=repr)


def conversations(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in [*range(-23, n), 10_000, 10_004]:
        for t in range(r.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", None, ""]), r.choice(["ja", "nö", "", None, "ja"])))
    rows += rows[:9] + [(None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(700, t, "user", "long " * (t % 3)) for t in range(900)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit("clash"), "run": F.lit(3), "depth": F.lit("x")})
    got = answered(trie.digests(df))
    assert got == plain_trie(rows)
    assert got == by_sql(trie.ORACLE_SQL, conversations=pd.DataFrame(rows, columns=TURNS.replace(",", "").split()[::2]).astype({"conv_id": "Int64", "turn": "Int64"}))


def test_trie_of_one_and_none(spark):
    assert trie.digests(spark.createDataFrame([], TURNS)).collect() == []
    got = answered(trie.digests(spark.createDataFrame([(5, 0, "user", "")], TURNS)))
    assert got == plain_trie([(5, 0, "user", "")])


def test_trie_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(trie, "FAN", 2)
    monkeypatch.setattr(trie, "IDS", 8)
    rows = conversations(3) + [(c, t, "user", "the same") for c in range(20_000, 20_200, 5) for t in range(3)]
    assert answered(trie.digests(spark.createDataFrame(rows, TURNS))) == plain_trie(rows)


# --- Merkle manifest -------------------------------------------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for d, s, g, n, t in rows:
        bad = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
        leaf = [h("".join(map(said, (d, s, g, m, t)))) for m in (n, n + 1 if bad else n)]
        groups[g].append((d is not None, d or 0, leaf[0], leaf[1], d))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    trees = {g: tree([x[2] for x in sorted(v)]) for g, v in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for g, v in groups.items():
        for i, (_, _, leaf, altered, d) in enumerate(sorted(v)):
            proof, now = "", altered
            for levels, at in ((trees[g], i), (top, order.index(g))):
                for level in levels[:-1]:
                    beside = level[at ^ 1] if at ^ 1 < len(level) else ""
                    proof, now, at = proof + beside, h(beside + now if at & 1 else now + beside), at >> 1
            out.append((d, leaf, trees[g][-1][0], top[-1][0], h(proof), now, now == top[-1][0]))
    return sorted(out, key=repr)


def documents(n):
    r = random.Random(n)
    langs = ["en"] * 6 + ["de", "", None, "zz", "ñ", "_"]
    rows = [(r.choice([i, i, None]), r.choice(["a", "", None]), r.choice(langs), r.choice([i, None, 2**63 - 1]), r.choice(["text", "", None, "é" * i])) for i in range(n)]
    return rows + rows[:7] + [(10**6, None, "once", 3, "x" * 100_000)]


@pytest.mark.parametrize(("n", "band"), [(90, 1), (90, 2), (200, 3), (40, 10)])
def test_manifest(spark, n, band):
    rows = documents(n)
    df = spark.createDataFrame(rows, DOCS).withColumns({"pos": F.lit(1), "hash": F.lit("clash"), "level": F.lit("x"), "g": F.lit(0)})
    got = answered(merkle.manifest(df, band))
    assert got == plain_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_sql(spark):
    rows = [(d, s, g, min(n, 5000) if n is not None else None, t) for d, s, g, n, t in documents(80)]
    table = pd.DataFrame(rows, columns=DOCS.replace(",", "").split()[::2]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    assert answered(merkle.manifest(spark.createDataFrame(rows, DOCS))) == by_sql(merkle.ORACLE_SQL, documents=table)


def test_manifest_of_one_and_none(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
    one = [(7, "s", "en", 3, "abc")]
    assert answered(merkle.manifest(spark.createDataFrame(one, DOCS))) == plain_manifest(one)


# --- token counts ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=tokens.model_path())


def odd_texts():
    own = ["", " ", "a ", " a", "  ", "a  b ", "\n\nx", "x▁ y", "▁▁", "a ▁b", "日本語テキスト" * 9, "\0a b\0", "é x", " ́y", "<s> </s><unk>", "a\tb\t\tc   d", "aaaa" * 40, "🙂🙃 x🙂", "\n \n "]
    return own + [a + b for a in own for b in own] + ["x".join([a, b] * 9) for a in own for b in own]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_parts_add_up(library, size):
    texts = odd_texts()
    assert tokens.lengths(texts, tokens.model_path(), 100, size) == [len(x) for x in library.encode(texts)]


def test_counts(spark, library):
    r = random.Random(4)
    texts = [*odd_texts()[:300], None, "word " * 200_000, "unbroken" * 20_000, "".join(chr(r.randrange(32, 0x3000)) for _ in range(50_000))]
    rows = [(i if i % 50 else None, t, "clash") for i, t in enumerate(texts)] * 2
    got = sorted(map(tuple, tokens.counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()), key=repr)
    n = dict(zip(texts, (len(x) for x in library.encode([t or "" for t in texts])), strict=True))
    assert got == sorted(((d, len((t or "").encode()), n[t], n[t] > 4096) for d, t, _ in rows), key=repr)
    assert tokens.counts(spark.createDataFrame([], "doc_id int, text string")).collect() == []
