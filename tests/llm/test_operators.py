"""The training-data operators against brute force, on small inputs with nulls, blanks, ties and repeats."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import ann, chat, decontam, htmltext, langid, licenses, lm, packing, similar, simhash, urlfilter

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly box many jars of red ink near old stone bridges".split()


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    base = [text(r, 60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0].upper()), (22, base[1] + " extra"), (30, None), (31, ""), (32, " \n "), (33, "two words"), (33, "two words"), (None, base[2]), (40, text(r, 4000))]
    return spark.createDataFrame([(*x, "en", "src0", 0, "clash") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string")


def brute_fingerprint(t):
    w = [x.lower() for x in (t or "").split()]
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks():
    masks = np.array(simhash.covering_masks(4), np.uint64)
    assert len(masks) == 31
    r = random.Random(1)
    for at in itertools.chain(itertools.combinations(range(0, 64, 5), 4), (r.sample(range(64), 4) for _ in range(20000))):
        assert (masks & np.uint64(sum(1 << p for p in at)) == 0).any()


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least = {g: min((d for (d, _), k in zip(rows, group, strict=True) if k == g and d is not None), default=None) for g in group}
    return sorted(((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, group, strict=True)), key=repr)


def test_near_duplicates(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == brute_components(rows)


def test_large_buckets_are_split(spark):
    r = random.Random(2)
    hub = r.getrandbits(64)
    values = {hub} | {hub ^ sum(1 << p for p in r.sample(range(64), r.randrange(1, 9))) for _ in range(300)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")

    def parts(edges):
        group = {v: v for (v,) in signed}
        for a, b in edges:
            x, y = group[a], group[b]
            group = {k: x if g == y else g for k, g in group.items()}
        return {frozenset(k for k in group if group[k] == g) for g in group.values()}

    brute = [(a, b) for (a,), (b,) in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert parts((r["a"], r["b"]) for r in simhash.links(df, direct=8).collect()) == parts(brute)


def test_deduplicate(spark):
    r = random.Random(9)
    base, other = text(r, 200).split(), text(r, 200)
    edited = [" ".join("changed" if i in at else w for i, w in enumerate(base)) for at in ((10,), (10, 90), (150,))]
    rows = [(5, " ".join(base)), (3, edited[0]), (7, edited[1]), (8, edited[2]), (9, other), (9, other), (10, None), (11, ""), (None, "alone in the world of words")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, least int")
    got = similar.deduplicate(df)
    assert got.columns == ["doc_id", "text", "least"]
    assert sorted((r[0] for r in got.collect()), key=str) == [10, 3, 9, None]
    assert similar.deduplicate(df.limit(0)).count() == 0


def test_groups_are_exact(spark):
    """Groups against all pairs compared exactly: many edits about the border, and chains between followers."""
    r = random.Random(4)
    rows = []
    for base in (text(r, 200).split() for _ in range(4)):
        for _ in range(25):
            at = set(r.sample(range(len(base)), r.randrange(0, 9)))
            rows.append(" ".join(f"changed{r.random()}" if i in at else w for i, w in enumerate(base)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for hot, held in ((similar.HOT, similar.HELD), (8, 4000)):  # as they are, and with buckets dealt out and few sets held
        assert [x["least"] for x in similar.groups(df, hot, held).orderBy("doc_id").collect()] == group
    assert 4 < len(set(group)) < len(rows)


def test_packing(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d, *t.encode(x or "", add_special_tokens=False).ids, 1) for d, x in docs.where("doc_id is not null and doc_id <> 33").select("doc_id", "text").collect())
    rows = packing.pack(docs.coalesce(1), 64).collect()
    for d, *ids in want:
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1] and sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    by = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 64 or n & (n - 1) == 0 for n in by.values())


def test_differencing():
    r = random.Random(4)
    lengths = [r.randrange(1, 2048) for _ in range(60)]
    sets = packing.differenced(lengths, 8)
    assert sorted(i for s in sets for i in s) == list(range(60))
    sums = [sum(lengths[i] for i in s) for s in sets]
    assert max(sums) - min(sums) < 100
    for w in packing.windows(lengths, 2048):
        assert sum(lengths[i] for i in w) <= 2048
    assert len(packing.windows([1500, 1500, 1000], 2048)) == 3  # two would exceed the capacity
    with pytest.raises(ValueError):
        packing.windows([3000], 2048)


def test_packing_raises_the_window_count():
    """The query's path packs by windows(): no sequence is padded, each id lies in one piece, and the count does rise."""
    r = random.Random(7)
    risen = 0
    for n in (0, 1, 3, 40, 200):
        lengths = [r.choice([r.randrange(1, 64), r.randrange(40, 60), 200]) for _ in range(n)]
        p = packing._Packer(0, 64)
        for i, k in enumerate(lengths):
            p.add(i, np.arange(k, dtype="<u4"))
        p.close()
        at, full = {}, {}
        for d, start, length, _, tokens, seq, offset in p.rows:
            at.setdefault(d, []).append((start, length))
            assert tokens == lengths[d] and offset == full.get(seq, 0)
            full[seq] = offset + length
        for d, parts in at.items():
            assert [s for s, _ in sorted(parts)] == [0, *itertools.accumulate(k for _, k in sorted(parts))][:-1] and sum(k for _, k in parts) == lengths[d]
        assert len(at) == n and sum(full.values()) == sum(lengths) and all(k == 64 or k & (k - 1) == 0 for k in full.values())
        assert sum(k < 64 for k in full.values()) <= 6
        risen += any(len(packing.windows(lengths[i : i + 12], 64)) > -(-sum(lengths[i : i + 12]) // 64) for i in range(0, n - 12, 12) if max(lengths[i : i + 12]) <= 64)
    assert packing.windows([60, 60, 8], 64) and len(packing.windows([40, 40, 40], 64)) == 3  # two hold 120 but not uncut


def test_packing_of_a_table(spark):
    """Ids of a whole table against the tokenizers package."""
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.read.parquet(path)
    rows = packing.pack(df.union(df.limit(1)).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))).collect()
    want = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in df.select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in rows} == {*want, None}
    for r in rows:
        if r["doc_id"] is not None:
            ids = want[r["doc_id"]]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert packing.pack(df.limit(0)).count() == 0


def test_encoder():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(1)
    for _ in range(1000):
        x = "".join(r.choice(["a", "the", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "'s", "12", "!", "\xa0", "\x1c", "　", "你好", " x", "😀", "\r\n", "<|"]) for _ in range(r.randrange(14)))
        assert list(e(x)) == t.encode(x, add_special_tokens=False).ids


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.org/x", link.format("https://example.com/en/1")), (2, "http://b.org/y", '<meta http-equiv="refresh" content="0;url=http://a.org/x">'),
        (3, "http://c.org", link.format("/up")), (3, "http://c.org", link.format("/up")), (4, None, None), (5, "nothing", "x"), (6, "http://e.org/q?x=1#a", link.format("http://k.net/fr/")),
        (7, "HTTPS://X.Example.COM/en/", ""), (8, "http://f.org/", link.format("http://e.org/q?x=1") + '<meta http-equiv="refresh" content="0; url=https://www.example.com/en/2">'), (9, "http://g.org/a/b", link.format("http://z.net/es/1")), (10, "http://notexample.com/en/", ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, urlfilter.rule_table(spark, urlfilter.RULES)).collect()}
    assert got[1] == ("a.org", "/x", None, "block") and got[2][3] == "block" and got[3] == ("c.org", "", None, "allow")
    assert got[4] == ("", "", None, "allow") == got[5]
    assert got[6][3] == "allow" == got[8][3]  # an allowed address in the component comes first
    assert got[7] == ("x.example.com", "/en/", "example.com/en/", "block")
    assert got[9][3] == "block" and got[10] == ("notexample.com", "/en/", "com/", "allow")
    assert urlfilter.judge(df.limit(0), urlfilter.rule_table(spark, [])).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (None, x[0].tolist()), (7, x[7].tolist()), (2004, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df.where("vec_id % 100 = 0"), df, shard_rows=400).collect()
    ids, y = np.array([*range(1500), 2004]), np.concatenate([x, x[5:6]]).astype(np.float32).astype(float)
    hit = 0
    for q in range(0, 1500, 100):
        own = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [g["rank"] for g in own] == list(range(1, 11))
        assert all(abs(g["score"] - d[list(ids).index(g["vec_id"])]) < 1e-9 for g in own)
        hit += len({ids[i] for i in want} & {g["vec_id"] for g in own})
    assert hit / 150 >= 0.9 and {g["query_id"] for g in got} == set(range(0, 1500, 100))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_with_copies(spark):
    """Copies of a vector are found by the smallest ids whatever their number; few candidates are all returned."""
    r = np.random.default_rng(5)
    hot, x = r.normal(size=8), r.normal(size=(200, 8))
    rows = [(i, (hot if i % 3 == 0 else x[i % 200]).tolist()) for i in range(1200)] + [(5000, [1.0, 2.0]), (5001, [1.0, 2.0]), (5002, [4.0, 6.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df.where("vec_id % 100 = 0"), df, shard_rows=60).collect()
    y = np.array([v for _, v in rows[:1200]], np.float32).astype(float)
    for q in range(0, 1200, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        want = [int(i) for i in np.lexsort((np.arange(1200), d)) if i != q][:10]
        own = [g["vec_id"] for g in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])]
        assert q % 3 and len(set(own) & set(want)) >= 9 or own == want
    few = sorted((g["rank"], g["vec_id"], g["score"]) for g in got if g["query_id"] == 5000)
    assert few == [(1, 5001, 0.0), (2, 5002, 5.0)]


def test_short_items_are_compared_whole(spark):
    docs = spark.createDataFrame([(1, "Forty two!"), (2, "forty two"), (3, "it is forty two"), (4, "yes"), (5, "forty"), (6, "..."), (7, None), (8, "no item"), (2, "forty two")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "forty two"), (11, "Yes."), (12, "--"), (13, "a longer item of several words here"), (14, "Forty, two")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["score"], r["first_word"], r["last_word"]) for r in decontam.find(docs, bench).collect())
    assert got == [(1, 10, 1.0, 0, 1), (1, 14, 1.0, 0, 1)] + [(2, 10, 1.0, 0, 1)] * 2 + [(2, 14, 1.0, 0, 1)] * 2 + [(4, 11, 1.0, 0, 0)]
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench).collect()) == [3, 5, 6, 7, 8]


def test_decontamination(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [say(r.randrange(15, 50)) for _ in range(20)]
    docs, want = [], set()
    for i in range(200):
        w = say(r.randrange(20, 200))
        if i % 4 == 0:
            own = list(items[i % 20])
            for p in range(i % 7, len(own), 7):
                own[p] = "other"
            w[10:10] = own
        docs.append((i, " ".join(w).capitalize()))
    docs += [(300, None), (301, ""), (None, " ".join(items[0]))]
    bench = [(i, ", ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, "")]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    one = decontam.Bench.of([x for x in bench if x[1]])
    for d, t in docs:
        ids = one.numbered(t)
        want |= {(d, i) for i, item in enumerate(one.items) if len(ids) and decontam.align(item, ids)[0] >= decontam.THRESHOLD}
    assert len(want) == 51
    for chars in (4_000_000, 1500):
        assert {(g["doc_id"], g["item_id"]) for g in decontam.find(df, b, block_chars=chars).collect()} == want
        assert {g["doc_id"] for g in decontam.clean(df, b, block_chars=chars).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_alignment_score():
    a = np.array([1, 2, 3, 4, 5])
    assert decontam.align(a, np.array([9, 1, 2, 3, 4, 5, 9])) == (1.0, 1, 5)
    assert decontam.align(a, np.array([1, 2, 9, 3, 4, 5]))[0] == 0.9
    assert decontam.align(a, np.array([1, 2, 9, 4, 5]))[0] == 0.7
    assert decontam.align(a, np.array([], int))[0] == 0


def test_chat(spark):
    r = random.Random(3)
    marks = ["</s>", "<s>", "[INST]", "[/INST]", " ", "\\", "<<SYS>>", "<</SYS>>", "\n", "a", "[ROLE x] ", " [/ROLE]", "[", "<", "é", "\\\\", " [/INST]", " </s>", "]"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None, "a b]\n"]), r.choice([None, ""]) if r.random() < 0.1 else "".join(r.choice(marks) for _ in range(r.randrange(9)))) for c in [None, *range(60)] for t in range(r.randrange(1, 6))] + chat.HOSTILE
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again")]
    got = {x["conv_id"]: x for x in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in {x[0] for x in rows}:
        own = sorted((t, role or "", s or "") for k, t, role, s in rows if k == c)
        learned = "".join(s for _, role, s in own if role == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(own), hashlib.sha256("".join(f"{a}\n{s}\n" for _, a, s in own).encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_escapes_control_strings(spark):
    """No control string stands in a turn's text, whatever the text; a turn's form doesn't depend on the others."""
    r = random.Random(5)
    marks = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]", "[", "<", "x", "SYS>>", "/s>", " "]
    for _ in range(3000):
        role, said = r.choice(["user", "assistant", "system", "tool", ""]), "".join(r.choice(marks) for _ in range(r.randrange(8)))
        out = chat.render_turn(role, said)
        [(back, again, begin, end)] = chat.parse(out)
        assert (back, again) == (role, said)
        assert not any(m in out[begin:end] for m in ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE ", "[/ROLE]"))
        assert chat.format_turns([("user", "a"), (role, said)]) == chat.render_turn("user", "a") + out
    assert chat.escape("plain <b> and \\ stay", 1) == "plain <b> and \\ stay" and chat.escape("[INST]", 1) == "[\\INST]"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, n_turns int")
    assert chat.digests(empty).count() == 0 == chat.formatted(empty).count()


def test_language(spark):
    tongue = {"en": "the house and that river with", "fr": "la maison est dans une rue avec", "de": "das haus und der fluss mit einem"}
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(tongue[k].split()) for _ in range(40)), k, f"h{i % 5}.{k}.example.{k}") for i, k in enumerate(list(tongue) * 60)]
    test = rows[120:] + [(900, None, None, None), (901, "123 !!", None, None), (902, "Привет мир как дела сегодня вечером дома", None, "x"), (903, "THE!! HOUSE!! AND!! THAT!!", "en", None)]
    cols = "doc_id long, text string, lang string, source string"
    model = langid.fit(spark.createDataFrame(rows[:120], cols))
    df = spark.createDataFrame(test, cols)
    got = {g["doc_id"]: g for g in langid.identify(df, host=F.col("source"), declared=F.col("lang"), model=model).collect()}
    assert all(got[i]["language"] == k for i, _, k, _ in test if k)
    assert not any(got[i]["accepted"] for i in (900, 901, 902))
    kept = langid.accepted(df, host=F.col("source"), model=model)
    assert kept.columns == df.columns and {g["doc_id"] for g in kept.collect()} == {x[0] for x in test} - {900, 901, 902}


def test_main_text():
    page = "<html><head><title>T</title><style>x</style></head><body><header>Site</header><nav><a>Menu</a></nav><div class='cookie-notice'>We use cookies</div>{}<aside>Side</aside><footer>&copy; me</footer></body></html>"
    article = "<article><h1>Head &amp; tail</h1><p><b>First   para<br>goes on.<p>Second<!-- no --> one.</p><div class='ad'>Buy</div><ul><li>item</ul><form>Mail<input></form><div id='comments'><p>Nice</p></div></article>"
    weights = htmltext.fit([page.format(article)] * 50)
    assert htmltext.extract(page.format(article), weights) == "Head & tail\nFirst para goes on.\nSecond one.\nitem"
    plain = page.format("<div><p>Some words that make up the text of this page here.</p><p>And some more.</p></div>")
    assert htmltext.extract(plain, weights) == "Some words that make up the text of this page here.\nAnd some more."
    assert [htmltext.extract(x, weights) for x in (None, "", "<script>var t='</p>';</script>", "bare words", "<p>cut of")] == ["", "", "", "bare words", "cut of"]


def test_best_run_is_best():
    r = random.Random(2)
    for _ in range(300):
        items = [("word", " ".join("w" * r.randrange(1, 4)), False) if r.random() < 0.5 else ("tag", r.choice(["p", "div", "-nav"]), False) for _ in range(r.randrange(12))]
        weights = {"p": 0.5, "div": 2.0, "-nav": 5.0}
        score = lambda a, b: sum(len(x.split()) if k == "word" else -weights[x] for k, x, _ in items[a:b])  # noqa: E731,B023
        start, end = htmltext.best_run(items, weights)
        assert score(start, end) == max((score(a, b) for a in range(len(items) + 1) for b in range(a, len(items) + 1)), default=0)


def test_licenses(spark):
    rows = [(1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "LICENSED UNDER CC BY-NC 4.0!"), (3, "no such words"), (4, None), (5, ""), (6, "Licensed under the Apache License, Version 2.1."), (7, "This work is licenced under the GNU General Public License version 3"), (8, "foo bar " * 900 + "Released under the MIT License. " + "foo " * 900)]
    got = {(g["doc_id"], g["line"]): g for g in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, 1]["license"] == "Apache-2.0" and got[1, 1]["status"] == "exact"
    assert got[2, 0]["license"] == "CC-BY-NC-4.0" and got[7, 0]["license"] == "GPL-3.0"
    assert got[6, 0]["license"] is None and got[6, 0]["missing"] == ["2.0"] and got[6, 0]["added"] == ["2.1"]
    assert got[8, 0]["license"] == "MIT" and not {3, 4, 5} & {d for d, _ in got}
    for _, template in licenses.TEMPLATES:
        assert licenses.identify(template)[2] == "exact"


def test_lm(spark):
    r = random.Random(1)
    rows = [(i, " ".join(f"a{k} b{k} c{k}" for k in (r.randrange(5) for _ in range(30)))) for i in range(100)] + [(200, None), (201, " "), (202, "b1 b1 c4 a2 a2 b3 c0 c0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary, net = lm.fit(df)
    got = {g["doc_id"]: g for g in lm.score(df, (vocabulary, net)).collect()}
    v = lm.Vocabulary(vocabulary)
    for i in (0, 50, 202):
        c = v.classes(rows[i][1] if i < 100 else rows[-1][1])
        want = sum(float(net.logits(np.array([c[k - 1] * lm.CLASSES + c[k + 1]]))[0, c[k]]) for k in range(1, len(c) - 1))
        assert abs(got[i]["log_likelihood"] - want) < 1e-2 and got[i]["n_tokens"] == len(c) - 2
    assert got[200]["n_tokens"] == 0 == got[201]["log_likelihood"] and got[200]["mean_log_likelihood"] is None
    assert np.mean([got[i]["mean_log_likelihood"] for i in range(100)]) > got[202]["mean_log_likelihood"] + 1


def test_lm_counts_all_windows(spark):
    """Words, their numbers and the windows of the whole table, against a plain count of them."""
    from collections import Counter

    r = random.Random(12)
    rows = [(i, text(r, r.randrange(0, 40))) for i in range(60)] + [(7, "the the quick"), (7, "the the quick"), (None, "bridges of ink"), (80, None), (81, " \t "), (82, "end " * 300_000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_tokens int").repartition(5)
    vocabulary = lm.frequent(df)
    count = Counter(w for _, t in rows for w in (t or "").lower().split())
    assert {x["word"]: x["n"] for x in vocabulary.counted.collect()} == count
    assert list(vocabulary) == sorted(count, key=lambda w: (-count[w], w))[: lm.WORDS]
    v = lm.Vocabulary(list(vocabulary))
    want = Counter()
    for _, t in rows:
        c = v.classes(t).tolist()
        want.update((c[i - 1] * lm.CLASSES + c[i + 1], c[i]) for i in range(1, len(c) - 1))
    assert {(x["context"], x["target"]): x["n"] for x in lm.windows(df, list(vocabulary)).collect()} == want
    got = lm.score(df, (vocabulary, lm.Network.fresh())).collect()
    assert sorted((repr(x["doc_id"]), x["n_tokens"]) for x in got) == sorted((repr(i), len((t or "").split())) for i, t in rows)
    assert lm.score(df.limit(0)).count() == 0


def brute_language(model, rows, hosts):
    """Posteriors by the formula: text likelihood, host prior smoothed by suffix and all, declared language."""
    k = len(model.langs)
    ll = [model.likelihoods(t) for _, t, _, _ in rows]
    sure = []
    for (x, n), (_, _, host, tag) in zip(ll, rows, strict=True):
        p = np.exp(langid.EVIDENCE * (x - x.max()))
        p /= p.sum()
        if n and p.argmax() < k and p.max() > 0.9:
            sure.append((host, tag or "", int(p.argmax())))
    count = lambda test: np.array([sum(j == i for h, d, j in sure if test(h, d)) for i in range(k)], float)
    top = (count(lambda h, d: True) + 1) / (count(lambda h, d: True) + 1).sum()
    suffix = lambda h: h.rsplit(".", 1)[1] if h and "." in h else None
    smooth = lambda own, parent: (own + langid.PARENT * parent) / (own.sum() + langid.PARENT)
    kinds = [*model.langs, "*", ""]
    said = np.array([count(lambda h, d, x=x: (d if d in kinds else "*") == x) for x in kinds]) + 1
    said = np.log(said / said.sum(axis=0))
    out = []
    for (x, _), (_, _, host, tag) in zip(ll, rows, strict=True):
        prior = top
        if host is not None and any(h == host for h, _, _ in sure):
            s = suffix(host)
            own = np.array([langid.SUFFIX if langid.SUFFIX_LANGUAGE.get(s) == lang else 0.0 for lang in model.langs])
            of = smooth((count(lambda h, d: suffix(h) == s) if s else 0) + own, top)
            domain = ".".join(host.split(".")[-2:]) if host.count(".") > 1 else None
            mid = smooth(count(lambda h, d: domain is not None and h is not None and h.count(".") > 1 and h.endswith(domain)) if domain else np.zeros(k), of)
            prior = smooth(count(lambda h, d: h == host), mid)
        d = said[kinds.index((tag or "") if (tag or "") in kinds else "*")]
        z = langid.EVIDENCE * x + np.append(np.log(prior), 0) + np.append(d, d.mean()) + np.append(np.full(k, np.log1p(-langid.OTHER_PRIOR)), np.log(langid.OTHER_PRIOR))
        z = np.exp(z - z.max())
        out.append(z.max() / z.sum())
    return out


def test_language_posteriors(spark):
    """Fused posteriors against the formula worked out row by row; repeated rows, long texts and an empty table."""
    tongue = {"en": "the house and that river with", "fr": "la maison est dans une rue avec", "de": "das haus und der fluss mit einem"}
    r = random.Random(18)
    hosts = ["a.example.de", "b.example.de", "c.org", "localhost", None, "x.y.fr", "z.y.fr"]
    rows = [(i, " ".join(r.choice(tongue[lang].split()) for _ in range(r.choice([1, 3, 30]))), r.choice(hosts), r.choice([None, lang, "pt"])) for i, lang in enumerate(list(tongue) * 40)]
    rows += [(5, rows[5][1], rows[5][2], rows[5][3]), (300, "the house " * 200_000, None, None), (301, None, "c.org", None)]
    fit = spark.createDataFrame([(" ".join(r.choice(v.split()) for _ in range(30)), k) for k, v in tongue.items() for _ in range(20)], "text string, lang string")
    model = langid.fit(fit)
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, tag string")
    got = langid.identify(df, host=F.col("host"), declared=F.col("tag"), model=model).collect()
    want = sorted((repr(x[0]), round(p, 6)) for x, p in zip(rows, brute_language(model, rows, hosts), strict=True))
    assert sorted((repr(g["doc_id"]), round(g["posterior"], 6)) for g in got) == want
    assert langid.identify(df.limit(0), host=F.col("host"), model=model).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """The chain on a small corpus: each stage against all pairs, and what is packed against the tokenizers package."""
    import corpus_pipeline
    from quire.llm import queries

    r = random.Random(31)
    tongue = {"en": "the house and that river with some old stones near it".split(), "de": "das haus und der fluss mit einem alten stein daneben".split()}
    say = lambda lang, n: [r.choice(tongue[lang]) + str(r.randrange(9)) * r.randrange(2) for _ in range(n)]
    items = [say("en", 30) for _ in range(5)]
    docs, base = [], [say("en", 120) for _ in range(6)]
    for i in range(90):
        w = list(r.choice(base)) if i % 3 else say(r.choice(["en", "de"]), r.randrange(20, 90))
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = "changed"
        if i % 10 == 0:
            w[5:5] = items[i % 5]
        docs.append((i, " ".join(w), "de" if w[0] in tongue["de"] else "en"))
    docs += [(200, "12345 !!!", None), (201, None, None), (202, "", None)]
    rows = [(i, t, lang, f"src{i % 3}", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {g["doc_id"] for g in langid.identify(df, host=F.col("source")).where("accepted").collect()}
    assert not kept & {200, 201, 202}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.lower().split()) for i, t, _ in docs if i in kept)}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((group[a], group[b]))
            group = {i: x if g == y else g for i, g in group.items()}
    kept = {i for i in kept if group[i] == i}
    one = decontam.Bench.of([(i, " ".join(t)) for i, t in enumerate(items)])
    texts = {i: t for i, t, _ in docs}
    kept = {i for i in kept if not any(decontam.align(item, one.numbered(texts[i]))[0] >= decontam.THRESHOLD for item in one.items)}
    assert 10 < len(kept) < 80
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {x["doc_id"]: x["doc_tokens"] for x in packed} == {i: len(t.encode(texts[i], add_special_tokens=False).ids) + 1 for i in kept}
    spark.createDataFrame([(1, "http://a.example.de/x", "<html lang='de'><article><p>" + " ".join(tongue["de"] * 9) + "</p></article></html>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {g["page_id"]: (g["language"], g["accepted"]) for g in queries.page_language(spark, str(tmp_path)).collect()}
    assert got == {1: ("de", True), 2: (None, False)}


def test_gradients():
    net, r = lm.Network.fresh(), np.random.default_rng(0)
    context, counts = np.array([5, 700, 65535]), r.integers(0, 3, (3, lm.CLASSES)).astype(np.float32)
    loss = lambda: -(net.logits(context) * counts).sum() / counts.sum()
    for a, g in zip(net.arrays(), net.gradients(context, counts), strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        base, a[i] = a[i], a[i] + 1e-2
        up = loss()
        a[i] = base - 1e-2
        assert abs((up - loss()) / 2e-2 - g[i]) < 1e-3
        a[i] = base


def test_lm_knows_every_word(spark):
    """Rare words count as themselves: junk of the same ending and length scores lower, and a block asks once a word."""
    r = random.Random(3)
    spell = lambda: "".join(r.choice("aeioulmnrst") for _ in range(7)) + "ed"
    rare = [spell() for _ in range(400)]
    rows = [(i, " ".join(r.choice(rare) for _ in range(40))) for i in range(200)] + [(None, rare[0]), (300, "")]
    junk = [(500, " ".join("xqzvkwj" + "ed" for _ in range(40))), (501, " ".join(f"{r.randrange(10**7):07d}ed" for _ in range(40)))]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string")
    got = {g["doc_id"]: g["mean_log_likelihood"] for g in lm.score(df.where("doc_id is null or doc_id < 500 or doc_id = 501")).collect()}
    assert len(got) == 203 and min(got[i] for i in range(200)) > got[501] + 1
    model = lm.fit(df.where("doc_id < 500"))
    seen = {g["doc_id"]: g["mean_log_likelihood"] for g in lm.score(df, model).collect()}
    assert seen[500] < min(seen[i] for i in range(200)) - 5 and seen[300] is None
    k, n = model[0].known, {x["word"]: x["n"] for x in model[0].counted.collect()}
    v = lm.Vocabulary(list(model[0]))
    word = next(w for w in n if v[w] > lm.WORDS)
    c = v.classes(word)
    want = float(model[1].logits(np.array([0]))[0, c[1]]) + k.within(c[1:2] - 1 - lm.WORDS, np.array([n[word]]), k.spelled([word.encode()]))[0]
    assert abs(lm.score(spark.createDataFrame([(1, word)], "doc_id long, text string"), model).first()["log_likelihood"] - want) < 1e-4


def test_main_text_is_whole():
    """Left-out elements inside an article split nothing off it, nor does a list of single words."""
    sample = "<body><div class='ad'>Buy</div><nav>Menu</nav><article><p>Some words of an article here.</p></article><footer>Me</footer></body>"
    weights = htmltext.fit([sample] * 2000)
    inner = "<h1>Short title</h1><div class='ad'>Buy</div><p>" + "word " * 100 + "</p><aside>Side</aside><table><tr><td>one</td></tr><tr><td>two</td></tr></table><form>Mail</form><p>The end.</p>"
    whole = "\n".join(["Short title", "word " * 99 + "word", "one", "two", "The end."])
    assert htmltext.extract(f"<body><div class='ad'>Buy</div><article>{inner}</article><footer>Me</footer></body>", weights) == whole
    assert htmltext.extract(f"<body><article>First one.</article><p>Between</p><article>{inner}</article></body>", weights) == "First one.\n" + whole
    assert [x for _, x, _ in htmltext.stream("<div class='ad'>Buy</div><p>a</p>")] == ["-div", "p", "a", "/p"]
    plain = f"<body><div><p>Lead in words.</p><div class='ad'>Buy</div><p>{'word ' * 20}</p><ul><dd>item</dd></ul></div></body>"
    assert htmltext.extract(plain, weights) == "Lead in words.\n" + "word " * 19 + "word\nitem"


def test_main_text_by_the_scan(spark):
    """The scan decides on whole pages: unmarked ones, several articles, innocent class names; and as a table."""
    sample = "<html><body><div class='wrap'><div>x</div><div>y</div></div><article><p>Some words of an article here.</p></article></body></html>"
    weights = htmltext.fit([sample] * 500)
    said = [f"{'word ' * 19}{k}" for k in ("one", "two", "three")]
    assert htmltext.extract("<body>" + "".join(f"<div>{x}</div>" for x in said) + "</body>", weights) == "\n".join(said)
    two = "<main><article><p>A first article of some words.</p></article><article><p>And a second one.</p></article></main>"
    assert htmltext.extract(two, weights) == "A first article of some words.\nAnd a second one."
    teaser = f"<body><article><p>{said[0]}</p></article><div>{'elsewhere ' * 30}</div><article>More</article></body>"
    assert htmltext.extract(teaser, weights) == said[0] + "\nMore"
    for sizes in ((40, 50), (10, 30, 50), (1, 1)):
        parts = [f"{'inside ' * n}{n}".strip() for n in sizes]
        apart = f"<ul>{'<li><a>menu</a></li>' * 400}</ul><div>{'outside ' * 60}</div>"
        assert htmltext.extract("<body>" + apart.join(f"<article><table>{'<tr></tr>' * 2000}</table><p>{x}</p></article>" for x in parts) + "</body>", weights) == "\n".join(parts)
    for name, kept in (("related-work", True), ("product-search", True), ("comment", False), ("site-nav", False), ("related-posts", False), ("userComments", False), ("adventure", True), ("cookie_notice bar", False), ("share-buttons", False)):
        got = htmltext.extract(f"<article><p>Before it.</p><div class='{name}'>Inside it.</div><p>After it.</p></article>", weights)
        assert ("Inside it." in got) == kept, name
    rows = [(i, f"u{i}", sample, "clash") for i in range(30)] + [(30, "u", None, ""), (30, "u", None, ""), (31, "u", "", ""), (None, None, "<p>bare &amp; whole</p>" * 20000, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.main_texts(df).collect()
    assert sorted((repr(r["page_id"]), r["text"]) for r in got) == sorted((repr(i), htmltext.extract(h, htmltext.fitted(df))) for i, _, h, _ in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and max(r["n_chars"] for r in got) == 20000 * 13 - 1
    assert htmltext.main_texts(df.limit(0)).count() == 0 and htmltext.fitted(df.limit(0)) == {}


def test_licenses_over_lines(spark):
    """Notices wrapped over lines or side by side in one line are all found."""
    import textwrap

    for k, (name, template) in enumerate(licenses.TEMPLATES):
        wrapped = textwrap.fill(template, 30, initial_indent=" * ", subsequent_indent=" * ")
        got = list(licenses.notices(f"Some prose here.\n\n{wrapped}\n\nMore prose."))
        assert [(g[0], g[1], g[3]) for g in got] == [(2, name, "exact")], k
    two = "Copyright me. All rights reserved. Released under the MIT License. Docs are under another: Licensed under CC BY-NC 4.0."
    assert [g[1] for g in licenses.notices(two)] == ["proprietary", "MIT", "CC-BY-NC-4.0"]
    assert [g[1] for g in licenses.notices("Licensed under the Apache\nLicense, Version 2.1.")] == [None, None]
    rows = licenses.scan(spark.createDataFrame([(1, two)], "doc_id long, text string")).collect()
    assert [(r["line"], r["license"], r["status"]) for r in rows] == [(0, k, "contained") for k in ("proprietary", "MIT", "CC-BY-NC-4.0")]


def test_licenses_confirm_every_template():
    """A short notice after much prose is confirmed though longer templates shrink the block more."""
    prose = "In this guide we copy files, merge and publish associated documentation, and use source and binary forms with or without modification. Any purpose is fine; you may not use this file in other subject to the following terms of the source code form, permitted provided that conditions are met. This free software is released into the public, and any person may obtain a copy and distribute it, with or without fee. "
    for name, notice in (("proprietary", "All rights reserved."), ("MIT", "Released under the MIT License."), ("CC0-1.0", "Released under CC0 1.0 Universal.")):
        assert licenses.identify(prose + notice)[0] == name
        assert [g[1] for g in licenses.notices(prose + notice)] == [name]


def test_language_sample_is_of_distinct_texts(spark):
    """Neither a hot group of copies nor a frequent language keeps another language out of the model."""
    texts = spark.createDataFrame([(f"text number {i}",) for i in range(200)], "text string")
    first = texts.orderBy(F.xxhash64("text")).first()["text"]  # its copies would fill the sample
    rows = [(first, "en")] * 100 + [(f"frequent words {i}", "de") for i in range(100)] + [("une phrase rare", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert langid.fit(df, 20).langs == ("de", "en", "fr")
    once = langid.fit(df.distinct(), 20)
    assert (langid.fit(df, 20).table == once.table).all()


def test_every_link_is_an_edge(spark):
    """All canonical links and refresh redirects of a page count, and relative ones are resolved."""
    link, go = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    html = link.format("http://one.org/") + link.format("https://two.org/x") + go.format("http://three.org/") + go.format("http://four.org/y")
    html += "".join(link.format(x) for x in ("../up", "./same?q=../a", "/r/./s/../t", "../../../top", ".."))
    df = spark.createDataFrame([("http://a.org/d/e/f", html), ("http://none.org/", None)], "url string, html string")
    got = {r["b"] for r in urlfilter.link_edges(df).collect()}
    assert got == {"one.org/", "two.org/x", "three.org/", "four.org/y", "a.org/d/up", "a.org/d/e/same?q=../a", "a.org/r/t", "a.org/top", "a.org/d/"}
