"""Nearest neighbours of vectors that are shifted, tiny, huge or clustered: recall against brute force in double precision."""

import numpy as np
import pytest

from quire.llm import ann

N, DIM, K = 3000, 24, 10


def cloud(kind):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (N, DIM))
    if kind == "shifted":
        return x + 10_000
    if kind == "tiny":
        return x * 1e-25
    if kind == "huge":
        return x * 1e20
    if kind == "beyond":
        return x * 1e200
    if kind == "clusters":
        return r.normal(0, 1, (30, DIM))[r.integers(0, 30, N)] * 1e6 + x * 1e-3
    return x


@pytest.mark.parametrize("kind", ["plain", "shifted", "tiny", "huge", "beyond", "clusters"])
def test_recall(spark, kind):
    x = cloud(kind)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df.where("vec_id % 100 = 0"), df, K, shard_rows=1000).sort("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, N, 100):
        d = x - x[q]
        m = np.abs(d).max(axis=1, initial=0)
        far = np.where(m > 0, m, 1) * np.sqrt(((d / np.where(m > 0, m, 1)[:, None]) ** 2).sum(axis=1))
        far[q] = np.inf
        want = np.lexsort((np.arange(N), far))[:K]
        assert len(got[q]) == K
        hits += len({v for v, _ in got[q]} & set(want.tolist()))
        assert all(s == pytest.approx(far[v], rel=1e-12) for v, s in got[q])
    assert hits / (N // 100 * K) >= 0.95
