import math
import random

import numpy as np
import pytest

from fleetops.llm import top_k as T
from fleetops.llm.top_k import Index, build, search, top_k
from tests.llm.helpers import rows

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, block string, score string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "v", "b", "s") for i, v in vectors], SCHEMA)


def brute(vectors, k, every, scale=64):
    good = {
        i: [math.floor(scale * float(np.float32(x))) for x in v]
        for i, v in vectors
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for q, a in good.items():
        if q % every == 0:
            ranked = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, start=1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, dims, k", [(300, 8, 20), (30, 3, 50), (1, 4, 5), (200, 1, 7)])
def test_against_brute_force(spark, n, dims, k):
    rng = np.random.default_rng(n)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, dims)]) for i in range(n)]
    got = rows(top_k(table(spark, vectors), k, 5), "query_id", "rank", "vec_id", "score")
    assert got == brute(vectors, k, 5)


def test_ties_and_blocks(spark):
    """One vector that a third of the rows share, spread over small blocks; the smaller ids win."""
    rng = random.Random(1)
    vectors = [(i, [0.5, -0.25, 0.125] if i % 3 == 0 else [rng.choice([-0.5, 0.0, 0.25]) for _ in range(3)]) for i in range(400)]
    df = table(spark, vectors)
    quantised = df.select("vec_id", T.quantised(df["embedding"]).alias("vector"))
    index = build(quantised, 50)
    assert index.count() > 4
    got = search(index, quantised.filter("vec_id % 20 = 0"), 9, 3)
    assert rows(got, "query_id", "rank", "vec_id", "score") == brute(vectors, 9, 20)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, [1.0, 2.0]),
        (20, None),
        (40, [nan, 1.0]),
        (60, [inf, 1.0]),
        (80, [None, 1.0]),
        (None, [1.0, 1.0]),
        (1, [1.0]),
        (2, []),
        (3, [-1.0, 0.5, 7.0]),
        (100, [0.0, 0.0]),
    ]
    repeated = vectors + [(0, [1.0, 2.0]), (3, [-1.0, 0.5, 7.0])]
    got = rows(top_k(table(spark, repeated), 20, 20), "query_id", "rank", "vec_id", "score")
    assert got == brute(vectors, 20, 20)
    assert top_k(table(spark, vectors).limit(0)).count() == 0
    assert top_k(table(spark, [(1, [1.0])])).count() == 0


def test_rows_of_one_id_are_rows_of_their_own(spark):
    """A third of the rows share the id 0, each with a vector of its own: all are queries, and find each other."""
    rng = np.random.default_rng(5)
    plain = [(0 if i % 3 == 0 else i, [float(x) for x in rng.integers(-9, 9, 3) / 16]) for i in range(90)]
    vectors = list({(i, tuple(v)): (i, v) for i, v in plain}.values())
    want = []
    for q, (i, a) in enumerate(vectors):
        if i % 20 == 0:
            scored = [(-sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b)), j) for r, (j, b) in enumerate(vectors) if r != q]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:7], start=1)]
    got = rows(top_k(table(spark, plain), 7, 20), "query_id", "rank", "vec_id", "score")
    assert got == sorted(want, key=repr)


def test_blocks_are_bounded_by_components(spark, monkeypatch):
    """Ten times the dimensions give a tenth of the rows a block, and the same results."""
    monkeypatch.setattr(T, "BLOCK_NUMBERS", 2_000)
    monkeypatch.setattr(T, "QUERY_NUMBERS", 400)
    rng = np.random.default_rng(6)
    for dims in (4, 40):
        vectors = [(i, [float(x) for x in rng.normal(0, 0.3, dims)]) for i in range(200)]
        df = table(spark, vectors)
        quantised = df.select("vec_id", T.quantised(df["embedding"]).alias("vector"))
        sizes = [len(b[0]) // 8 for b in build(quantised).select("ids").collect()]
        assert sum(sizes) == 200 and max(sizes) * dims < 2 * 2_000
        got = rows(top_k(df, 6, 10), "query_id", "rank", "vec_id", "score")
        assert got == brute(vectors, 6, 10)


def test_scores_by_bitmaps_are_exact():
    rng = np.random.default_rng(3)
    rows_ = rng.integers(-1000, 1000, (130, 6))
    index = Index.loaded(*Index.of(np.arange(130), rows_).dumped())
    for query in rng.integers(-70, 70, (10, 6)):
        found = index.top(query, 130, -1)
        assert dict(found) == {i: int(s) for i, s in enumerate(rows_ @ query)}
