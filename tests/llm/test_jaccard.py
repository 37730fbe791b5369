import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetops.llm import jaccard
from fleetops.llm.components import components
from fleetops.llm.jaccard import (
    classes,
    digest,
    forest,
    gram_counts,
    gram_sets,
    join,
    one_of_each,
    pivots,
    representatives,
    slot,
    with_texts,
)
from tests.llm.helpers import AWKWARD, documents, rows, words


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(texts, n, percent, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(sets)):
        least.setdefault(find(i), []).append(ids[i])
    named = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(ids[i], len(sets[i]), named[find(i)]) for i in range(len(sets))]


def family(rng, size, copies, changes):
    """A text and copies of it with some words changed, dropped or added."""
    base = [f"w{rng.randrange(40)}" if rng.random() < 0.3 else f"u{rng.randrange(10**6)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.choice([0, 1])] = rng.choice([[], [f"n{rng.randrange(10**6)}"]])
        out.append(rng.choice([" ", "\n"]).join(w if rng.random() < 0.9 else [x.upper() for x in w]))
    return out


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 50), (2, 100)])
@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, n, percent, seed):
    rng = random.Random(10 * n + seed)
    texts = [t for _ in range(12) for t in family(rng, rng.choice([3, 12, 40, 150]), rng.randrange(12), 5)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(60)] + AWKWARD
    docs = documents(spark, texts).repartition(4)
    assert rows(join(docs, n, percent), "doc_id", "n_shingles", "component_id") == sorted(brute(texts, n, percent), key=repr)


def test_a_large_family_in_small_blocks(spark, monkeypatch):
    """A group of near copies that one task may not hold is split, with the same result."""
    rng = random.Random(4)
    texts = family(rng, 60, 250, 4) + family(rng, 60, 100, 12)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 2000)
    got = rows(join(documents(spark, texts)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute(texts, 3, 90), key=repr)


def test_many_short_classes_in_small_blocks(spark, monkeypatch):
    """Classes of few n-grams are counted too when a pivot is split."""
    rng = random.Random(5)
    texts = family(rng, 40, 200, 3) + [" ".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(60)]
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 20)
    got = rows(join(documents(spark, texts)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute(texts, 3, 90), key=repr)


@pytest.mark.parametrize("places, kept", [((0, 0, 9), {0, 1}), ((0, 5, 9), {0, 1, 2}), ((0, 6, 12, 12), {2, 3}), ((0, 6), set())])
def test_classes_far_apart_around_an_n_gram_do_not_meet(spark, places, kept):
    """At 90 percent two sets of 100 share 95, so a shared n-gram's places differ by 5 at most."""
    names = [bytes([i]) * 16 for i in range(len(places))]
    columns = [[100] * len(names), [7] * len(names), range(len(names)), places]
    packed = [np.array(list(c), dtype=t).tobytes() for c, t in zip(columns, ("<u4", "<u8", "<u4", "<u4"))]
    fields = "part int, keys binary, sizes binary, grams binary, owners binary, places binary"
    entries = spark.createDataFrame([(0, b"".join(names), *packed)], fields)
    found = pivots(entries, 2, 90).collect()
    assert {bytes(r["member"])[0] for r in found} == kept
    assert {bytes(r["pivot"])[0] for r in found} == ({min(kept)} if kept else set())


def test_forest_joins_what_all_pairs_would():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 80).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(80) < 0.04, rng.integers(0, 1 << 63, 80).astype(np.uint64), base)) for _ in range(60)]
    homes = [{b"p"}] * 60
    found = forest(sets, [0] * 60, homes, b"p", 90, False)
    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
    assert all(similar(sets[i], sets[j]) for i, j in found)
    def groups(pairs):
        root = list(range(60))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [b if r == a else r for r in root]
        return root
    everything = [(i, j) for i in range(60) for j in range(i) if similar(sets[i], sets[j])]
    same = lambda r: [[r[i] == r[j] for j in range(60)] for i in range(60)]
    assert same(groups(found)) == same(groups(everything))
    assert len(found) < 60
    assert not forest(sets, [0] * 60, [{b"a", b"p"}] * 60, b"p", 90, False)  # the least common pivot is another


def test_counts_cover_all_documents(spark):
    texts = ["a b c d", "a b c", "x"] * 20
    counts = gram_counts(documents(spark, texts).repartition(5))
    want = np.zeros(len(counts), dtype=np.int64)
    for t in texts:
        np.add.at(want, slot(gram_sets([t.encode()])[0]), 1)
    assert (counts == want).all()


def test_ids_that_repeat_or_are_missing(spark):
    long = " ".join(str(i) for i in range(50))
    texts = [long, long + " x", long, long, "other text of its own", None, "", "y"]
    ids = [9, 9, None, 4, 4, 4, None, None]
    docs = documents(spark, texts, ids=ids)
    assert rows(join(docs), "doc_id", "n_shingles", "component_id") == sorted(brute(texts, 3, 90, ids), key=repr)
    kept = rows(one_of_each(docs), "doc_id", "text")
    assert kept == sorted([(4, long), (4, "other text of its own"), (4, None), (None, ""), (None, "y")], key=repr)
    assert one_of_each(docs).columns == docs.columns
    again = documents(spark, [long, long, "", ""], ids=[1, 1, 2, 2])
    assert rows(one_of_each(again), "doc_id", "text") == sorted([(1, long), (2, ""), (2, "")], key=repr)


def test_each_class_gets_one_text_where_ids_repeat_or_are_missing(spark):
    base = " ".join(f"w{i}" for i in range(200))
    texts = [f"{base} end{i % 40}" for i in range(120)]
    ids = [None] * 60 + [7] * 60
    docs = documents(spark, texts, ids=ids).repartition(5).cache()
    wanted = representatives(classes(docs)).withColumnRenamed("class", "member")
    got = with_texts(docs, wanted.withColumn("kept", F.lit(1))).collect()
    assert len(got) == 40 and {r["kept"] for r in got} == {1}
    assert all(digest(gram_sets([r["text"].encode()])[0]) == bytes(r["member"]) for r in got)
    assert rows(join(docs), "doc_id", "n_shingles", "component_id") == sorted(brute(texts, 3, 90, ids), key=repr)


def test_no_rows(spark):
    docs = documents(spark, ["a"]).limit(0)
    assert join(docs).count() == 0 and one_of_each(docs).count() == 0
    assert join(documents(spark, [None, ""])).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    links += [(5, 5), (None, 1), (2000, 2000)] + [(7, 3000 + i) for i in range(100)]
    got = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    root = {}
    for a, b in links:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(60):
        for a, b in links:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
