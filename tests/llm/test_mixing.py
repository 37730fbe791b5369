import math
import random

import pytest

from fleetops.llm.mixing import copy_plan, mix, source_targets
from tests.llm.helpers import AWKWARD, documents, rows, words


def brute_targets(sizes, weights=(1, 2, 3), cap=3.0):
    """Share by weight; cut what is above a cap; share the excess again; until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {s: 0.0 for s in order}, set(order), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share, left = left, 0.0
        for s in list(open_):
            target[s] += share * weight[s] / total
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_the_end_of_sharing_again(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 1000, 5000]) for s in [None, "", "a", "b", "é", "z", "Z", "10"][: 3 + seed]}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    want = brute_targets(sizes)
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)


def test_taken_words_are_near_the_targets(spark):
    rng = random.Random(1)
    texts = ["w " * rng.choice([0, 1, 5, 50, 300]) for _ in range(900)]
    sources = ["hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]) for _ in texts]
    docs = documents(spark, texts, sources=sources)
    plan = copy_plan(docs).collect()
    assert len(plan) == len(texts)
    assert rows(copy_plan(docs.repartition(5))) == sorted((tuple(r) for r in plan), key=repr)
    for source in {r["source"] for r in plan}:
        own = [r for r in plan if r["source"] == source]
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(0 <= r["copies"] <= 3 for r in own)
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    want = {r["id"]: r["copies"] for r in plan}
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD + AWKWARD, sources=[None, "a"], ids=[1] * 11 + [None] * 11)
    plan = copy_plan(docs)
    assert plan.count() == 22
    assert sum(r["size"] for r in plan.collect()) == 2 * sum(len(words(t)) for t in AWKWARD)
    assert mix(docs).count() == sum(r["copies"] for r in plan.collect())
    assert copy_plan(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0


def test_nothing_to_mix(spark):
    assert {r["copies"] for r in copy_plan(documents(spark, ["", None])).collect()} <= {0}
