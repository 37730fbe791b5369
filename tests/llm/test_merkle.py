"""The manifest against a plain recursive one, by hand-made small trees, and against SQL."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fleetops.llm import merkle
from tests.llm.helpers import AWKWARD, documents, rows


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, extra=0):
    n_chars = None if row.n_chars is None else row.n_chars + extra
    values = (row.doc_id, row.source, row.lang, n_chars, row.text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The root, and for each node the siblings on its way as (on the left?, digest)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            ways[i].append((other < place, nodes[other] if other < len(nodes) else ""))
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [place // 2 for place in at]
    return nodes[0], ways


def brute_force(records):
    langs = {}
    for row in records:
        langs.setdefault(row.lang, []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subroots, below = [], {}
    for lang in order:
        group = sorted(langs[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        root, ways = tree([leaf(r) for r in group])
        subroots.append(root)
        below[lang] = list(zip(group, ways))
    root, above = tree(subroots)
    out = []
    for lang, subroot, rest in zip(order, subroots, above):
        for row, way in below[lang]:
            extra = int(row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0)
            node = leaf(row, extra)
            for on_left, other in way + rest:
                node = digest(other, node) if on_left else digest(node, other)
            proof = digest(*[other for _, other in way + rest])
            out.append((row.doc_id, leaf(row), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4, 256])
def test_equals_brute_force(spark, block):
    docs = documents(spark, AWKWARD * 5, langs=["en", "de", "en", None, "en", "fr", "en"])
    assert rows(merkle.verified(docs, merkle.tampered_n_chars(), block)) == brute_force(docs.collect())


def test_nulls_and_repeated_rows(spark):
    texts = ["a", "a", "a", None, "", "b"] * 3
    docs = documents(spark, texts, langs=[None, "", "x"], sources=[None, "s"], ids=[None, 1, 1] * 6)
    docs = docs.withColumn("n_chars", F.when(F.length("text") > 0, F.col("n_chars")))
    assert rows(merkle.verified(docs, merkle.tampered_n_chars(), 4)) == brute_force(docs.collect())


@pytest.mark.parametrize("n", [1, 5, 17])
def test_one_language_of_any_size(spark, n):
    docs = documents(spark, [f"t{i}" for i in range(n)])
    got = rows(merkle.verified(docs, merkle.tampered_n_chars(), 4))
    assert got == brute_force(docs.collect())
    assert {r[2] for r in got} == {r[3] for r in got}


def test_empty_table(spark):
    assert rows(merkle.verified(documents(spark, ["a"]).limit(0), merkle.tampered_n_chars())) == []


def test_long_text_and_tampering(spark):
    docs = documents(spark, ["é" * 500_000, "x"] * 20)
    got = rows(merkle.verified(docs, merkle.tampered_n_chars()))
    assert got == brute_force(docs.collect())
    assert {r[6] for r in got} == {True, False}


def test_witness_is_the_rows_own(spark):
    docs = documents(spark, [f"t{i}" for i in range(11)])
    for row in merkle.manifest(docs, block=4).collect():
        node = row.leaf
        for level, side in enumerate(row.sides):
            other = row.siblings[64 * level : 64 * level + 64].strip()
            node = digest(other, node) if side == "L" else digest(node, other)
        assert node == row.root and row.tampered is None
