import random
from collections import Counter
from hashlib import sha256

import pytest

from fleetops.llm.substring import COVERS, cover_for, remove_repeats
from fleetops.llm.words import word_hashes
from tests.llm.helpers import AWKWARD, documents, rows, words


def brute(texts, window):
    split = [words(t) for t in texts]
    often = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if often[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), sha256(kept.encode()).hexdigest(), kept))
    return out


def check(spark, texts, window, **options):
    docs = documents(spark, texts, **options)
    done = remove_repeats(docs.repartition(3), window)
    assert sorted(done.columns) == sorted([*docs.columns, "n_removed", "kept_sha256", "removed"])
    got = rows(done, "doc_id", "n_words", "n_removed", "kept_sha256", "text")
    want = []
    for i, (t, (n, gone, sha, kept)) in enumerate(zip(texts, brute(texts, window))):
        want.append((options.get("ids", range(len(texts)))[i], n, gone, sha, kept if gone else t or ""))
    assert got == sorted(want, key=repr)
    for r in done.collect():
        assert sum(s["end"] - s["first"] for s in r["removed"]) == r["n_removed"]


def test_covers_are_complete():
    assert all(c.complete() for c in COVERS)
    assert cover_for(35).period == 21 and cover_for(1).period == 1 and cover_for(5).period == 3


@pytest.mark.parametrize("window", [1, 2, 4, 10, 35])
@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, window, seed):
    rng = random.Random(100 * window + seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(rng.choice([window - 1, window, window + 1, 3 * window + 7])) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += fresh(rng.randrange(30)) + rng.choice(shared)
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts + fresh(rng.randrange(20))))
    texts += [texts[0], texts[1], "a b " * 60, "z " * 200, " ".join(rng.choice("ab") for _ in range(300))]
    check(spark, texts, window)


def test_awkward_rows(spark):
    check(spark, AWKWARD, 3)
    check(spark, AWKWARD, 35)
    long = " ".join(str(i) for i in range(40))
    check(spark, [long, long, long + " x", None], 35, ids=[7, 7, 7, None])
    assert remove_repeats(documents(spark, ["a"]).limit(0), 35).count() == 0


def test_words_that_sums_cannot_tell_apart(spark):
    """Thue-Morse words and their complements have equal sums modulo 2**64 in any odd base."""
    morse = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    for n in (64, 65, 1024, 2048):
        pair = word_hashes([morse[:n].encode(), other[:n].encode(), morse[:n].encode()]).tolist()
        assert pair[0] == pair[2] != pair[1]
    check(spark, [f"x y {morse} z w", f"x y {other} z w", f"v y {morse} z u"], 3)
