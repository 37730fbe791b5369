import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fleetops.llm import outliers
from fleetops.llm.outliers import LIMIT, chi_square_limit, verdicts, word_stats
from tests.helpers import plan
from tests.llm.helpers import AWKWARD, documents, words


def brute_stats(text):
    text = text or ""
    found = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(spark):
    rng = random.Random(3)
    texts = AWKWARD + ["a b a b a b", "<#> $ %", "p q r s t p q r s t u", "\n\n a\n a\n\ta"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(60)]
    got = {r["doc_id"]: tuple(r[c] for c in STATS) for r in word_stats(documents(spark, texts)).collect()}
    assert got == {i: brute_stats(t) for i, t in enumerate(texts)}


def test_no_python_in_the_plans(spark):
    stats = word_stats(documents(spark, ["a b c"]))
    text = plan(verdicts(stats.select("doc_id", "lang", "source", *STATS)))
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def table(spark, rng, groups):
    """Prose with some repeated lines, and a few texts full of symbols or of very long words."""
    out = []
    for lang, source, n in groups:
        for i in range(n):
            size = rng.choice([15, 60, 400])
            length = 4 if lang == "en" else 7
            text = [("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 2 * length)))) for _ in range(size)]
            kind = "clean"
            if i % 12 == 0:
                text, kind = [w + "###" for w in text], "bad"
            elif i % 12 == 1:
                text, kind = [w * 9 for w in text], "bad"
            out.append((kind, " ".join(text), lang, source))
    return out


def test_outliers_are_rejected_and_clean_texts_kept(spark):
    rng = random.Random(5)
    made = table(spark, rng, [("en", "a", 300), ("de", "a", 300), (None, None, 120), ("en", "rare", 9), ("xx", "a", 3)])
    docs = documents(spark, [m[1] for m in made], langs=[m[2] for m in made], sources=[m[3] for m in made])
    stats = word_stats(docs).select("doc_id", "lang", "source", *STATS)
    judged = verdicts(stats).collect()
    assert len(judged) == len(made)
    for r in judged:
        assert r["kept"] == (made[r["doc_id"]][0] == "clean"), (made[r["doc_id"]], r)
    assert {r["group"] for r in judged if r["source"] == "rare"} == {"1=en"}
    assert {r["group"] for r in judged if r["lang"] == "xx"} == {"0"}


def test_base_rules_and_empty_tables(spark):
    docs = documents(spark, AWKWARD)
    stats = word_stats(docs).select("doc_id", "lang", "source", *STATS)
    got = verdicts(stats).collect()
    assert all(r["base_failed"] and not r["kept"] and r["distance"] is None for r in got)
    assert verdicts(stats.limit(0)).count() == 0


def test_chi_square():
    draws = (np.random.default_rng(0).standard_normal((400_000, 4)) ** 2).sum(axis=1)
    assert abs((draws <= chi_square_limit(0.75, 2)).mean() - 0.75) < 0.005
    assert 23 < LIMIT < 24


def estimate(x):
    """The same estimate of one group by plain numpy."""
    spreads, n = np.array(outliers.SPREADS), len(x)
    at = lambda values, share: np.sort(values, axis=0)[max(int(np.ceil(share * n)) - 1, 0)]
    middle = at(x, 0.5)
    spread = np.maximum((at(x, 0.75) - at(x, 0.25)) / 1.349, spreads)
    squashed = np.tanh((x - middle) / spread) * spread
    ends = []
    for first in (np.diag(spread**2), np.cov(squashed.T, bias=True) + np.diag(spreads**2)):
        centre, matrix, det = middle, first, np.inf
        while True:
            rest = x - centre
            d = np.einsum("ni,ij,nj->n", rest, np.linalg.inv(matrix), rest)
            near = x[d <= at(d, outliers.SUPPORT)]
            new = np.cov(near.T, bias=True) * outliers.CONSISTENCY + np.diag(spreads**2)
            if not np.linalg.slogdet(new)[1] < det - outliers.FALL:
                break
            centre, matrix, det = near.mean(axis=0), new, np.linalg.slogdet(new)[1]
        ends.append((det, centre, matrix))
    return min(ends, key=lambda e: e[0])[1:]


def test_kept_equals_numpy(spark):
    rng = np.random.default_rng(11)
    records = []
    for lang, source, n in [("en", "a", 400), ("en", "b", 250), ("de", "a", 120), (None, "a", 60), ("en", None, 12)]:
        for i in range(n):
            words_ = int(rng.integers(12, 800))
            odd = rng.random() < 0.3  # a third of a group may lie elsewhere, close together
            chars = int(words_ * (9 + rng.normal() / 5 if odd and source == "b" else 5 + rng.normal() / 2))
            symbols = int(chars * abs(rng.normal()) * (0.1 if rng.random() < 0.1 else 0.002))
            records.append((len(records), lang, source, words_, chars, symbols, int(rng.integers(0, 3)), int(words_ * 0.19 * rng.random() ** 6)))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS)
    got = {r.doc_id: r for r in verdicts(spark.createDataFrame(records, schema)).collect()}
    numbers = np.array([r[3:] for r in records], dtype=float)
    n, letters = numbers[:, 0] + outliers.PRIOR_WORDS, numbers[:, 1] + outliers.PRIOR_WORDS * outliers.PRIOR_LENGTH
    x = np.stack([np.log(letters / n), np.sqrt(numbers[:, 2] / letters), np.sqrt(numbers[:, 3] / n), np.sqrt(numbers[:, 4] / n)], axis=1)
    groups = {"2=en\x1f=a": ("en", "a"), "2=en\x1f=b": ("en", "b"), "2=de\x1f=a": ("de", "a"), "2-\x1f=a": (None, "a"), "1=en": ("en",)}
    seen = set()
    for name, key in groups.items():
        members = np.array([r[1 : 1 + len(key)] == key for r in records])
        centre, matrix = estimate(x[members])
        for i in np.nonzero([got[r[0]].group == name for r in records])[0]:
            rest = x[i] - centre
            distance = np.sqrt(rest @ np.linalg.inv(matrix) @ rest)
            assert abs(got[i].distance - distance) < 1e-6
            assert got[i].kept == (distance <= np.sqrt(LIMIT))
            seen.add(i)
    assert len(seen) == len(records)
    assert len({r.kept for r in got.values()}) == 2


def test_columns_that_clash_stay(spark):
    stats = word_stats(documents(spark, AWKWARD)).select("doc_id", "lang", "source", *STATS)
    taken = ["group", "kept", "Distance", "x0", "m1", "l10", "by_lang", "d", "own", "start", "base_failed"]
    wide = stats.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in taken])
    judged = verdicts(wide)
    assert judged.columns == [*wide.columns, "_group", "_distance", "_base_failed", "_kept"]
    for row in judged.collect():
        assert [row[c] for c in taken] == [f"{c}{row.doc_id}" for c in taken]
        assert row._base_failed and not row._kept
