import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from fleetops.llm import lang_id
from fleetops.llm.lang_id import AMBIGUOUS, SHARPNESS, UNKNOWN, code, fit, gram_counts, grams, known_language, labelled_part, op2_lang_id, predict
from tests.llm.helpers import AWKWARD, documents, rows

SYLLABLES = {f"l{i}": [a + b for a in "bdfgklmnprstvz"[i : i + 5] for b in "aeiou"] for i in range(9)}


def text(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_codewords_differ(n):
    words = code(n)
    assert words.shape[0] == n and len({tuple(w) for w in words}) == n
    if n > 2:
        apart = [(words[i] != words[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= 2  # one wrong bit never decides


@pytest.mark.parametrize("n", [2, 4, 9])
def test_languages_are_told_apart(spark, n):
    rng = random.Random(n)
    langs = sorted(SYLLABLES)[:n]
    train = [(text(x, rng, rng.randint(5, 80)), x) for x in langs for _ in range(30)]
    model = fit(spark.createDataFrame(train, "text string, lang string"))
    tests = [(x, text(x, rng, rng.randint(8, 60))) for x in langs for _ in range(20)]
    got = predict(documents(spark, [t for _, t in tests]), model).collect()
    right = sum(r["lang_pred"] == tests[r["doc_id"]][0] for r in got)
    assert right >= 0.97 * len(tests)
    assert all(0 <= float(r["score"]) <= 1 for r in got)


def test_counts_are_those_of_all_texts(spark):
    rng = random.Random(2)
    made = [(text(x, rng, 20), x) for x in ["l0", "l4"] for _ in range(40)]
    counts = gram_counts(spark.createDataFrame(made, "text string, lang string").repartition(7))
    for lang in ("l0", "l4"):
        want = sum(np.bincount(grams([t.encode()])[0], minlength=1 << 15) for t, x in made if x == lang)
        assert (counts[lang] == want).all()


def test_a_text_is_read_the_same_beside_any_other():
    some = [b"", b"abc def", b" x ", "É漢 1".encode(), b"12 !", b"\n\nabc"]
    together = grams(some)
    for i, t in enumerate(some):
        alone = grams([t])
        assert together[0][together[1] == i].tolist() == alone[0].tolist()
        assert bool(together[2][i]) == bool(alone[2][0])


def test_awkward_rows(spark):
    rng = random.Random(3)
    model = fit(spark.createDataFrame([(text(x, rng, 50), x) for x in ("l0", "l4") for _ in range(5)], "text string, lang string"))
    docs = documents(spark, AWKWARD + ["123 456 !?"])
    done = predict(docs, model)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in done.collect()}
    without = [i for i, t in enumerate(AWKWARD + ["1"]) if not any(c.isalpha() for c in t or "")]
    assert all(got[i] == (UNKNOWN, 0.0) for i in without)
    assert all(got[i][0] != UNKNOWN for i in range(len(AWKWARD)) if i not in without)
    assert set(docs.columns) - {"score"} < set(done.columns) and done.columns.count("score") == 1
    assert not {r["doc_id"] for r in known_language(done, model).collect()} & set(without)
    assert predict(docs.limit(0), model).count() == 0
    nothing = fit(labelled_part(docs.limit(0)))
    assert {r["lang_pred"] for r in predict(docs, nothing).collect()} == {UNKNOWN}
    one = fit(spark.createDataFrame([("abc", "l0")], "text string, lang string"))
    assert {(r["lang_pred"], r["score"]) for r in predict(documents(spark, ["zzz"]), one).collect()} == {("l0", 1.0)}


@pytest.mark.parametrize("langs", [["l0"], ["l0", "l4"], ["l0", "l1", "l2", "l3"]])
def test_the_filter_keeps_learned_languages_only(spark, langs):
    rng = random.Random(5)
    train = [(text(x, rng, rng.randint(5, 80)), x) for x in langs for _ in range(30)]
    model = fit(spark.createDataFrame(train, "text string, lang string"))
    short = [text(x, rng, n) for x in langs for n in (1, 2, 3, 5) for _ in range(5)]
    mixed = [" ".join(text(x, rng, 6) for x in rng.choices(langs, k=4)) for _ in range(20)]
    coded = [text(x, rng, 20) + " 4F3c9aQQ77e1bXzw0d81 " + text(x, rng, 20) for x in langs]
    unlearned = [text("l8", rng, n) for n in (10, 30, 80) for _ in range(10)]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (60, 200, 900) for _ in range(5)]
    junk += ["漢字仮名" * 20, "привет мир как дела сегодня друзья"]
    good, bad = short + mixed + coded, unlearned + junk
    done = predict(documents(spark, good + bad), model)
    kept = {r["doc_id"] for r in known_language(done, model).collect()}
    assert kept == set(range(len(good)))


def test_a_model_that_does_not_judge_keeps_all_with_letters(spark):
    model = fit(spark.createDataFrame([("abc abd", "l0"), ("xyz xyw", "l1")], "text string, lang string"), judging=False)
    done = predict(documents(spark, ["abc", "12", None, "qqq"]), model)
    assert [r["fit"] for r in done.collect()] == [None] * 4
    assert rows(known_language(done, model), "doc_id") == [(0,), (3,)]


def test_held_out_accuracy(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    got = op2_lang_id(spark, testdata).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["lang"] is not None and r["n_chars"] >= 40]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def plain_decoded(margins, model):
    """Nearest codeword by loss, language by language."""
    out = []
    for row in margins:
        losses = []
        for word in model.words:
            weighed = [t * math.exp(-max(-8.0, min(8.0, w * m))) for w, m, t in zip(word, row, model.trust)]
            losses.append(sum(weighed) / sum(model.trust))
        near = [math.exp(-SHARPNESS * (x - min(losses))) for x in losses]
        out.append((near.index(max(near)), max(near) / sum(near)))
    return out


@pytest.mark.parametrize("n", [2, 4, 9])
def test_decoding_equals_a_plain_one(spark, n):
    rng = random.Random(n)
    langs = sorted(SYLLABLES)[:n]
    train = [(text(x, rng, rng.randint(5, 60)), x) for x in langs for _ in range(20)]
    model = fit(spark.createDataFrame(train, "text string, lang string"), judging=False)
    texts = [text(rng.choice(langs), rng, rng.randint(1, 40)) for _ in range(40)]
    for row in predict(documents(spark, texts), model).collect():
        # A text's margins: the mean weight of its n-grams, bit by bit.
        bucket, _, _ = grams([texts[row.doc_id].encode()])
        margins = [sum(float(model.weights[g, b]) for g in bucket) / len(bucket) for b in range(model.weights.shape[1])]
        best, score = plain_decoded([margins], model)[0]
        assert row.lang_pred == model.langs[best]
        assert abs(row.score - score) < 1e-6
        assert row.ambiguous == (score < AMBIGUOUS)


def test_learned_languages_have_a_bound(spark):
    rows_ = [("a b c", f"x{i}") for i in range(50)] + [("le la les", "fr")] * 3 + [("the of", "en")] * 5
    labelled = spark.createDataFrame(rows_, "text string, lang string")
    assert sorted(gram_counts(labelled, most=3)) == ["en", "fr", "x0"]


def test_batches_of_long_texts_take_little_memory(spark, monkeypatch):
    """Arrays of n-grams are held for a small part of a batch, as all workers of an executor share its memory."""
    docs = documents(spark, ["the cat and the dog", "le chat et le chien"], langs=["en", "fr"])
    model = fit(docs.select("text", "lang"))
    lang_id.letters()
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = predict(docs.select("text"), model)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["le chat and the dog, " * 200] * 500)})
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([batch]))) == 500
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
