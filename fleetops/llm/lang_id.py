"""Language identification with error-correcting output codes.

Each language has a codeword; each bit of the code is one binary classifier that tells the languages with a 1 from
those with a 0 by character n-grams (naive Bayes log odds, languages weighing alike). A text's margins are compared
with all codewords; each bit's loss counts by how well the bit separates its languages, and the nearest codeword wins.
Texts whose two nearest codewords are about equally near are flagged as ambiguous.

Whether a text is in a learned language at all is judged apart from that, by how likely its n-grams are, word by word
in the language that fits the word best, against how likely those of the learned rows are.

The counts are taken over all labelled rows in Spark: each task adds up a table of fixed size per language, and only
these tables, at most MOST_LANGS x BUCKETS numbers, reach the driver.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetops.llm.runtime import carried, in_arrow, process_cache, unpacked
from fleetops.llm.tokens import slices

BUCKETS = 1 << 15  # n-grams of one to three characters are counted in so many hashed places
ORDERS = (1, 2, 3)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SMOOTHING = 0.5
MOST_LANGS = 256  # languages that are learned, those with the most rows; each is a table of 256 KB
EXHAUSTIVE = 7  # up to so many languages, every way to split them is a bit; beyond, BITS random splits
BITS = 63
SHARPNESS = 4.0  # from losses to scores
AMBIGUOUS = 0.6  # a score below this is ambiguous
UNIT = 8  # letters of a word that are judged together
LEAST_FIT = -7.0  # a filter keeps documents from here on, in usual deviations of the learned rows
WORST_UNIT = -2.0  # no unit counts as less likely, by n-gram, so that a few codes or names do not outweigh a text
LEAST_SPREAD = 0.1  # learned rows are taken to differ by this at least
UNKNOWN = "und"
SLICE = 1 << 17  # bytes of text that are taken to n-grams at once: some 250 bytes of arrays each


def letters() -> np.ndarray:
    """For each code point its lower-case letter's place in the n-gram alphabet, 32 for what is no letter."""
    cache = process_cache()
    if "letters" not in cache:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for first, last in ((0, 0x33480), (0xE0100, 0xE01F0)):  # no letter stands outside of these planes
            for c in range(first, last):
                if unicodedata.category(chr(c))[0] == "L":
                    low = chr(c).lower()
                    table[c] = ord(low) if len(low) == 1 else c
        cache["letters"] = table
    return cache["letters"]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the text each belongs to, and whether each text has a letter."""
    bucket, owner, found, _ = grams_and_units(texts, numbered=False)
    return bucket, owner, found


def grams_and_units(texts: list[bytes], numbered: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like ``grams``, and, if ``numbered``, for each n-gram the number of the word, or part of a long word, that it begins in.

    Runs of anything but letters count as one space, and one stands before each text; an n-gram must hold a letter.
    """
    led = ["\n" + t.decode() for t in texts]
    points = np.frombuffer("".join(led).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(led), dtype=np.int32), [len(t) for t in led])
    chars = letters()[points]
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32) | (owner[1:] != owner[:-1])
    chars, owner = chars[keep].astype(np.uint64), owner[keep]
    letter = chars != 32
    found = np.zeros(len(texts), dtype=bool)
    found[owner[letter]] = True
    if numbered:
        at = np.arange(len(chars))
        unit = np.cumsum((at - np.maximum.accumulate(np.where(letter, 0, at))) % UNIT == 0) - 1
    buckets, owners, units = [], [], []
    for order in ORDERS:
        n = len(chars) - order + 1
        if n <= 0:
            continue
        value = np.full(n, order, dtype=np.uint64)
        some = np.zeros(n, dtype=bool)
        for k in range(order):
            value = (value + chars[k : n + k]) * np.uint64(MULTIPLIERS[k])
            some |= letter[k : n + k]
        some &= owner[:n] == owner[order - 1 : n + order - 1]
        value ^= value >> np.uint64(29)
        buckets.append(((value * np.uint64(MULTIPLIERS[0])) >> np.uint64(64 - 15)).astype(np.int32)[some])
        owners.append(owner[:n][some])
        if numbered:
            units.append(unit[:n][some])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), found, np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners), found, np.concatenate(units) if numbered else np.zeros(0, np.int64)


def likelihoods(bucket: np.ndarray, owner: np.ndarray, unit: np.ndarray, tables: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """For each of n texts the mean of its n-grams by the tables, by the best one for each unit; the spread of units; units."""
    grams_in = np.bincount(unit)
    best = np.max([np.bincount(unit, weights=table[bucket]) for table in tables], axis=0)
    text = np.zeros(len(grams_in), dtype=np.int64)
    text[unit] = owner
    used = grams_in > 0
    grams_in, best, text = grams_in[used], np.maximum(best, WORST_UNIT * grams_in)[used], text[used]
    total = np.maximum(np.bincount(text, weights=grams_in, minlength=n), 1)
    mean = np.bincount(text, weights=best, minlength=n) / total
    units = np.bincount(text, minlength=n)
    spread = np.bincount(text, weights=(best - grams_in * mean[text]) ** 2, minlength=n) / total**2 * units
    return mean, spread, units


def learned_langs(labelled: DataFrame, most: int = MOST_LANGS) -> list[str]:
    """The languages with the most rows, ``most`` of them at most, so that what reaches the driver has a bound."""
    counted = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    return [r["lang"] for r in counted.collect()]


def gram_counts(labelled: DataFrame, most: int = MOST_LANGS) -> dict[str, np.ndarray]:
    """Counts by bucket for each of the ``most`` most frequent languages of rows (text, lang), over all rows of them."""
    labelled = labelled.filter(F.col("lang").isin(learned_langs(labelled, most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
            for low, high in slices([len(t) for t in texts], SLICE):
                here = sorted(set(langs[low:high]))
                number = np.array([here.index(x) for x in langs[low:high]], dtype=np.int64)
                bucket, owner, _ = grams(texts[low:high])
                counted = np.bincount(number[owner] * BUCKETS + bucket, minlength=len(here) * BUCKETS)
                for i, lang in enumerate(here):
                    total = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    total += counted[i * BUCKETS : (i + 1) * BUCKETS]
        for lang, total in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                total += np.frombuffer(counts, dtype=np.int64)
        for lang, total in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [total.tobytes()]})

    fields = "lang string, counts binary"
    by_task = in_arrow(labelled.select("text", "lang"), run, fields)
    summed = in_arrow(by_task.repartition("lang"), add, fields)
    return {r["lang"]: np.frombuffer(r["counts"], dtype=np.int64) for r in summed.collect()}


def code(n: int) -> np.ndarray:
    """Codewords as rows of 0 and 1: all splits of few languages, well separated random ones of many."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= EXHAUSTIVE:
        rows = [(1, *rest) for rest in itertools.product((0, 1), repeat=n - 1) if not all(rest)]
        return np.array(rows, dtype=np.int8).T
    best, widest = None, -1
    for seed in range(20):
        tried = np.random.default_rng(seed).integers(0, 2, (n, BITS)).astype(np.int8)
        tried = tried[:, (tried.min(axis=0) == 0) & (tried.max(axis=0) == 1)]
        apart = (tried[:, None] != tried[None]).sum(axis=2) + BITS * np.eye(n, dtype=np.int64)
        if apart.min() > widest:
            best, widest = tried, apart.min()
    return best


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits: log odds, scaled so that a usual text's margin is about 1
    trust: np.ndarray  # bits: how well each separates its languages
    tables: np.ndarray | None = None  # languages x buckets: log rates, a usual text's mean being about 0
    usual: np.ndarray | None = None  # languages x (mean of a usual row, variance of rows, variance of units)

    def fits(self, best: np.ndarray, mean: np.ndarray, units: np.ndarray) -> np.ndarray:
        """How far texts are from usual rows of the languages, in deviations; few units may deviate more."""
        centre, of_rows, of_units = self.usual[best].T
        return (mean - centre) / np.sqrt(of_rows + of_units / np.maximum(units, 1))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest language, score) of rows of margins."""
        loss = np.exp(-np.clip(self.words[None] * margins[:, None], -8, 8))
        total = (loss * self.trust).sum(axis=2) / self.trust.sum()
        nearness = np.exp(-SHARPNESS * (total - total.min(axis=1, keepdims=True)))
        scores = nearness / nearness.sum(axis=1, keepdims=True)
        best = scores.argmax(axis=1)
        return best, scores[np.arange(len(best)), best]


def usual_rows(labelled: DataFrame, langs: list[str], tables: np.ndarray) -> np.ndarray:
    """For each language what its rows usually have by the tables: the middle, the variance of rows and that of units."""
    shared = labelled.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for low, high in slices([len(t) for t in texts], SLICE):
                bucket, owner, found, unit = grams_and_units(texts[low:high])
                if not len(bucket):
                    continue
                mean, spread, _ = likelihoods(bucket, owner, unit, shared.value, high - low)
                rows = [batch.column(1).slice(low, high - low), pa.array(mean), pa.array(spread)]
                yield pa.RecordBatch.from_arrays(rows, names=["lang", "mean", "spread"]).filter(pa.array(found))

    measured = in_arrow(labelled.select("text", "lang"), run, "lang string, mean double, spread double")
    middle = F.percentile_approx("mean", [0.05, 0.5], 10_000).alias("mean")
    found = {r["lang"]: r for r in measured.groupBy("lang").agg(middle, F.percentile_approx("spread", 0.5, 10_000).alias("spread")).collect()}
    usual = []
    for lang in langs:
        low, centre = found[lang]["mean"] if lang in found else (0.0, 0.0)
        usual.append((centre, max((centre - low) / 1.645, LEAST_SPREAD) ** 2, found[lang]["spread"] if lang in found else 1.0))
    return np.array(usual)


def fit(labelled: DataFrame, judging: bool = True) -> Model:
    """A model of rows (text, lang) without nulls. Without any rows it knows no language.

    Without ``judging`` it only tells languages apart, and the rows are read once instead of twice.
    """
    counts = gram_counts(labelled)
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.ones(1))
    rates = np.array([counts[x] for x in langs], dtype=np.float64) + SMOOTHING
    rates /= rates.sum(axis=1, keepdims=True)
    words = code(len(langs)) * 2.0 - 1
    weights, trust = [], []
    for bit in words.T:
        if (bit > 0).all():
            weights.append(np.zeros(BUCKETS))
            trust.append(1.0)
            continue
        odds = np.log(rates[bit > 0].mean(axis=0)) - np.log(rates[bit < 0].mean(axis=0))
        usual = bit * (rates @ odds)  # each language's expected margin, on its own side if positive
        weights.append(odds / max(usual.mean(), 1e-9))
        trust.append(max(usual.min(), 0.0) + 0.05 * max(usual.mean(), 0.0) + 1e-9)
    model = Model(langs, words, np.array(weights, dtype=np.float32).T.copy(), np.array(trust))
    if judging:
        # The learned rows are judged without what each of them has added to the counts, as other texts are.
        without = np.log(np.maximum(np.array([counts[x] for x in langs]) - 1, 0) + SMOOTHING)
        without -= np.log(np.exp(without).sum(axis=1, keepdims=True))
        centre = (rates * without).sum(axis=1, keepdims=True)
        model.tables = (np.log(rates) - centre).astype(np.float32)
        model.usual = usual_rows(labelled, langs, (without - centre).astype(np.float32))
    return model


PREDICTED = "lang_pred string, score double, ambiguous boolean, margins array<float>, fit double"


def predict(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` (text and others) with lang_pred, score, ambiguous, the margins of the code's bits and fit.

    Whole texts are read, and nothing but texts. A null text, one without letters, or a model that knows no language
    gives ``und`` with score 0, not ambiguous, and fit null, as from a model that does not judge. A model of one
    language answers it with score 1. Repeated rows are
    predicted each; columns named like the added ones are replaced. Without ``keep_text`` the text is left out.
    """
    # Plain values, as workers may not have this module.
    values = (model.langs, model.words, model.weights, model.trust, model.tables, model.usual)
    shared = docs.sparkSession.sparkContext.broadcast(values)
    added = StructType.fromDDL(PREDICTED)
    docs = docs.drop(*added.names)
    at = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]
    result = StructType([docs.schema.fields[i] for i in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        bits = model.weights.shape[1]
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            for low, high in slices([len(t) for t in texts], SLICE):
                bucket, owner, found, unit = grams_and_units(texts[low:high], numbered=model.usual is not None)
                n = high - low
                count = np.maximum(np.bincount(owner, minlength=n), 1)
                margins = np.stack(
                    [np.bincount(owner, weights=model.weights[bucket, b], minlength=n) / count for b in range(bits)], axis=1
                )
                if model.langs:
                    best, score = model.decode(margins)
                else:
                    best, score, found = np.zeros(n, int), np.zeros(n), np.zeros(n, dtype=bool)
                names = [model.langs[b] if f else UNKNOWN for b, f in zip(best, found)]
                score = np.where(found, score, 0.0)
                fitting = np.zeros(n)
                judged = found & (model.usual is not None)
                if judged.any():
                    mean, _, units = likelihoods(bucket, owner, unit, model.tables, n)
                    fitting = model.fits(best, mean, units)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(low, n) for i in kept],
                        pa.array(names, pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(found & (score < AMBIGUOUS)),
                        pa.array(list(margins.astype(np.float32)), pa.list_(pa.float32())),
                        pa.array(fitting, pa.float64(), mask=~judged),
                    ],
                    names=result.names,
                )

    return in_arrow(docs, run, result)


def known_language(predicted: DataFrame, model: Model) -> DataFrame:
    """The rows in a language that the model knows: some letters, and n-grams about as likely as in the learned rows.

    Short texts may deviate more, and mixed ones are judged word by word, so both stay. Texts without letters, in
    languages that were not learned, and junk made of letters go. A model that does not judge keeps all with letters.
    """
    known = F.col("lang_pred") != UNKNOWN
    return predicted.filter(known if model.usual is None else known & (F.col("fit") >= LEAST_FIT))


def known_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (text and others) that ``known_language`` keeps, with all their columns as they were."""
    predicted = predict(carried(docs, ["text"]), model)
    return unpacked(known_language(predicted, model), docs.columns, ["text"])


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def labelled_part(docs: DataFrame) -> DataFrame:
    """What may be learned from: rows with a language and a text outside of the held-out third."""
    learnable = F.coalesce(remainder(F.col("doc_id")) != 1, F.lit(False))
    return docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")


def op2_lang_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs.select("doc_id", "text"), fit(labelled_part(docs), judging=False), keep_text=False).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "ambiguous",
    )
