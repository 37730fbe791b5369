"""Quality rules with robust multivariate outliers.

Word statistics of every whole text become a vector of four transformed rates. For each language and source the
minimum covariance determinant is estimated from two robust starts, medians with quartile spreads and medians with the
covariance of squashed values: the closest documents are a first set, then concentration steps follow (mean and
covariance of that set, new distances, new set) until no group's determinant falls any more, and each group takes its
start with the lower one. Documents farther than a chi-square quantile from their group's centre are rejected.

Everything is DataFrame functions. Statistics are computed inside the row, once, and kept as five numbers per
document; each step aggregates those numbers by group with partial sums and mergeable quantile sketches, so a group
with a third of all rows costs its tasks no more than others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetops.llm.runtime import checkpointed, free_name, stored
from fleetops.llm.words import words

SYMBOLS = r"[^#*$%&|<>]+"  # what is not a symbol
HAS_WORD = r"[^ \t\n\x0B\f\r]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
MOST_STEPS = 40  # far more than any group was seen to need
FALL = 1e-3  # a determinant that falls by a smaller share stands still
SUPPORT = 0.75  # share of a group that the estimate rests on
MIN_GROUP = 40  # groups with fewer documents use those of their language, then all
TAIL = 1e-4  # share of a normal group beyond the limit
ACCURACY = 10_000
# Rates of short texts lean to a usual one by this many words; spreads are at least these, as most rates are 0.
PRIOR_WORDS, PRIOR_LENGTH = 20.0, 5.0
SPREADS = (0.05, 0.05, 0.08, 0.15)
DIMENSIONS = len(SPREADS)


def word_stats(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The table with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (BIGINT), under the prefix.

    A null text has no words and all counts 0. Columns of the input whose names clash are replaced; the prefix is there to
    keep them. Keep what this gives, by a checkpoint or a table, before filtering it: Spark may move a filter below its steps.
    """
    p = "__stat_"
    c = lambda name: F.col(p + name)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(HAS_WORD))
    grams = F.transform(
        F.sequence(F.lit(0), c("n") - WINDOW),
        lambda i: F.xxhash64(*[F.get(c("hashes"), i + k) for k in range(WINDOW)]),
    )
    in_order = F.array_sort(F.transform(c("grams"), lambda gram, i: F.struct(gram.alias("gram"), i.alias("at"))))
    alike = lambda x, i: F.get(c("sorted"), i).getField("gram") == x.getField("gram")
    twice = F.filter(c("sorted"), lambda x, i: ((i > 0) & alike(x, i - 1)) | F.coalesce(alike(x, i + 1), F.lit(False)))
    starts = F.array_sort(F.transform(twice, lambda x: x.getField("at")))
    reach = lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(c("starts"), i + 1) - at, F.lit(WINDOW)))
    covered = F.aggregate(F.transform(c("starts"), reach), F.lit(0), lambda total, x: total + x)
    counts = {
        "n_words": c("n"),
        "word_chars": F.char_length(F.array_join(c("words"), "")),
        "n_symbols": F.char_length(F.regexp_replace(text, SYMBOLS, "")),
        "n_dup_lines": F.size(c("lines")) - F.size(F.array_distinct(c("lines"))),
    }
    # Words and lines go before the windows are made, so that a row never holds all of it at once.
    counted = docs.withColumns({p + "words": words(text), p + "lines": lines}).withColumn(p + "n", F.size(c("words")))
    counted = counted.withColumns(
        {
            **{prefix + name: value.cast("long") for name, value in counts.items()},
            p + "hashes": F.when(c("n") >= WINDOW, F.transform(c("words"), lambda w: F.xxhash64(w))),
        }
    ).drop(p + "words", p + "lines")
    return (
        counted.withColumn(p + "grams", F.when(c("n") >= WINDOW, grams))
        .drop(p + "hashes")
        .withColumn(p + "sorted", F.when(F.size(F.array_distinct(c("grams"))) < F.size(c("grams")), in_order))
        .drop(p + "grams")
        .withColumn(p + "starts", F.when(c("sorted").isNotNull(), starts))
        .drop(p + "sorted")
        .withColumn(prefix + "n_repeat_words", F.coalesce(F.when(c("starts").isNotNull(), covered), F.lit(0)).cast("long"))
        .drop(p + "starts", p + "n")
    )


def fails_base() -> Column:
    """Too few words, or too many of them in repeated windows."""
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * n)


def transformed() -> list[Column]:
    """Log of the mean word length; roots of the shares of symbols, repeated lines and repeated words."""
    n = F.col("n_words") + F.lit(PRIOR_WORDS)
    letters = F.col("word_chars") + F.lit(PRIOR_WORDS * PRIOR_LENGTH)
    return [
        F.log(letters / n),
        F.sqrt(F.col("n_symbols") / letters),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def chi_square_share(x: float, half: int) -> float:
    """The chi-square distribution function for 2 * half degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def chi_square_limit(share: float, half: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, half) < share else (low, mid)
    return high


LIMIT = chi_square_limit(1 - TAIL, DIMENSIONS // 2)
# A normal group's closest three quarters spread less than the group; this makes up for it.
CONSISTENCY = SUPPORT / chi_square_share(chi_square_limit(SUPPORT, DIMENSIONS // 2), DIMENSIONS // 2 + 1)


def squared_distance() -> Column:
    """Mahalanobis distance by the joined centre ``m<i>`` and Cholesky factor ``l<i><j>``, squared."""
    solved: list[Column] = []
    for i in range(DIMENSIONS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
    total = solved[0] * solved[0]
    for z in solved[1:]:
        total = total + z * z
    return total


PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
CENTRE, FACTOR = [f"m{i}" for i in range(DIMENSIONS)], [f"l{i}{j}" for i, j in PAIRS]
KEYS = ["group", "start"]


def factored(moments: DataFrame, scale: float) -> DataFrame:
    """Rows (group, start, m<i>, c<i><j>) with the scaled covariances replaced by their Cholesky factor, spreads added,
    and ``det``, the log of the determinant."""
    out = moments
    for i, j in PAIRS:
        value = F.col(f"c{i}{j}") * F.lit(scale)
        if i == j:
            value = value + F.lit(SPREADS[i] ** 2)
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # Spreads keep the matrix positive; rounding may not undo that.
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(DIMENSIONS)), F.lit(0.0))
    return out.select(*KEYS, *CENTRE, *FACTOR, det.alias("det"))


def first_guesses(vectors: DataFrame) -> DataFrame:
    """Two starts for each ``group``: quartile spreads alone, and the covariance of values squashed beyond a spread."""
    quartiles = vectors.groupBy("group").agg(
        *[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], ACCURACY).alias(f"q{i}") for i in range(DIMENSIONS)]
    )
    spread = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(SPREADS[i]))
    centres = stored(
        quartiles.select(
            "group",
            *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(DIMENSIONS)],
            *[spread(i).alias(f"s{i}") for i in range(DIMENSIONS)],
        )
    )
    plain = centres.select(
        "group",
        F.lit(0).alias("start"),
        *CENTRE,
        *[(F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS],
        F.lit(float("inf")).alias("det"),
    )
    joined = vectors.join(centres, "group")
    squashed = {f"z{i}": F.tanh((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")) * F.col(f"s{i}") for i in range(DIMENSIONS)}
    moments = joined.withColumns(squashed).groupBy("group", F.lit(1).alias("start")).agg(
        *[F.first(m).alias(m) for m in CENTRE], *[F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}{j}") for i, j in PAIRS]
    )
    return plain.unionByName(factored(moments, 1.0).withColumn("det", F.lit(float("inf"))))


def estimates(vectors: DataFrame) -> DataFrame:
    """Centre and factor for each ``group`` of rows (group, x0..x3), of the start that ends with the lower determinant."""
    found = stored(first_guesses(vectors))
    for _ in range(MOST_STEPS):
        measured = vectors.join(found, "group").withColumn("d", squared_distance())
        limits = stored(measured.groupBy(*KEYS).agg(F.percentile_approx("d", SUPPORT, ACCURACY).alias("limit")))
        moments = (
            measured.join(limits, KEYS)
            .filter("d <= limit")
            .groupBy(*KEYS)
            .agg(
                *[F.avg(f"x{i}").alias(f"m{i}") for i in range(DIMENSIONS)],
                *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in PAIRS],
            )
        )
        before = found.select(*KEYS, F.col("det").alias("before"))
        stepped = stored(factored(moments, CONSISTENCY).join(before, KEYS).withColumn("falls", F.col("det") < F.col("before") - FALL))
        still = found.join(stepped.filter("NOT falls").select(*KEYS), KEYS, "left_semi").select(*found.columns)
        found = stored(stepped.filter("falls").select(*found.columns).unionByName(still))
        if stepped.filter("falls").isEmpty():
            break
    best = found.groupBy("group").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
    return found.join(best, KEYS).select("group", *CENTRE, *FACTOR)


def verdicts(stats: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``stats`` (with the columns of ``word_stats``) plus group, distance, base_failed and kept.

    Documents that fail the base rules are not kept and shape no estimate. A null language or source is a value of its
    own. Groups of under MIN_GROUP such documents are judged with all of their language, or else with all documents;
    where even those are fewer, the estimate rests on what there is. ``stats`` is worked out once and kept.
    The table's own columns come back whole; where it has one of an added name already, the added one is led by ``_``.
    """
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    lang, both = tag(lang_col), F.concat(tag(lang_col), F.lit("\u001f"), tag(source_col))
    names = [f"x{i}" for i in range(DIMENSIONS)]
    x = [value.alias(name) for name, value in zip(names, transformed())]
    own = F.struct(*[F.col(f"`{c}`") for c in stats.columns]).alias("own")
    # Kept before anything is filtered: Spark would work the arrays of word_stats out once more below a filter.
    rated = checkpointed(stats).select(own, fails_base().alias("base_failed"), *x, lang.alias("by_lang"), both.alias("by_both"))
    sound = rated.filter(~F.col("base_failed"))
    sizes = stored(sound.groupBy("by_lang", "by_both").agg(F.count("*").alias("n")))
    langs = sizes.groupBy("by_lang").agg(F.sum("n").alias("n_lang"))
    groups = stored(
        sizes.join(langs, "by_lang").select(
            "by_both",
            F.when(F.col("n") >= MIN_GROUP, F.concat(F.lit("2"), F.col("by_both")))
            .when(F.col("n_lang") >= MIN_GROUP, F.concat(F.lit("1"), F.col("by_lang")))
            .otherwise(F.lit("0"))
            .alias("group"),
        )
    )
    levels = F.explode(
        F.array(F.concat(F.lit("2"), F.col("by_both")), F.concat(F.lit("1"), F.col("by_lang")), F.lit("0"))
    )
    vectors = sound.select(levels.alias("group"), *names).join(groups.select("group").distinct(), "group", "left_semi")
    found = estimates(vectors)
    judged = (
        rated.join(groups, "by_both", "left")
        .join(found, "group", "left")
        .withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(squared_distance())))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= math.sqrt(LIMIT), F.lit(False)))
    )
    added = [F.col(c).alias(free_name(stats.columns, c)) for c in ("group", "distance", "base_failed", "kept")]
    return judged.select("own.*", *added)


def op4_outliers(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return verdicts(word_stats(docs).select("doc_id", "lang", "source", *counts)).select("doc_id", *counts, "base_failed", "kept")
