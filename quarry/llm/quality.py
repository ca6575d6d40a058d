"""Quality rules, with DataFrame operations only.

Every document gets base counts and a score: the mean, over its words and word pairs, of the log-likelihood ratio between two multinomials
over hashed n-grams, that of trusted documents and that of the raw corpus. The raw counts are taken over all documents; the trusted target
may be a bounded sample of labelled rows (TRUSTED_ROWS). A document is kept if it passes the base rules and its score reaches a threshold
that follows from the trusted documents' own scores. No randomness is involved: each document's verdict follows from the tables alone.

Defined results. Null or empty text: all counts 0, base_failed. Repeated rows: each has its own result. No trusted documents: the ratio is 0
everywhere, so only base rules decide. Null doc_id: judged like others, never trusted. Labels that repeat or contradict each other: an id with a good
label is trusted. Ties of scores: equal texts have equal verdicts. Very long texts: judged whole, in one task's memory. Empty table: no rows. Other columns
of the input play no part, whatever their names, also names that differ by case only; keep_good() keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, WORD_GAP, constant, numbered, pick

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30  # in 100 words
#: Hash buckets of n-grams; two arrays of so many numbers are all that comes to the driver.
BUCKETS = 1 << 14
#: Labelled documents that the target may be fitted on at most: those whose ids have the smallest hashes.
TRUSTED_ROWS = 20_000
#: Counts added to each bucket, in proportion to the raw corpus, so that the ratio of an unseen bucket is 0.
PRIOR = 20.0
#: Words by which a score is shrunk towards 0: the ratio of a short text is mostly chance.
SHRINK = 30
#: The threshold lies so many standard deviations of the trusted documents' scores below their mean.
DEVIATIONS = 4.5


def _n(a: Column) -> Column:
    return F.size(a).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def _windows(hashes: Column, window: int) -> Column:
    """A 64-bit hash of each window of so many words, from the words' hashes."""
    n = F.size(hashes)
    return F.when(n < window, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)])))


def _repeated(held: Column) -> Column:
    """Where the windows start that equal another, from the sorted (h, i) of all windows."""

    def equal(k: Column, other: Column) -> Column:
        return F.coalesce(F.get(held, k)["h"] == F.get(held, other)["h"], F.lit(False))

    at = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda k: equal(k, k - 1) | equal(k, k + 1))
    return F.array_sort(F.transform(at, lambda k: F.get(held, k)["i"]))


def base_counts(docs: DataFrame) -> DataFrame:
    """Add _words_h (the words' hashes) and the base counts to doc_id, text."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    d = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_words", words_of(F.col("text")))
    d = d.withColumn("_lines", lines).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    d = d.withColumn("n_words", _n(F.col("_h")))
    d = d.withColumn("word_chars", F.length(F.translate("text", BLANKS, "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"))
    d = d.withColumn("n_dup_lines", _n(F.col("_lines")) - _n(F.array_distinct("_lines")))
    d = d.withColumn("_windows", _windows(F.col("_h"), WINDOW)).drop("text", "_words", "_lines")
    held = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    any_repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    d = d.withColumn("_held", F.when(any_repeated, held))
    d = d.withColumn("_at", F.when(F.col("_held").isNotNull(), _repeated(F.col("_held"))).otherwise(F.array().cast("array<int>")))
    steps = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(WINDOW))))
    d = d.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("_windows", "_held", "_at")


def _buckets(h: Column, buckets: int) -> Column:
    """Hash buckets of the words and of the word pairs."""
    pairs = F.transform(h, lambda w, i: F.xxhash64(w, F.get(h, i + 1)))
    return F.concat(F.transform(h, lambda w: F.pmod(w, F.lit(buckets)).cast("int")), F.transform(F.slice(pairs, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), lambda w: F.pmod(w, F.lit(buckets)).cast("int")))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of documents labelled good (quality 1, not toxic): all, or those `rows` with the smallest hashes."""
    good = pick(labels, "doc_id", "quality", "toxic").where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


class QualityModel:
    """Log ratios of the buckets, as a list of numbers of fixed length, and the threshold."""

    def __init__(self, ratios: list[float], threshold: float):
        self.ratios, self.threshold = ratios, threshold

    def score(self, h: Column) -> Column:
        """Sum of the ratios over the words and word pairs, by their number plus SHRINK."""
        table, n = constant(self.ratios, "double"), len(self.ratios)

        def ratio(x: Column) -> Column:
            return F.get(table, F.pmod(x, F.lit(n)).cast("int"))

        total = F.aggregate(h, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("bigint").alias("p")), lambda a, w: F.struct((a["s"] + ratio(w) + F.when(a["p"].isNull(), 0.0).otherwise(ratio(F.xxhash64(a["p"], w)))).alias("s"), w.alias("p")))["s"]
        return total / (2 * F.size(h) + SHRINK)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> QualityModel:
    """Count the n-grams of all documents and those of the trusted ones, in one pass, then score the trusted ones for the threshold.

    The trusted ids are at most `trusted_rows`, so they are broadcast whatever the size of the data.
    """
    trusted = F.broadcast(trusted_ids(labels, trusted_rows).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good")))
    d = pick(docs, "doc_id", "text").join(trusted, F.col("doc_id") == F.col("_id"), "left")
    d = d.select("_good", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    grams = d.select("_good", F.explode(_buckets(F.col("h"), buckets)).alias("b"))
    counted = grams.groupBy("b").agg(F.count("*").alias("n"), F.count("_good").alias("good"))
    raw, good = [0] * buckets, [0] * buckets
    for b, n, g in counted.collect():  # a row for each bucket at most
        raw[b], good[b] = n, g
    n_raw, n_good = sum(raw), sum(good)
    if not n_good:
        return QualityModel([0.0] * buckets, -1.0)
    p_raw = [r / n_raw for r in raw]
    ratios = [math.log((g + PRIOR * buckets * p) / (n_good + PRIOR * buckets) / p) if p else 0.0 for g, p in zip(good, p_raw, strict=True)]
    model = QualityModel(ratios, 0.0)
    scores = d.where("_good = 1").select(F.round(model.score(F.col("h")), 9).alias("s"))
    # Sums over sorted integers agree between runs, whatever the order of rows.
    s = scores.select((F.col("s") * 1e9).cast("long").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("t"), F.sum(F.col("s").cast("decimal(38,0)") * F.col("s")).alias("q")).first()
    mean = float(s.t) / s.n / 1e9
    var = max(0.0, float(s.q) / s.n / 1e18 - mean * mean)
    model.threshold = mean - DEVIATIONS * math.sqrt(var)
    return model


def _held_up(verdict: Column) -> Column:
    """The verdict, such that filters on it or on its fields stay above it.

    The id only marks the column as non-deterministic: else the optimizer moves a filter below the projections and writes out the nested
    arrays at each of their uses, also within lambdas, which then compute them anew for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, verdict)


def judge(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of every document."""
    model = model or fit(docs, labels)
    d = base_counts(pick(docs, "doc_id", "text")).withColumn("score", model.score(F.col("_h")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= model.threshold))
    return d.select(_held_up(F.struct("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")).alias("_verdict")).select("_verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """The rows of `docs`, with all their columns, that judge() keeps."""
    model = model or fit(docs, labels)
    names, own = docs.columns, numbered(docs)
    inner = own.select(F.struct(*own.columns).alias("_row"), F.col(f"_c{names.index('text')}").alias("text"))
    kept = ~F.col("base_failed") & (model.score(F.col("_h")) >= model.threshold)
    return base_counts(inner).withColumn("_kept", _held_up(kept)).where("_kept").select("_row.*").toDF(*names)
