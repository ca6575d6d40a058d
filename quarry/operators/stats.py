"""Statistics of chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper ends of the length buckets; the audit counts 5,500 itself in the fourth.
ENDS = (1000, 3000, 5000, 5500)


def length_stats(chunks: DataFrame, length: str = "char_length") -> DataFrame:
    p = F.percentile(length, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    a = chunks.agg(F.min(length).alias("min"), F.max(length).alias("max"), F.round(F.avg(length), 6).alias("mean"), p.alias("p"))
    return a.select("min", "max", "mean", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("median", "p90", "p95", "p99"))])


def length_buckets(chunks: DataFrame, length: str = "char_length", audit: bool = False) -> DataFrame:
    x = F.col(length)
    fourth = (x >= 5000) & ((x <= 5500) if audit else (x < 5500))
    fifth = ((x > 5500) if audit else (x >= 5500)) & (x <= 6000)
    tests = {"lt_1000": x < 1000, "lt_3000": (x >= 1000) & (x < 3000), "lt_5000": (x >= 3000) & (x < 5000), "to_5500": fourth, "to_6000": fifth, "over_6000": x > 6000}
    return chunks.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("max"))


def duplicates(rows: DataFrame, id_: str) -> DataFrame:
    """All rows, repeats of non-empty ids, distinct ids."""
    x = F.nullif(F.col(id_).cast("string"), F.lit(""))
    return rows.agg(F.count("*").alias("total"), (F.count(x) - F.count_distinct(x)).alias("duplicates"), F.count_distinct(x).alias("unique_ids"))


def percent_of_total(rows: DataFrame, by: str) -> DataFrame:
    """by and percent: the share of all rows that each value has. The values are few; their counts meet in one task."""
    return rows.groupBy(by).count().withColumn("percent", F.round(100 * F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))), 6)).select(by, "percent")


def run_counters(metadata: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """documents, failed_documents (rows of `failed`) and fallback_documents (without articles, before chunking)."""
    no_article = ~F.array_contains(F.coalesce("fingerprint", F.array().cast("array<string>")), "article")
    n = metadata.agg(F.count("*").alias("documents"), F.count_if(no_article).alias("fallback_documents"))
    return n.select("documents", F.lit(failed.count() if failed is not None else 0).cast("long").alias("failed_documents"), "fallback_documents")


def chunking_stats(chunks: DataFrame, counters: DataFrame) -> DataFrame:
    """One row of a run: the counters, chunks, and chunk_length, length_buckets and chunks_per_document as structs (null without chunks)."""
    lengths, buckets, per = length_stats(chunks), length_buckets(chunks), chunks_per_document(chunks)
    one = lambda d, name: d.select(F.struct(*d.columns).alias(name))
    n = chunks.agg(F.count("*").alias("chunks"))
    whole = F.broadcast(counters).join(F.broadcast(n)).join(F.broadcast(one(lengths, "chunk_length"))).join(F.broadcast(one(buckets, "length_buckets"))).join(F.broadcast(one(per, "chunks_per_document")))
    return whole.select("documents", "failed_documents", "fallback_documents", "chunks", *[F.when(F.col("chunks") > 0, F.col(c)).alias(c) for c in ("chunk_length", "length_buckets", "chunks_per_document")])
