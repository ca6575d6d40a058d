"""From a folder of JSON documents to cleaned texts, structure, chunks, statistics, indexes and the audit, with a table written after each stage."""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import audit, chunking, retrieval, stats, structure
from quarry.operators.embedding import Embedder, embed
from quarry.sources import files

LOG = logging.getLogger("quarry")


@dataclass
class Config:
    target_size: int = chunking.TARGET
    soft_limit: int = chunking.SOFT
    hard_limit: int = chunking.HARD

    @classmethod
    def of(cls, given: dict | None) -> Config:
        """Known keys of `given`; others are left out."""
        return cls(**{f.name: int(given[f.name]) for f in fields(cls) if given and given.get(f.name) is not None})


def load_config(path: str) -> dict:
    """A YAML file of the driver; a missing or empty one is {}."""
    import yaml

    at = Path(path)
    return (yaml.safe_load(at.read_text(encoding="utf-8")) or {}) if at.exists() else {}


def parse(docs: DataFrame) -> DataFrame:
    """Metadata rows (METADATA_SCHEMA) of cleaned documents."""
    return structure.with_units(docs).select("document_id", "document_title", "document_link", "text", F.transform("units", lambda u: u.dropFields("rank")).alias("units"), "fingerprint")


def run_parsing(spark: SparkSession, input_dir: str, output_dir: str, tolerant: bool = False) -> DataFrame:
    """Write cleaned_data.csv and metadata.jsonl (folders); the metadata as read back."""
    docs = files.raw_documents(spark, input_dir, tolerant)
    files.write_jsonl(parse(docs), f"{output_dir}/metadata.jsonl", "overwrite")
    metadata = files.read_jsonl(spark, f"{output_dir}/metadata.jsonl", files.METADATA_SCHEMA)
    files.write_csv(metadata.select("document_id", F.col("text").alias("cleaned_text"), "document_title", F.col("document_link").alias("link")), f"{output_dir}/cleaned_data.csv", "overwrite")
    return metadata


def run_chunking(spark: SparkSession, metadata_path: str, output_dir: str, config: Config | None = None) -> dict:
    """Chunk stored metadata; write chunks.jsonl, chunks.csv (not if there are no chunks; both folders) and chunking_stats.json. Lines that aren't JSON count as failed. The statistics."""
    c = config or Config()
    rows, failed = files.read_tolerant(spark, metadata_path, files.METADATA_SCHEMA)
    made = chunking.chunk(rows, c.target_size, c.soft_limit, c.hard_limit).drop("raw_text")
    files.write_jsonl(made, f"{output_dir}/chunks.jsonl", "overwrite")
    chunks = files.read_jsonl(spark, f"{output_dir}/chunks.jsonl", files.CHUNK_SCHEMA)
    files.write_csv(chunks, f"{output_dir}/chunks.csv", "overwrite", even_if_empty=False)
    out = files.write_stats(stats.chunking_stats(chunks, stats.run_counters(rows, failed)), f"{output_dir}/chunking_stats.json")
    LOG.info("%d documents, %d failed, %d chunks", out["documents"], out["failed_documents"], out["chunks"])
    return out


def run_indexing(spark: SparkSession, chunks: DataFrame, output_dir: str, embedder: Embedder | None = None) -> None:
    """Write vectors (Parquet) and the sparse index of chunks; vectors already there stay, and their chunks aren't encoded again."""
    target = f"{output_dir}/vectors"
    try:
        there = spark.read.parquet(target).select("chunk_id")
        chunks_left = chunks.join(there, "chunk_id", "left_anti")
    except Exception as e:  # the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        chunks_left = chunks
    embed(chunks_left, embedder).write.mode("append").parquet(target)
    retrieval.Bm25Index.build(chunks, f"{output_dir}/bm25")
    chunks.select("chunk_id", "document_id", "text").write.mode("overwrite").parquet(f"{output_dir}/texts")


def run(spark: SparkSession, input_dir: str, output_dir: str, config: Config | None = None, index: bool = False, embedder: Embedder | None = None, tolerant: bool = False) -> dict:
    """All stages; the statistics."""
    run_parsing(spark, input_dir, output_dir, tolerant)
    out = run_chunking(spark, f"{output_dir}/metadata.jsonl", output_dir, config)
    if index:
        run_indexing(spark, files.read_jsonl(spark, f"{output_dir}/chunks.jsonl", files.CHUNK_SCHEMA), output_dir, embedder)
    return out


def run_audit(spark: SparkSession, chunks_path: str, source_path: str, stats_path: str, mode: str = "compat") -> tuple[DataFrame, DataFrame]:
    """(errors, report) of stored chunks against their source and statistics. Missing chunks or an empty source raise; missing statistics are an error."""
    lines = files.lines_of(spark, chunks_path).select("value")
    chunks, _ = files.read_tolerant(spark, chunks_path, files.CHUNK_SCHEMA)
    docs = files.source_documents(spark, source_path)
    if docs.isEmpty():
        raise ValueError(f"no document in {source_path}")
    try:
        counted = spark.read.option("wholetext", True).text(stats_path).select(F.get_json_object("value", "$.failed_documents").cast("long").alias("failed_documents"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        counted = spark.createDataFrame([], "failed_documents long")
    errors = audit.audit(chunks, docs, mode).unionByName(audit.audit_lines(lines)).unionByName(audit.audit_stats(counted))
    return errors, audit.report(errors, chunks, docs, mode)
