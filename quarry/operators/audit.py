"""Data-quality audit of chunks: one row for each error (layer, chunk_id, message).

audit() holds a typed table against its rules: mode="raw" against raw_text and unpruned chunks, mode="compat" against text as written. A typed table can't tell a missing
key from a null one nor a number from its text, so audit_lines() holds the JSON lines themselves, and audit_stats() the run's statistics.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.stats import length_buckets
from quarry.operators.structure import HARD_LEVELS, level_units, placed
from quarry.session import ship

REQUIRED = ("document_id", "chunk_id", "chunk_index", "text")
NUMBERS = ("chunk_index", "char_start", "char_end", "char_length")
#: Keys of every chunk record; those of NOT_EMPTY hold more than blanks.
KEYS = ("document_id", "chunk_id", "chunk_index", "document_title", "part_number", "part_title", "chapter_number", "chapter_title", "section_number", "section_title",
        "articles", "clauses", "points", "char_start", "char_end", "char_length", "chunk_type", "is_split", "text")
NOT_EMPTY = ("document_id", "chunk_id", "text", "chunk_type")
#: Code points of a source that chunks are held against at once.
BLOCK = 4096
ERRORS = "layer string, chunk_id string, message string"


def _messages(chunks: DataFrame, docs: DataFrame | None, mode: str) -> DataFrame:
    """The chunks with `_messages`, an array of (layer, message) by the rules on a row and its neighbour, and `_blank_gap`, whether only blanks are missing before it.

    docs: a document in a row (document_id, text, units), or in pieces (see structure.unit_rows).
    """
    text = F.col("raw_text" if mode == "raw" and "raw_text" in chunks.columns else "text")
    by_doc = Window.partitionBy("document_id").orderBy("chunk_index", "char_start")
    c = chunks.select(*dict.fromkeys((*REQUIRED, *NUMBERS)), text.alias("_text"))
    c = c.withColumn("_i", F.row_number().over(by_doc) - 1).withColumn("_end", F.lag("char_end").over(by_doc))
    start, end, length = F.col("char_start"), F.col("char_end"), F.col("char_length")
    rules = [("schema", F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == ""), f"{k} is empty") for k in REQUIRED if k not in NUMBERS]
    rules += [("schema", F.col(k).isNull(), f"{k} is no integer") for k in NUMBERS]
    rules += [
        ("offsets", start < 0, "negative start"),
        ("offsets", end <= start, "end not after start"),
        ("offsets", length != end - start, "length differs from offsets"),
        ("offsets", F.col("_n") != length, "text has another length"),
        ("continuity", F.col("_i") != F.col("chunk_index"), "index jumps"),
        ("continuity", start < F.col("_end"), "overlap"),
    ]
    blank_gap = F.lit(False)
    c = c.withColumn("_n", F.length("_text"))
    if docs is not None:
        c = _held_against(c, docs)
        rules.append(("source", F.col("_total").isNotNull() & ((start < 0) | ~F.col("_same") | (F.col("_n") != F.greatest(F.least(end, F.col("_total")) - start, F.lit(0)))), "text differs from the source"))
        lost = F.coalesce("_lost", F.lit(False))
        blank_gap = F.coalesce((start > F.col("_end")) & ~lost & F.col("_total").isNotNull(), F.lit(False))
        rules.append(("continuity", (start > F.col("_end")) & lost, "text lost in a gap"))
        rules.append(("boundary", F.col("_inside"), "a part, chapter or section starts inside"))
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(layer).alias("layer"), F.lit(message).alias("message"))) for layer, bad, message in rules])
    return c.select("chunk_id", "char_length", F.filter(found, lambda x: x.isNotNull()).alias("_messages"), blank_gap.alias("_blank_gap"))


def _blocks(docs: DataFrame) -> DataFrame:
    """document_id, block, at, source and hard (where parts, chapters and sections start in it): the sources cut at the multiples of BLOCK, and where their pieces end."""
    ship(docs.sparkSession)
    whole, kept = "piece" not in docs.columns, "units" in docs.columns
    if whole:
        hard = F.transform(F.filter("units", lambda u: u["level"].isin(*HARD_LEVELS)), lambda u: u["char_start"].cast("int")) if kept else F.array().cast("array<int>")
        rows = docs.select(F.col("document_id").cast("string"), "text", F.lit(0).alias("at"), hard.alias("hard")).where("text is not null")
    else:
        rows = placed(docs).select(F.col("document_id").cast("string"), F.when(F.col("at") + F.length("text") < F.col("total"), F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"), "at", F.lit(None).cast("array<int>").alias("hard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*b.columns, strict=True):
                d, text, at, hard = (x.as_py() for x in row)
                marks: dict[int, list[int]] = {}
                for m in hard if whole else (at + u.char_start for level in HARD_LEVELS for u in level_units(text, level)):
                    marks.setdefault(m // BLOCK, []).append(m)
                starts = [at, *range((at // BLOCK + 1) * BLOCK, at + len(text), BLOCK)] if text else []
                cut = [text[s - at : (s // BLOCK + 1) * BLOCK - at] for s in starts]
                for i in range(0, len(starts), 1000):
                    own = starts[i : i + 1000]
                    columns = [pa.array([d] * len(own), pa.string()), pa.array([s // BLOCK for s in own], pa.int32()), pa.array(own, pa.int32()), pa.array(cut[i : i + 1000], pa.string()), pa.array([marks.get(s // BLOCK, []) for s in own], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["document_id", "block", "at", "source", "hard"])

    return rows.mapInArrow(run, "document_id string, block int, at int, source string, hard array<int>")


def _held_against(c: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with `_total` (the source's length, null without one), `_same` (nothing of the text differs), `_lost` (the gap before holds more than blanks) and `_inside` (a heading starts in it), without
    `_text`. A chunk meets the blocks of the source that it and its gap touch, each with its own slice alone."""
    if "piece" in docs.columns:
        totals = docs.groupBy("document_id").agg((F.sum(F.length("text") + 1) - 1).alias("_total"))
    else:
        totals = docs.groupBy("document_id").agg(F.max(F.length("text")).alias("_total"))
    totals = totals.select(F.col("document_id").cast("string").alias("_d"), "_total")
    c = c.join(totals, F.col("document_id").cast("string") == F.col("_d"), "left").drop("_d")
    zero = F.lit(0)
    start, end = F.greatest(F.col("char_start"), zero), F.least(F.col("char_end"), F.col("_total").cast("int"))
    gap, gap_end = F.greatest(F.col("_end"), zero), F.least(F.col("char_start"), F.col("_total").cast("int"))
    touched = lambda a, b: F.when(b > a, F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    keys = [x for x in c.columns if x != "_text"]
    at = F.col("_block") * BLOCK
    low, high = F.greatest(start, at), F.least(end, at + BLOCK)
    own = F.expr("substring(_text, _low - char_start + 1, _high - _low)")
    parts = c.withColumn("_block", F.explode_outer(F.array_distinct(F.concat(touched(start, end), touched(gap, gap_end)))))
    parts = parts.withColumns({"_low": low, "_high": high}).withColumn("_own", F.when(F.col("_high") > F.col("_low"), own)).drop("_text", "_low", "_high")
    blocks = _blocks(docs).select(F.col("document_id").alias("_d"), F.col("block").alias("_b"), "at", "source", "hard")
    met = parts.join(blocks, (F.col("document_id").cast("string") == F.col("_d")) & (F.col("_block") == F.col("_b")), "left")
    met = met.withColumns({"_low": low, "_a": F.greatest(low, F.col("at")), "_z": F.least(high, F.col("at") + F.length("source")), "_ga": F.greatest(gap, F.col("at")), "_gz": F.least(gap_end, F.col("at") + F.length("source"))})
    # A slice of a text that is too short is shorter than the source's and differs, as does the length then.
    same = F.when(F.col("_z") > F.col("_a"), F.expr("substring(_own, _a - _low + 1, _z - _a) = substring(source, _a - at + 1, _z - _a)")).otherwise(True)
    lost = (F.col("_gz") > F.col("_ga")) & F.expr("substring(source, _ga - at + 1, _gz - _ga)").rlike(r"(?U)[^\s\x1c-\x1f]")
    inside = F.exists("hard", lambda m: (m > F.col("char_start")) & (m < F.col("char_end")))
    met = met.select(*keys, same.alias("_same"), lost.alias("_lost"), inside.alias("_inside"))
    rest = [k for k in keys if k not in ("document_id", "_i")]
    return met.groupBy("document_id", "_i").agg(*[F.first(k).alias(k) for k in rest], F.bool_and("_same").alias("_same"), F.bool_or("_lost").alias("_lost"), F.bool_or("_inside").alias("_inside"))


def audit(chunks: DataFrame, docs: DataFrame | None = None, mode: str = "raw") -> DataFrame:
    """The errors of a typed table. Each repeat of a chunk_id is one; a negative start has no slice of the source, so its text differs too."""
    rows = _messages(chunks, docs, mode).select("chunk_id", F.inline("_messages"))
    repeated = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")
    again = repeated.select("chunk_id", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select("chunk_id", F.lit("schema").alias("layer"), F.lit("chunk_id repeats").alias("message"))
    return rows.select("layer", "chunk_id", "message").unionByName(again)


def report(errors: DataFrame, chunks: DataFrame, docs: DataFrame | None = None, mode: str = "raw") -> DataFrame:
    """metric and n: chunks, errors by layer, gaps of blanks that are tolerated, chunks over 6,000 (reported, no error), and the length buckets as the audit cuts them."""
    rows = _messages(chunks, docs, mode).agg(F.count("*").alias("chunks"), F.count_if("_blank_gap").alias("blank gaps"))
    flat = rows.unpivot([], list(rows.columns), "metric", "n")
    buckets = length_buckets(chunks, audit=True)
    return flat.unionByName(buckets.unpivot([], list(buckets.columns), "metric", "n")).unionByName(errors.groupBy(F.concat(F.lit("errors: "), "layer").alias("metric")).agg(F.count("*").alias("n")))


def line_errors(line: str | None) -> list[tuple[str | None, str]]:
    """(chunk_id, message) of a line: JSON syntax, missing keys, empty fields and numbers that aren't integers (true and 1.0 aren't). Blank lines have none."""
    if line is None or not line.strip():
        return []
    try:
        record = json.loads(line.strip())
    except (ValueError, RecursionError):
        return [(None, "not JSON")]
    if not isinstance(record, dict):
        return [(None, "not a JSON object")]
    found = [f"{k} is missing" for k in KEYS if k not in record]
    found += [f"{k} is empty" for k in NOT_EMPTY if record.get(k) is None or (isinstance(record[k], str) and not record[k].strip())]
    found += [f"{k} is no integer" for k in NUMBERS if type(record.get(k)) is not int]
    name = record.get("chunk_id")
    return [(None if name is None else str(name), m) for m in found]


def audit_lines(lines: DataFrame) -> DataFrame:
    """The errors of raw JSON lines (the only column, as spark.read.text gives it), before any typed reading."""
    ship(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [e for line in b.column(0).to_pylist() for e in line_errors(line)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (["schema"] * len(found), [e[0] for e in found], [e[1] for e in found])], ["layer", "chunk_id", "message"])

    return lines.mapInArrow(run, ERRORS)


def audit_stats(stats: DataFrame) -> DataFrame:
    """An error if the statistics (failed_documents; no row if there is no file) are missing or count failed documents."""
    failed = F.lit(0) if "failed_documents" not in stats.columns else F.coalesce(F.col("failed_documents"), F.lit(0))
    found = stats.agg(F.count("*").alias("n"), F.sum(failed).alias("failed"))
    message = F.when(F.col("n") == 0, "statistics are missing").when(F.col("failed") > 0, "documents failed")
    return found.select(F.lit("stats").alias("layer"), F.lit(None).cast("string").alias("chunk_id"), message.alias("message")).where("message is not null")


def passed(errors: DataFrame) -> bool:
    return errors.isEmpty()
