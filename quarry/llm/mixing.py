"""Mixing sources to target weights, with DataFrame operations only.

Each source has a weight; all weights share a budget of words. A document gets a hash-random key; within each source the documents are
range-sorted by key, distributed prefix sums of their words are taken, and the source is cut where its exact budget ends. A source whose
budget exceeds its size repeats whole epochs first. No source takes more than `max_epochs` times its size: the level of water filling
gives what the others take instead.

Defined results. Null text: no words. Null source: a source of its own, last in order. Empty table: no rows. Repeated rows: rows of one
source and doc_id (null ids count as one id) form a unit with one key; if the cut falls inside such a unit, each of its rows is taken in
proportion. Ties of keys: by doc_id. Null doc_id: documents like others. Very long texts: a document is a row, and its words are counted in one pass.
Other columns of the input play no part, whatever their names, also names that differ by case only; mixed_documents() keeps them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, materialize, numbered, pick, prefix_sums, small

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(doc_id, F.lit(seed))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """One row per source: source, source_size, target. Sources by code point, null last, have the weights in turn.

    The table of sources is what a mix is configured by, one row each, so one task orders it.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    every = Window.partitionBy(F.lit(0))
    ranked = (
        sources.withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
    )
    before = Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(budget).cast("long") if budget is not None else F.sum("source_size").over(every)
    # The level that the budget reaches if all sources that fill up earlier are full and no other is.
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("is_open", F.col("level") < F.col("fills_at"))
    found = F.min(F.when(F.col("is_open"), F.struct("fills_at", F.col("source").isNull(), "source", "level"))).over(every)["level"]
    target = F.when(F.col("is_open"), F.col("weight") * found).otherwise(F.col("cap").cast("double"))
    return leveled.select("source", "source_size", target.alias("target"))


def cuts(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """One row per source: its target, whole epochs, and the unit in which the rest of the budget ends (cut_at, with `part` of `unit_size` words)."""
    goal = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    targets = source_targets(sized, weights, max_epochs, budget).withColumn("epochs", F.coalesce(F.try_divide(goal - F.pmod(goal, F.nullif("source_size", F.lit(0))), "source_size"), F.lit(0)).cast("long"))
    targets = small(materialize(targets.withColumn("rest", goal - F.col("epochs") * F.col("source_size")), "mix-targets"))
    units = sized.where("size > 0").groupBy("source", "key", "doc_id").agg(F.sum("size").alias("unit_size"))
    placed = prefix_sums(units, ["source"], ["key", "doc_id"], "unit_size", "ends", "mix-sums")
    t = targets.select(F.col("source").alias("_source"), "rest")
    ends_in = (F.col("ends") - F.col("unit_size") <= F.col("rest")) & (F.col("rest") < F.col("ends"))
    ending = placed.join(t, F.col("source").eqNullSafe(F.col("_source"))).where(ends_in).select("_source", F.struct("key", "doc_id").alias("cut_at"), (F.col("rest") - F.col("ends") + F.col("unit_size")).alias("part"), "unit_size")
    return materialize(targets.join(ending, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "source_size", "target", "epochs", "cut_at", "part", "unit_size"), "mix-cuts")


def _extra(key: Column, doc_id: Column, size: Column, c: str = "") -> Column:
    """Words taken of a document beyond the whole epochs."""
    at, own = F.struct(key.alias("key"), doc_id.alias("doc_id")), F.col(f"{c}cut_at")
    split = F.when(F.col(f"{c}unit_size") == size, F.col(f"{c}part")).otherwise(F.floor(size * (F.col(f"{c}part") / F.col(f"{c}unit_size"))))
    return F.coalesce(F.when(at < own, size).when(at == own, split), F.lit(0)).cast("long")


def sized_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, key of each document, written once so that the texts are read once."""
    d = pick(docs, "doc_id", "source", "text")
    return materialize(d.select("doc_id", "source", n_words(F.col("text")).alias("size"), key_of(F.col("doc_id"), seed).alias("key")), "mix-sizes")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every document; `taken` counts repeats."""
    sized = sized_documents(docs, seed)
    c = small(cuts(sized, weights, max_epochs, budget).withColumnRenamed("source", "_source"))
    taken = F.col("size") * F.col("epochs") + _extra(F.col("key"), F.col("doc_id"), F.col("size"))
    return sized.join(c, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None, seed: int = 0) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken; the copy in which a source's budget ends has its first words only.

    Documents without words belong to no budget: they are kept once if their source takes a whole epoch, else they go by their key like others.
    Texts stay where they are read: only the table of cuts, a row per source, goes to them. n_chars, where present, follows a shortened text.
    """
    sized = sized_documents(docs, seed)
    c = cuts(sized, weights, max_epochs, budget)
    c = small(c.select(*[F.col(x).alias(f"_mix_{x}") for x in c.columns]))
    names, own = docs.columns, numbered(docs)
    doc_id, source, text = (F.col(f"_c{names.index(n)}") for n in ("doc_id", "source", "text"))
    key, cut_at = key_of(doc_id, seed), F.col("_mix_cut_at")
    at = F.struct(key.alias("key"), doc_id.alias("doc_id"))
    # Only the units at the cut need their words counted.
    part = F.when(at == cut_at, _extra(key, doc_id, n_words(text), "_mix_"))
    copies = F.col("_mix_epochs") + F.when(at < cut_at, 1).otherwise(0)
    rows = own.join(c, source.eqNullSafe(F.col("_mix_source"))).withColumn("_mix_part", part).withColumn("_mix_copies", copies)
    whole = F.array_repeat(F.lit(-1).cast("long"), F.col("_mix_copies").cast("int"))
    rows = rows.withColumn("_mix_take", F.explode(F.when(F.col("_mix_part") > 0, F.concat(whole, F.array("_mix_part"))).otherwise(whole)))
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_mix_take").cast("int")), "")
    shortened = F.col("_mix_take") >= 0
    out = rows.withColumn(f"_c{names.index('text')}", F.when(shortened, first).otherwise(text))
    if "n_chars" in names:
        n = f"_c{names.index('n_chars')}"
        out = out.withColumn(n, F.when(shortened, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*own.columns).toDF(*names)
