"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize, new_path, ship  # noqa: F401

#: A word is a maximal run of characters other than these six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Rows up to which a table that has been written and counted is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000

def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns; others go, whatever they are called (also names that differ by case only)."""
    at = [df.columns.index(n) for n in names]
    apart = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return apart.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])


def numbered(df: DataFrame) -> DataFrame:
    """The table with its columns named _c0, _c1 and so on, so that no name clashes, also by case only; toDF(*df.columns) names them back."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def constant(numbers: Sequence[float], kind: str) -> Column:
    """A list of numbers, of a fixed length, as one array literal (the optimizer folds it)."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables from the shared folder. What is still to be computed must not read them."""
    for df in tables:
        path = df.__dict__.pop("written_at", None) if df is not None else None
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (materialized) table has at most so many rows, else the table as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, label: str) -> DataFrame:
    """Add `out`: the inclusive running sum of `value` within `keys`, in the order of `order`. No key is ever in one task as a whole.

    Rows are range-partitioned by (keys, order), so a hot key spans many partitions; each partition sums its own rows, and what a key carries
    into a later partition comes from a table with a row for each partition boundary that the key crosses. The rows with their local sums are
    written once, so that partition numbers agree between both uses.
    """
    cols = [F.col(c) for c in (*keys, *order)]
    dealt = df.repartitionByRange(*cols).withColumn("_pid", F.spark_partition_id())
    local = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = materialize(dealt.withColumn("_local", F.sum(value).over(local)), label)
    totals = summed.groupBy(*keys, "_pid").agg(F.max("_local").alias("_total"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    carried = totals.withColumn("_in", F.sum("_total").over(by_key.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    carried = materialize(carried.where("_in > 0").drop("_total"), f"{label}-carry")
    other = small(carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), "_in"))
    on = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return summed.join(other, on, "left").select(*df.columns, (F.col("_local") + F.coalesce("_in", F.lit(0))).alias(out))


def open_shared(path: str, mode: str):
    """Open a file of the shared folder, local or in any store that pyarrow reaches by its URI."""
    if path.startswith("file:") or "://" not in path:
        at = "/" + path.removeprefix("file:").lstrip("/")
        if "w" in mode:
            os.makedirs(os.path.dirname(at), exist_ok=True)
        return open(at, mode)
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    if "w" in mode:
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(at)
    return fs.open_input_file(at)


def publish(temporary: str, final: str) -> None:
    """Give a finished file its final name; a later attempt of the same task replaces it by the same bytes."""
    if temporary.startswith("file:") or "://" not in temporary:
        os.replace(*["/" + p.removeprefix("file:").lstrip("/") for p in (temporary, final)])
        return
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(temporary)
    fs.move(at, pyarrow.fs.FileSystem.from_uri(final)[1])


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow by a function of this package, which goes to the workers with it."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
