"""Sessions, the package's way to the executors' Python workers, and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()
_OWN_DIRS: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Add this package to the application's Python files, once, so that workers on every executor can import it.

    Spark 4.1 joins the partitions of a union's sides that are partitioned alike one to one, and fails where adaptive execution has coalesced these sides differently; so the session goes without that.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    path = Path(tempfile.mkdtemp(prefix="quarry-py-")) / "quarry.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir.

    Only a single-machine session (local master) may leave it unset and gets a folder of its own; a cluster must name one.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _OWN_DIRS:
            _OWN_DIRS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quarry-")
            sc.setCheckpointDir(_OWN_DIRS[sc.applicationId])
        base = _OWN_DIRS[sc.applicationId]
    return f"{base.rstrip('/')}/quarry-{sc.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read them back: the lineage ends there, and a lost executor costs no earlier stage.

    The tables of an application lie in one folder, quarry-<application id>, and may be deleted after it ends; discard() deletes those that nothing needs any more.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
