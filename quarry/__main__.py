"""python -m quarry run | audit"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from quarry.plans import pipeline

MOST_REPORTED = 20


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description="Chunk structured texts, and audit the chunks.")
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="from a folder of JSON documents to chunks and statistics")
    run.add_argument("--config", default="configs/default.yaml", help="YAML with the sections pipeline and chunking")
    run.add_argument("--input-dir")
    run.add_argument("--output-dir")
    run.add_argument("--index", action="store_true", help="also write vectors and the sparse index")
    run.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    audit = commands.add_parser("audit", help="exit 0 if chunks keep all rules, else 1")
    audit.add_argument("--chunks", default="output/chunks.jsonl")
    audit.add_argument("--source", default="output/metadata.jsonl")
    audit.add_argument("--stats", default="output/chunking_stats.json")
    audit.add_argument("--mode", default="compat", choices=["compat", "raw"])
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    if a.command == "run":
        logging.basicConfig(level=a.log_level, format="%(asctime)s - %(levelname)s - %(message)s")
        try:
            config = pipeline.load_config(a.config)
            folders = config.get("pipeline") or {}
            pipeline.run(spark, a.input_dir or folders.get("input_dir", "data/raw"), a.output_dir or folders.get("output_dir", "output"), pipeline.Config.of(config.get("chunking")), a.index)
        except Exception:
            logging.getLogger("quarry").exception("the run failed")
            return 1
        return 0
    try:
        errors, report = pipeline.run_audit(spark, a.chunks, a.source, a.stats, a.mode)
    except Exception as e:
        print(f"ERROR: {e}")
        return 1
    for r in report.orderBy("metric").collect():
        print(f"{r.metric}: {r.n}")
    first = errors.orderBy("layer", "chunk_id", "message").limit(MOST_REPORTED).collect()
    for r in first:
        print(f"{r.layer}: {r.chunk_id}: {r.message}")
    print("FAILED" if first else "PASSED")
    return 1 if first else 0


if __name__ == "__main__":
    sys.exit(main())
