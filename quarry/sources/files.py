"""Sources and sinks of the corpus, on any file system that Spark reads."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import clean, strip
from quarry.session import ship

CHUNK_SCHEMA = (
    "document_id string, chunk_id string, chunk_index int, document_title string, document_link string, part_number string, part_title string, chapter_number string, chapter_title string, "
    "section_number string, section_title string, articles array<string>, clauses array<string>, points array<string>, char_start int, char_end int, char_length int, chunk_type string, is_split boolean, text string"
)
METADATA_SCHEMA = "document_id string, document_title string, document_link string, text string, units array<struct<level:string,number:string,title:string,char_start:int,char_end:int>>, fingerprint array<string>"


def documents_in(value: str) -> list[tuple[str, str | None, str | None, str | None]]:
    """(id, passage, name, link) of each document of a JSON file's text.

    An object with both `passage` and `id` is one document. Of any other object, the values are that are objects with a `passage`, under their own id or else their key; of a repeated key the last counts. Ids become text as
    they are: a null id is "None". Lists and other values hold no document. A passage that is neither text nor null raises.
    """
    data = json.loads(value)
    if not isinstance(data, dict):
        return []
    several = [(None, data)] if "passage" in data and "id" in data else list(data.items())
    out = []
    for key, d in several:
        if isinstance(d, dict) and "passage" in d:
            if not isinstance(d["passage"] or "", str):
                raise ValueError(f"the passage of {d.get('id', key)!r} is no text")
            out.append((str(d.get("id", key)), d["passage"] or None, *(None if d.get(k) is None else str(d[k]) for k in ("name", "link"))))
    return out


def raw_documents(spark: SparkSession, path: str, tolerant: bool = False, normalize: bool = True) -> DataFrame:
    """document_id, text, document_title, document_link of a folder of .json files (not of its subfolders), as documents_in() finds them.

    Malformed files raise unless `tolerant`, which leaves them out. Documents that are empty once cleaned are left out. A file is read whole by one task.
    """
    ship(spark)
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value in b.column(0):
                try:
                    found = documents_in(value.as_py())
                except ValueError:
                    if not tolerant:
                        raise
                    continue
                for s in range(0, len(found), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found[s : s + 1000]], pa.string()) for i in range(4)], ["document_id", "passage", "name", "link"])

    d = raw.mapInArrow(run, "document_id string, passage string, name string, link string")
    d = d.select("document_id", clean(F.col("passage"), normalize).alias("text"), strip(F.col("name")).alias("document_title"), strip(F.col("link")).alias("document_link"))
    return d.where("text <> ''")


def entries(value: Column) -> Column:
    """key and value (JSON text, or a string itself) of each field of a JSON object, as an array of structs in their order; none for what isn't an object."""
    return F.coalesce(F.map_entries(F.from_json(value, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    return spark.read.schema(schema).json(path, mode=mode)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files that hold more than blanks, with `place`, their order in the files."""
    text = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("i")).alias("place"))
    return text.where(strip(F.col("value")) != "")


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, failed): the lines that are JSON objects of the schema, and the others as text (value). Blank lines are neither."""
    parsed = lines_of(spark, path).select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | (F.substring(strip(F.col("value")), 1, 1) != "{")
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select("value")


def source_documents(spark: SparkSession, path: str, schema: str = METADATA_SCHEMA) -> DataFrame:
    """The rows of a JSONL file under document_id, or under `id` where that is missing or empty; of rows of one id the last counts, and lines that aren't JSON are left out."""
    rows = lines_of(spark, path).select("place", F.from_json("value", f"{schema}, id string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).where("r is not null and r._corrupt is null")
    name = F.coalesce(F.nullif(F.col("r.document_id"), F.lit("")), F.nullif(F.col("r.id"), F.lit("")))
    last = rows.withColumn("_id", name).where("_id is not null").groupBy("_id").agg(F.max_by("r", "place").alias("r"))
    return last.select("_id", "r.*").drop("document_id", "id", "_corrupt").withColumnRenamed("_id", "document_id")


def read_questions(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """qid, question, answer (texts) of one JSON object, in the file's order."""
    raw = spark.read.option("wholetext", True).text(path)
    rows = raw.select(F.posexplode(entries(F.col("value"))).alias("place", "e"))
    rows = rows if first is None else rows.where(F.col("place") < first)
    q = F.from_json("e.value", "question string, answer array<string>")
    return rows.select(F.col("e.key").alias("qid"), q["question"].alias("question"), q["answer"].alias("answer"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A line of JSON for each row, nulls included."""
    df.write.option("ignoreNullFields", "false").json(path, mode=mode)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add lines to what lies there."""
    write_jsonl(df, path, "append")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", even_if_empty: bool = True) -> None:
    """With header; arrays as JSON. (Spark writes no byte-order mark.)"""
    if not even_if_empty and df.isEmpty():
        return
    arrays = [n for n, t in df.dtypes if t.startswith("array")]
    df.withColumns({n: F.to_json(n) for n in arrays}).write.csv(path, mode, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file in any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_stats(stats: DataFrame, path: str) -> dict:
    """The only row as a JSON file; fields that are null (those of a run without chunks) are left out."""
    out = {k: v for k, v in stats.first().asDict(recursive=True).items() if v is not None}
    write_file(stats.sparkSession, path, json.dumps(out, ensure_ascii=False, indent=2).encode())
    return out


def write_submission(answers: DataFrame, path: str) -> None:
    """{qid: {"answer": [...]}}, and beside it (.zip for .json) the same as the only member, submission.json, of a ZIP. A set of questions, a few thousand, fits the driver."""
    out = {r.qid: {"answer": list(r.answer)} for r in answers.orderBy("qid").collect()}
    data = json.dumps(out, ensure_ascii=False, indent=2).encode()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("submission.json", data)
    write_file(answers.sparkSession, path, data)
    write_file(answers.sparkSession, path.removesuffix(".json") + ".zip", packed.getvalue())
