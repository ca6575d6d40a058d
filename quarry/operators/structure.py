"""Structural units of legal texts with exact code-point offsets.

A document is one row and its units come from one pass over its text in an Arrow-batched function, in time linear in its length: offsets are the matches' own, which
Spark's regular-expression functions don't give. Documents of any size come in pieces, rows of their own: what relates units of different pieces (ends, contexts, owners) is
carried by windows over a small summary of each piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ship

#: The levels in order and what marks their headings, from the first character of a line that isn't blank.
PATTERNS = {
    "part": r"Phần\s+([IVXLCDM]+|\d+)\s*[\.\:\-]?\s*(.*)$",
    "chapter": r"Chương\s+([IVXLCDM]+|\d+)\s*[\.\:\-]?\s*(.*)$",
    "section": r"Mục\s+([IVXLCDM]+|\d+)\s*[\.\:\-]?\s*(.*)$",
    "article": r"Điều\s+(\d+[A-Za-z]?)\s*[\.\:\-]?\s*(.*)$",
    "clause": r"(\d+)\s*[\.\)]\s+(.+)$",
    "point": r"([a-zđ])\s*[\.\)]\s+(.+)$",
    "decimal_section": r"(\d+\.\d+)\s+(.+)$",
}
#: Levels whose letters count in either case.
FOLDED = ("part", "chapter", "section", "article", "point")
RANK = {level: i for i, level in enumerate(PATTERNS)}
HARD_LEVELS = ("part", "chapter", "section")
UNITS = "array<struct<level:string,rank:int,number:string,title:string,char_start:int,char_end:int>>"

_LINES = {level: re.compile(r"^[^\S\n]*(?=\S)" + p, re.MULTILINE | (re.IGNORECASE if level in FOLDED else 0)) for level, p in PATTERNS.items()}
_UNITS_ARROW = pa.list_(pa.struct([("level", pa.string()), ("rank", pa.int32()), ("number", pa.string()), ("title", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())]))


#: A line that a heading may reach beyond: it holds no more than the parts before a title.
OPEN = re.compile(r"(?:Phần|Chương|Mục|Điều)?\s*(?:[IVXLCDM]+|\d+[A-Za-z]?|\d+\.\d+|[a-zđ])?\s*[.:\-)]?", re.IGNORECASE)


class Unit(NamedTuple):
    level: str
    rank: int
    number: str
    title: str | None
    char_start: int
    char_end: int


def java_pattern(level: str) -> str:
    """The level's pattern in Java's syntax, with Python's white space and case rules, lines ended by line feeds only."""
    return f"(?{'i' if level in FOLDED else ''}mdU)" + (r"^\s*" + PATTERNS[level]).replace(r"\s", r"[\s\x1c-\x1f]")


def fingerprint(text: Column) -> Column:
    """The levels that occur, in their order."""
    return F.filter(F.array(*[F.when(text.rlike(java_pattern(level)), F.lit(level)) for level in PATTERNS]), lambda x: x.isNotNull())


def level_units(text: str, level: str) -> Iterator[Unit]:
    """The units of one level in order; each ends where the next begins. A heading begins with the blank lines before it, as far as no heading of its level holds them."""
    before: tuple[str, str | None, int] | None = None
    free = 0  # where the last match ends
    for m in _LINES[level].finditer(text):
        start = at = m.start()
        while at > free and text[at - 1].isspace():
            at -= 1
            if at == 0 or text[at - 1] == "\n":
                start = at
        free = m.end()
        if before:
            yield Unit(level, RANK[level], *before, start)
        before = (m[1].strip(), m[2].strip() or None, start)
    if before:
        yield Unit(level, RANK[level], *before, len(text))


def units_of(text: str | None) -> list[Unit]:
    """The units of all levels by char_start, ties by level."""
    found = [u for level in PATTERNS for u in level_units(text, level)] if text else []
    return sorted(found, key=lambda u: (u.char_start, u.rank))


def levels_of(units: list[Unit]) -> list[str]:
    there = {u.level for u in units}
    return [level for level in PATTERNS if level in there]


def with_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `units`, of all levels by char_start (ties by level), and `fingerprint`. Null text: none. Texts of any length are read whole."""
    ship(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                found = [units_of(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([[u._asdict() for u in f] for f in found], _UNITS_ARROW), pa.array(list(map(levels_of, found)), pa.list_(pa.string()))], [*names, "units", "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("units", T.DataType.fromDDL(UNITS)), T.StructField("fingerprint", T.ArrayType(T.StringType()))]))


def exploded(docs: DataFrame) -> DataFrame:
    """document_id and the units' fields, a row each, of documents that have units."""
    return docs.select("document_id", F.inline("units"))


def pieces_of(text: str, size: int) -> Iterator[str]:
    """The text in pieces of `size` code points at least, which line feeds join: each ends with a line that no heading reaches beyond."""
    at, end = 0, text.find("\n", size)
    while end >= 0:
        if OPEN.fullmatch(text[max(at, text.rfind("\n", 0, end) + 1) : end].strip()):
            end = text.find("\n", end + 1)
            continue
        yield text[at:end]
        at, end = end + 1, text.find("\n", end + 1 + size)
    yield text[at:]


def _summaries(pieces: DataFrame) -> DataFrame:
    """document_id, piece, n (code points with the line feed), firsts (by level, where its first unit starts) and lasts (its last unit), counted from the piece's start."""
    ship(pieces.sparkSession)
    kind = pa.list_(pa.struct([("number", pa.string()), ("title", pa.string()), ("char_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, firsts, lasts = [], [], []
            for x in b.column(2):
                text = x.as_py()
                first, last = [None] * len(PATTERNS), [None] * len(PATTERNS)
                for level, k in RANK.items():
                    for u in level_units(text, level):
                        last[k] = u
                        if first[k] is None:
                            first[k] = u.char_start
                n.append(len(text) + 1)
                firsts.append(first)
                lasts.append([u and {"number": u.number, "title": u.title, "char_start": u.char_start} for u in last])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, kind)], ["document_id", "piece", "n", "firsts", "lasts"])

    return pieces.select(F.col("document_id").cast("string"), F.col("piece").cast("long"), "text").mapInArrow(run, "document_id string, piece long, n long, firsts array<int>, lasts array<struct<number:string,title:string,char_start:int>>")


def with_carry(pieces: DataFrame) -> DataFrame:
    """Add to each piece where it starts in its document (`at`), the document's length (`total`), and by level the last unit before the piece (`before`), where the first one after it starts (`after`) and
    whether the document has one (`levels`).

    A piece's summary is a small row of its own, and the windows run over these alone.
    """
    so_far = Window.partitionBy("document_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    to_come = Window.partitionBy("document_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    placed = _summaries(pieces).withColumn("at", F.coalesce(F.sum("n").over(so_far), F.lit(0)).cast("int")).withColumn("total", (F.sum("n").over(Window.partitionBy("document_id")) - 1).cast("int"))
    last = [F.when(F.col("lasts")[k].isNotNull(), F.struct(F.col("lasts")[k]["number"].alias("number"), F.col("lasts")[k]["title"].alias("title"), (F.col("at") + F.col("lasts")[k]["char_start"]).alias("char_start"))) for k in range(len(PATTERNS))]
    before = F.array(*[F.last(x, ignorenulls=True).over(so_far) for x in last])
    after = F.array(*[F.last(F.col("at") + F.col("firsts")[k], ignorenulls=True).over(to_come) for k in range(len(PATTERNS))])
    levels = F.array(*[F.max(F.col("firsts")[k].isNotNull()).over(Window.partitionBy("document_id")) for k in range(len(PATTERNS))])
    carry = placed.select(F.col("document_id").alias("_d"), F.col("piece").alias("_p"), "at", "total", before.alias("before"), after.alias("after"), levels.alias("levels"))
    return pieces.join(F.broadcast(carry), F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("piece") == F.col("_p"))).drop("_d", "_p")


def placed(pieces: DataFrame) -> DataFrame:
    """Add `at` and `total` alone, which need no unit."""
    n = pieces.select(F.col("document_id").alias("_d"), F.col("piece").alias("_p"), (F.length("text") + 1).alias("n"))
    w = Window.partitionBy("_d")
    carry = n.select("_d", "_p", F.coalesce(F.sum("n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("at"), (F.sum("n").over(w) - 1).cast("int").alias("total"))
    return pieces.join(F.broadcast(carry), F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("piece") == F.col("_p"))).drop("_d", "_p")


def unit_rows(pieces: DataFrame, context: bool = False, owner: str | None = None) -> DataFrame:
    """document_id, level, number, title, char_start and char_end of the units of documents in pieces (document_id, piece, text; stored, as they are read twice), a row each.

    A document's text is its pieces in order, joined by line feeds; each piece but the last ends with a line that no heading reaches beyond, as pieces_of() cuts it. `context` adds number and title of the
    part, chapter and section in force at each unit's start: the last ones until there; a chapter ends the section before it, a part ends nothing. `owner` adds, as `owner`, the number of the last unit
    of a level that has begun; as units of one level tile the text from the first on, it's the one that holds the start.
    """
    ship(pieces.sparkSession)
    kinds: dict[str, pa.DataType] = {"document_id": pa.string(), "level": pa.string(), "number": pa.string(), "title": pa.string(), "char_start": pa.int32(), "char_end": pa.int32()}
    kinds |= {f"{level}_{k}": pa.string() for level in HARD_LEVELS for k in ("number", "title")} if context else {}
    kinds |= {"owner": pa.string()} if owner else {}
    part, chapter, section = (RANK[level] for level in HARD_LEVELS)
    own = RANK.get(owner, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*b.columns, strict=True):
                document_id, text, at, total, before, after = (x.as_py() for x in row)
                units, ends = units_of(text), []
                for u in reversed(units):
                    ends.append(total if after[u.rank] is None else after[u.rank])
                    after[u.rank] = at + u.char_start
                columns = [[document_id] * len(units), [u.level for u in units], [u.number for u in units], [u.title for u in units], [at + u.char_start for u in units], ends[::-1]]
                now: list[tuple[str | None, str | None]] = [(x["number"], x["title"]) if x else (None, None) for x in before]
                if before[section] and before[chapter] and before[section]["char_start"] < before[chapter]["char_start"]:
                    now[section] = (None, None)
                found, owners = [], []
                for u in units if context or owner else ():
                    now[u.rank] = (u.number, u.title)
                    if u.rank == chapter:
                        now[section] = (None, None)
                    if context:
                        found.append((*now[part], *now[chapter], *now[section]))
                    owners.append(now[own][0])
                columns += [[f[i] for f in found] for i in range(6)] if context else []
                columns += [owners] if owner else []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    rows = with_carry(pieces).select(F.col("document_id").cast("string"), "text", "at", "total", "before", "after")
    return rows.mapInArrow(run, ", ".join(f"{k} {'int' if t == pa.int32() else 'string'}" for k, t in kinds.items()))


def fingerprints(pieces: DataFrame) -> DataFrame:
    """document_id and fingerprint (the levels that occur, in their order) of documents in pieces."""
    return pieces.groupBy("document_id").agg(F.array_compact(F.array(*[F.when(F.bool_or(F.col("text").rlike(java_pattern(level))), F.lit(level)) for level in PATTERNS])).alias("fingerprint"))
