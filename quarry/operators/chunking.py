"""Structure-respecting chunks of bounded size.

A document stays one row until its chunks are cut: units, stretches, the greedy fold, contexts, texts, pruning and marks are one pass over a document in an Arrow-batched
function, in time linear in its length, and what comes out are the chunks' small rows; names and enriched texts are columns of these. So nothing is shuffled, and no document's text is carried beside
each of its chunks.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Callable, Collection, Iterable, Iterator
from itertools import groupby, pairwise
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import chunk_id, enriched, tail_after_prefix, word_count
from quarry.operators.sizes import small
from quarry.operators.structure import HARD_LEVELS, PATTERNS, RANK, Unit, placed, units_of, with_carry
from quarry.session import materialize, ship

TARGET, SOFT, HARD = 5000, 5000, 6000
MIN_WORDS = 5
#: What preambles that are boilerplate hold.
MOTTOS = ("CỘNG HÒA XÃ HỘI", "Độc lập - Tự do")
#: What is cut from a document; chunk_id and text follow from it.
CUT = (
    "document_id string, chunk_index int, document_title string, document_link string, part_number string, part_title string, chapter_number string, chapter_title string, "
    "section_number string, section_title string, articles array<string>, clauses array<string>, points array<string>, char_start int, char_end int, char_length int, chunk_type string, "
    "is_split boolean, raw_text string"
)
#: Code points of chunks that a batch of the result holds, about.
BATCH_CHARS = 1 << 19
_BREAK = re.compile(r"\n(?:\s*\n)?")


class Stretch(NamedTuple):
    start: int
    end: int
    level: str
    articles: tuple[str, ...] = ()
    clauses: tuple[str, ...] = ()
    border: bool = False


def strides(s: Stretch, target: int) -> Iterator[Stretch]:
    for at in range(s.start, s.end, target):
        yield s._replace(start=at, end=min(at + target, s.end), level="hard_char", border=s.border and at == s.start)


def lines(text: str, s: Stretch, target: int, hard: int) -> Iterator[Stretch]:
    """By lines, a blank line going with the line before; a line over `hard` in strides."""
    ends = [s.start + m.end() for m in _BREAK.finditer(text[s.start : s.end])]
    if not ends or ends[-1] < s.end:
        ends.append(s.end)
    at = s.start
    for end in ends:
        line = s._replace(start=at, end=end, level="paragraph", border=s.border and at == s.start)
        yield from strides(line, target) if end - at > hard else (line,)
        at = end


def main_level(levels: Collection[str]) -> str:
    return next((x for x in ("article", "clause") if x in levels), "paragraph")


def stretches(text: str, units: list[Unit], target: int, hard: int, main: str | None = None, owner: str | None = None) -> Iterator[Stretch]:
    """The document cut at its borders and its main level; what is over `hard` by clauses, lines or strides. Of a piece of a document, that begins at such a cut, `main` is the document's level
    and `owner` the number of the level's unit that the piece begins in."""
    n = len(text)
    main = main or main_level({u.level for u in units})
    own = [u for u in units if u.level == main]
    clauses = [u for u in units if u.level == "clause"]
    at_clause = [u.char_start for u in clauses]
    borders = {u.char_start for u in units if u.level in HARD_LEVELS}
    cuts = sorted({0, n, *(x for x in borders if x < n), *(u.char_start for u in own)})
    k = -1
    for start, end in pairwise(cuts):
        while k + 1 < len(own) and own[k + 1].char_start <= start:
            k += 1
        # Units of one level tile the text from the first on, so the last that has begun is the owner.
        name = own[k].number if k >= 0 else owner
        number = (name,) if name else ()
        s = Stretch(start, end, main, number if main == "article" else (), number if main == "clause" else (), start in borders)
        if end - start <= hard:
            yield s
        elif main == "clause":
            yield from lines(text, s, target, hard)
        elif main == "article" and (i := bisect_left(at_clause, start)) < (j := bisect_left(at_clause, end)):
            parts = [s._replace(end=at_clause[i], level="clause")] + [s._replace(start=at_clause[x], end=at_clause[x + 1] if x + 1 < j else end, level="clause", clauses=(clauses[x].number,), border=at_clause[x] in borders) for x in range(i, j)]
            for part in parts:
                if part.end > part.start:
                    yield from lines(text, part, target, hard) if part.end - part.start > hard else (part,)
        else:
            yield from strides(s, target)


def pack(parts: Iterable[Stretch], soft: int, hard: int) -> Iterator[list[Stretch]]:
    """Greedy: a stretch at a border opens a chunk, as does one that would reach beyond `hard`; one that reaches beyond `soft` closes it."""
    held: list[Stretch] = []
    for s in parts:
        if held and (s.border or s.end - held[0].start > hard):
            yield held
            held = []
        held.append(s)
        if len(held) > 1 and s.end - held[0].start > soft:
            yield held
            held = []
    if held:
        yield held


def contexts(units: list[Unit], starts: Iterable[int]) -> Iterator[dict[str, Unit]]:
    """The part, chapter and section in force at each of the ascending positions; a chapter ends the section before it, a part ends nothing."""
    now: dict[str, Unit] = {}
    marks = iter([u for u in units if u.level in HARD_LEVELS])
    mark = next(marks, None)
    for at in starts:
        while mark and mark.char_start <= at:
            if mark.level == "chapter":
                now.pop("section", None)
            now[mark.level] = mark
            mark = next(marks, None)
        yield dict(now)


def is_short(raw: str) -> bool:
    return len(raw.rpartition("]\n")[2].split()) < MIN_WORDS  # as of the enriched text, whose first line ends so


def record(document_id: str | None, title: str | None, link: str | None, i: int, c: list[Stretch], now: dict[str, Unit], raw: str) -> dict[str, Any]:
    """CUT of a chunk whose stretches and context are known."""
    articles, clauses = (list(dict.fromkeys(a for x in c for a in of(x))) for of in (lambda x: x.articles, lambda x: x.clauses))
    context = {f"{level}_{k}": getattr(now[level], k) if level in now else None for level in HARD_LEVELS for k in ("number", "title")}
    start, end = c[0].start, c[-1].end
    return {
        "document_id": document_id, "chunk_index": i, "document_title": title, "document_link": link, **context,
        "articles": articles, "clauses": clauses, "points": [], "char_start": start, "char_end": end, "char_length": end - start, "chunk_type": c[0].level,
        "is_split": any(x.level in ("paragraph", "hard_char") for x in c), "raw_text": raw,
    }


def document_chunks(document_id: str | None, title: str | None, link: str | None, text: str | None, packed: Callable[[str, list[Unit]], Iterable[list[Stretch]]], prune: bool, structure: bool = True) -> list[dict[str, Any]]:
    """CUT of the chunks of one document: numbered, pruned, then marked where chunks have an article (or, without articles, a clause) in common."""
    if not text:
        return []
    units = units_of(text) if structure else []
    cut = list(packed(text, units))
    out = []
    for i, (c, now) in enumerate(zip(cut, contexts(units, [c[0].start for c in cut]), strict=True)):
        raw = text[c[0].start : c[-1].end]
        if not (prune and is_short(raw)):
            out.append(record(document_id, title, link, i, c, now, raw))
    keys = [[("a", x) for x in r["articles"]] or [("c", x) for x in r["clauses"]] for r in out]
    seen = Counter(k for own in keys for k in own)
    for r, own in zip(out, keys, strict=True):
        r["is_split"] = r["is_split"] or any(seen[k] > 1 for k in own)
    return out


def chunk(docs: DataFrame, target: int = TARGET, soft: int = SOFT, hard: int = HARD, prune: bool = True, cut: str = "structure") -> DataFrame:
    """Chunk records of documents (document_id, document_title, document_link, text), cut by their structure, by `lines` alone, or `plain` as texts without structure.

    Null or empty text: no chunk. Null document_id: chunks without chunk_id. Repeated rows: each is chunked. raw_text stays beside the enriched text.
    """
    ship(docs.sparkSession)
    if cut == "lines":
        packed = lambda t, units: pack(lines(t, Stretch(0, len(t), "clause"), target, hard), soft, hard)
    else:
        packed = lambda t, units: pack(stretches(t, units, target, hard), soft, hard)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, chars = [], 0
            for row in zip(*(c for c in b.columns), strict=True):
                for r in document_chunks(*(x.as_py() for x in row), packed, prune, cut == "structure"):
                    rows.append(r)
                    chars += r["char_length"]
                    if chars >= BATCH_CHARS:
                        yield cut_batch(rows)
                        rows, chars = [], 0
            if rows:
                yield cut_batch(rows)

    return named(docs.select(F.col("document_id").cast("string"), "document_title", "document_link", "text").mapInArrow(run, CUT))


def cut_batch(rows: list[dict[str, Any]], extra: dict[str, pa.DataType] | None = None) -> pa.RecordBatch:
    by_kind = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    kinds = {name: by_kind[kind] for name, kind in (f.split() for f in CUT.split(", "))} | (extra or {})
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


def named(made: DataFrame) -> DataFrame:
    """Cut rows with chunk_id and the enriched text."""
    name = F.when(F.col("document_id").isNotNull(), chunk_id(F.col("document_id"), F.col("chunk_index")))
    text = enriched(F.col("raw_text"), *(F.col(c) for c in ("document_title", "chapter_title", "section_title", "articles")))
    return made.select("document_id", name.alias("chunk_id"), *[c for c in made.columns if c not in ("document_id", "raw_text")], text.alias("text"), "raw_text")


def section_chunks(rows: Iterable[tuple], target: int, soft: int, hard: int, prune: bool, structure: bool) -> Iterator[dict[str, Any]]:
    """CUT, section and kept of the chunks of one section, numbered from 0, from its pieces in order: (document_id, section, document_title, document_link, text, at, total, before, levels).

    The fold takes stretches as the pieces give them, so no more than an open chunk's pieces are held. A chunk that is pruned is a row without text.
    """
    texts: list[tuple[int, str]] = []  # where they start, and the pieces that chunks may still need
    marks: deque[Unit] = deque()
    now: dict[str, Unit] = {}
    head: list[tuple] = []

    def cut(held: tuple) -> Iterator[Stretch]:
        text, at, total, before, levels = held
        if at + len(text) < total:
            text += "\n"
        texts.append((at, text))
        if not structure:
            yield Stretch(at, at + len(text), "paragraph")
            return
        main = main_level([level for level, there in zip(PATTERNS, levels, strict=True) if there])
        units = units_of(text)
        marks.extend(u._replace(char_start=at + u.char_start) for u in units if u.level in HARD_LEVELS)
        entered = before[RANK[main]] if main in RANK else None
        inside = [u.number for u in units if u.level == main]
        for s in stretches(text, units, target, hard, main, owner[0] or (entered and entered["number"])):
            yield s._replace(start=at + s.start, end=at + s.end)
        owner[0] = inside[-1] if inside else owner[0]

    owner: list[str | None] = [None]

    def pieces() -> Iterator[Stretch]:
        held = None
        for row in rows:
            if not head:
                head.append(row)
                for level in HARD_LEVELS if structure else ():
                    if u := row[7][RANK[level]]:
                        now[level] = Unit(level, RANK[level], u["number"], u["title"], u["char_start"], 0)
                if "section" in now and "chapter" in now and now["section"].char_start < now["chapter"].char_start:
                    del now["section"]
            text, at, total, before, levels = row[4:]
            if held and structure:
                main = main_level([level for level, there in zip(PATTERNS, levels, strict=True) if there])
                first = [u for u in units_of(text[:4096]) if u.char_start == 0]
                if not any(u.level in (*HARD_LEVELS, main) for u in first):  # no cut of the document: one piece with the one before
                    held = (held[0] + "\n" + text, *held[1:])
                    continue
            if held:
                yield from cut(held)
            held = (text, at, total, before, levels)
        if held:
            yield from cut(held)

    def plain() -> Iterator[Stretch]:
        """A document without structure: whole, or in strides that don't mind where pieces end."""
        total, at = None, 0
        for s in pieces():
            total = head[0][6]
            if total <= hard:
                continue
            while at + target <= s.end:
                yield Stretch(at, at + target, "hard_char")
                at += target
        if total is not None and total <= hard:
            yield Stretch(0, total, "paragraph")
        elif total is not None and at < total:
            yield Stretch(at, total, "hard_char")

    for i, c in enumerate(pack(pieces() if structure else plain(), soft, hard)):
        start, end = c[0].start, c[-1].end
        if end == start:
            continue
        while marks and marks[0].char_start <= start:
            mark = marks.popleft()
            if mark.level == "chapter":
                now.pop("section", None)
            now[mark.level] = mark
        while texts and texts[0][0] + len(texts[0][1]) <= start:
            texts.pop(0)
        raw = "".join(t[max(0, start - at) : end - at] for at, t in texts if at < end)
        kept = not (prune and is_short(raw))
        yield record(head[0][0], head[0][2], head[0][3], i, c, now, raw if kept else "") | {"section": head[0][1], "kept": kept}


def chunk_pieces(pieces: DataFrame, target: int = TARGET, soft: int = SOFT, hard: int = HARD, prune: bool = True, cut: str = "structure") -> DataFrame:
    """chunk() of documents in pieces (document_id, document_title, document_link, section, piece, text; stored; see structure.unit_rows), cut by their structure or `plain`.

    A section is a number that ascends with the pieces; each but a document's first begins at a part, chapter or section, where a chunk begins whatever came before. So sections are folded apart, each
    piece by piece, and what they have in common (numbers of chunks, shared articles) follows from the stored rows. Pieces that begin at no cut are joined to the one before.
    """
    spark = pieces.sparkSession
    ship(spark)
    structure = cut == "structure"
    rows = with_carry(pieces) if structure else placed(pieces).withColumns({"before": F.lit(None).cast("array<string>"), "levels": F.lit(None).cast("array<boolean>")})
    columns = (F.col("document_id").cast("string"), (F.col("section") if structure else F.lit(0)).cast("long").alias("section"), "document_title", "document_link", "text", "at", "total", "before", "levels")
    dealt = rows.select(*columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "document_id", "section").sortWithinPartitions("document_id", "section", "at")
    extra = {"section": pa.int64(), "kept": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, chars = [], 0
        each = (tuple(x.as_py() for x in row) for b in batches for row in zip(*b.columns, strict=True))
        for _, own in groupby(each, key=lambda r: r[:2]):
            for r in section_chunks(own, target, soft, hard, prune, structure):
                found.append(r)
                chars += r["char_length"] + 500
                if chars >= BATCH_CHARS:
                    yield cut_batch(found, extra)
                    found, chars = [], 0
        if found:
            yield cut_batch(found, extra)

    made = materialize(dealt.mapInArrow(run, CUT + ", section long, kept boolean"), "chunks")
    if not structure:  # strides are split already, and nothing has an article
        return named(made.where("kept").drop("section", "kept"))
    sizes = made.groupBy("document_id", "section").agg((F.max("chunk_index") + 1).alias("n"))
    so_far = Window.partitionBy("document_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("document_id").alias("_d"), F.col("section").alias("_s"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).cast("int").alias("_base"))
    keys = F.when(F.size("articles") > 0, F.transform("articles", lambda x: F.concat(F.lit("a"), x))).otherwise(F.transform("clauses", lambda x: F.concat(F.lit("c"), x)))
    keyed = made.where("kept").select("document_id", "section", "chunk_index", F.explode(keys).alias("k")).withColumn("n", F.count("*").over(Window.partitionBy("document_id", "k")))
    shared = keyed.where("n > 1").select(F.col("document_id").alias("_ds"), F.col("section").alias("_ss"), F.col("chunk_index").alias("_is")).distinct().withColumn("_shared", F.lit(True))
    d = made.where("kept").join(shared, F.col("document_id").eqNullSafe(F.col("_ds")) & (F.col("section") == F.col("_ss")) & (F.col("chunk_index") == F.col("_is")), "left")
    d = d.join(small(base), F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("section") == F.col("_s")))
    d = d.withColumns({"chunk_index": F.col("chunk_index") + F.col("_base"), "is_split": F.col("is_split") | F.coalesce("_shared", F.lit(False))})
    return named(d.select(*[c for c in made.columns if c not in ("section", "kept")]))


def prune_short(chunks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    return chunks.where(word_count(tail_after_prefix(F.col("text"))) >= min_words)


def prune_boilerplate(chunks: DataFrame, mottos: Iterable[str] = MOTTOS) -> DataFrame:
    """Without preambles that hold a motto. No level of chunk() is a preamble; chunks of other origin may have one."""
    held = F.lit(False)
    for m in mottos:
        held = held | F.coalesce(F.contains(F.col("text"), F.lit(m)), F.lit(False))
    return chunks.where(~(F.col("chunk_type").eqNullSafe("preamble") & held))


def mark_split(chunks: DataFrame) -> DataFrame:
    """is_split where a chunk of the same document has an article (or, without articles, a clause) in common."""
    keys = F.when(F.size("articles") > 0, F.transform("articles", lambda x: F.concat(F.lit("a"), x))).otherwise(F.transform("clauses", lambda x: F.concat(F.lit("c"), x)))
    keyed = chunks.select("document_id", "chunk_id", F.explode(keys).alias("k"))
    shared = keyed.groupBy("document_id", "k").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    both = keyed.join(shared, ["document_id", "k"]).select("document_id", "chunk_id").distinct().withColumn("_shared", F.lit(True))
    return chunks.join(both, ["document_id", "chunk_id"], "left").withColumn("is_split", F.col("is_split") | F.coalesce("_shared", F.lit(False))).drop("_shared").select(*chunks.columns)
