"""Goldens of the engine's operators, and its queries against DuckDB on the smallest tables."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import audit, chunking, evaluation, retrieval, structure
from quarry.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TEXT = "Mở đầu\n\nĐiều 1. Tên một\n1. Khoản một\na) Điểm a\nĐiều 2\nNội dung hai"
DDL = "document_id string, document_title string, document_link string, text string"


def test_clean(spark):
    raw = "A\\B\tC\r\n---\r\n\r\n\r\n  x  y \n\n\n\nz "
    rows = spark.createDataFrame([(raw,), (None,), ("",)], "t string").select(T.clean(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["AB C\n\nx y\n\nz", "", ""]


def test_text_functions(spark):
    d = spark.createDataFrame([(" \x1fT\u00a0", ["b", None, "a", "b"], "[x]\ny]\nz w", "7_chunk_0012")], "t string, a array<string>, e string, c string")
    r = d.select(T.optional_title(F.col("t")).alias("t"), T.optional_title(F.lit(" \t")).alias("none"), T.unique_in_order(F.col("a")).alias("a"), T.tail_after_prefix(F.col("e")).alias("e"), T.word_count(T.tail_after_prefix(F.col("e"))).alias("n"), T.document_of(F.col("c")).alias("d"), T.chunk_id(F.lit("x"), F.lit(12345)).alias("c")).first()
    assert tuple(r) == ("T", None, ["b", "a"], "z w", 2, "7", "x_chunk_12345")
    rows = [(t, c, s, a) for t in (None, "", "T") for c in (None, "C") for s in (None, "S") for a in ([], ["1", "2a"])]
    got = spark.createDataFrame(rows, "t string, c string, s string, a array<string>").select(T.enriched(F.lit("raw"), F.col("t"), F.col("c"), F.col("s"), F.col("a")).alias("x")).collect()
    head = lambda t, c, s, a: " | ".join(k + v for k, v in (("Văn bản: ", t), ("Chương: ", c), ("Mục: ", s), ("Điều ", ", ".join(a))) if v)
    assert [r.x for r in got] == [f"[{head(*x)}]\nraw" if head(*x) else "raw" for x in rows]
    assert got[-1].x == "[Văn bản: T | Chương: C | Mục: S | Điều 1, 2a]\nraw" and got[0].x == "raw"


def test_normalized_cleaning(spark):
    rows = spark.createDataFrame([("e\u0301 a\\",), ("a  b",), (None,)], "t string").select(T.clean(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["é a", "a b", ""]


def test_units(spark):
    d = structure.with_units(spark.createDataFrame([("a", None, None, TEXT)], DDL))
    got = [(r.level, r.number, r.title, r.char_start, r.char_end) for r in d.select(F.inline("units")).collect()]
    assert got == [("article", "1", "Tên một", 7, 47), ("clause", "1", "Khoản một", 24, 66), ("point", "a", "Điểm a", 37, 66), ("article", "2", "Nội dung hai", 47, 66)]


def test_chunks(spark):
    got = chunking.chunk(spark.createDataFrame([("a", None, None, TEXT)], DDL), 20, 20, 30).orderBy("chunk_index").collect()
    assert [(r.char_start, r.char_end, r.chunk_type, r.articles, r.clauses, r.is_split) for r in got] == [(0, 24, "article", ["1"], [], True), (24, 47, "clause", ["1"], ["1"], True), (47, 66, "article", ["2"], [], False)]
    assert got[0].text.startswith("[Điều 1]\n")


@pytest.mark.parametrize(("n", "ends"), [(0, []), (6000, [6000]), (6001, [5000, 6001]), (11000, [5000, 11000]), (11001, [5000, 10000, 11001])])
def test_unstructured(n, ends):
    text = "x" * n
    packed = list(chunking.pack(chunking.stretches(text, [], 5000, 6000), 5000, 6000)) if n else []
    assert [c[-1].end for c in packed] == ends


def test_fusion(spark):
    dense = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c")], "qid int, rank int, chunk_id string")
    sparse = spark.createDataFrame([(0, 1, "c"), (0, 2, "d")], "qid int, rank int, chunk_id string")
    assert [r.chunk_id for r in retrieval.fuse(dense, sparse).orderBy("rank").collect()] == ["c", "a", "b", "d"]


def test_macro(spark):
    questions = spark.createDataFrame([("q1", ["d1", "d2"]), ("q2", [])], "qid string, answer array<string>")
    hits = spark.createDataFrame([("q1", 1, "d1"), ("q1", 2, "d3")], "qid string, rank int, doc_id string")
    r = evaluation.macro(questions, hits).first()
    assert (r.recall, r.precision, r.f2) == (0.25, 0.25, 0.25)
    assert evaluation.macro(questions.limit(0), hits).first().recall is None


def test_audit_finds_faults(spark):
    chunks = spark.createDataFrame([("a", "a_chunk_0000", 0, 0, 3, 3, "abc"), ("a", "a_chunk_0002", 2, 2, 6, 4, "xdef")], "document_id string, chunk_id string, chunk_index int, char_start int, char_end int, char_length int, text string")
    found = {r.message for r in audit.audit(chunks, spark.createDataFrame([("a", "abcdef")], "document_id string, text string")).collect()}
    assert found == {"index jumps", "overlap", "text differs from the source"}


def test_audit_of_lines_and_statistics(spark):
    good = {k: "x" for k in audit.KEYS} | {k: 1 for k in audit.NUMBERS} | {"part_title": None}
    lines = [good, {k: v for k, v in good.items() if k != "points"}, good | {"char_end": "1"}, good | {"char_start": True}, good | {"char_length": 1.0}, good | {"chunk_type": " "}, [1]]
    rows = [(json.dumps(x),) for x in lines] + [('{"a": ',), (" ",), (None,)]
    found = sorted(r.message for r in audit.audit_lines(spark.createDataFrame(rows, "value string")).collect())
    assert found == sorted(["points is missing", "char_end is no integer", "char_start is no integer", "char_length is no integer", "chunk_type is empty", "not a JSON object", "not JSON"])
    stats = spark.createDataFrame([(0,)], "failed_documents int")
    got = [[r.message for r in audit.audit_stats(x).collect()] for x in (stats, stats.limit(0), stats.selectExpr("2 AS failed_documents"))]
    assert got == [[], ["statistics are missing"], ["documents failed"]]


def test_audit_faults_holds_the_lines_too(spark):
    found = {r.message for r in catalog.queries()["audit_faults"](spark, str(DATA)).collect()}
    assert {"not JSON", "is_split is missing", "char_end is no integer", "index jumps"} <= found


@pytest.mark.parametrize("name", ["clean_documents", "chunk_fallback", "chunk_stats", "length_buckets", "prune_short", "mark_split", "structural_units", "context_asof", "chunk_structured", "chunk_lines", "audit_faults", "audit_report", "bm25_stats", "bm25_topk", "hybrid_rrf", "rerank_jaccard", "eval_macro_f2", "submission_rows", "resume_antijoin"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, sql = catalog.queries()[name](spark, str(DATA)), con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    key = lambda r: str([round(x, 5) if isinstance(x, float) else x for x in r])
    ours, theirs = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key), sorted((tuple(r[sql.columns.index(c)] for c in cols) for r in sql.fetchall()), key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(math.isclose(x, y, abs_tol=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def pieces(spark, texts, size):
    """Texts by document as in_pieces rows, cut after so many characters."""
    rows = [(d, i, p) for d, t in texts.items() for i, p in enumerate(structure.pieces_of(t, size))]
    return spark.createDataFrame(rows, "document_id string, piece long, text string").repartition(3), len(rows)


def awkward(rng, n):
    return "\n".join(rng.choice(["Phần", "IV", "Phần I. A", "Chương 2", "Chương 3: B", "", " ", "Mục 1", ".", "Điều 1", "Điều 2. C", "1. d", "2.", "a) e", "1.1 f", "g", "", "h i j k l m"]) for _ in range(n)) + rng.choice(["", "\n"])


def test_units_of_pieces_are_those_of_the_whole(spark):
    rng = random.Random(5)
    texts = {str(i): awkward(rng, rng.randint(0, 60)) for i in range(120)}
    split, n = pieces(spark, texts, 10)
    assert n > 400 and all("\n".join(structure.pieces_of(t, 10)) == t for t in texts.values())
    want = []
    for d, t in texts.items():
        units = structure.units_of(t)
        now = {}
        for u, c in zip(units, chunking.contexts([v for v in units if v.level != "article"], [u.char_start for u in units]), strict=True):
            now[u.level] = u.number
            # A unit's context is that at its own place in the order, so headings of a lower rank that start there don't count yet.
            c = {k: v for k, v in c.items() if (v.char_start, v.rank) <= (u.char_start, u.rank)}
            want.append((d, u.level, u.number, u.title, u.char_start, u.char_end, now.get("article"), c.get("part") and c["part"].title))
    got = structure.unit_rows(split, context=True, owner="article").collect()
    assert sorted(map(str, want)) == sorted(str((r.document_id, r.level, r.number, r.title, r.char_start, r.char_end, r.owner, r.part_title)) for r in got)
    levels = {r.document_id: r.fingerprint for r in structure.fingerprints(split).collect()}
    assert levels == {d: structure.levels_of(structure.units_of(t)) for d, t in texts.items()}


def test_legal_pieces_are_the_corpus(spark):
    d = str(DATA)
    for t in ("customer", "orders", "lineitem"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(f"plain_{t}")
    lines = catalog.LINES.format(customer="plain_customer", orders="plain_orders", lineitem="plain_lineitem")
    whole = spark.sql(f"WITH {lines} SELECT CAST(d AS STRING) AS d, array_join(transform(array_sort(collect_list(struct(pa, ch, se, ar, cl, k, po, line))), x -> x.line), '\n') AS text FROM l GROUP BY d")
    cut = {}
    for r in sorted(catalog.legal_pieces(spark, d).collect(), key=lambda r: r.piece):
        cut.setdefault(r.document_id, []).append(r.text)
    assert {r.d: r.text for r in whole.collect()} == {d: "\n".join(p) for d, p in cut.items()} and max(map(len, cut.values())) > 1


def sectioned(texts, size):
    """Texts as pieces that begin where a document is cut, with the number of the part, chapter or section that the piece lies in."""
    rows = []
    for d, t in texts.items():
        units = structure.units_of(t)
        main = chunking.main_level({u.level for u in units})
        held, section = [], 0
        for p in structure.pieces_of(t, size):
            first = {u.level for u in structure.units_of(p) if u.char_start == 0}
            if held and first & {*structure.HARD_LEVELS}:
                section += 1
            if held and not first & {*structure.HARD_LEVELS, main}:
                held[-1] = (*held[-1][:4], held[-1][4], held[-1][5] + "\n" + p) if len(held) % 2 else held[-1]
                if len(held) % 2:
                    continue
            held.append((d, "T", None, section, len(held), p))
        rows += held
    return rows


def test_chunks_of_pieces_are_those_of_the_whole(spark):
    rng = random.Random(9)
    texts = {str(i): awkward(rng, rng.randint(0, 80)) for i in range(80)} | {"x": "y" * 700}
    kind = "document_id string, document_title string, document_link string, section long, piece long, text string"
    rows = sectioned(texts, 10)
    assert len({r[:4] for r in rows}) > 150 and {d: "\n".join(r[5] for r in rows if r[0] == d) for d in texts} == texts
    whole = spark.createDataFrame([(d, "T", None, t) for d, t in texts.items()], DDL)
    split = spark.createDataFrame(rows, kind).repartition(5)
    for cut, prune in (("structure", True), ("structure", False), ("plain", False)):
        got, want = (sorted(map(str, x.collect())) for x in (chunking.chunk_pieces(split, 30, 30, 40, prune, cut), chunking.chunk(whole, 30, 30, 40, prune, cut)))
        assert got == want


def test_audit_of_pieces_is_that_of_the_whole(spark):
    rng = random.Random(4)
    texts = {str(i): "\n".join(rng.choice(["Chương 1. A", "b c", "", " ", "Điều 2. d", "é" * 3000]) for _ in range(rng.randint(1, 12))) for i in range(40)}
    split, _ = pieces(spark, texts, 900)
    whole = structure.with_units(spark.createDataFrame(list(texts.items()), "document_id string, text string"))
    rows = []
    for d, t in texts.items():
        at = i = 0
        while at < len(t):
            end = at + rng.randint(1, 9000)
            text = t[at:end]
            rows.append((d, f"{d}-{i}", i, at, end, end - at, text if rng.random() < 0.8 else text[:-1] + "?"))
            at, i = min(end, len(t)) + rng.choice([0, 0, 1, 5000, -2]), i + 1
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, char_start int, char_end int, char_length int, text string")
    want = []
    for (d, name, _, a, z, _, text), before in zip(rows, [None, *rows], strict=False):
        gap = texts[d][before[4] : a] if before and before[0] == d else ""
        want += [name + " text differs from the source"] * (a < 0 or texts[d][a:z] != text) + [name + " text lost in a gap"] * bool(gap.strip())
        want += [name + " a part, chapter or section starts inside"] * any(a < u.char_start < z for u in structure.units_of(texts[d]) if u.level in structure.HARD_LEVELS)
    for docs in (split, whole):
        assert sorted(f"{r.chunk_id} {r.message}" for r in audit.audit(chunks, docs).where("layer in ('source', 'boundary') or message = 'text lost in a gap'").collect()) == sorted(want)


def test_shared_answers_stay_a_row_each(spark):
    hits = spark.createDataFrame([(0, 1, 5), (0, 2, 7), (1, 1, 7), (3, 1, 5)], "qid int, rank int, doc_id int")
    asked = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "none")], "qid int, label string")
    members = spark.createDataFrame([("a", 7), ("a", 8), ("b", 5)], "label string, doc_id int")
    assert sorted(map(tuple, evaluation.reciprocal_rank_by(hits, asked, members, "label").collect())) == [(0, 0.5), (1, 0.0), (2, 0.0)]
    assert sorted(map(tuple, evaluation.judged_by(hits, asked, members, "label").collect())) == [(0, 0.5, 0.5), (1, 0.0, 0.0), (2, 0.0, 0.0)]
    plan = catalog.queries()["mrr"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "explode" not in plan


def test_sparse_search_scores_in_tasks(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    chunks = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(300)] + [(300, None)], "chunk_id long, text string").repartition(4)
    queries = spark.createDataFrame([(q, " ".join(rng.choices([*words, "none"], k=5))) for q in range(20)] + [(20, "none"), (21, "")], "qid long, query string")
    # A stored index's search joins postings; the one without an index scores in tasks and shuffles none.
    joined = retrieval.Bm25Index.of(chunks, only=retrieval.query_terms(queries)).search(queries, 6)
    direct = retrieval.bm25(queries, chunks, 6)
    rounded = lambda d: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 5)) for r in d.collect())
    assert rounded(direct) == rounded(joined)
    assert "Join" not in direct._jdf.queryExecution().optimizedPlan().toString()
