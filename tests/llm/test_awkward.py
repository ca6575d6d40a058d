"""Each operator and each stage of the pipeline on one awkward table: null ids and columns, repeated rows and ids, empty and very long texts, ties, clashing names; and on empty tables."""

import hashlib
import io
import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import brute_components, words

import corpus_pipeline
from quarry.llm import byte_bpe, chat, html_text, jaccard, mixing, quality, sharding, token_records, topk, warc

#: Names that differ by case only from those the operators read.
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>, c1 string, c2 string, c3 string"
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "extra", "TEXT", "Source", "DOC_ID"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    long = " ".join(rng.choices([f"long{i}" for i in range(50_000)], k=300_000))
    base = " ".join(f"b{i}" for i in range(80))
    texts = [(1, base), (1, base), (1, "another text of one id"), (None, base + " tail"), (None, None), (None, None), (2, None), (3, ""), (3, " \n\t "), (4, long), (5, long + " end"), (6, "x" * 2_000_000), (7, " " * 1_500_000), (8, "a b c d"), (9, "a b c d"), (-3, "Ünï 🙂 é́")]
    return [(i, t, None, [None, "s", "t"][k % 3], None if t is None else len(t), {"k": k} if k % 2 else None, "T", "S", "D") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, AWKWARD).toDF(*NAMES).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 0), (4, 1, None), (8, None, None)], "doc_id long, quality int, toxic int")


def bag(values):
    return sorted(values, key=repr)


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert bag((r.doc_id, r.size, r.source) for r in got) == bag((r[0], len(words(r[1])), r[3]) for r in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == NAMES and {type(r.extra) for r in mixed.select("extra").collect()} <= {dict, type(None)}


def test_jaccard(docs, rows):
    want = brute_components([r[1] for r in rows])
    ids = [r[0] for r in rows]
    group = {}
    for k, (_, c) in want.items():
        group.setdefault(c, []).append(ids[k])
    least = lambda c: min((i for i in group[c] if i is not None), default=None)
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()) == bag((ids[k], n, least(c) if n else ids[k]) for k, (n, c) in want.items())


def test_without_near_copies(docs, rows):
    out = jaccard.without_near_copies(docs)
    assert out.columns == NAMES
    got = [(r[0], (r[1] or "")[:20], len(r[1] or "")) for r in out.collect()]
    # One of the base's, of the long ones' and of "a b c d"; the other texts, and rows without words once each.
    assert bag(got) == bag([(1, rows[0][1][:20], len(rows[0][1])), (1, "another text of one ", 22), (4, rows[9][1][:20], len(rows[9][1])), (6, "x" * 20, 2_000_000), (8, "a b c d", 7), (-3, rows[15][1], len(rows[15][1])), (None, "", 0), (None, "", 0), (2, "", 0), (3, "", 0), (3, " \n\t ", 4), (7, " " * 20, 1_500_000)])


def test_token_records(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_records.default_tokenizer())
    path = f"file://{tmp_path}/r"
    token_records.write(docs, path)
    back = token_records.read(spark, path).collect()
    want = sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "") for r in rows))
    assert [r.doc_id for r in sorted(back, key=lambda r: r.start)] == [i if there else None for there, i, _, _ in want]
    start = 0
    for r, (_, _, _, t) in zip(sorted(back, key=lambda r: r.start), want, strict=True):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    shuffled = token_records.read_shuffled(spark, path, 1).collect()
    assert bag((r.doc_id, zlib.crc32(bytes(r.ids))) for r in shuffled) == bag((r.doc_id, r.ids_crc32) for r in back)
    other = token_records.read_shuffled(spark, path, 2).collect()
    assert [bytes(r.ids) for r in shuffled] == [bytes(r.ids) for r in token_records.read_shuffled(spark, path, 1).collect()] != [bytes(r.ids) for r in other]


def test_damaged_frames_are_told():
    data = token_records.frame(token_records.pack(5, np.arange(9), 2)) * 2
    f = io.BytesIO(data)
    assert token_records.unpack(token_records.read_frame(f))[0] == 5 and token_records.read_frame(f) and token_records.read_frame(f) is None
    one = data[: len(data) // 2]
    for bad in (one[:5], one[:-1], bytes([one[0] ^ 1]) + one[1:], one[:15] + bytes([one[15] ^ 1]) + one[16:]):
        with pytest.raises(ValueError, match="damaged"):
            token_records.read_frame(io.BytesIO(bad))
    for ids in ([], [0], [65_535, 70_000]):
        doc_id, back = token_records.unpack(token_records.pack(None, np.array(ids, np.int64), 4))
        assert doc_id is None and back.tolist() == ids


def test_sharding(docs, rows):
    got = sharding.assign(docs).collect()
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len({r.shard for r in got if r.doc_id == i}) == 1 for i in {r.doc_id for r in got})


def test_quality(docs, rows, labels):
    got = quality.judge(docs, labels).collect()
    assert bag((r.doc_id, r.n_words) for r in got) == bag((r[0], len(words(r[1]))) for r in rows)
    out = quality.keep_good(docs, labels)
    assert out.columns == NAMES and out.count() == sum(r.kept for r in got)


def test_byte_bpe(docs, rows):
    got = bag((r.doc_id, r.decoded_sha256) for r in byte_bpe.digests(docs).collect())
    assert got == bag((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()
    assert bag((r.doc_id, hashlib.sha256(bytes(r.bytes)).hexdigest()) for r in back) == got


def test_html(spark):
    long = "<p>" + "word and the " * 400_000 + "</p>"
    pages = [(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>the and of a &#0000000000000000000000065; &#99999999999999;</p>", "x"), (None, "u", long, "x"), (2, "u", "<a " * 50_000, "x")]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, h string").toDF("page_id", "url", "html", "HTML")).collect()
    assert bag((r.page_id, r.url) for r in got) == bag(p[:2] for p in pages)
    assert all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == len("word and the " * 400_000) - 1


def test_warc(spark, monkeypatch, tmp_path):
    page = "<p>" + "ü" * 200 + "</p>"
    rows = [(None, "u", page), (7, "u", page), (3, "\0\t\nv", page), (3, "w", page), (4, None, "x" * 3_000_000), (4, None, "x" * 3_000_000), (None, None, None), (5, "http://[bad", "")]
    got = warc.archive(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, p int").toDF("page_id", "url", "html", "HTML")).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {page: 3, "x" * 3_000_000: 4}
    want = [(i, len((t or "").encode()), digest(t), "revisit" if t in first and i != first[t] else "response", first[t] if t in first and i != first[t] else None) for i, _, t in rows]
    assert bag(map(tuple, got)) == bag(want)


def test_warc_histories_are_in_global_order(spark, tmp_path):
    """More runs than are merged at once, a URL that most captures share, and ranges that part it."""
    rng = random.Random(4)
    pages = [(i, "http://hot.example/" if rng.random() < 0.7 else f"http://{rng.choice('abc')}.example/{rng.randint(0, 30)}", f"page {i}") for i in range(5000)]
    path = f"file://{tmp_path}/w"
    runs = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7), path)
    assert runs.count() == 7
    merged = warc.merge(runs, path, fan_in=3)
    files = merged.orderBy("run").collect()
    entries = [e for r in files for e in warc.read_run(r.run, [])]
    assert len(files) > 1 and len(entries) == 5000 and entries == sorted(entries, key=warc.sort_key)
    hot = warc.url_key("http://hot.example/")
    assert sum(any(e[0] == hot for e in warc.read_run(r.run, [])) for r in files) > 1
    assert sorted(r.page_id for r in warc.histories(spark, merged).collect()) == list(range(5000))


def test_chat(spark):
    rows = [(1, 1, "a b", "x"), (1, 2, "a_b", "y"), (1, 2, "a_b", "y"), (1, None, "a%20b", "z"), (1, 3, None, None), (None, 1, "user", "q" * 1_000_000), (None, 1, "assistant", "r"), (2, 1, "system", "s"), (3, 1, "<|im_end|>", "t"), (3, 2, "", "u")]
    made = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, t int").toDF("conv_id", "turn", "role", "text", "TEXT")
    segments = chat.segments(made)
    got = {(r.conv_id, r.perspective): r for r in chat.dialogues(segments).collect()}
    assert set(got) == {(1, "a%20b"), (1, "a_b"), (1, "a%2520b"), (None, "user"), (None, "assistant"), (3, "%3C|im_end|>"), (3, "")}
    own = got[1, "a_b"]
    assert [own.text[m.start : m.end] for m in own.mask] == ["y<|im_end|>"] * 2
    assert own.text == "<|im_start|>user name=a%2520b\nz<|im_end|>\n<|im_start|>user name=a%20b\nx<|im_end|>\n" + "<|im_start|>assistant\ny<|im_end|>\n" * 2 + "<|im_start|>user\n<|im_end|>\n"
    parts = chat.dialogues(segments.where("conv_id = 1"), 60).where("perspective = 'a_b'").orderBy("part").collect()
    assert len(parts) > 1 and "".join(p.text for p in parts) == own.text
    assert [p.text[m.start : m.end] for p in parts for m in p.mask] == ["y<|im_end|>"] * 2


def test_topk_rows_play_no_part(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "x")] * 2 + [(1, [0.5, 0.5], "x"), (None, [9.0, 9.0], "x")], "vec_id long, embedding array<float>, e string").toDF("vec_id", "embedding", "Embedding")
    assert bag(map(tuple, topk.nearest(df).collect())) == [(0, 1, 1, 128 * 256), (0, 2, 1, 128 * 256)]


EMPTY = {
    "mix": lambda s, d, x: mixing.mix(d), "mixed": lambda s, d, x: mixing.mixed_documents(d), "shards": lambda s, d, x: sharding.assign(d), "join": lambda s, d, x: jaccard.join(d), "near": lambda s, d, x: jaccard.without_near_copies(d),
    "bpe": lambda s, d, x: byte_bpe.digests(d), "records": lambda s, d, x: token_records.round_trip(d), "judge": lambda s, d, x: quality.judge(d, x), "keep": lambda s, d, x: quality.keep_good(d, x),
    "html": lambda s, d, x: html_text.extract(d.selectExpr("doc_id page_id", "lang url", "text html")), "warc": lambda s, d, x: warc.archive(d.selectExpr("doc_id page_id", "lang url", "text html")),
    "chat": lambda s, d, x: chat.segments(d.selectExpr("doc_id conv_id", "n_chars turn", "lang role", "text")), "topk": lambda s, d, x: topk.nearest(d.selectExpr("doc_id vec_id", "array(1D) embedding")),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert EMPTY[name](spark, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# The pipeline, and the models of its stages, in plain Python.


def hash64(*values) -> int:
    """Spark's xxhash64 of longs, ints and strings: each seeds the next; nulls leave the seed."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if not isinstance(v, np.int32) else struct.pack("<i", v)
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def plain_quality(rows, labels):
    """kept and score by row: the ratio and threshold as they are written down."""
    n = quality.BUCKETS
    grams = []
    for _, t in rows:
        h = [hash64(w) for w in words(t)]
        grams.append([x % n for x in h] + [hash64(a, b) % n for a, b in zip(h, h[1:], strict=False)])
    trusted = {i for i, q, toxic in labels if q == 1 and not toxic and i is not None}
    raw, good = np.zeros(n), np.zeros(n)
    for (i, _), g in zip(rows, grams, strict=True):
        np.add.at(raw, g, 1)
        if i in trusted:
            np.add.at(good, g, 1)
    p = raw / raw.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(p > 0, np.log((good + quality.PRIOR * n * p) / (good.sum() + quality.PRIOR * n) / p), 0.0)
    scores = [ratio[g].sum() / (2 * len(words(t)) + quality.SHRINK) for (_, t), g in zip(rows, grams, strict=True)]
    own = [s for (i, _), s in zip(rows, scores, strict=True) if i in trusted]
    threshold = np.mean(own) - quality.DEVIATIONS * np.std(own)
    kept = []
    for (_, t), s in zip(rows, scores, strict=True):
        w = words(t)
        seen, hit = {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                hit |= {i + k for i in at for k in range(8)}
        kept.append(not (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and s >= threshold)
    return kept, scores


def plain_targets(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(sizes), strict=False))
    target, budget, left = {}, sum(sizes.values()), set(sizes)
    while left:
        share = {s: budget * weights[s] / sum(weights[x] for x in left) for s in left}
        full = [s for s in left if share[s] >= 3 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 3 * sizes[s]
            budget -= target[s]
            left.remove(s)
    return target


def plain_mix(rows):
    """taken by row (doc_id, text, source) of a table without repeated ids."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    target, taken = plain_targets(sizes), {}
    for s, size in sizes.items():
        goal = min(math.floor(target[s] + 0.5), 3 * size)
        epochs, rest = divmod(goal, size) if size else (0, 0)
        for i, t in sorted(((i, t) for i, t, x in rows if x == s), key=lambda r: (hash64(r[0], np.int32(0)), r[0])):
            n = len(words(t))
            more = min(n, max(0, rest))
            rest -= n
            taken[i] = epochs * n + more
    return taken


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary, junk = [f"word{i}" for i in range(600)], [f"zz{i}" for i in range(300)]
    texts = []
    for _ in range(70):
        t = " ".join(rng.choices(vocabulary, k=rng.randint(25, 200)))
        texts.append(t)
        if rng.random() < 0.3:
            w = t.split()
            w[rng.randrange(len(w))] = "edited"
            texts += [" ".join(w), t]
    texts += [" ".join(rng.choices(junk, k=120)) for _ in range(12)] + ["short", None, "", "x y z " * 60]
    rng.shuffle(texts)
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(not (t or "zz").startswith(("zz", "x y", "short"))), 0) for i, t, *_ in rows if i % 2 == 0]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def test_quality_against_a_plain_model(spark, corpus):
    path, rows, labels = corpus
    kept, scores = plain_quality([r[:2] for r in rows], labels)
    got = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()}
    assert {i: got[i].kept for i in got} == dict(enumerate(kept)) and 0 < sum(kept) < len(kept)
    assert all(math.isclose(got[i].score, s, abs_tol=1e-9) for i, s in enumerate(scores))


def test_mix_against_a_plain_model(spark, corpus):
    path, rows, _ = corpus
    got = {r.doc_id: r.taken for r in mixing.mix(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    assert got == plain_mix([(i, t, s) for i, t, _, s, _ in rows])


def test_pipeline_against_plain_models(spark, corpus):
    path, rows, labels = corpus
    kept, _ = plain_quality([r[:2] for r in rows], labels)
    rows = [r for r, k in zip(rows, kept, strict=True) if k]
    component = brute_components([r[1] for r in rows])
    rows = [r for k, r in enumerate(rows) if component[k][1] == k]
    taken = plain_mix([(i, t, s) for i, t, _, s, _ in rows])
    enc, want = byte_bpe.encoding(byte_bpe.default_ranks(), byte_bpe.default_pattern()), []
    for i, t, *_ in rows:
        epochs, more = divmod(taken[i], len(words(t)))
        cut = " ".join(words(t)[:more])
        for copy in [t] * epochs + [cut] * (more > 0):
            ids = np.array(enc.encode_ordinary(copy), "<u4")
            want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(copy.encode()).hexdigest()))
    assert len(corpus_pipeline.STAGES) == 4 and len(want) > 20
    assert bag(map(tuple, corpus_pipeline.run(spark, path).collect())) == bag(want)


def test_stages_on_awkward_documents(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == (NAMES if k < 3 else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        assert out.count() >= 0
        none = stage(spark, now.limit(0), str(tmp_path))
        assert none.columns == out.columns and none.count() == 0
