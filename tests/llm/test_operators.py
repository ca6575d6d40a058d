"""The training-data operators on awkward small tables, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, chat, components, html_text, jaccard, mixing, quality, sharding, token_records, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, target int, slot int, key string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def make(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t or ""), "x", 1, 2, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", "  \n\t ", "one", "one", "Two words", "a b c d", "A b c d", "x " * 9000, "🙂 é́   z" * 30]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 300))) for _ in range(12)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    for i, b in enumerate(base):
        out += [b] * (i % 3)
        for _ in range(i):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        out.append(f"{passage} {' '.join(rng.choices(vocabulary, k=30))}")
    return out


def brute_components(texts):
    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s[i]), find(i)) for i in range(len(s))}


def test_jaccard(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(make(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_jaccard_signatures_lose_no_link():
    rng = np.random.default_rng(1)
    for trial in range(300):
        n = int(rng.integers(2, 700))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, len(x) // 7) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**64, int(rng.integers(0, drop + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both) or np.array_equal(x, y):
            continue
        share = rng.random()
        common = {s for s in np.union1d(x, y).tolist() if rng.random() < share}
        out = []
        for s in (x, y):
            read, judged = jaccard.prefix_lengths(s)
            shown = np.arange(read)
            f = np.array([v in common for v in s[:read].tolist()], bool)
            out.append(jaccard.signatures(len(s), read, judged, shown, s[:read].view(np.int64), f))
        assert set(out[0][0].tolist()) & set(out[1][0].tolist()) or set(out[0][1].tolist()) & set(out[1][1].tolist()), (trial, len(x), len(y))


def test_without_near_copies(spark, texts):
    kept = sorted(r.doc_id for r in jaccard.without_near_copies(make(spark, texts)).collect())
    assert kept == sorted({c for _, c in brute_components(texts).values()})


def test_without_near_copies_of_repeated_ids(spark):
    """One row of each component stays, whichever ids repeat; rows without words all stay, equal ones once."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(5, a, "x"), (5, a + " one", "x"), (3, b, "x"), (5, b + " one", "x"), (7, c, "x"), (7, c, "y"), (7, c, "y"), (None, c + " one", "x"), (None, d, "x"), (None, d + " one", "x")]
    rows += [(8, "", "x"), (8, "", "y"), (8, "", "y"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = jaccard.without_near_copies(docs).collect()
    assert set(map(tuple, got)) <= set(rows)
    assert sorted((str(r.doc_id), (r.text or " ")[0]) for r in got if r.text) == [("3", "b"), ("5", "a"), ("7", "c"), ("None", "d")]
    assert sorted((str(r.doc_id), r.lang) for r in got if not r.text) == [("8", "x"), ("8", "y"), ("None", "x")]


def test_without_near_copies_keeps_any_columns(spark):
    """Also maps, and names that differ by case only; of rows of one id and text one stays, the same in each run."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, {"k": 1}, "u"), (1, a, {"k": 2}, "u"), (2, a + " more", {}, "v"), (3, b, None, None), (4, None, {"k": None}, "w"), (4, None, {"k": None}, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, Text2 string").toDF("doc_id", "text", "m", "TEXT")
    got = [tuple(r) for r in jaccard.without_near_copies(docs).collect()]
    assert jaccard.without_near_copies(docs).columns == docs.columns
    assert len(got) == 3 and all(r in rows for r in got) and sorted(r[0] for r in got) == [1, 3, 4]
    assert sorted(map(str, got)) == sorted(map(str, (tuple(r) for r in jaccard.without_near_copies(docs.repartition(3)).collect())))


def test_mix(spark, texts):
    docs = make(spark, texts, ["b", None, "a", "c"])
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts)
    assert all(r.size == len(words(texts[r.doc_id])) and 0 <= r.taken <= 3 * r.size for r in got)
    total, by = sum(r.size for r in got), {}
    for r in got:
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    assert all(abs(t - taken) <= 1 for _, t, taken in by.values())
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    target, budget, open_ = {}, total, set(by)
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * by[s][0]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * by[s][0]
            budget -= target[s]
            open_.remove(s)
    assert all(abs(target[s] - by[s][1]) < 1e-6 for s in by)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)


def test_shards(spark, texts):
    got = sharding.assign(make(spark, texts)).collect()
    by = {}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert r.grown_shard in (r.shard, 24)
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(texts) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_slot_maps():
    now = sharding.slot_map(24)
    held = [now.count(s) for s in range(24)]
    assert max(held) - min(held) <= 2
    assert sharding.slot_map(25) == sharding.grow(now)
    loads = [1 + (7 * i) % 50 for i in range(len(now))]
    edited = sharding.rebalance(now, loads)
    total = [sum(v for v, s in zip(loads, edited, strict=True) if s == k) for k in range(24)]
    assert max(total) <= 1.02 * sum(loads) / 24


def test_stored_slot_maps(spark, texts, tmp_path):
    """Write, rebalance and reread: assign() stores maps with the loads of all documents, and places rows by them."""
    path, docs = f"file://{tmp_path}/maps", make(spark, texts)
    got = sharding.assign(docs, 3, 64, path).collect()
    loads, now, later = sharding.read_loads(spark, path, 0), sharding.read_map(spark, path, 0), sharding.read_map(spark, path, 1)
    want = [0] * 64
    for r in got:
        want[r.virtual_slot] += len((texts[r.doc_id] or "").encode()) + 8
        assert (r.shard, r.grown_shard) == (now[r.virtual_slot], later[r.virtual_slot])
    assert loads == want and now == sharding.slot_map(3, 64) and later == sharding.slot_map(4, 64)
    assert sum(r.rows for r in spark.read.parquet(f"{path}/version=0").collect()) == len(texts)
    edited = sharding.rebalance(later, loads)
    sharding.write_map(spark, path, 2, edited, sharding.slot_loads(docs, 64))
    assert edited != later and sharding.read_map(spark, path, 2) == edited and sharding.read_loads(spark, path, 2) == loads
    total = lambda m: max(sum(v for v, s in zip(loads, m, strict=True) if s == k) for k in range(4))
    assert total(edited) < total(later)
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.write_map(spark, path, 2, edited)


def test_quality_counts(spark, texts):
    docs = make(spark, [*texts, "same line here\nother\nsame line here\n\n# a <b>", " ".join("abcdefghij") + " " + " ".join("abcdefghij")])
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    for r in quality.judge(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
        w, t = words(r.text), r.text or ""
        seen, hit = {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        for starts in seen.values():
            if len(starts) > 1:
                hit |= {i + k for i in starts for k in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_keep_good_agrees_with_judge(spark, texts):
    """Also on texts whose repeated windows are many; clashing names stay, and the optimizer must not inline the nested arrays into the filter."""
    repeated = " ".join(f"w{i % 150}" for i in range(3000))
    docs = make(spark, [*texts, repeated, None]).withColumn("kept", F.lit("own"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    kept = sorted(r.doc_id for r in quality.judge(docs, labels).collect() if r.kept)
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns
    assert kept and sorted(r.doc_id for r in out.collect()) == kept
    verdicts = quality.judge(docs, labels)
    assert sorted(r.doc_id for r in verdicts.where("kept").collect()) == kept
    long = verdicts.where("n_words > 50 and not base_failed").select("doc_id").collect()
    assert sorted(r.doc_id for r in long) == sorted(r.doc_id for r in verdicts.collect() if r.n_words > 50 and not r.base_failed)


def versions(rng, n, base, most_edits, most_own):
    passage = rng.integers(0, 2**64, base, dtype=np.uint64)
    return [np.unique(np.concatenate([rng.permutation(passage)[int(rng.integers(0, most_edits)) :], rng.integers(0, 2**64, int(rng.integers(0, most_own)), dtype=np.uint64)])) for _ in range(n)]


def linked_pairs(found):
    return {(i, j) for j in range(len(found)) for i in range(j) if 100 * len(np.intersect1d(found[i], found[j])) >= 75 * len(np.union1d(found[i], found[j]))}


@pytest.mark.parametrize("tile_rows", [4096, 7])
def test_jaccard_rest_loses_no_link(spark, monkeypatch, tile_rows):
    """The rest's bounds: sets that link stay a pair, whichever shingles are lone, and what goes doesn't link. Sketches of different widths, and groups of many tiles."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile_rows)
    rng = np.random.default_rng(3)
    found = versions(rng, 60, 60, 9, 20) + versions(rng, 40, 250, 60, 90) + versions(rng, 20, 30, 2, 12)
    schema = "node long, hashes binary"
    hashes = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(found)], schema)
    todo = spark.createDataFrame([(k, i, len(s), 0, i) for i, s in enumerate(found) for k in (0, 1)], "sig long, node long, n int, lone int, comp long")
    got = {(r.a, r.b) for r in jaccard._rest(todo, hashes)[0].collect()}
    linked = linked_pairs(found)
    assert linked and linked <= got and len(got) < 2 * len(linked)
    assert len({jaccard.sketch_bits(len(s)) for s in found}) > 2


def test_near_pairs_by_lone_shingles():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 2**64, 60, dtype=np.uint64)
    own = [int(x) for x in rng.integers(0, 20, 50)]
    found = [np.unique(np.concatenate([passage, rng.integers(0, 2**64, k, dtype=np.uint64)])) for k in own]
    n, lone, comp = np.array([len(s) for s in found]), np.array(own), np.arange(50) // 2
    every = np.arange(50)
    i, j = jaccard.near_pairs(n, lone, comp, [jaccard.sketch(s) for s in found], every, every)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in linked_pairs(found) if comp[a] != comp[b]}


def test_jaccard_links_sets_read_whole_and_in_part(spark):
    """334 and 346 shingles link around a passage that sets of 420 to 462, read below PART, hold too; others lead all buckets."""
    rng, new = random.Random(0), iter(range(10**6))
    own = lambda n: [f"o{next(new)}" for _ in range(n)]
    passage, second = own(304), own(150)
    docs = [passage + own(34), passage + own(46)]
    docs += [passage + second + own(k) for k in range(1, 13)]
    docs += [passage + own(rng.randint(120, 146)) for _ in range(40)]
    texts = [" ".join(d) for d in docs]
    want = brute_components(texts)
    assert want[1][1] == 0
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(make(spark, texts)).collect()} == want


def test_byte_bpe(spark, texts):
    got = {r.doc_id: r for r in byte_bpe.digests(make(spark, texts)).collect()}
    enc = byte_bpe.encoding(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    for i, t in enumerate(texts):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    long = "ab  c\n\n d " * 400 + "é" * 900 + " x" * 500
    assert "".join(byte_bpe.pieces(long, 50)) == long
    assert [i for p in byte_bpe.pieces(long, 50) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(long)


@pytest.mark.parametrize("n", [999, 1000, 1001, 40_000])
def test_byte_bpe_long_blanks(n):
    """Long runs of blanks are encoded apart from the pattern; where the library can take the whole, the ids are the same."""
    enc = byte_bpe.encoding(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    for a in ("", "x", "x'", "1 ", "\x1c", "é!"):
        for blank in (" ", "\n", "\t", " \n", "\u3000", "\x85 "):
            for b in ("", "y", "'s", "\x1c", " \x1f", "\U0001f642", "x" * 60_000):
                t = a + blank * n + b
                assert byte_bpe.encode(t, enc).tolist() == enc.encode_ordinary(t)
    t = "a" + " " * 1_000_000 + "b " * 30_000 + "\n" * 1_000_000
    assert byte_bpe.decode(byte_bpe.encode(t, enc), enc) == t.encode()


def test_token_records(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(token_records.default_tokenizer()), 0
    got = sorted(token_records.round_trip(make(spark, texts)).collect())
    assert len(got) == len(texts)
    for r in got:
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_warc(spark):
    page = "<p>" + "x" * 120 + "</p>"
    pages = spark.createDataFrame([(3, "http://a.com/x", page), (1, None, page), (2, "http://B.com:80/?b&a#f", "short"), (4, "u\r\nv", "short"), (5, "http://c", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.archive(pages).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: ("response", None, 127, digest(page)), 3: ("revisit", 1, 127, digest(page)), 2: ("response", None, 5, digest("short")), 4: ("response", None, 5, digest("short")), 5: ("response", None, 0, digest(""))}
    assert warc.archive(pages.limit(0)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 20])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(50), k=rng.randint(0, 9))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))


def test_html():
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy</div><article><h1>Head</h1><p>Text &amp; more.<p>Short.<form>f</form></article><footer>&copy; x</footer>"
    assert html_text.main_text(page) == "Head Text & more. Short."
    assert [html_text.main_text(x) for x in (None, "", "<nav>a", "<script>x")] == ["", "", "", ""]


def brute_topk(rows, scale=256, every=50, k=5):
    """(query_id, rank, vec_id, score) in Python's integers."""
    q = [(i, [int(np.floor(scale * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63))  # noqa: B905, E731
    out = []
    for i in sorted({i for i, _ in q if i % every == 0}):
        found = sorted((-dot(u, v), j) for h, u in q if h == i for j, v in q if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return out


def nearest(spark, rows, **sizes):
    df = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, Vec_Id string" if len(rows and rows[0]) > 2 else "vec_id long, embedding array<double>"), **sizes)
    return sorted(map(tuple, df.collect()))


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[100:180] = x[100]
    rows = [(i, [float(v) for v in r], "other") for i, r in enumerate(x)] + [(400, None, ""), (450, [1.0, None], ""), (500, [float("nan")] * 8, ""), (None, [1.0] * 8, ""), (550, [float("inf")] * 8, "")]
    assert nearest(spark, rows, pivots=4, chunk=3, annulus=16) == brute_topk([r[:2] for r in rows])
    assert nearest(spark, rows[:4]) == brute_topk([r[:2] for r in rows[:4]])
    assert nearest(spark, []) == []


def test_topk_of_repeated_ids_and_other_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=int(n)).tolist()) for i, n in zip(rng.integers(0, 120, 200), rng.integers(0, 9, 200), strict=True)]
    assert nearest(spark, rows, pivots=3, chunk=2, annulus=8) == brute_topk(rows)


def test_topk_of_huge_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 8)).tolist()) for i in range(120)]
    assert nearest(spark, rows, annulus=32) == brute_topk(rows)
    rows[7] = (7, [1e300, 0.0, 0.0, -1e300])
    got, want = nearest(spark, rows, annulus=32), brute_topk([(i, np.clip(v, -1e97, 1e97).tolist()) for i, v in rows])
    assert [r[3] for r in got] == [r[3] for r in want]


def test_topk_prunes_clustered_vectors(spark):
    """By the triangle inequality most annuli of far clusters are never scored."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 16))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    x = np.concatenate([c + 0.02 * rng.normal(size=(150, 16)) for c in centers])
    q = topk.quantized(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    asked = q.where("vec_id % 50 = 0")
    share = topk.scored_share(topk.found(q, asked, pivots=32, annulus=64, chunk=20), q, asked)
    assert 0 < share < 0.3, share


def test_pivot_bounds_hold():
    rng = np.random.default_rng(4)
    x, q = np.floor(256 * rng.normal(size=(500, 6))), np.floor(256 * rng.normal(size=(40, 6)))
    norm = float(np.sqrt((x * x).sum(1)).max()) * (1 + 1e-9)
    p = topk.fit_pivots(x[:200], 7)
    true = np.sqrt((q * q).sum(1)[:, None] + norm * norm - 2 * q @ x.T)
    to_x, to_q = topk._distances(x, p, topk._lengthened(x, norm)), topk._distances(q, p, 0.0)
    assert (np.abs(to_q[:, None] - to_x[None]).max(2) <= true + 1e-6 * norm).all()


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, None, "?"), (2, 0, "system", "alone")]
    d = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.perspective: r for r in chat.dialogues(d).collect()}
    assert set(got) == {"ann", "bob"}
    a = got["ann"]
    assert [a.text[m.start : m.end] for m in a.mask] == ["hi < |im_end|><|im_end|>"]
    assert a.text.startswith("<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\n") and "user name=bob" in a.text


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, monkeypatch, one_task):
    """In one task or dealt out, against a plain search; a path, a star, a cycle, loops and repeated edges."""
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 60)] + [(3000 + i, 3000 + (i + 1) % 9) for i in range(9)] + [(5, 5), (7, -7), (7, -7), (-7, 7)]
    edges += [(rng.randrange(4000, 4100), rng.randrange(4000, 4100)) for _ in range(60)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.u: r.root for r in found.collect()} == {x: m for x, m in least.items() if x != m}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
