"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct 5-word shingles; two link when 100 * |intersection| >= 75 * |union|. Documents with equal sets form one
class, and only one of each class takes part in the join.

Prefixes. A set's shingles are ordered by hash. Sets that link share all but missing(n) = n // 4 shingles of either at most. Shingles that more than FREQUENT sets
index are frequent, the others rare. A set with more than missing(n) rare shingles is plain: the first missing(n) + 1 of them are indexed singly. If two plain
sets link, the prefix that ends first holds a shingle of the other set, and so does the other's prefix. A set with fewer is full of frequent shingles (one of
many near copies, or a well-known passage with little else). All its rare shingles are indexed singly, and its frequent ones in combinations of two:
they fall into partitions by hash, and every two of one partition make a signature. So many are taken, in order, that the set's units,
    (rare shingles that judge) + sum over partitions of (frequent shingles - 1),
exceed missing(n): then whatever the other set misses, a rare shingle or two frequent ones of one partition are left for both. The number of partitions
follows from n, and a set also has the combinations of the partitions of any size it may link with, so it has about n signatures.
Sets of up to WHOLE shingles are judged by all their shingles, larger ones by those whose hashes lie in the first PART of all hashes, and only these are
read from a larger set (unless they might lack units, or a set of WHOLE might link). Whether a shingle is frequent depends on the
shingle alone, as proof needs: on a count over all sets, or on being so common that a sample of the sets shows it (such hot shingles are never gathered in one
place to be counted).

Verification. Sets that share a signature form a bucket. Buckets of single shingles hold FREQUENT sets at most; of their pairs, those go on that share enough
indexed shingles: if the prefix of x, of r rare shingles, ends first and c are shared, x and y share n - r + c shingles at most. Buckets of combinations may be
large, and their pairs are never listed first: in up to LEADER_ROUNDS rounds, while that finds links, their members are compared with one leader, and what links is joined to components. Buckets
that hold several components then are gathered in groups, those with the same smallest member, so that near copies, which share hundreds of buckets, meet once. A group's members are compared by
their sketches in tiles of a bounded size, whatever the group's, and only pairs of different components that lone shingles and sketches let link are listed and verified; so no link between components is lost.
A comparison reads the two whole sets, made again from the texts.

Hashes have 64 bits: two different shingles of compared sets are taken as one with a chance of about n * m / 2^64. Equal sets are told by 128-bit hashes, and a class is named by 64 of those bits.

Defined results. Null or blank text: the empty set, linked with nothing. Fewer than 5 words: the whole sequence is the one shingle. Null doc_id: a document
like others; a component of null ids alone has a null id. Repeated rows: each row has its result. Empty table: no rows. Other columns of the input play no part;
without_near_copies() keeps them, of whatever type and name. Ties: equal sets are one class, named by its smallest doc_id. Very long texts: a set fits into a task's memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, discard, map_arrow, materialize, numbered, pick, small
from quarry.llm.components import components

SIZE = 5
#: 100 * intersection >= LEAST * union.
LEAST = 75
#: A shingle that more prefixes hold is indexed in combinations.
FREQUENT = 8
#: Shingles of a set for each of its partitions, about.
TO_A_PARTITION = 12
#: Sets of so many shingles are judged by all of them, larger ones by those in this part of the hashes.
WHOLE, PART = 256, 0.4
LEADER_ROUNDS = 3
#: One set in so many shows hot shingles: those found HOT_SEEN times or more there, the HOT_MOST most common of them.
HOT_SAMPLE, HOT_SEEN, HOT_MOST = 32, 8, 100_000
#: Bytes of text that are hashed at once; a longer text is hashed as a whole.
SLICE = 1 << 20
#: Members that a task compares with a leader in a row before the leader's set is sent again.
STAR = 1_000
#: Bits of a set's sketch for each of its shingles, at least.
SKETCH_BITS = 8
#: Members of a group that meet in one task are those of two tiles, each of about so many rows and bytes of sketches at most.
TILE_ROWS, TILE_BYTES = 4_096, 8 << 20
#: Bytes of sketches that are compared at once.
COMPARED_BYTES = 8 << 20

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _factors(n: int, seed: int) -> np.ndarray:
    """Odd factors for n places."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_PLACES = [_factors(64, 1)]
_IN_SHINGLE = _factors(SIZE + 1, 2)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words in order; A-Z as a-z."""
    data = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, lengths = edge[0::2], edge[1::2] - edge[0::2]
    if len(starts):
        if (longest := int(lengths.max())) > len(_PLACES[0]):
            _PLACES[0] = _factors(2 * longest, 1)
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        h = np.add.reduceat(data[word].astype(np.uint64) * _PLACES[0][place], first)
        h = _mix(h + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    else:
        h = np.zeros(0, np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(h, np.searchsorted(starts, ends[:-1]))


def shingle_set(h: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a sequence of word hashes."""
    n = len(h)
    if not n:
        return h
    m = min(SIZE, n)
    s = np.zeros(n - m + 1, np.uint64)
    for i in range(m):
        s += h[i : n - m + 1 + i] * _IN_SHINGLE[i]
    s = _mix(s + np.uint64(m) * _IN_SHINGLE[SIZE:])
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The shingle set of each text, hashed in slices."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append(t or b"")
        size += len(part[-1])
        if size >= SLICE:
            yield from map(shingle_set, word_hashes(part))
            part, size = [], 0
    if part:
        yield from map(shingle_set, word_hashes(part))


def set_key(s: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of n: a power of two."""
    return 1 << max(8, (SKETCH_BITS * n - 1).bit_length())


def sketch(s: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of the shingles falls on each bit. Two sets differ in as many shingles as their sketches do in bits, at least.

    The sketch of half the bits is one half exclusive-or the other, so sets of different sizes can be compared.
    """
    bits = sketch_bits(len(s))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def missing(n: int) -> int:
    """Shingles of a set of n at most that a linked set doesn't hold: at LEAST of 100, the intersection has LEAST * n / 100 or more."""
    return n - -(-LEAST * n // 100)


def partitions(n: int) -> int:
    """Partitions of frequent shingles for sets of n shingles, a power of two."""
    most = n // TO_A_PARTITION
    return 1 << (most.bit_length() - 1) if most else 1


def prefix_lengths(s: np.ndarray) -> tuple[int, int]:
    """How many of a set's shingles, in order, are read, and how many of those judge whether it is plain."""
    n = len(s)
    part = int(np.searchsorted(s, np.uint64(int(PART * 2**64))))
    judged = n if n <= WHOLE else part
    # A plain set of WHOLE may end its prefix anywhere, so a set that may link with it is read whole.
    read = n if LEAST * n <= 100 * WHOLE or part - partitions(n) < missing(n) + 1 else part
    return read, judged


def signatures(n: int, read: int, judged: int, place: np.ndarray, shingle: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The single and the combined signatures of a set of n, and how many rare shingles it indexes.

    place, shingle, frequent: those of the `read` first shingles that other sets hold too; any other is rare and can't be shared.
    """
    need = missing(n) + 1
    order = np.unique(place, return_index=True)[1]  # equal rows bring a shingle again
    place, shingle, frequent = place[order], shingle[order].view(np.uint64), frequent[order]
    rare_before = place - np.cumsum(frequent) + frequent
    units = judged - int(frequent[place < judged].sum())
    if units >= need:
        return shingle[~frequent & (rare_before < need)].view(np.int64), np.zeros(0, np.int64), need
    own, held, taken, out = partitions(n), defaultdict(int), 0, []
    common = shingle[frequent]
    for s in common.tolist():
        if units >= need:
            break
        held[(s >> 17) % own] += 1
        units += held[(s >> 17) % own] > 1
        taken += 1
    common = np.sort(common[:taken])
    low, high = -(-LEAST * n // 100), 100 * n // LEAST
    for m in sorted({partitions(low), partitions(n), partitions(high)}):
        by: dict[int, list[int]] = defaultdict(list)
        for s in common.tolist():
            by[(s >> 17) % m].append(s)
        for group in by.values():
            if len(group) > 1:
                g = np.array(group, np.uint64)
                i, j = np.triu_indices(len(g), 1)
                out.append(_mix(g[i] * _IN_SHINGLE[0] + g[j] * _IN_SHINGLE[1] + np.uint64(m)))
    combined = np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)
    return shingle[~frequent].view(np.int64), combined.view(np.int64), read - int(frequent.sum())


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, mark and text (as bytes); doc_id and mark, a hash of the text, name a row, or rows that are equal."""
    return pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n, read, judged, key and node (64 bits of the key) of every document."""
    d = _texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(s), *prefix_lengths(s), set_key(s)) for s in sets(b.column(2).to_pylist())]
            n, read, judged, keys = zip(*rows, strict=True) if rows else ([], [], [], [])
            nodes = [None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int32()) for x in (n, read, judged)), pa.array(keys, pa.binary()), pa.array(nodes, pa.int64())], ["doc_id", "mark", "n", "read", "judged", "key", "node"])

    return map_arrow(d, run, f"doc_id {d.schema[0].dataType.simpleString()}, mark bigint, n int, read int, judged int, key binary, node bigint")


def _prefixes(texts: DataFrame) -> DataFrame:
    """node and prefix (the shingles that are read, in order) of each of the texts that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                nodes, prefixes = [], []
                for s in sets(b.column(0).slice(start, 1000).to_pylist()):
                    if len(s):
                        nodes.append(int.from_bytes(set_key(s)[:8], "little", signed=True))
                        prefixes.append(s[: prefix_lengths(s)[0]].view(np.int64))
                ends = np.cumsum([0, *map(len, prefixes)])
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], ["node", "prefix"])

    return map_arrow(texts.select("text"), run, "node bigint, prefix array<bigint>")


SIGNED = "sig bigint, combined boolean, node bigint, n int, rare int, lone int"


def _signed(shared: DataFrame) -> DataFrame:
    """SIGNED of each node: its signatures, its size, the rare shingles it indexes, and `lone`, how many of those that judge no set it may link with holds.

    No other set reads these, and sets it may link with would: every set reads the first PART of the hashes, and a set of WHOLE shingles at most, judged by all, links
    only with sets that are read whole. Shingles of larger sets beyond PART may be held by sets that don't read them, so they never count as lone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                cols: list[list[np.ndarray]] = [[] for _ in range(6)]
                part = b.slice(s, 500)
                for node, n, read, judged, place, shingle, frequent in zip(*(part.column(i).to_pylist() for i in range(4)), *(part.column(i) for i in range(4, 7)), strict=True):
                    place = place.values.to_numpy()
                    single, combined, rare = signatures(n, read, judged, place, shingle.values.to_numpy(), frequent.values.to_numpy(zero_copy_only=False))
                    k = len(single) + len(combined)
                    for c, x in zip(cols, (np.concatenate([single, combined]), np.arange(k) >= len(single), *(np.full(k, y) for y in (node, n, rare, judged - int((place < judged).sum())))), strict=True):
                        c.append(x)
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in SIGNED.split(", ")])

    return map_arrow(shared, run, SIGNED)


def _signatures(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """SIGNED of the sets of `texts` (mark, text), a text of each class; signatures without a partner may be among them.

    What is shuffled of a set are its prefix's shingles, in three numbers each: `deal` (the shingle, or for hot ones, which are frequent without a count, a hash of
    the node), the node, and `tag` (the place, and for a hot shingle its number among those).
    """
    sample = _prefixes(texts.where(F.pmod("mark", F.lit(HOT_SAMPLE)) == 0)).select(F.explode("prefix").alias("shingle"))
    seen = sample.groupBy("shingle").count().where(F.col("count") >= HOT_SEEN).orderBy(F.desc("count"), "shingle").limit(HOT_MOST)
    hot = materialize(seen.select(F.col("shingle").alias("_hot"), F.row_number().over(Window.orderBy("shingle")).alias("number")), "jaccard-hot")  # HOT_MOST rows at most
    spread = _prefixes(texts).select("node", F.posexplode("prefix").alias("place", "shingle"))
    spread = spread.join(F.broadcast(hot), F.col("shingle") == F.col("_hot"), "left")
    number = F.col("number").cast("long")
    dealt = spread.select("node", F.when(number.isNull(), F.col("shingle")).otherwise(F.xxhash64("node")).alias("deal"), (F.shiftleft(F.coalesce(number, F.lit(0).cast("long")), 32) + F.col("place")).alias("tag"))
    counted = dealt.withColumn("c", F.count("*").over(Window.partitionBy("deal"))).withColumn("number", F.shiftright("tag", 32))
    shared = counted.where("number > 0 or c > 1").join(F.broadcast(hot.withColumnRenamed("number", "_number")), F.col("number") == F.col("_number"), "left")
    shared = shared.select("node", F.pmod("tag", F.lit(1 << 32)).alias("place"), F.coalesce("_hot", "deal").alias("shingle"), ((F.col("number") > 0) | (F.col("c") > FREQUENT)).alias("frequent"))
    by_node = shared.groupBy("node").agg(F.collect_list(F.struct("place", "shingle", "frequent")).alias("s"))
    sized = classes.select(F.col("node").alias("_node"), "n", "read", "judged")
    return _signed(by_node.join(sized, F.col("node") == F.col("_node")).select("node", "n", "read", "judged", "s.place", "s.shingle", "s.frequent"))


def _fits(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can link."""
    return 100 * F.least(a, b) >= LEAST * F.greatest(a, b)


def _sets_again(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes (sorted, binary) of the wanted nodes (node, _id, _mark), from the texts."""
    texts = _texts(docs).join(small(wanted.select("_id", "_mark")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                found = list(sets(b.column(0).slice(s, 500).to_pylist()))
                nodes = [int.from_bytes(set_key(x)[:8], "little", signed=True) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "hashes"])

    # Equal rows bring a set more than once.
    return map_arrow(texts, run, "node bigint, hashes binary").dropDuplicates(["node"])


def _sketches(hashes: DataFrame, nodes: DataFrame) -> DataFrame:
    """_node and sketch (binary) of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sketch(np.frombuffer(x.as_buffer(), np.uint64)).tobytes() for x in part.column(1)], pa.binary())], ["_node", "sketch"])

    return map_arrow(hashes.join(small(nodes.select(F.col("node").alias("_node")).distinct()), F.col("node") == F.col("_node"), "left_semi"), run, "_node bigint, sketch binary")


def _verified(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """a, b, linked of every pair (a, b), each set sent once for each leader `a` it is compared with, and a leader's set once for STAR members."""
    counted = pairs.groupBy("a").agg(F.count("*").alias("c"))
    few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    stars = pairs.join(counted, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / STAR)).alias("part"))
    heads = counted.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / STAR) - 1)).alias("part"))
    met = stars.unionByName(heads)  # two rows a pair at most
    rows = (F.broadcast(met) if few else met).join(hashes, F.col("b") == F.col("node")).select("a", "part", "b", "hashes")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b") != F.col("a")).select("a", "b", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                out: list[tuple[int, int, bool]] = []
                part = batch.slice(s, 2000)
                for a, b, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    x = np.frombuffer(raw.as_buffer(), np.uint64)
                    if a == b:
                        head = x
                        continue
                    small_, large = (x, head) if len(x) <= len(head) else (head, x)
                    at = np.searchsorted(large, small_)
                    both = int((large[np.minimum(at, len(large) - 1)] == small_).sum())
                    out.append((a, b, 100 * both >= LEAST * (len(x) + len(head) - both)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])

    return map_arrow(rows, run, "a bigint, b bigint, linked boolean")


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The buckets that still hold nodes of different components, with each node's component."""
    now = buckets.join(roots, F.col("node") == F.col("u"), "left").select("sig", "node", "n", "lone", F.coalesce("root", "node").alias("comp"))
    mixed = now.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("sig").alias("_sig"))
    return materialize(now.join(mixed, F.col("sig") == F.col("_sig"), "left_semi"), "jaccard-open")


def _enough(a: str, b: str, shared: Column) -> Column:
    """Whether two sets with so many shared single signatures can link: whichever prefix ends first, its set lacks its other rare shingles."""
    most = F.greatest(F.col(f"{a}n") - F.col(f"{a}rare"), F.col(f"{b}n") - F.col(f"{b}rare")) + shared
    return (100 + LEAST) * most >= LEAST * (F.col(f"{a}n") + F.col(f"{b}n"))


def _pairs_of_singles(singles: DataFrame) -> DataFrame:
    """a, b of the buckets of single shingles, FREQUENT members at most, that share enough of them."""
    x, y = (singles.select(F.col("sig").alias(f"{s}sig"), F.col("node").alias(s), F.col("n").alias(f"{s}n"), F.col("rare").alias(f"{s}rare")) for s in "ab")
    both = x.join(y, (F.col("asig") == F.col("bsig")) & (F.col("a") < F.col("b")) & _fits(F.col("an"), F.col("bn")))
    counted = both.groupBy("a", "b").agg(F.count("*").alias("c"), *[F.first(k).alias(k) for k in ("an", "bn", "arare", "brare")])
    return counted.where(_enough("a", "b", F.col("c"))).select("a", "b")


def near_pairs(n: np.ndarray, lone: np.ndarray, comp: np.ndarray, sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of left, one of right, as numbers of rows) of different components that may link by their sizes, lone shingles and sketches. If left is right, each pair once.

    Two sets that link differ in their lone shingles at least, and any two in as many shingles as their sketches do in bits.
    """
    widths = np.array([len(x) for x in sketches])
    at = np.zeros(len(n), np.int64)
    by_width: dict[int, np.ndarray] = {}
    # For each width the sketches of that width, and those of twice the width folded: sets that fit differ by less.
    for w in np.unique(widths):
        own, wide = np.flatnonzero(widths == w), np.flatnonzero(widths == 2 * w)
        x = np.stack([sketches[i] for i in own])
        at[own] = np.arange(len(own))
        if len(wide):
            y = np.stack([sketches[i] for i in wide])
            x = np.concatenate([x, y[:, :w] ^ y[:, w:]])
        by_width[int(w)] = x
    n, lone = n.astype(np.int64), lone.astype(np.int64)
    own_rows = {int(w): int((widths == w).sum()) for w in by_width}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 21) // max(1, len(right)))
    for s in range(0, len(left), step):
        a = left[s : s + step, None]
        sizes = n[a] + n[right]
        may = (comp[a] != comp[right]) & (100 * np.minimum(n[a], n[right]) >= LEAST * np.maximum(n[a], n[right])) & ((100 + LEAST) * (lone[a] + lone[right]) <= (100 - LEAST) * sizes)
        if left is right:
            may &= a < right
        i, j = np.nonzero(may)
        i, j = left[s + i], right[j]
        for w, x in by_width.items():
            here = np.flatnonzero(np.minimum(widths[i], widths[j]) == w)
            most = max(1, COMPARED_BYTES // (8 * w))
            for c in range(0, len(here), most):
                k = here[c : c + most]
                u, v = (at[z] + np.where(widths[z] == w, 0, own_rows[w]) for z in (i[k], j[k]))
                bits = np.bitwise_count(x[u] ^ x[v]).sum(1, dtype=np.int64)
                near = k[(100 + LEAST) * bits <= (100 - LEAST) * (n[i[k]] + n[j[k]])]
                found.append((i[near], j[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _rest(todo: DataFrame, hashes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(pairs, tables they are read from): a, b of the buckets' pairs of different components that may link (near_pairs). todo: sig, node, n, lone, comp.

    Buckets with the same smallest node are one group, whose members meet in tiles; a pair of a group may be one that no bucket holds, which does no harm.
    """
    groups = todo.groupBy("sig").agg(F.min("node").alias("g")).select(F.col("sig").alias("_sig"), "g")
    members = todo.join(groups, F.col("sig") == F.col("_sig")).groupBy("g", "node").agg(*[F.min(c).alias(c) for c in ("n", "lone", "comp")])
    members = materialize(members, "jaccard-members")
    sizes = members.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum(F.col("n").cast("long")) * (SKETCH_BITS / 4 / TILE_BYTES))).alias("tiles")).withColumnRenamed("g", "_g")
    placed = members.join(sizes, F.col("g") == F.col("_g")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    sketches = materialize(_sketches(hashes, members), "jaccard-sketches")
    met = placed.join(sketches, F.col("node") == F.col("_node"))
    key = ("g", "first", "second")
    met = met.select("g", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"), "tile", "node", "n", "lone", "comp", "sketch")

    def compare(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        first, second, tile, node, n, lone, comp = (t.column(i).to_numpy() for i in range(1, 8))
        sketches = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(8)]
        left, right = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
        i, j = near_pairs(n, lone, comp, sketches, left, left if first[0] == second[0] else right)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group: tuple | None = None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                if e > s:
                    if held and tuple(keys[s]) != group:
                        yield compare(held)
                        held = []
                    group = tuple(keys[s])
                    held.append(b.slice(s, e - s))
        if held:
            yield compare(held)

    return map_arrow(met.repartition(*key).sortWithinPartitions(*key), run, "a bigint, b bigint").distinct(), [members, sketches]


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, roots): rows doc_id, n, key of every document; classes key, node, first (its smallest doc_id); roots u, root of classes' nodes that a link touches.

    Tables go once what follows has been written.
    """
    rows = materialize(shingled(docs), "jaccard-rows")
    some = rows.where("n > 0")
    classes = some.groupBy("key", "node", "n", "read", "judged").agg(F.min(F.struct("doc_id", "mark")).alias("pick"), F.min("doc_id").alias("first"))
    classes = materialize(classes, "jaccard-classes")
    picked = classes.select(F.col("key").alias("_key"), "pick")
    copies = some.join(picked, F.col("key") == F.col("_key")).where(F.struct("doc_id", "mark") != F.col("pick")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    copies = materialize(copies, "jaccard-copies")
    texts = _texts(docs).join(small(copies), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_anti")
    signed = materialize(_signatures(texts.select("mark", "text"), classes), "jaccard-signed")
    listed = materialize(_pairs_of_singles(signed.where("not combined")), "jaccard-listed")
    combined = signed.where("combined").drop("combined", "rare")
    twice = combined.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select(F.col("sig").alias("_sig"))
    buckets = materialize(combined.join(twice, F.col("sig") == F.col("_sig"), "left_semi"), "jaccard-buckets")
    discard(copies, signed)
    active = listed.select(F.col("a").alias("_node")).union(listed.select("b")).union(buckets.select("node")).distinct()
    wanted = materialize(active.join(classes, F.col("_node") == F.col("node")).select("node", F.col("pick.doc_id").alias("_id"), F.col("pick.mark").alias("_mark")), "jaccard-wanted")
    hashes = materialize(_sets_again(docs, wanted), "jaccard-sets")
    discard(wanted)
    state = _Verification(hashes)
    todo: DataFrame | None = buckets
    for r in range(LEADER_ROUNDS):
        own = todo if r else todo.withColumn("comp", F.col("node"))
        # First the member with fewest shingles of its own, as an original among its edited copies; then others.
        rank = F.struct("lone", "node", "n", "comp") if r == 0 else F.struct(F.xxhash64("node", F.lit(r)).alias("lone"), "node", "n", "comp")
        leaders = own.groupBy("sig").agg(F.min(rank).alias("l")).select(F.col("sig").alias("_sig"), F.col("l.node").alias("a"), F.col("l.n").alias("an"), F.col("l.comp").alias("acomp"))
        stars = own.join(leaders, F.col("sig") == F.col("_sig")).where((F.col("comp") != F.col("acomp")) & _fits(F.col("n"), F.col("an"))).select("a", F.col("node").alias("b")).distinct()
        found = state.verify(stars.unionByName(listed).distinct() if r == 0 else stars)
        if r and not found:
            break
        left = _open(todo, state.roots)
        discard(todo)
        todo = left
        if todo.isEmpty():
            break
    if not todo.isEmpty():
        pairs, read = _rest(todo, hashes)
        rest = materialize(pairs, "jaccard-rest")
        state.verify(rest)
        discard(rest, *read)
    discard(todo, listed, hashes, *state.checked)
    return rows, classes, state.roots


class _Verification:
    """What has been verified: `checked`, tables of pairs (a, b, linked), and `roots`, the components of all links so far."""

    def __init__(self, hashes: DataFrame):
        self.hashes, self.checked, self.roots = hashes, [], None

    def verify(self, pairs: DataFrame) -> bool:
        """Verify the pairs that haven't been, and join what links to components; whether any pair links."""
        for done in self.checked:
            seen = done.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
            pairs = pairs.join(seen, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")
        pairs = materialize(pairs, "jaccard-pairs")
        new = materialize(_verified(pairs, self.hashes), "jaccard-verified")
        discard(pairs)
        self.checked.append(new)
        found = new.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if self.roots is not None and found.isEmpty():
            return False
        before = self.roots
        self.roots = components(found if before is None else found.unionByName(before.select("u", F.col("root").alias("v"))), "jaccard-components")
        discard(before)
        return True


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the smallest doc_id that its links reach."""
    rows, classes, roots = links(docs)
    joined = classes.join(roots, F.col("node") == F.col("u"), "left").select("key", F.col("first"), F.coalesce("root", "node").alias("comp"))
    least = joined.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = materialize(joined.join(least, "comp").select("key", "component_id"), "jaccard-named")
    out = rows.select("doc_id", "n", "key").join(small(named).withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one of each component stays: that with its smallest doc_id.

    Ids may repeat: of a component's rows with its smallest id, that of the smallest text hash stays, and of rows with that id and text one. Null ids come last.
    Rows without words are linked with nothing and all stay, equal ones once.
    """
    rows, classes, roots = links(docs)
    comps = classes.join(roots, F.col("node") == F.col("u"), "left").select(F.col("key").alias("_key"), F.coalesce("root", "node").alias("comp"))
    # How many rows have an id and text; only where several do, their other columns matter.
    counted = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("c"), F.first("key").alias("key"))
    least = counted.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "c")).alias("l"))
    least = least.join(comps, F.col("key") == F.col("_key")).groupBy("comp").agg(F.min("l").alias("l"))
    kept = least.select(F.col("l.doc_id").alias("_keep"), F.col("l.mark").alias("_mark"), F.col("l.c").alias("_c"), F.lit(False).alias("_blank"))
    kept = materialize(kept.union(counted.where("key is null").select("doc_id", "mark", "c", F.lit(True))), "jaccard-kept")
    names, own = docs.columns, numbered(docs)
    doc_id, text = (F.col(f"_c{names.index(n)}") for n in ("doc_id", "text"))
    held = own.join(small(kept), doc_id.eqNullSafe(F.col("_keep")) & (F.xxhash64(text) == F.col("_mark")))
    alone = held.where("_c = 1").select(*own.columns)
    if kept.where("_c > 1").isEmpty():
        return alone.toDF(*names)
    row = F.xxhash64(F.to_json(F.struct(*own.columns), {"ignoreNullFields": "false"}))
    several = held.where("_c > 1").withColumn("_row", row).groupBy("_keep", "_mark", F.when(F.col("_blank"), F.col("_row")).alias("_each")).agg(F.min_by(F.struct(*own.columns), "_row").alias("_r"))
    return alone.unionByName(several.select("_r.*")).toDF(*names)
