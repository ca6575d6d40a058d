"""WARC archives of web pages, with payload deduplication and an externally merged capture index.

Each task writes its pages as gzip members of a WARC file and, for every RUN_ENTRIES captures, a run: index lines sorted by URL key, time
and page. The runs undergo k-way merging by a loser tree, FAN_IN at a time, until the last pass merges all that is left, a range of keys in
each task; its files, in their order, hold the capture histories in global order. All files are streamed; a merge holds one line of each run.

Among pages with equal payloads of at least MIN_PAYLOAD bytes, the one with the smallest page_id is a response; the others are revisit
records without payload that name it. Equal payloads are told by SHA-256; digests are computed in the JVM and grouped there, so a payload
that a third of all pages share costs a partial count in each task.

Defined results. Null html: an empty payload. Null page_id: a capture after all others of its key and time, and never the first of equal
payloads unless all their ids are null (then all are responses). Repeated page_id: rows that equal the smallest id of their payload are all
responses. Null url: the key of an empty URL. Ties of key and time: by page_id, then by place in the archives. Very long payloads: a record fits into a task's memory. Empty table: no
files. Other columns of the input play no part.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, materialize, new_path, open_shared, pick, publish, small

MIN_PAYLOAD = 100
RUN_ENTRIES = 50_000
#: Tasks that read the archives back, at most.
READ_TASKS = 10_000
FAN_IN = 128
#: Lines of a merged range, about.
RANGE_ENTRIES = 200_000
#: Lines between two fences at least, and fences of a merged run at most, about.
FENCE, FENCES = 256, 1000
#: Captures without a time of their own are a second apart from here on, by page_id.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN = "run string, entries bigint, fences array<struct<key:string,offset:bigint>>"
ENTRY = "url_key string, time string, page_id bigint, file string, offset bigint, length bigint, digest string, record_type string"


def url_key(url: str | None) -> str:
    """The host's labels in reverse order, then path and sorted query, lower-case, without scheme, www, port and fragment."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return quote((url or "").lower())
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return f"{','.join(reversed(host.split('.')))}){u.path.lower() or '/'}{'?' + query.lower() if query else ''}".replace("\n", "").replace("\t", "").replace("\0", "")


def capture_time(page_id: int | None) -> datetime:
    return EPOCH + timedelta(seconds=max(0, page_id or 0) % 3_000_000_000)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with HTTP head and payload, or a revisit with the head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = quote(url or "", safe="%/:?#[]@!$&'()*+,;=~")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>", f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {refers_to}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The headers (lower-case names), `http` (the HTTP head's) and `payload` of a record."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    out = fields(head)
    http, _, payload = rest[: int(out["content-length"])].partition(b"\r\n\r\n")
    return out | {"http": fields(http), "payload": payload}


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, so that a new item plays one match a level, against stored losers."""

    def __init__(self, sources: Iterable[Iterator], key):
        self.sources, self.key = list(sources), key
        self.k = max(1, len(self.sources))
        self.items = [next(s, None) for s in self.sources] or [None]
        self.keys = [None if x is None else key(x) for x in self.items]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        """-1, a seat not yet taken, wins, so that the first players are parked on their way; an exhausted source loses."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.keys[a], self.keys[b]
        return y is None and (x is not None or a < b) or x is not None and y is not None and (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            if i < 0:
                break
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while (w := self.losers[0]) >= 0 and self.items[w] is not None:
            yield self.items[w]
            self.items[w] = next(self.sources[w], None)
            self.keys[w] = None if self.items[w] is None else self.key(self.items[w])
            self._play(w)


def sort_key(entry: list) -> tuple:
    """Of an index line: URL key, time, page_id (null last), and the place of the record."""
    return (entry[0], entry[1], entry[2] is None, entry[2] or 0, entry[3], entry[4])


def place(entry: list) -> str:
    """URL key and time of an index line, in one string of the same order; fences and ranges are made of these, so one URL's captures may span ranges."""
    return f"{entry[0]}\0{entry[1]}"


def write_run(path: str, attempt: int, entries: Iterable[list], every: int = FENCE) -> tuple[str, int, list[tuple[str, int]]]:
    """Sorted index lines to a file, with a fence at every so many lines; what RUN has of it."""
    fences, offset, n, temporary = [], 0, 0, f"{path}.{attempt}.tmp"
    with open_shared(temporary, "wb") as f:
        for e in entries:
            line = json.dumps(e, ensure_ascii=False).encode() + b"\n"
            if n % every == 0:
                fences.append((place(e), offset))
            f.write(line)
            offset, n = offset + len(line), n + 1
    publish(temporary, path)
    return path, n, fences


def read_run(path: str, fences: list[tuple[str, int]], low: str = "", high: str | None = None) -> Iterator[list]:
    """The lines of a run whose places are in [low, high), from the last fence before them on."""
    at = bisect.bisect_left([k for k, _ in fences], low) - 1
    with open_shared(path, "rb") as f:
        f.seek(fences[at][1] if at >= 0 else 0)
        for line in f:
            e = json.loads(line)
            if high is not None and place(e) >= high:
                break
            if place(e) >= low:
                yield e


def _runs(rows: Iterable[tuple]) -> pa.RecordBatch:
    rows = list(rows)
    fence = pa.list_(pa.struct([("key", pa.string()), ("offset", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[{"key": k, "offset": o} for k, o in r[2]] for r in rows], fence)], ["run", "entries", "fences"])


def write(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write the WARC files and their sorted runs under `path`; a row for each run."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    d = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    d = d.withColumn("digest", F.sha2("payload", 256))
    facts = materialize(d.select("page_id", "digest", F.octet_length("payload").alias("n")), "warc-facts").where(F.col("n") >= min_payload)
    firsts = facts.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    # A row for each payload that repeats: however many pages share one, it's one row.
    firsts = small(materialize(firsts.select(F.col("digest").alias("_digest"), "first"), "warc-firsts"))
    again = F.when((F.octet_length("payload") >= min_payload) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    d = d.join(firsts, F.col("digest") == F.col("_digest"), "left").select("page_id", "url", "payload", "digest", again.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        name = f"pages-{number:06d}.warc.gz"
        temporary, f, offset, entries, done = f"{path}/{name}.{attempt}.tmp", None, 0, [], []

        def flush() -> None:
            entries.sort(key=sort_key)
            done.append(write_run(f"{path}/runs/run-{number:06d}-{len(done):04d}", attempt, entries))
            entries.clear()

        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c for c in b.columns), strict=True):
                page_id, url, digest, refers_to = page_id.as_py(), url.as_py(), digest.as_py(), refers_to.as_py()
                f = f or open_shared(temporary, "wb")
                data = gzip_member(record(page_id, url, payload.as_py(), digest, refers_to))
                f.write(data)
                entries.append([url_key(url), f"{capture_time(page_id):%Y%m%d%H%M%S}", page_id, name, offset, len(data), digest, "response" if refers_to is None else "revisit"])
                offset += len(data)
                if len(entries) >= RUN_ENTRIES:
                    flush()
        if entries:
            flush()
        if f:
            f.close()
            publish(temporary, f"{path}/{name}")
        yield _runs(done)

    return materialize(map_arrow(d, run, RUN), "warc-runs")


def merge(runs: DataFrame, path: str, fan_in: int = FAN_IN) -> DataFrame:
    """Merge sorted runs into capture histories: files history-*.idx under `path` in global order. A row for each file, as for runs."""
    spark, n, level = runs.sparkSession, runs.count(), 0

    def merged(target: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            attempt = TaskContext.get().taskAttemptId()
            for b in batches:
                for job in b.to_pylist():
                    sources = [read_run(r["run"], [(x["key"], x["offset"]) for x in r["fences"]], job["low"], job["high"]) for r in sorted(job["runs"], key=lambda r: r["run"])]
                    yield _runs([write_run(f"{path}/{target}-{job['job']:06d}.idx", attempt, LoserTree(sources, sort_key), max(FENCE, sum(r["entries"] for r in job["runs"]) // FENCES))])

        return run

    one = F.struct("run", "entries", "fences")
    while n > fan_in:  # each job merges so many whole runs; their number falls by that factor
        jobs = runs.withColumn("job", F.pmod(F.xxhash64("run"), F.lit(-(-n // fan_in)))).groupBy("job").agg(F.collect_list(one).alias("runs"), F.lit("").alias("low"), F.lit(None).cast("string").alias("high"))
        runs = materialize(map_arrow(jobs.repartition(-(-n // fan_in), "job"), merged(f"level-{level}"), RUN), "warc-runs")
        n, level = runs.count(), level + 1
    # The last pass: at most fan_in runs, cut at places that part their entries evenly; a job for each range.
    fences = runs.select(F.explode("fences.key").alias("key"))
    total = runs.agg(F.sum("entries")).first()[0] or 0
    parts = max(1, min(-(-total // RANGE_ENTRIES) if total > RANGE_ENTRIES else min(8, total // 2000), 10_000))
    lows: list[str] = []  # fewer than `parts` keys
    if parts > 1:
        dealt = fences.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("low"))
        lows = sorted({r.low for r in dealt.collect()})[1:]
    bounds = list(zip(["", *lows], [*lows, None], strict=True))
    ranges = spark.createDataFrame([(i, low, high) for i, (low, high) in enumerate(bounds)], "job int, low string, high string").withColumn("all", F.lit(0))
    last = runs.groupBy(F.lit(0).alias("all")).agg(F.collect_list(one).alias("runs"))  # one row of at most fan_in runs
    jobs = ranges.repartition(len(bounds), "job").join(F.broadcast(last), "all")
    return materialize(map_arrow(jobs, merged("history"), RUN), "warc-histories").where("entries > 0")


def histories(spark: SparkSession, merged: DataFrame) -> DataFrame:
    """The captures of the merged index (ENTRY): files are in global order, and lines in order within each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRY.split(", ")]
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "offset", "length") else pa.string()) for n in names])
        for b in batches:
            for path in b.column(0).to_pylist():
                held = []
                for e in read_run(path, []):
                    held.append(dict(zip(names, e, strict=True)))
                    if len(held) >= 5000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return map_arrow(merged.select("run").repartitionByRange("run"), run, ENTRY)


def read(spark: SparkSession, path: str, captures: DataFrame, files: int = 1) -> DataFrame:
    """Read the captures' records from the archives, file by file in the order of offsets: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits).

    files: how many archives there are. The tasks are told by it, as adaptive execution sees only the short index lines. A response whose payload doesn't match its digest raises ValueError.
    """
    places = captures.select("file", "offset", "length").repartition(max(1, min(files, READ_TASKS)), "file").sortWithinPartitions("file", "offset")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            for s in range(0, b.num_rows, 500):
                held = []
                for r in b.slice(s, 500).to_pylist():
                    if r["file"] != name:
                        if f:
                            f.close()
                        name, f = r["file"], open_shared(f"{path}/{r['file']}", "rb")
                    f.seek(r["offset"])
                    x = parse_record(zlib.decompress(f.read(r["length"]), 31))
                    digest, full = x["warc-payload-digest"].removeprefix("sha256:"), x["warc-type"] == "response"
                    if full and hashlib.sha256(x["payload"]).hexdigest() != digest:
                        raise ValueError(f"damaged record at {r['offset']} of {name}")
                    held.append({"page_id": number(x.get("x-page-id")), "payload_bytes": int(x["http"]["content-length"]), "payload_digest": digest, "record_type": x["warc-type"], "refers_to": number(x.get("x-refers-to-page-id")), "url": x["warc-target-uri"], "payload": x["payload"] if full else None})
                yield pa.RecordBatch.from_pylist(held, schema=schema)
        if f:
            f.close()

    return map_arrow(places, run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary")


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives, merge the index, and read every record back through it."""
    spark, path = pages.sparkSession, path or new_path(pages.sparkSession, "warc")
    runs = write(pages, path)
    return read(spark, path, histories(spark, merge(runs, path)), runs.count()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
