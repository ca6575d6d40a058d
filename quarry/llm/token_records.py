"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record file holds frames, one for each document, in ascending order of doc_id over all files:

    length      8 bytes   little-endian, of the payload
    check       4 bytes   masked CRC-32 of those 8 bytes
    payload     `length` bytes
    check       4 bytes   masked CRC-32 of the payload

A payload is the byte of flags (1: doc_id is null), doc_id (8 bytes, signed), the number of ids (8 bytes) and the zstd-compressed ids, in 2 bytes each
if the vocabulary has at most 65,536, else 4. The mask turns a check right by 15 bits and adds a constant, as record formats of this kind do,
so that a check over bytes which hold checks stays sound. The offset index is a Parquet table: file, doc_id, offset, length, n_tokens, start_in_file.

A task writes its file under a name of its attempt and then renames it, so a lost executor or a second attempt leaves whole files only.

Defined results. Null text: no ids but the end id. Null doc_id: before all others. Repeated rows, or ids: a record each, side by side, by text. Very long texts: a record
fits into a task's memory. A frame whose check doesn't hold, or that ends early, raises ValueError. Empty table: no record. Other columns of the input play no part.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, materialize, new_path, open_shared, pick, publish

END_ID = 1
#: Fixed value: what the mask adds.
MASK_ADDS = 0xA282EAD8
#: What a worker process remembers with its ids: parts between blanks, and pieces of such parts.
CACHED_PARTS = 250_000
CACHED_PIECES = 700_000
INDEX = "file int, doc_id bigint, nth bigint, offset bigint, length bigint, n_tokens bigint, start_in_file bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADDS) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(f) -> bytes | None:
    """The next payload, None at the end; raises ValueError where a check fails or bytes are missing."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("damaged length")
    n = struct.unpack("<Q", head[:8])[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked_crc(body[:n]):
        raise ValueError("damaged payload")
    return body[:n]


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    import zstandard

    raw = ids.astype(f"<u{width}").tobytes()
    return struct.pack("<BBqQ", doc_id is None, width, doc_id or 0, len(ids)) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and the ids as unsigned 32-bit numbers."""
    import zstandard

    null, width, doc_id, n = struct.unpack_from("<BBqQ", payload)
    raw = zstandard.ZstdDecompressor().decompress(payload[18:], max_output_size=max(1, n * width))
    return None if null else doc_id, np.frombuffer(raw, f"<u{width}").astype("<u4")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for the 256 bytes in a byte-level vocabulary: printable bytes for themselves, the others in order from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """The tokenizers library's encode(text, add_special_tokens=False), with the ids of parts remembered: a part's text to its packed ids.

    The tokenizer drops white space, and neither its normalization nor its merges reach across a space or a line feed, so a text's ids are
    those of its parts between them, in order. A part of Latin letters and then punctuation splits further, as the tokenizer splits it, into
    lower-case letters and punctuation, which go to its model at once; any other part goes through the whole tokenizer. Only time depends on what is remembered.
    """

    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
    #: Parts like these may hold the text of a special token.
    SPECIAL = "<|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {"": b""}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], self.kind).tobytes()
            if len(self.pieces) >= CACHED_PIECES:
                self.pieces.clear()
                self.pieces[""] = b""
            self.pieces[piece] = ids
        return ids

    def __missing__(self, part: str) -> bytes:
        if (m := self.SIMPLE.fullmatch(part)) and self.SPECIAL not in part:
            ids = self._piece(m[1].lower()) + self._piece(m[2])
        else:
            ids = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, self.kind).tobytes()
        if len(self) < CACHED_PARTS:
            self[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), self.kind)


@cache
def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordEncoder(path)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text, append `end_id`, and write the record files into `path`; the result is the offset index, written too.

    The documents are range-partitioned by doc_id; file numbers follow that order. (The ranges are sampled by doc_id alone; only the texts' one shuffle moves them.)
    """
    tokenizer = tokenizer or default_tokenizer()
    d = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    dealt = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get(), encoder(tokenizer)
        number, final = task.partitionId(), f"{path}/records-{task.partitionId():06d}.bin"
        temporary = f"{path}/attempt-{task.taskAttemptId()}-{task.partitionId():06d}.tmp"
        offset = start = nth = 0
        index: list[tuple] = []

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip(("file", "doc_id", "nth", "offset", "length", "n_tokens", "start_in_file"), r, strict=True)) for r in index], schema=pa.schema([("file", pa.int32()), *[(n, pa.int64()) for n in ("doc_id", "nth", "offset", "length", "n_tokens", "start_in_file")]]))
            index.clear()
            return out

        f = None
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = f or open_shared(temporary, "wb")
                ids = np.append(enc.encode(text.as_py() or ""), end_id)
                data = frame(pack(doc_id, ids, enc.width))
                f.write(data)
                index.append((number, doc_id, nth, offset, len(data), len(ids), start))
                offset, start, nth = offset + len(data), start + len(ids), nth + 1
            if len(index) >= 5000:
                yield rows()
        if f:
            f.close()
            publish(temporary, final)
        yield rows()

    index = map_arrow(dealt, run, INDEX)
    index.write.parquet(f"{path}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


def file_starts(index: DataFrame) -> DataFrame:
    """file, n (its ids) and file_start: the ids of all files before it. One row for each file."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    return files.withColumn("file_start", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, unsigned 32-bit little-endian) and ids_crc32 of every record, read from the files in order."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    files = materialize(file_starts(index), "record-files")
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])
        for b in batches:
            for number, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open_shared(f"{path}/records-{number:06d}.bin", "rb") as f:
                    held: list[dict] = []
                    while (payload := read_frame(f)) is not None:
                        doc_id, ids = unpack(payload)
                        raw = ids.tobytes()
                        held.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids": raw, "ids_crc32": zlib.crc32(raw)})
                        start += len(ids)
                        if len(held) >= 500:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return map_arrow(files.select("file", "file_start").repartition(min(n, 10_000), "file"), run, "doc_id bigint, start bigint, n_tokens bigint, ids binary, ids_crc32 bigint")


def read_shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """doc_id and ids of every record in a random order that `seed` fixes: the offset index is sorted by a hash, and records are read at their offsets."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index").withColumn("key", F.xxhash64("file", "nth", F.lit(seed)))
    order = index.repartitionByRange("key", "file", "nth").sortWithinPartitions("key", "file", "nth").select("file", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for s in range(0, b.num_rows, 500):
                held = []
                for r in b.slice(s, 500).to_pylist():
                    with open_shared(f"{path}/records-{r['file']:06d}.bin", "rb") as f:
                        f.seek(r["offset"])
                        doc_id, ids = unpack(read_frame(io.BytesIO(f.read(r["length"]))))
                    held.append({"doc_id": doc_id, "ids": ids.tobytes()})
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return map_arrow(order, run, "doc_id bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write the records and read them back: doc_id, start, n_tokens, ids_crc32."""
    path = path or new_path(docs.sparkSession, "records")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")
