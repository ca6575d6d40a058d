"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding at positions where the split pattern always starts a new match, so the library's regex never sees more
than about PIECE characters at once and the ids are those of the whole text. Long runs of blanks, on which that regex runs out of stack, are
found apart from it: all of a run but its last blank (all, at the text's end) is one match of the pattern, and is encoded as such. Decoding
joins the tokens' bytes; it never passes through str, so ids that end inside a character decode to the same bytes.

Defined results. Null text: empty, no ids. Lone surrogates can't be in a Spark string. Very long texts, with or without blanks: encoded whole,
in one task's memory. Repeated rows, or ids: each row encoded. Null doc_id: a row like others. Empty table: no rows. Other columns of the
input play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import map_arrow, pick

#: Characters of a text that are encoded at once.
PIECE = 50_000
#: Runs of so many blanks or more (the pattern's `\s`: Unicode white space) are encoded apart from the pattern.
LONG_RUN = 1_000
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    """The pattern that splits text before the merges."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def encoding(path: str, pattern: str):
    """The encoding of a rank file, once per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """Cut a text at spaces between two non-blanks: a match of the pattern ends before such a space and the next begins with it.

    A stretch without such a space stays whole.
    """
    start = 0
    while len(text) - start > most:
        at = start + most
        while (at := text.find(" ", at)) >= 0 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts that are encoded apart, and whether a part is one match by itself, as a long run of blanks is."""
    start = 0
    for run in _BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if start < run.start():
            yield from ((p, False) for p in pieces(text[start : run.start()]))
        yield text[run.start() : end], True
        start = end
    if start < len(text):
        yield from ((p, False) for p in pieces(text[start:]))


def encode(text: str | None, enc) -> np.ndarray:
    parts = [np.array(enc._encode_single_piece(p), np.uint32) if whole else enc.encode_to_numpy(p, disallowed_special=()) for p, whole in stretches(text or "")]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def decode(ids: np.ndarray, enc) -> bytes:
    return enc.decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (unsigned 32-bit little-endian numbers, as binary) of every document's whole text."""
    path, pattern, d = path or default_ranks(), pattern or default_pattern(), pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                ids = [encode(t, enc).astype("<u4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_arrow(d, run, f"doc_id {d.schema[0].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and bytes (the decoded bytes) from doc_id, ids as encode_documents() returns them. Null ids decode to no bytes."""
    path, pattern, d = path or default_ranks(), pattern or default_pattern(), pick(encoded, "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                out = [decode(np.frombuffer(x or b"", "<u4"), enc) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return map_arrow(d, run, f"doc_id {d.schema[0].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and decoded again from the ids, in one pass."""
    path, pattern, d = path or default_ranks(), pattern or default_pattern(), pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1):
                ids = encode(text.as_py(), enc)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decode(ids, enc)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(d, run, f"doc_id {d.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
