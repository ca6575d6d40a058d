"""Scalar text functions on columns. White-space classes and line ends are those of Python's re and str, on Java's regex engine."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java's Unicode white space, and the four separators that Python counts too.
SPACE = r"[\s\x1c-\x1f]"
#: What cleaning replaces after backslashes have gone, and by what, in this order; tabs become blanks between the first two.
LINE_ENDS = ("\r\n?", "\n")
CLEANING = (
    (r"(?md)^[=\-_*]{3,}\s*$", ""),
    (r"(?U)[\s\x1c-\x1f&&[^\n]]+", " "),
    (r"(?md)^[ \t]+|[ \t]+$", ""),
    ("\n{3,}", "\n\n"),
)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Unicode NFC; Spark has no such function, so this one is an Arrow-batched UDF."""
    return _nfc(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def clean(text: Column, normalize: bool = True) -> Column:
    """Conservative cleaning, in this order: NFC, backslashes, line ends, tabs, separator lines, runs of blanks, line ends' blanks, empty lines, ends."""
    t = F.coalesce(text, F.lit(""))
    # Text of ASCII alone is composed already; only a null of it goes to Python.
    t = F.coalesce(nfc(F.when(t.rlike(r"[^\x00-\x7f]"), t)), t) if normalize else t
    t = F.replace(t, F.lit("\\"), F.lit(""))
    t = F.translate(F.regexp_replace(t, *LINE_ENDS), "\t", " ")
    for pattern, by in CLEANING:
        t = F.regexp_replace(t, pattern, by)
    return strip(t)


def optional_title(title: Column) -> Column:
    return F.nullif(strip(title), F.lit(""))


def unique_in_order(a: Column) -> Column:
    return F.array_distinct(F.filter(a, lambda x: x.isNotNull()))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rf"(?U){SPACE}+"), lambda x: x != ""))


def tail_after_prefix(text: Column) -> Column:
    """What follows the last `]` and line feed."""
    return F.substring_index(text, "]\n", -1)


def tokens(text: Column) -> Column:
    """The default tokenizer of both indexing and queries: lower case, split at white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def enriched(raw: Column, document: Column, chapter: Column, section: Column, articles: Column) -> Column:
    """A chunk's text under a line that names its document, chapter, section and articles; parts that are empty are left out."""

    def part(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    head = F.concat_ws(" | ", part("Văn bản: ", document), part("Chương: ", chapter), part("Mục: ", section), part("Điều ", F.array_join(articles, ", ")))
    return F.when(head != "", F.concat(F.lit("["), head, F.lit("]\n"), raw)).otherwise(raw)


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%04d", document_id, index)


def document_of(chunk_id_: Column) -> Column:
    return F.split_part(chunk_id_, F.lit("_chunk_"), F.lit(1))
