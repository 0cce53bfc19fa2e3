"""What several training-data operators share: tables, the shared folder, words."""

from __future__ import annotations

import re

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialize, shared_dir  # noqa: F401  the operators take them from here

#: Upper-case ASCII letters to lower case, and nothing else.
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A word: digits, lower-case ASCII letters and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Characters of text that a Python worker holds as separate words at a time.
SLICE_CHARS = 1_000_000
#: Bytes of text that a Python worker holds as strings at a time.
PART_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def words(text: str | None) -> list[str]:
    """The words of a whole text; a null has none."""
    return WORD.findall(lower(text)) if text else []


def slices(texts: list[str | None], chars: int = SLICE_CHARS):
    """Ranges (a, b) over texts of about that many characters; a longer text stands alone."""
    a = n = 0
    for b, t in enumerate(texts):
        if n and n + len(t or "") > chars:
            yield a, b
            a, n = b, 0
        n += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def parts(batches, at: int, size: int = PART_BYTES):
    """Arrow batches in parts of about that many bytes of text in column ``at``: what a worker turns
    into Python objects at a time. A longer text stands alone; an empty batch stays."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype("int64")
        if n.sum() <= size:
            yield batch
            continue
        part = (n.cumsum() - 1).clip(0) // size
        edges = [0, *(part[1:] != part[:-1]).nonzero()[0] + 1, len(n)]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


_LARGE: dict = {}


def large(key=None, make=None):
    """The worker's one large object: made at first, kept between tasks, gone when another is asked
    for. Without a key it only goes: workers serve many stages, and memory is bounded."""
    if key not in _LARGE:
        _LARGE.clear()
        if key is not None:
            _LARGE[key] = make()
    return _LARGE.get(key)


def keyed(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Only the key as a long and the text, whatever other columns there are."""
    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
