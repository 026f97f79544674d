"""Shared plumbing: streamed groups, slices of batches and hashing in numpy. Cuts, split joins and components are the library's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.components import HOT_SHARE, connected_components, cut, join_split

#: Bytes of text that one vectorised step works on; bounds a Python worker's memory whatever an Arrow batch holds.
SLICE_BYTES = 2 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c):
    """A-Z lower-cased and nothing else. For pure ASCII, lower() is that, and much faster than translate()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; Spark computes a repeated expression inside lambdas again each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text). Columns that are already so called stay untouched, which lets Spark recognise equal
    subplans and read one shuffle of the texts several times."""
    kinds = dict(docs.dtypes)
    doc = F.col("doc_id") if id_col == "doc_id" and kinds.get("doc_id") == "bigint" else F.col(id_col).cast("long").alias("doc_id")
    return docs.select(doc, F.col("text") if text_col == "text" else F.col(text_col).alias("text"))


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for a shuffle that adaptive execution does not size: enough for `each` rows in one, and at least the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch that hold about `most` bytes of text each, or one row that holds more."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()  # workers live on and serve other functions


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of Arrow batches whose rows come sorted by their first `keys` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit words (Steele, Lea and Flood's SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def min_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        old = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == old).all():
            break
    return label


__all__ = ["HOT_SHARE", "ascii_lower", "connected_components", "cut", "groups", "join_split", "let", "min_labels", "mix64", "parts_for", "slices", "texts"]
