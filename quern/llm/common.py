"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import places
from quern.sources.shipping import ship  # noqa: F401  # the operators take it from here

#: White space between words, as a Java regular expression and as bytes.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared folder of spark.checkpoint.dir."""
    return places.scratch(spark, name)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and its path: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def through_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    return written(df, name)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_doc, _id, _t): the whole row as a struct, so that no column name can clash; null text is empty."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"), F.col(f"`{key}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))


def unpacked(columns: list[str]) -> list[Column]:
    """The columns of a packed row again."""
    return [F.col("_doc").getField(c).alias(c) for c in columns]


def id_crc(key: str = "doc_id") -> Column:
    """crc32 of the id as text, for folds."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 2_000_000, rows: int = 1 << 31) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of a string column in parts of about so many bytes and at most so many rows, a row at least: bounds what array code holds at once."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = utf8(column)[1]
    at = 0
    while at < len(column):
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1))
        yield at, column.slice(at, stop - at)
        at = stop


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads the bits of each value."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first): 64-bit hashes of the A-Z-lowered words of all texts, where they are, and each text's first word (n + 1).

    Words are cut at white space and at the ends of texts. Equal words have equal hashes; unequal ones almost never.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = _SPACE[data]
    begin = ~gap
    begin[1:] &= gap[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begin[edges] = ~gap[edges]
    starts = np.flatnonzero(begin)
    stop = ~gap
    stop[:-1] &= gap[1:]
    stop[edges - 1] = ~gap[edges - 1]
    stop[-1] = ~gap[-1]
    ends = np.flatnonzero(stop) + 1
    longest = int((ends - starts).max()) if len(starts) else 0
    bounds = np.concatenate([[0], starts])
    place = np.arange(len(data), dtype=np.int64) - np.repeat(bounds, np.diff(np.append(bounds, len(data))))
    np.clip(place, 0, max(longest - 1, 0), out=place)
    value = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(max(longest, 1))[place]
    value[gap] = 0
    h = mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    return h, starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of so many words that begin at each word (len - size + 1 of them; they may cross texts)."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + n]
    return mixed(out)
