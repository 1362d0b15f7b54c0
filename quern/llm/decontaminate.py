"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so Jaccard similarity says little; what counts is
the share of an item's shingles that a document holds. Items are partitioned by the size
of their shingle sets. In a partition whose largest set has u shingles, an item's sketch is
its floor((1 - t) * u) + 1 smallest MinHash values. A document that holds at least the share
t of the item misses fewer shingles than that, so it holds one of the sketch for certain:
candidates lose nothing. Each candidate is then verified by exact shingle containment on
the words themselves.

Documents are read in place, whole, once, with no shuffle. Sketches are made for bounded batches of
items (by characters, checked). One batch goes to the tasks as it is; several are written to the
shared folder, one after the other, and tasks hold one at a time beside the rows at hand.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import shared_dir, shingle_hashes, ship, slices, table, utf8, word_hashes

#: Words in a shingle, share of an item's shingles, and characters of items in a pass.
SHINGLE, SHARE, PASS_CHARS = 5, 0.8, 16_000_000

_PLAIN = np.full(256, 32, np.uint8)
for _a, _b in ((48, 57), (97, 122), (128, 255)):
    _PLAIN[_a : _b + 1] = np.arange(_a, _b + 1)
_PLAIN[65:91] = np.arange(97, 123)


def plain(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with Latin letters lowered and ASCII other than letters and digits blanked; no byte moves."""
    out = _PLAIN[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[up] += 0x20
    return out


@dataclass
class Sketches:
    """A batch of items; sizes of shingles in use, each with its sketch hashes and their items, and all shingles of each item."""

    ids: list
    by_size: dict[int, tuple[np.ndarray, np.ndarray]]
    size: np.ndarray
    hashes: list[np.ndarray]
    grams: list[set[bytes]]


def _words(raw: bytes) -> list[bytes]:
    return plain(np.frombuffer(raw, np.uint8)).tobytes().split() if raw else []


def sketches(items: list[tuple[object, str | None]], share: float = SHARE) -> Sketches:
    """Sketches of (id, text) items. Items without a word match nothing; shorter ones than a shingle are one shingle."""
    out = Sketches([], {}, np.zeros(0, np.int64), [], [])
    sizes, parts = [], {}
    for item, text in items:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = _words(raw)
        if not words:
            continue
        k = min(SHINGLE, len(words))
        flat = plain(np.frombuffer(raw, np.uint8))
        h = np.unique(shingle_hashes(word_hashes(flat, np.array([0, len(flat)]))[0], k))
        largest = 1 << int(len(h) - 1).bit_length()  # of the item's partition
        n = min(len(h), int((1 - share) * largest + 1e-9) + 1)
        hs, its = parts.setdefault(k, ([], []))
        hs.append(h[:n])
        its.append(np.full(n, len(out.ids)))
        out.ids.append(item)
        sizes.append(k)
        out.hashes.append(h)
        out.grams.append({b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})
    out.size = np.array(sizes, np.int64)
    for k, (hs, its) in parts.items():
        h, i = np.concatenate(hs), np.concatenate(its)
        order = np.argsort(h, kind="stable")
        out.by_size[k] = h[order], i[order]
    return out


def hits(column: pa.Array, s: Sketches, share: float = SHARE) -> list[tuple[int, int, int]]:
    """(row, item, shared shingles) for each text and item with at least the share of the item's shingles."""
    return [(at + r, i, n) for at, part in slices(column) for r, i, n in _hits(part, s, share)]


def _hits(column: pa.Array, s: Sketches, share: float) -> list[tuple[int, int, int]]:
    data, offsets = utf8(column)
    data = plain(data)
    h, start, end, first = word_hashes(data, offsets)
    out = []
    for k, (keys, owners) in s.by_size.items():
        grams = shingle_hashes(h, k)
        if not len(grams):
            continue
        quick = np.zeros(1 << 20, bool)
        quick[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(quick[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
        lo = np.searchsorted(keys, grams[at], "left")
        n = np.searchsorted(keys, grams[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        row = np.searchsorted(first, at, "right") - 1
        whole = at + k <= first[row + 1]
        at, lo, n, row = at[whole], lo[whole], n[whole], row[whole]
        item = owners[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        for r, i in np.unique(np.stack([np.repeat(row, n), item]), axis=1).T if len(at) else ():
            a, b = first[r], first[r + 1]
            pos = a + np.flatnonzero(np.isin(grams[a : max(a, b - k + 1)], s.hashes[i]))
            found = {b" ".join(data[start[p + j] : end[p + j]].tobytes() for j in range(k)) for p in pos.tolist()} & s.grams[i]
            if len(found) >= share * len(s.grams[i]) - 1e-9:
                out.append((int(r), int(i), len(found)))
    return out


def batches_of(items: DataFrame, key: str = "item_id", text: str = "text", most: int = PASS_CHARS) -> Iterator[Sketches]:
    """Batches of at most so many characters of items (or one item that is longer), read one partition at a time."""
    held, size = [], 0
    for i, t in items.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).toLocalIterator():
        if held and size + len(t or "") > most:
            yield sketches(held)
            held, size = [], 0
        held.append((i, t))
        size += len(t or "")
    if held:
        yield sketches(held)


def told(spark: SparkSession, batches: Iterator[Sketches]) -> Callable[[], Iterator[Sketches]]:
    """A function for tasks that gives all batches, one at a time. The driver holds two at most, while it writes them."""
    first, second = next(batches, None), next(batches, None)
    if second is None:
        return lambda: iter(() if first is None else (first,))
    from pyarrow import fs

    folder, n = shared_dir(spark, "sketches"), 0
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    for n, s in enumerate(itertools.chain((first, second), batches), 1):
        with files.open_output_stream(f"{root}/{n}", compression=None) as f:
            f.write(pickle.dumps(s))

    def read() -> Iterator[Sketches]:
        there, root = fs.FileSystem.from_uri(folder)
        for k in range(1, n + 1):
            with there.open_input_stream(f"{root}/{k}", compression=None) as f:
                yield pickle.loads(f.read())  # written above

    return read


def contamination(df: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id", pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each row of df that holds at least 0.8 of an item's five-word shingles.

    Words are lower-cased runs of letters and digits. Null and empty texts and items match
    nothing. Rows that repeat are each reported. Nulls in doc_id or item_id are passed on.
    No items or an empty table give no rows.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    each = told(df.sparkSession, batches_of(items, most=pass_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in each():
                found = hits(b.column(1), s)
                size = [len(s.grams[i]) for _, i, _ in found]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for r, _, _ in found], pa.int64())), pa.array([s.ids[i] for _, i, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64()), pa.array(size, pa.int64()), pa.array([n / m for (_, _, n), m in zip(found, size, strict=True)], pa.float64())], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

    return rows.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long, containment double")


def drop_contaminated(df: DataFrame, items: DataFrame, *, text: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of df that hold no item, with all their columns, whatever their names; nothing is shuffled.

    Null and empty texts and items match nothing. Rows that repeat are judged alike. No items drop no row, and an empty table has none.
    """
    ship(df.sparkSession)
    at = df.columns.index(text)
    each = told(df.sparkSession, batches_of(items, most=pass_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for s in each():
                keep[[r for r, _, _ in hits(b.column(at), s)]] = False
            yield b.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it holds."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
