"""Packing documents into sequences by minimum bin slack.

Tasks encode the documents and cut those that are longer than a sequence. What is packed then is only
how many pieces there are of each length, a row for each length up to the capacity, whatever the size of the
corpus: for one sequence after the other a subset-sum over a bitset finds the fullest combination of the
lengths that are left. The fullest combination stays the fullest while its pieces last, so it is taken as
many times as they do at once. Two ways are tried, any combination and only those that hold the longest
piece left; the one that needs fewer sequences counts. The pieces of a length are numbered by the tasks that
made them, and a piece's number says which use of its length in which sequence it is.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import ship, slices, table, through_table
from quern.llm.tokens import _SPELLED

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 4096, 1

_RANK_BITS = 44

#: Pieces that can be put together from units, and the units of such a piece, lowered.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+").fullmatch
_ENDS = (",", ".", ";", ":", "!", "?")
_UNITS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-/:-`{-~]+").findall


class _Kept(dict):
    """Values by key, worked out where they are missing; of two generations the older goes, so what is common stays."""

    def __init__(self, work: Callable[[str], bytes], most: int, longest: int = 64):
        self.work, self.most, self.longest, self.older = work, most, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """Encodes texts with a tokenizers file whose pretokenizer drops white space; the ids of pieces between blanks and line ends are kept for reuse.

    No token of such a tokenizer spans white space, and none of its rules looks over it, so pieces can be encoded apart.
    Pieces of Latin letters, digits and ASCII marks without an apostrophe are put together from runs of letters, single digits and
    runs of marks. Where an added token has a blank in it, or probes show that these rules don't hold, texts go whole.
    """

    PROBES = ("a b", "It's the\n end", "x\n\ny  z", "é 12 ?!\nÀ b's", "<|a|> b\tc d", "Größe, (ÇÀ-12a) 3.14 aÿ! x_y ½ a×b", "#a$b A1B2")

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.signed = not any(re.search("^[A-Za-z]+[,.;:!?]?$", x) for x in added)
        self.units = _Kept(self._unit, most)
        self.pieces = _Kept(self._piece, most)
        self.simple = True
        self.simple = all(self._ids(p) == self._joined(p) for p in self.PROBES)
        self.pieces.clear()
        self.apart = not any(re.search(r"\s", x) for x in added) and all(self._ids(p) == self._joined(p) for p in self.PROBES)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        if not unit[0].isalpha():
            return self._ids(unit)
        ids = [t.id for t in self.model.tokenize(unit if unit.isascii() else unit.translate(_SPELLED))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if self.simple and self.signed and piece.isascii():  # letters, or letters and a mark
            if piece.isalpha():
                return self.units[piece.lower()]
            if piece[-1:] in _ENDS and piece[:-1].isalpha():
                return self.units[piece[:-1].lower()] + self.units[piece[-1]]
        if self.simple and _PLAIN(piece) and not self.added(piece):
            return b"".join([self.units[u] for u in _UNITS(piece.lower())])
        return self._ids(piece) if piece else b""

    def _joined(self, text: str) -> bytes:
        kept = self.pieces
        return b"".join([kept[p] for p in text.replace("\n", " ").split(" ")])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"" if not text else self._joined(text) if self.apart else self._ids(text)


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def cut(df: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids, _part, _place): every document's ids with the end id, in pieces of at most capacity; written to the shared folder.

    ids are little-endian unsigned 32-bit integers. _part is the task that made a piece, _place its number among the pieces of its length there.
    Null and empty texts hold the end id only; rows that repeat, and null ids, are documents of their own. Other columns are not read.
    """
    ship(df.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder, seen = TaskContext.get().partitionId(), encoder(tokenizer), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for first, texts in slices(b.column(1), most=1_000_000):
                docs = b.column(0).slice(first, len(texts))
                rows, at, lengths, ids = [], [], [], []
                for i, t in enumerate(texts.to_pylist()):
                    whole = coder.encode(t) + tail
                    for start in range(0, len(whole), 4 * capacity):
                        ids.append(whole[start : start + 4 * capacity])
                        lengths.append(len(ids[-1]) // 4)
                        rows.append(i)
                        at.append(start // 4)
                places = []
                for n in lengths:
                    places.append(int(seen[n]))
                    seen[n] += 1
                starts = np.array(at, np.int64)
                columns = [docs.take(pa.array(rows, pa.int64())), pa.array((starts // capacity).astype(np.int32)), pa.array(starts), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(len(rows), part, np.int32)), pa.array(places, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "_part", "_place"])

    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return through_table(rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, _part int, _place long"), "pieces")


def fullest(lengths: list[int], counts: Mapping[int, int], room: int) -> tuple[int, dict[int, int]]:
    """(sum, how many of each length): the largest sum up to room that the counted lengths make; lengths go from the longest, which are preferred.

    Bit s of a bitset says whether a sum s can be made; a length with a count goes in by powers of two.
    """
    within, reached, tried = (1 << (room + 1)) - 1, [1], []
    for n in lengths:
        left = min(counts[n], room // n)
        if not left:
            continue
        now, step = reached[-1], 1
        while left:
            take = min(step, left)
            now |= (now << (take * n)) & within
            left, step = left - take, 2 * step
        reached.append(now)
        tried.append(n)
        if now >> room & 1:
            break
    total = rest = reached[-1].bit_length() - 1
    used: dict[int, int] = {}
    for k in range(len(tried) - 1, -1, -1):
        while not reached[k] >> rest & 1:
            rest -= tried[k]
            used[tried[k]] = used.get(tried[k], 0) + 1
    return total, used


def combinations(counts: Mapping[int, int], capacity: int = CAPACITY, longest: bool = True) -> list[tuple[int, dict[int, int]]]:
    """(times, how many of each length) of the sequences in the order of their making, equal ones together; with longest each holds the longest piece that is left.

    A length whose pieces run short of a combination has fewer left than a sequence can hold of it, so there are at
    most capacity * (1 + ln capacity) entries however many pieces there are.
    """
    left = {n: c for n, c in counts.items() if c}
    lengths, out = sorted(left, reverse=True), []
    while lengths:
        if longest:
            first = lengths[0]
            left[first] -= 1
            _, used = fullest(lengths, left, capacity - first)
            left[first] += 1
            used[first] = used.get(first, 0) + 1
        else:
            _, used = fullest(lengths, left, capacity)
        times = min(left[n] // u for n, u in used.items())
        for n, u in used.items():
            left[n] -= times * u
        if any(not left[n] for n in used):
            lengths = [n for n in lengths if left[n]]
        out.append((times, used))
    return out


def best_combinations(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """combinations() of the way that needs fewer sequences."""
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    made = lambda way: sum(times for times, _ in way)
    first = combinations(counts, capacity)
    return first if made(first) == least else min(first, combinations(counts, capacity, longest=False), key=made)


def _segments(way: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): for each length of each combination the first number of its pieces there; and (that number, uses, first sequence, offset)."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for times, used in way:
        offset = 0
        for n in sorted(used, reverse=True):
            at = given.get(n, 0)
            rows.append((n << _RANK_BITS | at, at, used[n], sequence, offset))
            given[n] = at + times * used[n]
            offset += n * used[n]
        sequence += times
    found = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return found[:, 0].copy(), found[:, 1:].copy()


def packed(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """pieces of cut() with sequence_id and offset, where they stand; offsets in a sequence leave no gap. No pieces give no rows.

    A row for each length comes to the driver. The numbers of a length's pieces go on from task to task
    by a running sum over a row for each task and length, so no length, however common, meets in one task.
    """
    spark = pieces.sparkSession
    counts = through_table(pieces.groupBy("_part", "length").agg((F.max("_place") + 1).alias("_n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    keys, rows = _segments(best_combinations(totals, capacity))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    out = T.StructType([f for f in pieces.schema if not f.name.startswith("_")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("length").to_numpy(zero_copy_only=False)
            number = b.column("_place").to_numpy(zero_copy_only=False) + b.column("_first").to_numpy(zero_copy_only=False)
            at, uses, sequence, offset = rows[np.searchsorted(keys, (n << _RANK_BITS) | number, "right") - 1].T
            k = number - at
            own = [b.column(f.name) for f in out.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence + k // uses), pa.array(offset + k % uses * n)], out.names)

    return pieces.join(firsts.hint("merge"), ["_part", "length"]).mapInArrow(run, out)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, docs): the packed sequences, their ids and, in order, which piece of which document stands where."""
    part = F.struct("offset", "ids", "doc_id", "piece", "length")
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("_p"))  # capacity pieces at most
    ids = F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["ids"])), ""))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("_p", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("docs"))


def default_tokenizer() -> str:
    """The public vocabulary of 49,408 ids."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    pieces = cut(table(spark, sf_dir, "documents"), default_tokenizer())
    return packed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
