"""Token-id shards: independent zstandard frames, a trailing seek table, checksums for each frame.

A shard holds documents in ascending order. Its layout, little-endian throughout:

    frames      one zstandard frame for each run of documents; the content is the documents'
                ids, concatenated, as unsigned 32-bit integers
    directory   one zstandard skippable frame (magic 0x184D2A50): for each document its id,
                its frame's number, where in the frame it begins and its number of token ids
    seek table  the last skippable frame (magic 0x184D2A5E): for each frame its compressed and
                its full size and the low 32 bits of its content's XXH64; then the number of
                frames, a flag byte (0x80: checksums are there) and the magic 0x8F92EAB1

Any zstandard reader can decompress a whole shard. One that knows the seek table reads the
footer, then the directory, then only the frames of the documents that it was asked for: ShardReader
does so on an open file, by ranges, and fetch() on all shards of a folder.

Shards are written by tasks under a name of their own and then renamed, so a task that is
run again leaves the same shard. They are read back with Spark's binaryFile source.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import shared_dir, ship, table, through_table

#: Fixed values of the formats.
END_ID, SKIPPABLE, SEEKABLE, SEEK_SKIPPABLE, CHECKSUMS = 2, 0x184D2A50, 0x8F92EAB1, 0x184D2A5E, 0x80
DIRECTORY = np.dtype([("doc", "<i8"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4"), ("row", "<u4")])

#: White space that may make a blank-delimited piece depend on its neighbours.
_ODD = [*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f", "  ", "\n ", *map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))]


def _odd(text: str) -> bool:
    """Whether a text must go to the tokenizer whole."""
    return text[0] == " " or text[-1] == " " or any(x in text for x in (_ODD[:10] if text.isascii() else _ODD))


#: Pieces of Latin letters and ASCII punctuation, with one line break at most: the pretokenizer cuts between all four parts. Apostrophes and digits are left out.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PARTS = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)(?:\n([{_LETTERS}]+)([{_MARKS}]*))?").fullmatch
#: The byte-level alphabet of those letters.
_SPELLED = {c: "".join(chr(x if x > 0xA0 and x != 0xAD else x + 162 if x != 0xAD else 323) for x in chr(c).encode()) for c in range(0xC0, 0x100)}


class _Kept(dict):
    """Known pieces; an unknown one is noted, and its place in the notes stands for it."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        return len(self.new) - 1


class Encoder:
    """Encodes texts with a tokenizers file; the ids of pieces between single blanks are kept for reuse.

    A byte-level BPE splits before every blank that follows a non-blank, so pieces between
    single blanks can be encoded apart. New pieces that are plain words with punctuation are
    put together from words and marks, each of which the tokenizer's model is asked for once.
    A text with other white space around blanks, or with the content of one of the tokenizer's
    added tokens, goes to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 600_000, most_marks: int = 10_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.model, self.most, self.most_marks = self.tokenizer.model, most, most_marks
        self.always = {"": b"", "\n": self._ids("\n")}
        self.kept, self.words, self.marks = _Kept(), {}, dict(self.always)
        self.simple = all(self._word(w) == self._ids(w) for w in (" the", "Ère", " Größe", " çà", "ÿ"))  # else every piece is encoded whole

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of letters, with a blank before them or none."""
        spelled = word.replace(" ", "Ġ") if word.isascii() else word.translate(_SPELLED).replace(" ", "Ġ")
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece that follows a blank."""
        m = self.simple and _PARTS(piece)
        if not m:
            return self._ids(" " + piece)
        out = b""
        for word, marks in ((" " + m[1], m[2]), ("" if m[3] is None else m[3], m[4] or "")):
            if word and (w := self.words.get(word)) is None:
                if len(self.words) >= self.most:
                    self.words.clear()
                w = self.words[word] = self._word(word)
            if (k := self.marks.get(marks)) is None:
                if len(self.marks) >= self.most_marks:
                    self.marks = dict(self.always)
                k = self.marks[marks] = self._ids(marks)
            out = out + w + k if word[:1] == " " else out + self.marks["\n"] + w + k if word else out
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list = [b""] * len(texts)
        kept, fresh = self.kept, []
        kept.new = []
        total = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if _odd(t) or self.added(t):
                out[i] = self._ids(t)
                continue
            first, *pieces = t.split(" ")
            total += len(pieces)
            had = len(kept.new)
            found = list(map(kept.__getitem__, pieces))
            if len(kept.new) > had:
                fresh += map(self._piece, kept.new[had:])
                found = [fresh[x] if x.__class__ is int else x for x in found]
                if len(kept) + len(fresh) <= self.most:
                    kept.update(zip(kept.new[had:], fresh[had:], strict=True))
            out[i] = self._ids(first) + b"".join(found)
        if len(kept) + len(fresh) > self.most and 4 * len(fresh) > total:  # other words than those kept
            self.kept = _Kept()
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


class ShardWriter:
    """Builds one shard in memory; its size is bounded by the caller."""

    def __init__(self, frame_bytes: int = 1 << 20, level: int = 3):
        self.frame_bytes = frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.done, self.seeks, self.docs, self.open, self.size, self.held = [], [], [], [], 0, 0

    def add(self, doc: int, ids: bytes) -> None:
        """Append a document; ids are little-endian unsigned 32-bit integers."""
        self.docs.append((doc, len(self.seeks), self.size // 4, len(ids) // 4, 0))
        self.open.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        content = b"".join(self.open)
        frame = self.packer.compress(content)
        self.done.append(frame)
        self.held += len(frame)
        self.seeks.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def bytes(self) -> bytes:
        """The whole shard."""
        if self.open:
            self._close()
        directory = np.array(self.docs, DIRECTORY).tobytes()
        packed = struct.pack("<II", SKIPPABLE, len(directory)) + directory
        entries = [*self.seeks, (len(packed), 0, 0)]
        seek = b"".join(struct.pack("<III", *x) for x in entries) + struct.pack("<IBI", len(entries), CHECKSUMS, SEEKABLE)
        return b"".join([*self.done, packed, struct.pack("<II", SEEK_SKIPPABLE, len(seek)), seek])


class ShardReader:
    """Reads documents from a shard, given as bytes or as an open file that can seek.

    Of a file only the footer, the seek table, the directory and the frames of the documents asked for are read.
    """

    def __init__(self, data, size: int | None = None):
        self.file = io.BytesIO(data) if isinstance(data, bytes | bytearray | memoryview) else data
        size = self.file.seek(0, io.SEEK_END) if size is None else size
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9)) if size >= 9 else (0, 0, 0)
        if magic != SEEKABLE or flags != CHECKSUMS or size < 17 + 12 * n:
            raise ValueError("no seek table")
        self.seeks = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.seeks[:, 0])])
        self.docs = np.frombuffer(self._at(int(self.starts[-2]) + 8, int(self.seeks[-1, 0]) - 8), DIRECTORY)
        self.unpacker, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the shard is cut short")
        return data

    def frame(self, k: int) -> bytes:
        """The content of a frame, checked."""
        if self.last[0] != k:
            content = self.unpacker.decompress(self._at(int(self.starts[k]), int(self.seeks[k, 0])))
            if len(content) != self.seeks[k, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.seeks[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.last = k, content
        return self.last[1]

    def ids(self, row: int) -> bytes:
        """The ids of the row-th document, as bytes."""
        d = self.docs[row]
        return self.frame(int(d["frame"]))[4 * int(d["at"]) : 4 * (int(d["at"]) + int(d["n"]))]

    def rows_of(self, docs: np.ndarray) -> np.ndarray:
        """The rows of the documents with these ids, in the shard's order; one id may have several."""
        return np.flatnonzero(np.isin(self.docs["doc"], docs))


def _store(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all, by any file system that Arrow knows; a file of that name is replaced."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    own, target = f"{root}/.{name}.{uuid.uuid4().hex}", f"{root}/{name}"
    with files.open_output_stream(own, compression=None) as f:
        f.write(data)
    try:
        files.move(own, target)
    except OSError:  # some file systems don't rename onto what an earlier run of the task left
        if files.get_file_info(target).type != fs.FileType.File:
            raise
        files.delete_file(target)
        files.move(own, target)


def _writer(folder: str, path: str, shard_bytes: int, end: int):
    tail = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, shard, rows = TaskContext.get().partitionId(), 0, None, []
        coder = encoder(path)

        def close() -> None:
            name = f"shard-{part:07d}-{k:05d}.zst"
            _store(folder, name, shard.bytes())
            rows.append((name, sum(d[3] for d in shard.docs)))

        for b in batches:
            for at in range(0, b.num_rows, 64):
                few = b.slice(at, 64)
                for doc, ids in zip(few.column(0).to_pylist(), coder.encode(few.column(1).to_pylist()), strict=True):
                    shard = shard or ShardWriter()
                    shard.add(doc, ids + tail)
                    if shard.held >= shard_bytes:
                        close()
                        shard, k = None, k + 1
        if shard:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["name", "tokens"])

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            r = ShardReader(memoryview(content.as_buffer()))
            n = r.docs["n"].astype(np.int64)
            crc = np.fromiter((zlib.crc32(r.ids(i)) for i in range(len(n))), np.int64, len(n))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(r.docs["doc"].astype(np.int64)), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc)], ["name", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_shards(df: DataFrame, folder: str, tokenizer: str, *, order: list, text: str = "text", key: str = "doc_id", shard_bytes: int = 32 << 20, end: int = END_ID) -> DataFrame:
    """Write the rows' token ids as shards below folder, in the given order; (name, tokens) of each shard.

    The rows are dealt out by ranges of the order and sorted within; shard names sort as the rows do.
    """
    ship(df.sparkSession)
    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-1)).alias("doc_id"), F.col(f"`{text}`").alias("text"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    by = [f"_o{i}" for i in range(len(order))]
    sized = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    return through_table(sized.mapInArrow(_writer(folder, tokenizer, shard_bytes, end), "name string, tokens long"), "shards")


def read_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards; start counts the ids of all before it.

    The running sum is over shards, of which there is one for some tens of MB.
    """
    before = F.sum("tokens").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1))
    starts = shards.select("name", F.coalesce(before, F.lit(0)).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.zst").load(folder)
    read = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(_reader, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, "name").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def fetch(docs: DataFrame, folder: str, shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents in the shards whose id is in docs, as little-endian unsigned 32-bit integers.

    docs is a bounded list of ids: it goes to every task, in one array. Of each shard a task reads the footer, the
    directory, and the frames that hold one of the ids, by ranges.
    """
    ship(docs.sparkSession)
    wanted = np.array([r[0] for r in docs.select(F.col(f"`{key}`").cast("long")).where(F.col(f"`{key}`").isNotNull()).distinct().toLocalIterator()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with files.open_input_file(f"{root}/{name}") as f:
                    r = ShardReader(f, f.size())
                    rows = r.rows_of(wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(r.docs["doc"][rows].astype(np.int64)), pa.array([r.ids(i) for i in rows.tolist()], pa.binary())], ["doc_id", "ids"])

    return shards.select("name").mapInArrow(run, "doc_id long, ids binary")


def token_shards(df: DataFrame, tokenizer: str, *, order: list | None = None, folder: str | None = None, **options) -> DataFrame:
    """Encode and write df, read the files back, and return what they hold for each document.

    Null and empty texts hold the end id only. Rows that repeat an id are all written, tied
    in the order by their text's hash. A null id is written as -1, before all others. An empty table
    gives no shard and no rows. Other columns are not read.
    """
    spark, key, text = df.sparkSession, options.get("key", "doc_id"), options.get("text", "text")
    folder = folder or shared_dir(spark, "tokens")
    order = [F.col(f"`{key}`"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))] if order is None else order
    shards = write_shards(df, folder, tokenizer, order=order, **options)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, shards)


def default_tokenizer() -> str:
    """The public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files written."""
    return token_shards(table(spark, sf_dir, "documents"), default_tokenizer())
