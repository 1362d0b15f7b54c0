"""Repeats across documents by enhanced suffix arrays and common-prefix interval trees.

maximal_repeats() is the method: a suffix array with its common-prefix lengths, a stack scan
that builds the interval tree bottom up, and for each interval the test that its occurrences
extend to the left in more than one way. What passes is a maximal repeat, with all occurrences.

Over a corpus no suffix array spans all texts. Whatever is 50 bytes long contains the
same minimal 16-byte gram wherever it stands, so each run of windows with one minimal gram is
routed by that gram's hash:

1. Copies of whole texts are found by 128-bit digests; only the least id's text goes on.
2. Each block says which grams it has and in how many of its texts, a few bytes for a gram and
   block; grams that only one text has are dropped, and very common ones are marked.
3. Blocks cut the bytes of the runs that are left. A piece that several of a block's texts have is
   settled there, and goes on once, for the block's least id. Of a very common gram the windows go on
   one by one, each by its own hash, so that the texts around a passage that very many documents share
   don't meet in one task.
4. Pieces of one gram meet; a suffix array is built over the distinct ones, and its maximal repeats say
   which occurrences an earlier document covers.

Texts travel in compressed blocks of about 2 MB, so rows are few; every group that a task holds is
a block, or a partition's share of hashes. Blocks are written to the shared folder once, so every
later pass sees the same ones, and a lost executor costs a part of one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ship, slices, table, through_table, utf8

#: Bytes of a repeat, of a gram, of a block, and windows of a run at most.
LENGTH, GRAM, BLOCK, RUN = 50, 16, 2_000_000, 64
#: Texts with a gram from which on its windows go one by one, and digests whose copies are told to all tasks at most.
COMMON, MOST_SENT = 50_000, 50_000

_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)
_C = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.dtype([("hash", "<u4"), ("docs", "<u2")])
_WANTED = np.dtype([("hash", "<u4"), ("common", "?")])
_PIECE = np.dtype([("hash", "<u4"), ("at", "<u4"), ("n", "u1"), ("doc", "<i8"), ("piece", "<u4")])
_RANGE = np.dtype([("start", "<u4"), ("end", "<u4")])


def _packed(rec: np.ndarray, rising: str, level: int = 3) -> bytes:
    """Records by column and byte plane, compressed; the rising column as differences."""
    columns = [np.diff(rec[f], prepend=rec[f].dtype.type(0)) if f == rising else np.ascontiguousarray(rec[f]) for f in rec.dtype.names]
    raw = b"".join(c.view(np.uint8).reshape(len(rec), -1).T.tobytes() for c in columns)
    return b"\1" + zstandard.ZstdCompressor(level=level).compress(raw) if len(raw) > 64 else b"\0" + raw


def _unpacked(data: bytes, dtype: np.dtype, rising: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]) if data[0] else data[1:], np.uint8)
    n = len(raw) // dtype.itemsize
    out, at = np.empty(n, dtype), 0
    for f in dtype.names:
        size = dtype[f].itemsize
        column = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(dtype[f]).reshape(n)
        out[f] = np.cumsum(column, dtype=dtype[f]) if f == rising else column
        at += n * size
    return out


# --- the method -------------------------------------------------------------


def suffix_array(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of all suffixes of texts laid end to end; left is how many bytes each has to its text's end.

    lcp[i] is the common prefix of order[i - 1] and order[i], which never crosses an end; lcp[0] is 0. Prefix doubling.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(n)

    def dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        return order, rank

    def after(values: np.ndarray, k: int) -> np.ndarray:
        """values k places on; 0 beyond the text's end."""
        return np.where(left > k, values[np.minimum(place + k, n - 1)], 0)

    key = np.zeros(n, np.int64)
    symbol = data.astype(np.int64) + 1
    for k in range(6):
        key = key << 9 | after(symbol, k)
    order, rank = dense(key)
    ranks, k = [rank.astype(np.int32)], 6
    longest = int(left.max())
    while k < longest and rank.max() < n:
        key = after(rank, k)
        rank *= n + 1
        key += rank
        order, rank = dense(key)
        ranks.append(rank.astype(np.int32))
        k *= 2
    i, j = order[:-1].copy(), order[1:].copy()
    room = np.minimum(left[i], left[j])
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step, r = 6 << level, ranks[level]
        # texts that end at once agree beyond their ends; room caps that
        same = (lcp < room) & (r[np.minimum(i + lcp, n - 1)] == r[np.minimum(j + lcp, n - 1)])
        lcp = np.minimum(lcp + np.where(same, step, 0), room)
    for _ in range(5):
        same = (lcp < room) & (data[np.minimum(i + lcp, n - 1)] == data[np.minimum(j + lcp, n - 1)])
        lcp += same
    return order, np.concatenate([[0], lcp])


def maximal_repeats(data: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, lo, hi, length): the suffix order, and for each maximal repeat of at least so many bytes its occurrences order[lo:hi] and length.

    starts are where the texts begin. A scan with a stack keeps the open intervals; one that
    closes passes its left bytes up. It is reported if two of its occurrences have different bytes before
    them, or one begins a text, or a longer prefix isn't shared by all (so it can't be extended either way).
    """
    ends = np.append(starts[1:], len(data))
    sizes = ends - starts
    left = np.repeat(ends, sizes) - np.arange(len(data))
    order, lcp = suffix_array(data, left)
    before = np.full(len(data), 256, np.int64)
    before[1:] = data[:-1]
    before[starts[sizes > 0]] = 256  # a text's start: differs from everything
    long = lcp >= least
    out: list[tuple[int, int, int]] = []
    # only stretches of the order with long common prefixes hold intervals
    edge = np.flatnonzero(np.diff(np.concatenate([[False], long, [False]])))
    own = before[order]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        values, bytes_ = lcp[a:b].tolist(), own[a - 1 : b].tolist()
        stack: list[list[int]] = []  # length, first place, left byte (256: several)
        for k, height in enumerate([*values, 0]):
            first, byte = a - 1 + k, bytes_[k]
            while stack and stack[-1][0] > height:
                size, first, seen = stack.pop()
                seen = seen if seen == byte else 256
                if seen == 256:
                    out.append((first, a + k, size))
                byte = seen
                if stack and stack[-1][0] >= height:
                    stack[-1][2] = byte = stack[-1][2] if stack[-1][2] == byte else 256
            if stack and stack[-1][0] == height:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else 256
            elif height >= least:
                stack.append([height, first, byte])
    found = np.array(out, np.int64).reshape(-1, 3)
    return order, found[:, 0], found[:, 1], found[:, 2]


# --- blocks -----------------------------------------------------------------


_BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("offsets", pa.binary()), ("data", pa.binary())])


def _block(number: int, docs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    data, offsets = utf8(texts)
    values = (number, docs.to_numpy(zero_copy_only=False).astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), zstandard.ZstdCompressor(level=3).compress(data.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    for b in batches:
        for at, texts in slices(b.column(1), BLOCK):
            yield _block(part << 32 | k, b.column(0).slice(at, len(texts)), texts)
            k += 1


def _opened(docs: bytes, offsets: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(docs, "<i8"), np.frombuffer(offsets, "<i8"), np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def runs(data: np.ndarray, offsets: np.ndarray, most: int = 2 * BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, at, n) of the runs of LENGTH-byte windows with one minimal gram: the first window's place and how many; none crosses a text's end.

    Long data go in stretches of so many windows; a run that crosses from one to the next is two.
    """
    found = []
    for at in range(0, max(len(data) - LENGTH + 1, 1), most):
        own = np.clip(offsets - at, 0, max(min(most + LENGTH - 1, len(data) - at), 0))
        h, first, n = _runs(data[at : at + most + LENGTH - 1], own)
        found.append((h, first + at, n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _BYTES[data]
    for k in (1, 2, 4, 8):
        new = h[:-k] * _C
        new += h[k:]
        new ^= new >> np.uint64(29)
        h = new
    h *= _C
    wide, w = LENGTH - GRAM + 1, 1
    while w * 2 <= wide:
        h = np.minimum(h[:-w], h[w:])
        w *= 2
    if wide > w:
        h = np.minimum(h[: w - wide], h[wide - w :])
    at = np.arange(len(h))
    bounds = offsets[1:-1]
    inside = np.ones(len(h) + 1, np.int8)  # windows that would cross an end
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, np.clip(bounds - LENGTH + 1, 0, len(h)), 1)
    np.add.at(step, np.clip(bounds, 0, len(h)), -1)
    inside = np.cumsum(step)[:-1] == 0
    begin = inside.copy()
    begin[1:] &= (h[1:] != h[:-1]) | ~inside[:-1]
    first = np.flatnonzero(begin)
    group = np.cumsum(begin) - 1
    begin |= inside & ((at - first[np.maximum(group, 0)]) % RUN == 0) if len(first) else False
    first = np.flatnonzero(begin)
    size = np.add.reduceat(inside.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return h[first], first, size


def _keys(h: np.ndarray, parts: int) -> np.ndarray:
    """A hash's route (high 32 bits) and what is known of it there (low 32 bits)."""
    return (h >> np.uint64(40)) % np.uint64(parts) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def _grams(parts: int):
    """By route and block: the grams of a block and in how many of its texts each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *rest in zip(*(b.column(c).to_pylist() for c in ("block", "docs", "offsets", "data")), strict=True):
                _, offsets, data = _opened(*rest)
                h, at, _ = runs(data, offsets)
                if not len(h):
                    continue
                key, doc = _keys(h, parts), np.searchsorted(offsets, at, "right") - 1
                del h, at
                order = np.argsort(key, kind="stable")  # places rise, so a key's texts do
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                first = np.flatnonzero(new)
                new[1:] |= doc[1:] != doc[:-1]
                rec = np.empty(len(first), _GRAM)
                rec["hash"], rec["docs"] = key[first] & np.uint64(0xFFFFFFFF), np.minimum(np.add.reduceat(new, first, dtype=np.int64), 65535)
                route = (key[first] >> np.uint64(32)).astype(np.int64)
                edge = np.flatnonzero(np.diff(route, prepend=-1))
                stop = np.append(edge[1:], len(route))
                yield pa.RecordBatch.from_arrays([pa.array(route[edge]), pa.array([block] * len(edge), pa.int64()), pa.array([_packed(rec[x:y], "hash") for x, y in zip(edge.tolist(), stop.tolist(), strict=True)], pa.binary())], ["route", "block", "payload"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each route; rows come sorted by it."""
    now, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("route", *columns)), strict=True):
            if held and row[0] != now:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


def _shared(common: int):
    """Of each route's grams those that two texts or more have, by block, and whether at least common texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for route, rows in _grouped(batches, ("block", "payload")):
            recs = [_unpacked(p, _GRAM, "hash") for _, p in rows]
            rec = np.concatenate(recs)
            ends = np.cumsum([0, *map(len, recs)])
            del recs
            order = np.argsort(rec["hash"], kind="stable")
            h = rec["hash"][order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            texts = np.empty(len(rec), np.int64)
            texts[order] = np.repeat(np.add.reduceat(rec["docs"][order], first, dtype=np.int64), np.diff(np.append(first, len(h))))
            keep = texts > 1
            out = np.empty(int(keep.sum()), _WANTED)
            out["hash"], out["common"] = rec["hash"][keep], texts[keep] >= common
            cut = np.concatenate([[0], np.cumsum(keep)])[ends]
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some], pa.int64()), pa.array([route] * len(some), pa.int64()), pa.array([_packed(out[cut[i] : cut[i + 1]], "hash") for i in some], pa.binary())], ["block", "route", "payload"])

    return run


_CUT = pa.schema([("route", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("bytes", pa.binary())])


def window_hashes(data: np.ndarray, at: np.ndarray, most: int = 200_000) -> np.ndarray:
    """Hashes of the LENGTH bytes from each place."""
    out = np.empty(len(at), np.uint64)
    for i in range(0, len(at), most):
        part, h = at[i : i + most], np.zeros(len(at[i : i + most]), np.uint64)
        for k in range(LENGTH):
            h = h * _C + _BYTES[data[part + k]]
            h ^= h >> np.uint64(31)
        out[i : i + most] = h * _C
    return out


def _cut(parts: int, routes: int):
    """The bytes of a block's shared runs, by route. A piece that several texts of the block have goes on for the least id; for the others it goes whole, said in a row without bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _CUT.empty_table()
        docs, offsets, data = _opened(*(left[c][0].as_py() for c in ("docs", "offsets", "data")))
        block, packer, rows = left["block"][0].as_py(), zstandard.ZstdCompressor(level=3), []
        wanted = [_unpacked(p, _WANTED, "hash") for p in right["payload"].to_pylist()]
        keys = np.repeat(right["route"].to_numpy().astype(np.uint64), [len(w) for w in wanted]) << np.uint64(32) | np.concatenate([w["hash"] for w in wanted])
        common = np.concatenate([w["common"] for w in wanted])
        order = np.argsort(keys)
        keys, common = keys[order], common[order]
        h, at, n = runs(data, offsets)
        own = _keys(h, parts)
        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = keys[place] == own
        h, at, n, many = h[hit], at[hit], n[hit], common[place[hit]]
        if many.any():
            each = np.repeat(at[many], n[many]) + np.arange(n[many].sum()) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
            h, at, n = np.concatenate([h[~many], window_hashes(data, each)]), np.concatenate([at[~many], each]), np.concatenate([n[~many], np.ones(len(each), np.int64)])
            order = np.argsort(at, kind="stable")
            h, at, n = h[order], at[order], n[order]
        key, size, doc = _keys(h, routes), n + LENGTH - 1, docs[np.searchsorted(offsets, at, "right") - 1]
        raw = data.tobytes()
        known: dict[tuple[int, bytes], int] = {}
        piece = np.fromiter((known.setdefault((k, raw[a : a + m]), len(known)) for k, a, m in zip(key.tolist(), at.tolist(), size.tolist(), strict=True)), np.int64, len(at))
        del raw
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, piece, doc)
        later = doc > least[piece]
        if later.any():
            start, end = merged(at[later], at[later] + size[later], np.searchsorted(offsets, at[later], "right"))
            gone = np.empty(len(start), _RANGE)
            gone["start"], gone["end"] = start, end
            rows.append((block % routes, block, gone.tobytes(), None))
        texts, route = [p for _, p in known], (key >> np.uint64(32)).astype(np.int64)
        known.clear()
        left_over = np.flatnonzero(~later)
        left_over = left_over[np.argsort(route[left_over], kind="stable")]
        for some in np.split(left_over, np.flatnonzero(np.diff(route[left_over])) + 1) if len(left_over) else ():
            first, spot = np.unique(piece[some], return_inverse=True)
            out = np.empty(len(some), _PIECE)
            out["hash"], out["at"], out["n"], out["doc"], out["piece"] = key[some] & np.uint64(0xFFFFFFFF), at[some], n[some], doc[some], spot
            rows.append((int(route[some[0]]), block, _packed(out, "at"), packer.compress(b"".join(texts[i] for i in first.tolist()))))
        if not rows:
            return _CUT.empty_table()
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _CUT, strict=True)], schema=_CUT)

    return run


def merged(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of one owner as one; owners rise with the places."""
    if not len(start):
        return start, end
    order = np.lexsort((start, owner))
    start, end, owner = start[order], end[order], owner[order]
    reach = np.maximum.accumulate(end)  # ranges of an earlier owner end before
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def lowest_by_window(order: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, doc: np.ndarray, most: int = 1_000_000) -> np.ndarray:
    """For each place the least doc of the repeats' occurrences that hold the LENGTH bytes there; doc is each place's own, and the result is never above it.

    A repeat covers a stretch of windows at each occurrence. Stretches are laid down as two
    overlapping powers of two, which are then pushed down level by level; some occurrences at a time.
    """
    n, top = len(doc), int(size.max() - LENGTH + 1).bit_length()
    levels = np.full((top, n), np.iinfo(np.int64).max)
    count = hi - lo
    ends = np.cumsum(count)
    at = 0
    while at < len(lo):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + most, "right")))
        c = count[at:stop]
        first = np.cumsum(c) - c
        place = order[np.repeat(lo[at:stop], c) + np.arange(c.sum()) - np.repeat(first, c)]
        least = np.repeat(np.minimum.reduceat(doc[place], first), c)
        wide = np.repeat(size[at:stop] - LENGTH + 1, c)
        k = np.frexp(wide.astype(float))[1] - 1
        np.minimum.at(levels, (k, place), least)
        np.minimum.at(levels, (k, place + wide - (1 << k)), least)
        at = stop
    for k in range(top - 1, 0, -1):
        half = 1 << (k - 1)
        np.minimum(levels[k - 1], levels[k], out=levels[k - 1])
        np.minimum(levels[k - 1][half:], levels[k][:-half], out=levels[k - 1][half:])
    return np.minimum(levels[0], doc)


def repeated_stretch(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) within each text of what can hold a repeat: from its first to its last LENGTH-byte window whose hash stands twice; equal where there is none."""
    now, kept = _BYTES[data], {}
    for k in (1, 2, 4, 8, 16):
        new = now[:-k] * _C
        new += now[k:]
        new ^= new >> np.uint64(29)
        if k in (2, 16):
            kept[k] = now
        now = new
    n = len(data) - LENGTH + 1  # 32 + 16 + 2 bytes
    h = now[:n] * _C
    h += kept[16][32 : 32 + n]
    h *= _C
    h += kept[2][48 : 48 + n]
    del now, new, kept
    windows = np.maximum(length - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(starts)), windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    v = h[starts[text] + inside]
    order = np.argsort(v)
    same = v[order[1:]] == v[order[:-1]]
    twice = np.zeros(len(v), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begin, end = np.full(len(starts), np.iinfo(np.int64).max), np.zeros(len(starts), np.int64)
    np.minimum.at(begin, text[twice], inside[twice])
    np.maximum.at(end, text[twice], inside[twice] + LENGTH)
    return np.minimum(begin, end), end


def covered(hashes: list[int], pieces: list[bytes], docs: np.ndarray, most: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end): what of each piece a piece of a smaller document holds too; pieces of one hash are compared.

    Equal pieces are one text of the suffix array, of the least document; what isn't of that goes whole.
    """
    known: dict[tuple[int, bytes], int] = {}
    of = np.fromiter((known.setdefault(k, len(known)) for k in zip(hashes, pieces, strict=True)), np.int64, len(pieces))
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, of, docs)
    distinct = list(known)
    by_hash = sorted(range(len(distinct)), key=lambda i: distinct[i][0])
    sizes = np.array([len(p) for p in pieces], np.int64)
    later = docs > least[of]
    who, lo, hi = [np.flatnonzero(later)], [np.zeros(int(later.sum()), np.int64)], [sizes[later]]
    members = np.flatnonzero(~later)
    members = members[np.argsort(of[members], kind="stable")]
    first_member = np.searchsorted(of[members], np.arange(len(distinct) + 1))
    at = 0
    while at < len(by_hash):
        part, held = [], 0
        while at < len(by_hash) and (held < most or distinct[by_hash[at]][0] == distinct[part[-1]][0]):
            part.append(by_hash[at])
            held += len(distinct[by_hash[at]][1])
            at += 1
        seen = np.array([distinct[i][0] for i in part])
        alone = np.ones(len(part), bool)
        alone[1:] &= seen[1:] != seen[:-1]
        alone[:-1] &= seen[1:] != seen[:-1]
        part = [i for i, x in zip(part, alone.tolist(), strict=True) if not x]
        if not part:
            continue
        length = np.array([len(distinct[i][1]) for i in part], np.int64)
        trim, stop = repeated_stretch(np.frombuffer(b"".join(distinct[i][1] for i in part), np.uint8), np.cumsum(length) - length, length)
        some = np.flatnonzero(stop > trim)
        if not len(some):
            continue
        part, trim, stop = [part[i] for i in some.tolist()], trim[some], stop[some]
        length = stop - trim
        starts = np.cumsum(length) - length
        data = np.frombuffer(b"".join(distinct[i][1][a:b] for i, a, b in zip(part, trim.tolist(), stop.tolist(), strict=True)), np.uint8)
        order, first, last, size = maximal_repeats(data, starts, LENGTH)
        if not len(first):
            continue
        part = np.array(part)
        text = np.repeat(np.arange(len(part)), length)
        doc = least[part][text]
        gone = np.concatenate([[False], lowest_by_window(order, first, last, size, doc) < doc, [False]])
        edge = np.diff(gone.astype(np.int8))
        begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)  # windows; none begins in the last LENGTH - 1 bytes of a text
        owner = text[begin]
        many = first_member[part[owner] + 1] - first_member[part[owner]]
        member = members[np.repeat(first_member[part[owner]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        who.append(member)
        lo.append(np.repeat(begin - starts[owner] + trim[owner], many))
        hi.append(np.repeat(end - 1 + LENGTH - starts[owner] + trim[owner], many))
    return np.concatenate(who), np.concatenate(lo), np.concatenate(hi)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges that go, by block; those that their block has settled are passed on."""
    opener = zstandard.ZstdDecompressor()
    for _, rows in _grouped(batches, ("block", "payload", "bytes")):
        settled = [r[:2] for r in rows if r[2] is None]
        if settled:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in settled], pa.int64()), pa.array([x for _, x in settled], pa.binary())], ["block", "payload"])
        rows = [r for r in rows if r[2] is not None]
        if not rows:
            continue
        recs, pieces = [], []
        for _, payload, content in rows:
            rec, raw = _unpacked(payload, _PIECE, "at"), opener.decompress(content)
            size = np.empty(int(rec["piece"].max()) + 1, np.int64)
            size[rec["piece"]] = rec["n"].astype(np.int64) + LENGTH - 1
            ends = np.cumsum(size)
            own = [raw[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
            pieces += [own[i] for i in rec["piece"].tolist()]
            recs.append(rec)
        count = [len(r) for r in recs]
        rec = np.concatenate(recs)
        del recs
        who, lo, hi = covered(rec["hash"].tolist(), pieces, rec["doc"].astype(np.int64))
        of = np.repeat(np.arange(len(rows)), count)[who]
        out = np.empty(len(who), _RANGE)
        out["start"], out["end"] = rec["at"][who] + lo, rec["at"][who] + hi
        order = np.lexsort((out["end"], out["start"], of))
        out, of = out[order], of[order]
        cut = np.searchsorted(of, np.arange(len(rows) + 1))
        some = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some], pa.int64()), pa.array([np.unique(out[cut[i] : cut[i + 1]]).tobytes() for i in some], pa.binary())], ["block", "payload"])


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_NOTHING = hashlib.sha256(b"").hexdigest()


def _finished(with_bytes: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _RESULT.empty_table()
        docs, offsets, data = _opened(*(left[c][0].as_py() for c in ("docs", "offsets", "data")))
        ranges = np.concatenate([np.zeros(0, _RANGE), *(np.frombuffer(p, _RANGE) for p in right["payload"].to_pylist())])
        start, end = ranges["start"].astype(np.int64), ranges["end"].astype(np.int64)
        start, end = merged(start, end, np.searchsorted(offsets, start, "right"))
        cut = np.searchsorted(start, offsets)
        rows = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            lo, hi = start[cut[i] : cut[i + 1]].tolist(), end[cut[i] : cut[i + 1]].tolist()
            kept, digest = [data[x:y].tobytes() for x, y in zip([a, *hi], [*lo, b], strict=True)], hashlib.sha256()
            for x in kept:
                digest.update(x)
            rows.append((int(docs[i]), b - a, sum(hi) - sum(lo), len(lo), digest.hexdigest(), b"".join(kept) if with_bytes else None))
        for doc, n in zip(np.frombuffer(left["copy_docs"][0].as_py() or b"", "<i8").tolist(), np.frombuffer(left["copy_sizes"][0].as_py() or b"", "<i8").tolist(), strict=True):
            rows.append((doc, n, n, 1, _NOTHING, b"" if with_bytes else None))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT) if rows else _RESULT.empty_table()

    return run


def _text_digests(offsets: np.ndarray, data: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each text; None for those too short to lose anything."""
    raw = memoryview(np.ascontiguousarray(data))
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() if b - a >= LENGTH else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct texts of each block, with their least id and number."""
    for b in batches:
        for block, *rest in zip(*(b.column(c).to_pylist() for c in ("block", "docs", "offsets", "data")), strict=True):
            docs, offsets, data = _opened(*rest)
            found: dict[bytes, tuple[int, int]] = {}
            for digest, doc in zip(_text_digests(offsets, data), docs.tolist(), strict=True):
                if digest:
                    least, n = found.get(digest, (doc, 0))
                    found[digest] = min(least, doc), n + 1
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array([x for x, _ in found.values()], pa.int64()), pa.array([n for _, n in found.values()], pa.int64())], ["block", "digest", "doc", "n"])


_KNOWN = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("docs", "offsets", "data", "copy_docs", "copy_sizes"))])


def _without_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks without the bytes of texts that a smaller id has too; of those the ids and sizes stay."""
    packer = zstandard.ZstdCompressor(level=3)
    for b in batches:
        for block, known, *rest in zip(*(b.column(c).to_pylist() for c in ("block", "known", "docs", "offsets", "data")), strict=True):
            if not known:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, *rest, b"", b""), _KNOWN, strict=True)], schema=_KNOWN)
                continue
            docs, offsets, data = _opened(*rest)
            least = {x["digest"]: x["least"] for x in known}
            copy = np.array([d is not None and doc > least.get(d, doc) for d, doc in zip(_text_digests(offsets, data), docs.tolist(), strict=True)], bool)
            size = np.diff(offsets)
            kept = [data[a:c] for a, c, gone in zip(offsets[:-1].tolist(), offsets[1:].tolist(), copy.tolist(), strict=True) if not gone]
            new = np.concatenate([[0], np.cumsum(size[~copy])]).astype("<i8")
            values = (block, docs[~copy].tobytes(), new.tobytes(), packer.compress(b"".join(x.tobytes() for x in kept)), docs[copy].tobytes(), size[copy].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _KNOWN, strict=True)], schema=_KNOWN)


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of texts where of equal ones only the least id's bytes are left.

    Digests of very many copies are told to all tasks, MOST_SENT at most; the others, each of few rows, are joined.
    """
    digests = through_table(blocks.mapInArrow(_digests, "block long, digest binary, doc long, n long"), "digests")
    found = digests.groupBy("digest").agg(F.min("doc").alias("least"), F.sum("n").alias("texts"), F.count("*").alias("rows"))
    least = through_table(found.where("texts > 1").select("digest", "least", "rows"), "copies")
    edge = max(1000, (least.agg(F.sum("rows")).first()[0] or 0) // MOST_SENT)
    many, few = F.broadcast(least.where(F.col("rows") > edge).select("digest", "least")), least.where(F.col("rows") <= edge).select("digest", "least")
    told = digests.join(many, "digest").unionByName(digests.join(many, "digest", "left_anti").join(few, "digest"))
    lists = told.groupBy("block").agg(F.collect_list(F.struct("digest", "least")).alias("known"))
    return through_table(blocks.join(lists, "block", "left").mapInArrow(_without_copies, "block long, docs binary, offsets binary, data binary, copy_docs binary, copy_sizes binary"), "distinct-blocks")


def without_repeats(df: DataFrame, *, text: str = "text", key: str = "doc_id", with_bytes: bool = False, common: int = COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining bytes if asked for) of every row of df.

    A byte goes if a 50-byte string that covers it also starts in a row of a smaller id. Null
    and empty texts have no bytes. Rows that share an id don't remove from one another. A null id
    takes part as the smallest there can be, and is returned as null. An empty table gives no rows.
    The windows of grams that at least common texts have go one by one; it moves cost, not results.
    """
    spark = df.sparkSession
    ship(spark)
    none = -(1 << 63)
    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(none)).alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    blocks = through_table(rows.mapInArrow(_blocks, "block long, docs binary, offsets binary, data binary"), "text-blocks")
    known = distinct_blocks(blocks)
    n = known.count()
    parts, routes = max(48, n // 32), max(48, n // 9)  # some 64 MB of text for each route of grams, 18 MB for each of pieces
    grams = known.select("block", "docs", "offsets", "data").mapInArrow(_grams(parts), "route long, block long, payload binary")
    wanted = grams.repartition("route").sortWithinPartitions("route").mapInArrow(_shared(common), "block long, route long, payload binary")
    pieces = known.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_cut(parts, routes), "route long, block long, payload binary, bytes binary")
    ranges = pieces.repartition("route").sortWithinPartitions("route").mapInArrow(_found, "block long, payload binary")
    out = known.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(_finished(with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))
    return out if with_bytes else out.drop("kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without what earlier ones hold."""
    return without_repeats(table(spark, sf_dir, "documents"))
