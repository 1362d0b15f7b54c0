"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four 16-bit segments. Of at most three differing bits over
the ring of segments, some segment has none while the next has at most one (pigeonhole). So
each ring position gives keys of the segment as it is with codeword indices of the next: the
next segment, padded to 23 bits, is decoded with the perfect (23, 12) Golay code to the
codewords near it, one where the nearest is at distance two or less and six otherwise. Two
values that differ in one bit always share one of these codewords. Fingerprints that share a
key are compared exactly.

Equal fingerprints are one node, so exact copies cost nothing. A key's group is cut into
blocks where it is large, and pairs of blocks are compared apart; every block pair returns a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import packed, ship, table, through_table, unpacked
from quern.llm.components import components

#: Differing bits that link, words in a shingle, seed, and the generator of the (23, 12) Golay code.
DISTANCE, SHINGLE, SEED, GOLAY = 3, 3, 42, 0b101011100011


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text; 0 where it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < SHINGLE else [b"%b %b %b" % x for x in zip(words, words[1:], words[2:], strict=False)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):  # so many at a time, for very long texts
        part = grams[at : at + (1 << 16)]
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in part), ">u8", len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(grams)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp: the fingerprint's bits as a signed long) of every row."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _syndromes(v: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words by the generator."""
    v = v.copy()
    for k in range(22, 10, -1):
        v ^= np.where(v >> k & 1, GOLAY << (k - 11), 0)
    return v


@lru_cache(1)
def near_codewords() -> tuple[np.ndarray, np.ndarray]:
    """(indices, count) for each 16-bit value: the indices of the codewords at distance four or less, six at most."""
    errors = np.array([sum(1 << i for i in c) for w in range(5) for c in itertools.combinations(range(23), w)], np.int64)
    which = _syndromes(errors)
    order = np.argsort(which, kind="stable")
    first = np.searchsorted(which[order], np.arange(2049))
    values = np.arange(1 << 16, dtype=np.int64)
    s = _syndromes(values)
    count = (first[s + 1] - first[s]).astype(np.int64)
    out = np.zeros((1 << 16, 6), np.int64)
    for j in range(6):
        has = count > j
        out[has, j] = (values[has] ^ errors[order[first[s[has]] + j]]) >> 11
    return out, count


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every key of the fingerprints (uint64)."""
    table_, count = near_codewords()
    rows, keys = [], []
    for a in range(4):
        exact = (fp >> np.uint64(16 * a)).astype(np.int64) & 0xFFFF
        fuzzy = (fp >> np.uint64(16 * ((a + 1) % 4))).astype(np.int64) & 0xFFFF
        for j in range(6):
            at = np.flatnonzero(count[fuzzy] > j)
            rows.append(at)
            keys.append(a << 28 | exact[at] << 12 | table_[fuzzy[at], j])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, node = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        row, key = golay_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(node[row])], ["key", "fp", "node"])


def forest(group: np.ndarray, fp: np.ndarray, cross: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) of a spanning forest of the links among rows of the same group; rows come sorted by group.

    cross, where given, holds each row's side; sides other than 0 are compared only with other sides.
    """
    n = len(group)
    root = np.arange(n)
    left = np.arange(n - 1)
    step = 1
    while len(left := left[left + step < n]) and len(left := left[group[left] == group[left + step]]):
        right = left + step
        near = np.bitwise_count(fp[left] ^ fp[right]) <= DISTANCE
        if cross is not None:
            near &= (cross[left] == 0) | (cross[left] != cross[right])
        u, v = left[near], right[near]
        while len(u):
            ru, rv = root[u], root[v]
            apart = ru != rv
            u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
            np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
            while not np.array_equal(up := root[root], root):
                root = up
        step += 1
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, b, c, side, fp, node) sorted by key, b, c; a group's rows may run on into the next batch."""
    rest: list[np.ndarray] | None = None

    def done(cols: list[np.ndarray]) -> pa.RecordBatch:
        g = np.cumsum(np.concatenate([[0], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)])) if len(cols[0]) else cols[0]
        row, root = forest(g, cols[4].view(np.uint64), cols[3])
        e = np.unique(np.stack([cols[5][row], cols[5][root]]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], ["a", "b"])

    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for i in range(6)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        cut = last[-1] + 1 if len(last) else 0
        rest = [x[cut:] for x in cols]
        if cut:
            yield done([x[:cut] for x in cols])
    if rest is not None:
        yield done(rest)


def links(nodes: DataFrame, *, block: int = 2048) -> DataFrame:
    """Edges (a, b) that join the nodes (fp, node; distinct) that are at most DISTANCE apart: a spanning forest for each key's group or pair of its blocks.

    No group reaches a task whole: those of over block rows are dealt into blocks, and each pair of blocks is a group of its own.
    """
    ship(nodes.sparkSession)
    keyed = nodes.mapInArrow(_keyed, "key long, fp long, node long")
    large = through_table(keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(2 * F.col("count") / block).cast("int").alias("n")), "large-keys")
    if large.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("side"), "fp", "node")
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        others = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))
        marked = keyed.join(large, "key", "left").withColumn("o", F.coalesce(own, F.lit(0)))
        spread = marked.select("key", "fp", "node", "o", F.explode(others).alias("p"))
        dealt = spread.select("key", F.least("o", "p").alias("b"), F.greatest("o", "p").alias("c"), F.when(F.col("o") == F.col("p"), 0).when(F.col("o") < F.col("p"), 1).otherwise(2).alias("side"), "fp", "node")
    return dealt.repartition("key", "b", "c").sortWithinPartitions("key", "b", "c").mapInArrow(_linked, "a long, b long").distinct()


def simhash_groups(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of df.

    Null or empty texts have fingerprint zero and are linked like any other. Rows that repeat
    a doc_id are all returned. A null doc_id gets its fingerprint's group where others share
    it, else a null component; it makes no links. An empty table gives no rows.
    """
    fps = through_table(fingerprints(df, text=text, key=key), "fingerprints")
    nodes = through_table(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    linked = components(links(nodes))
    named = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with one row of each group, that of the smallest id; df's columns may have any names.

    Rows without an id stay. Rows that share one id are one document: the one of least text stays, and it goes
    if any of them has a smaller id in its group. An empty table gives no rows. The ids that lose or repeat
    are joined against, not those that stay, which are far more.
    """
    groups = simhash_groups(df, text=text, key=key).where("doc_id is not null")
    found = groups.groupBy(F.col("doc_id").alias("_of")).agg(F.max((F.col("doc_id") > F.col("component_id")).cast("int")).alias("_lost"), F.count("*").alias("_n"))
    marked = through_table(found.where("_lost = 1 OR _n > 1").select("_of", "_lost"), "lost-or-repeated")
    packs = packed(df, text, key)
    kept = packs.join(marked, F.col("_id").cast("long") == F.col("_of"), "left_anti").select("_doc")
    if not (again := marked.where("_lost = 0").select("_of")).isEmpty():
        rows = packs.join(again, F.col("_id").cast("long") == F.col("_of"))
        kept = kept.unionByName(rows.groupBy("_of").agg(F.min_by("_doc", F.struct("_t", F.xxhash64("_doc"))).alias("_doc")).select("_doc"))
    return kept.select(*unpacked(df.columns))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_groups(table(spark, sf_dir, "documents"))
