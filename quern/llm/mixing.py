"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks. With integer weights w that sum to W, in exactly the
ratios asked for, block k (from 1) of a source is released at slot floor((k - 1) * W / w) and is
due by slot ceil(k * W / w); every slot takes the released block that is due first (ties: the
source's place in the sorted names). Utilization is exactly one, so no deadline is missed and
no source is ever a whole block ahead of or behind the share asked for.

The driver works the slots out, a step of a heap for each block, and no row is looked at for
it; a schedule that repeats after a few slots is worked out for one period only. Rows get
their slots by source and block number. When a source runs out, a new phase begins with the
weights of the rest; there are at most as many phases as sources.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import packed, table, unpacked

#: Documents in a block, slots of the longest period that is repeated, most sources, rows of a ranking bucket, and most blocks whose slots go to all tasks.
BLOCK, PERIOD, MOST_SOURCES, BUCKET, MOST_SENT = 64, 1000, 2000, 4096, 1 << 19


def integer_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Integers without a common factor in exactly the ratios of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def in_turn(weights: Mapping[str, int]) -> Iterator[str]:
    """The source of each slot of a period: of the released blocks, the one that is due first."""
    total = sum(weights.values())
    names = sorted(weights)
    waiting = {0: [(-(-total // weights[s]), n, 1) for n, s in enumerate(names)]}
    ready: list[tuple[int, int, int]] = []
    for slot in range(total):
        for x in waiting.pop(slot, ()):
            heapq.heappush(ready, x)
        _, n, k = heapq.heappop(ready)
        w = weights[names[n]]
        yield names[n]
        waiting.setdefault(max(slot + 1, k * total // w), []).append((-(-(k + 1) * total // w), n, k + 1))


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD) -> list[dict]:
    """For each phase and source with blocks in it: source, lo and hi (its blocks), start (first slot), w, total, and at (its slots, of one period at most).

    Schedules of more than period slots aren't repeated: every block of theirs has its slot in at.
    """
    left, lo, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        w = integer_weights({s: weights[s] for s in left})
        total = sum(w.values())
        at: dict[str, list[int]] = {s: [] for s in left}
        for slot, s in enumerate(in_turn(w)):
            at[s].append(slot)
            if total > period and len(at[s]) == left[s]:
                break
        if total > period:
            last, took = slot, {s: len(x) for s, x in at.items()}
        else:
            last = min(((n - 1) // w[s]) * total + at[s][(n - 1) % w[s]] for s, n in left.items())  # where the first one runs out
            rounds, rest = divmod(last + 1, total)
            took = {s: rounds * w[s] + sum(x < rest for x in at[s]) for s in left}
        for s, n in took.items():
            if n:
                out.append({"source": s, "lo": lo[s], "hi": lo[s] + n, "start": start, "w": w[s], "total": total, "at": at[s]})
                lo[s] += n
        left = {s: n - took[s] for s, n in left.items() if n > took[s]}
        start += last + 1
    return out


def places(plan: list[dict]) -> pa.Table:
    """(source, block, slot, release, deadline) of each block; deadlines beyond a long are the largest long."""
    names, most = {}, np.iinfo(np.int64).max
    source, *rest = (np.empty(sum(p["hi"] - p["lo"] for p in plan), t) for t in (np.int32, np.int64, np.int64, np.int64, np.int64))
    i = 0
    for p in plan:
        n, w, total, start = names.setdefault(p["source"], len(names)), p["w"], p["total"], p["start"]
        for j in range(p["hi"] - p["lo"]):
            source[i] = n
            for column, x in zip(rest, (p["lo"] + j, start + j // w * total + p["at"][j % w], start + j * total // w, min(start - (-(j + 1) * total // w), most)), strict=True):
                column[i] = x
            i += 1
    named = pa.array(list(names), pa.string()).take(pa.array(source))
    return pa.table([named, *map(pa.array, rest)], ["source", "block", "slot", "release", "deadline"])


def first_positions(slots: pa.Table, counts: Mapping[str, int], block: int) -> np.ndarray:
    """The first row's position of each block: blocks before it are full, but for the last ones of sources."""
    slot = slots["slot"].to_numpy()
    last = dict(zip(slots["source"].to_pylist(), slot.tolist(), strict=True))  # a source's blocks are in order
    ends = sorted((last[s], -n % block) for s, n in counts.items())
    lacking = np.concatenate([[0], np.cumsum([n for _, n in ends])])
    return slot * block - lacking[np.searchsorted([s for s, _ in ends], slot)]


def tempered(counts: Mapping[str, int], power: float = 0.5) -> dict[str, float]:
    """Target weights by a power of the sources' sizes: 1 as they are, 0 all alike."""
    return {s: float(n) ** power for s, n in counts.items() if n}


def mixed(df: DataFrame, weights: Mapping[str, float] | None = None, *, source: str = "source", key: str = "doc_id", text: str = "text", block: int = BLOCK, period: int = PERIOD, carry: bool = True) -> DataFrame:
    """Every row of df (as _doc, if carried) with _id, source, block, slot, release, deadline and position.

    block counts from 0 in its source; slot is where the block goes, release and deadline are
    its window; position is the row's place in the mixture, from 0 without gaps. Weights
    that are not given come from tempered(). A null source is a source of its own, named "";
    so are sources of the weights with no row: they have no slot. Within its source a row's
    place is by a hash of its id and text, so rows without an id, or with the same, are dealt evenly too; whole repeats take any order. A
    source without a weight raises ValueError. Empty tables give no rows.
    """
    spark = df.sparkSession
    packs = packed(df, text, key).withColumns({"source": F.coalesce(F.col("_doc").getField(source).cast("string"), F.lit(""))})
    packs = packs.withColumns({"_hash": F.xxhash64("_id", "_t"), "_tie": F.xxhash64("_t")}).drop("_t", *([] if carry else ["_doc"]))
    counts = {r["source"]: r["count"] for r in packs.groupBy("source").count().take(MOST_SOURCES + 1)}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: group them first")
    weights = tempered(counts) if weights is None else weights
    if lost := [s for s in counts if not weights.get(s, 0) > 0]:
        raise ValueError(f"no weight for source {lost[0]!r}")
    plan = phases({s: -(-n // block) for s, n in counts.items()}, weights, period)
    slots = places(plan)
    if len(slots):
        slots = slots.append_column("_first", pa.array(first_positions(slots, counts, block)))
    else:
        slots = slots.append_column("_first", pa.array([], pa.int64()))
    known = spark.createDataFrame([(s, -(-n // BUCKET)) for s, n in counts.items()], "source string, n_buckets int")
    slots_of = spark.createDataFrame(slots, "source string, block long, slot long, release long, deadline long, _first long")
    if len(slots) <= MOST_SENT:
        slots_of = F.broadcast(slots_of)
    split = packs.join(F.broadcast(known), "source")
    # the hash's range, cut evenly: buckets follow the hash's order
    split = split.withColumn("_bucket", F.floor((F.shiftrightunsigned("_hash", 32) * F.col("n_buckets")) / F.lit(float(1 << 32))).cast("int")).drop("n_buckets")
    sizes = split.groupBy("source", "_bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("source", "_bucket", before.alias("_before"))
    own = Window.partitionBy("source", "_bucket").orderBy(F.shiftrightunsigned("_hash", 32), "_hash", "_id", "_tie")
    rank = F.col("_before") + F.row_number().over(own) - 1
    ranked = split.join(offsets, ["source", "_bucket"]).withColumn("_rank", rank)
    ranked = ranked.withColumn("block", F.floor(F.col("_rank") / block).cast("long")).join(slots_of, ["source", "block"])
    return ranked.withColumn("position", F.col("_first") + F.col("_rank") % block).select(*(["_doc"] if carry else []), "_id", "source", "block", "slot", "release", "deadline", "position")


def in_mixed_order(df: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """The rows of df in the order of the mixture: written files follow it, by name and row."""
    return mixed(df, weights, **options).orderBy("position").select(*unpacked(df.columns))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes when the sources are mixed by the square roots of their sizes."""
    return mixed(table(spark, sf_dir, "documents"), carry=False).withColumnRenamed("_id", "doc_id")
