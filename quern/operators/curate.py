"""Filtering with reasons, enrichment, splits, shards, statistics and selection: DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quern.functions.metrics import rate
from quern.sources.places import scratch

#: The three transforms that rows are fanned out over.
TECHNIQUES = ("Flatten", "EncodeArithmetic", "Flatten+EncodeArithmetic")


def with_reason(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "skip_reason") -> DataFrame:
    """df with the first rule that rejects a row, null if none does. Exact under retries, unlike counters."""
    reason = F.lit(None).cast("string")
    for label, rejects in reversed(rules):
        reason = F.when(rejects, F.lit(label)).otherwise(reason)
    return df.withColumn(name, reason)


def reason_counts(df: DataFrame, name: str = "skip_reason", kept: str = "kept") -> DataFrame:
    """How many rows each reason took."""
    return df.groupBy(F.coalesce(name, F.lit(kept)).alias(name)).agg(F.count("*").alias("n"))


def reasons_observed(df: DataFrame, labels: Sequence[str], name: str = "skip_reason", kept: str = "kept") -> tuple[DataFrame, Observation]:
    """(df, counts): df, and how many of its rows each of the labels took, which its first action counts as the rows go by: no second pass."""
    seen = Observation()
    reason = F.coalesce(name, F.lit(kept))
    return df.observe(seen, *[F.count_if(reason == x).alias(x) for x in (*labels, kept)]), seen


def checked(names: Sequence[str], known: Sequence[str]) -> list[str]:
    """names, if all are known; else ValueError."""
    if odd := [n for n in names if n not in known]:
        raise ValueError(f"unknown: {odd[0]!r}; one of {', '.join(known)}")
    return list(names)


def fanned_out(df: DataFrame, values: Sequence[str] = TECHNIQUES, name: str = "technique") -> DataFrame:
    """Each row with each value."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def seeds(*keys: Column, seed: int = 42) -> Column:
    """A seed from 0 to 2^31 - 1 for each row, by its keys: the same whatever the order of rows."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 31))


def keys_needed(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys without null or empty parts."""
    some = F.lit(True)
    for k in keys:
        some &= F.coalesce(F.col(k).cast("string"), F.lit("")) != ""
    return df.where(some).select(*keys).distinct()


#: The column that says where a row stands among those of its table's files.
ARRIVAL = "_arrival"


def in_arrival(df: DataFrame) -> DataFrame:
    """df, read from files, with _arrival: by it rows go as a reader of one file after the other, by name, comes upon them. Joins and unions keep it.

    AnalysisException if df isn't read from files, or is more than a selection of their rows and columns.
    """
    return df.withColumn(ARRIVAL, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def reduced(source: DataFrame, targets: DataFrame, *keys: str) -> DataFrame:
    """The rows of source whose key some target needs."""
    return source.join(keys_needed(targets, *keys), list(keys), "left_semi")


def enriched(df: DataFrame, side: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str | Sequence[str] = (), default: str | None = "") -> DataFrame:
    """df with columns of side by key; rows of df are neither lost nor multiplied, whatever keys repeat on either side.

    Of side rows with one key the last by order counts, whatever it holds: by a column or several, and without one the
    last to arrive (in_arrival()). Misses and nulls become the default, if one is given. Tables bucketed by the
    keys (sinks.write_bucketed) are joined where they lie.
    """
    by = [order] if isinstance(order, str) else list(order)
    if not by:
        side, by = side if ARRIVAL in side.columns else in_arrival(side), [ARRIVAL]
    last = side.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("_last"))
    side = last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])
    out = df.drop(*columns).join(side, list(keys), "left")
    return out if default is None else out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(default)) for c in columns})


def stratified(df: DataFrame, stratum: str, key: str, ratio: float, seed: int = 42, group: str | None = None) -> DataFrame:
    """df with split: of each stratum exactly max(1, floor(n * ratio)) rows are test, the rest train, by a hash of seed and key.

    With group, whole groups go one way, so variants of one item don't leak; counts are then of groups.
    A stratum may hold most rows, so none is ranked whole: ranks are places within one of 65,536 hash
    ranges, added to the counts of the ranges before it.
    """
    named = df.withColumns({"_s": F.coalesce(F.col(stratum).cast("string"), F.lit("\x00")), "_u": F.coalesce(F.col(group or key).cast("string"), F.lit("\x00"))})
    units = named.select("_s", "_u").distinct() if group else named
    units = units.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "_u"))).withColumn("_b", F.substring("_h", 1, 4))
    whole = Window.partitionBy("_s")
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = units.groupBy("_s", "_b").agg(F.count("*").alias("_c"))
    ranges = ranges.select("_s", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"), F.greatest(F.lit(1), F.floor(F.sum("_c").over(whole) * ratio)).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", F.col("_u") if group else F.col(key)))
    ranked = units.withColumn("_r", place).join(ranges, ["_s", "_b"])
    split = F.when(F.col("_first") + F.col("_r") <= F.col("_n"), "test").otherwise("train").alias("split")
    if group:
        return named.join(ranked.select("_s", "_u", split), ["_s", "_u"]).drop("_s", "_u")
    return ranked.select(*df.columns, split)


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Counts and percentages of the total."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each group


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the scratch folder: for what is read more than once and dear to work out."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str | Column, dear: bool = False) -> DataFrame:
    """df in the order of by, with _range (a range of that order) and _place (the place within it, from 0).

    Ranges are dealt out by one shuffle and written to the scratch folder, so that a range stays what it
    is however often it is read, and whichever executors are lost. The order is first sampled, for which df is worked
    out once more; where its columns are dear and small, dear writes it before.
    """
    df = written(df, "undealt") if dear else df
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_range": F.spark_partition_id(), "_place": place})
    return written(rows, "dealt")


def numbered(df: DataFrame, *by: str | Column, name: str = "rn", dear: bool = False) -> DataFrame:
    """df with the place of each row by its keys, from 1, without taking all rows to one task; rows with equal keys take any order.

    A range's first place is the number of rows in those before it: one small row for each range.
    """
    rows = dealt(df, *by, dear=dear)
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_first"))
    return rows.join(F.broadcast(firsts), "_range").withColumn(name, F.col("_first") + F.col("_place") + 1).drop("_range", "_place", "_first")


def chunk(df: DataFrame, key: str, skip: int, most: int) -> DataFrame:
    """The rows after the first skip, so many at most, by key: for tables in no order. scans.chunk() takes rows as files hold them, without a sort."""
    return numbered(df, key).where(F.col("rn").between(skip + 1, skip + most)).drop("rn")


def sharded(df: DataFrame, key: str, rows: int, name: str = "shard_id") -> DataFrame:
    """df with the number of its shard of exactly so many rows (the last may have fewer), by key."""
    return numbered(df, key).withColumn(name, F.floor((F.col("rn") - 1) / rows)).drop("rn")


def shuffled(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in an order by a hash of seed and key; ties go by key."""
    return numbered(df, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key), name=name)


def fail_streak_stop(df: DataFrame, order: str, failed: Column, most: int, group: str | None = None) -> DataFrame:
    """(group, stop_at): where the run of failures first reaches most, by order; a success ends a run. Groups that never stop have no row.

    Runs are counted within ranges of the order, and each range takes over the length of the run
    that the ranges before it leave open, so neither all rows nor a large group go to one task.
    """
    keys = [group] if group else []
    rows = dealt(df.select(*keys, F.col(order).alias("_o"), F.coalesce(failed, F.lit(False)).cast("int").alias("_bad")), *keys, "_o")
    own = Window.partitionBy(*keys, "_range").orderBy("_place")
    rows = rows.withColumn("_island", F.sum(1 - F.col("_bad")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum("_bad").over(Window.partitionBy(*keys, "_range", "_island").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_run", run)
    # a row for each range (and group): whether a run may go through it, and the run that it leaves open
    ends = rows.groupBy(*keys, "_range").agg(F.max("_island").alias("_islands"), F.max_by("_run", "_place").alias("_open"))
    over = Window.partitionBy(*keys).orderBy("_range")
    ends = ends.withColumn("_chain", F.sum(F.when(F.col("_islands") > 0, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_out", F.sum("_open").over(Window.partitionBy(*keys, "_chain").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)))
    taken = ends.select(*keys, "_range", F.coalesce(F.lag("_out").over(over), F.lit(0)).alias("_in"))
    joined = rows.join(taken, "_range") if not group else rows.join(taken.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")) & (rows["_range"] == taken["_range"]))
    full = F.col("_run") + F.when(F.col("_island") == 0, F.col("_in")).otherwise(0)
    return joined.where((F.col("_bad") == 1) & (full >= most)).groupBy(*keys).agg(F.min("_o").alias("stop_at")).where("stop_at is not null")


def running(df: DataFrame, order: str, value: str, group: str) -> DataFrame:
    """df with seen and running: how many rows of its group there are up to each row by order, and the sum of their values (null until there is one).

    Counted within ranges of the order, with what the ranges before hold added, so that a large group doesn't go to one task. Null groups are a group.
    """
    rows = dealt(df, group, order)
    own = Window.partitionBy(group, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": F.count("*").over(own), "_s": F.sum(value).over(own)})
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(group, "_range").agg(F.count("*").alias("_c"), F.sum(value).alias("_t"))
    parts = parts.select(F.col(group).alias("_g"), F.col("_range").alias("_q"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c"), F.sum("_t").over(before).alias("_t"))
    out = rows.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_q")))
    total = F.when(F.col("_s").isNull() | F.col("_t").isNull(), F.coalesce("_s", "_t")).otherwise(F.col("_s") + F.col("_t"))
    return out.select(*df.columns, (F.col("_n") + F.col("_c")).alias("seen"), total.alias("running"))


def overall_first(df: DataFrame, order: str, fit: Column, most: int) -> DataFrame:
    """One row: how many fit rows a loop by order takes, so many at most, and how many rows it sees until it stops: that of the first fit row too many is seen as well."""
    last = df.where(fit).select(order).orderBy(order).limit(most + 1).agg(F.count("*").alias("n"), F.max(order).alias("at"))
    seen = df.join(F.broadcast(last), (F.col("n") <= most) | (F.col(order) <= F.col("at")))  # one row
    counts = seen.agg(F.least(F.lit(most), F.count_if(fit)).alias("evaluated"), F.count("*").alias("seen"))
    return counts.select(F.col("evaluated").cast("long").alias("evaluated"), "seen")


def grouped_lists(df: DataFrame, key: Column, value: str, name: str = "seed") -> DataFrame:
    """(key, n, ids): the rows of each key with their values in order."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(value)).alias("ids"))


def full_batches(df: DataFrame, order: Sequence[str], size: int, group: str | None = None) -> DataFrame:
    """df with batch (from 0 in its group), by order, without the rows of a last batch that is short."""
    keys = [group] if group else []
    rows = dealt(df, *keys, *order)
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_c"), F.min("_place").alias("_least"))
    by = Window.partitionBy(*keys)
    below = by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*[F.col(k).alias("_g") for k in keys], F.col("_range").alias("_q"), "_least", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_first"), F.sum("_c").over(by).alias("_all"))
    same = F.col("_range") == F.col("_q")
    placed = rows.join(firsts, same & F.col(group).eqNullSafe(F.col("_g")) if group else same)
    batch = F.floor((F.col("_first") + F.col("_place") - F.col("_least")) / size)
    return placed.withColumn("batch", batch).where((F.col("batch") + 1) * size <= F.col("_all")).drop("_range", "_place", "_q", "_g", "_least", "_first", "_all")


def merged_stats(parts: DataFrame, stats: str = "generation_stats", counters: str = "samples_per_transform") -> DataFrame:
    """(name, total): the sums of all counters, and of the map's entries as counters.name, over partial statistics; what lacks is 0."""
    fields = [f.name for f in parts.schema[stats].dataType.fields if f.name != counters]
    plain = F.array(*[F.struct(F.lit(f).alias("name"), F.coalesce(F.col(f"{stats}.{f}"), F.lit(0)).cast("long").alias("n")) for f in fields])
    mapped = F.transform(F.map_entries(F.coalesce(F.col(f"{stats}.{counters}"), F.create_map().cast("map<string,bigint>"))), lambda e: F.struct(F.concat(F.lit(f"{counters}."), e["key"]).alias("name"), e["value"].alias("n")))
    return parts.select(F.explode(F.concat(plain, mapped)).alias("e")).groupBy(F.col("e.name").alias("name")).agg(F.sum("e.n").alias("total"))


def check_stats(df: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of check results, overall ("ALL") and for each value of by, in one pass of grouping sets.

    functional_pass has three values: null was not tested.
    """
    tested = F.col("functional_pass").isNotNull()
    sums = [
        F.count("*").alias("total"), F.count_if("syntax_valid").alias("syntax_valid"), F.count_if("compiles").alias("compiles"), F.count_if("links").alias("links"),
        F.count_if(tested).alias("functional_tested"), F.count_if("functional_pass").alias("functional_pass"),
        F.coalesce(F.sum(F.when(tested, F.col("io_pass_count"))), F.lit(0)).cast("long").alias("io_pass_total"), F.coalesce(F.sum(F.when(tested, F.col("io_total_count"))), F.lit(0)).cast("long").alias("io_tested_total"),
    ]
    out = overall(df, sums, *by)
    for part, whole in (("syntax_valid", "total"), ("compiles", "total"), ("links", "total"), ("functional_pass", "functional_tested")):
        out = out.withColumn(f"{part}_pct", rate(F.col(part), F.col(whole)))
    return out.withColumn("io_pass_pct", rate(F.col("io_pass_total"), F.col("io_tested_total")))


def overall(df: DataFrame, aggregates: Sequence[Column], *by: str) -> DataFrame:
    """Aggregates over all rows (by is "ALL") and for each group."""
    if not by:
        return df.agg(*aggregates)
    keys = [F.col(k).cast("string").alias(k) for k in by]
    grouped = df.select(*[c for c in df.columns if c not in by], *keys).groupingSets([[], [F.col(k) for k in by]], *[F.col(k) for k in by])
    named = [F.when(F.max(F.grouping(k)) == 1, "ALL").otherwise(F.coalesce(F.first(k), F.lit(""))).alias(f"_{k}") for k in by]
    out = grouped.agg(*named, *aggregates)
    return out.drop(*by).withColumnsRenamed({f"_{k}": k for k in by})


def first_errors(df: DataFrame, order: str, most: int = 20) -> DataFrame:
    """(seq, level, error): the first so many failures, of syntax, else of compilation."""
    level = F.when(~F.col("syntax_valid"), "syntax").when(~F.col("compiles"), "compile")
    error = F.when(~F.col("syntax_valid"), F.col("syntax_error")).otherwise(F.col("compile_error"))
    return df.select(F.col(order).alias("seq"), level.alias("level"), error.alias("error")).where("level is not null").orderBy("seq").limit(most)


def best_worst(df: DataFrame, prompt: str, score: str, position: str, text: str) -> DataFrame:
    """For each prompt its best candidate (of equals the first) and its worst (of equals the last)."""
    by = F.struct(F.col(score), -F.col(position))
    return df.groupBy(prompt).agg(F.max_by(text, by).alias("best"), F.max(score).alias("best_score"), F.min_by(text, by).alias("worst"), F.min(score).alias("worst_score"))


def preferences(df: DataFrame, reference: str, ground_truth: bool = False) -> DataFrame:
    """best_worst() rows with chosen, rejected, their scores and the branch taken; rows without a preference go.

    The truth against the worst with ground_truth, or where all failed; the best against the worst where they differ; nothing where all tie.
    """
    truth = F.lit(ground_truth)
    all_failed = F.col("best_score") == 0
    better = F.col("best_score") > F.col("worst_score")
    branch = F.when(truth, "truth").when(better, "ranked").when(all_failed, "fallback").otherwise("tie")
    use_truth = F.col("branch").isin("truth", "fallback")
    return df.withColumn("branch", branch).where("branch <> 'tie'").withColumns({
        "chosen": F.when(use_truth, F.col(reference)).otherwise(F.col("best")), "rejected": F.col("worst"),
        "score_chosen": F.when(use_truth, 99).otherwise(F.col("best_score")).cast("int"), "score_rejected": F.col("worst_score").cast("int"),
    })


def newest(df: DataFrame, step: str, most: int) -> DataFrame:
    """The rows with the largest steps."""
    return df.orderBy(F.desc(step)).limit(most)


def _sizes(before: str, after: str) -> list[Column]:
    return [F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("long").alias(n) for c, n in ((before, "chars_before"), (after, "chars_after"))]


def _with_saved(sizes: DataFrame) -> DataFrame:
    return sizes.withColumn("saved_pct", F.lit(100.0) - rate(F.col("chars_after"), F.col("chars_before")))


def size_report(df: DataFrame, before: str, after: str) -> DataFrame:
    """Total lengths and the share saved, in percent."""
    return _with_saved(df.agg(*_sizes(before, after)))


def sizes_observed(df: DataFrame, before: str, after: str) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(df, report): df, and size_report() of it, from what its first action saw."""
    seen = Observation()
    report = lambda: _with_saved(df.sparkSession.createDataFrame([tuple(seen.get.get(n, 0) for n in ("chars_before", "chars_after"))], "chars_before long, chars_after long"))
    return df.observe(seen, *_sizes(before, after)), report


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: the mean by weight; weights of 0 count as 1 in all."""
    return F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))


def typed_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows; columns go by name and must be the same, or AnalysisException."""
    for o in others:
        first = first.unionByName(o)
    return first


def by_value(counts: Mapping[str, int]) -> dict[str, int]:
    """Counts with the largest first."""
    return dict(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])))
