"""What each of several filters removes in every order of applying them: a permutation trie, run depth first.

A node of the trie is the set of filters applied so far, for their order doesn't change what survives; sets that
several orders share are run once. Each node's survivors are a persisted DataFrame, made from its parent's by one more
filter; in one pass over them the rows that each further filter removes are counted. Depth first, only the
survivors along one path are held at a time, and what a lost executor held is made again from the table of verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.binding import let
from quern.llm.common import SPACES, shared_dir, table, through_table

_COUNTS = ("n", "removed", "good_lost", "toxic_lost")


def trie_edges(rows: DataFrame, filters: Sequence[str], part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """(part, state, filter, n, removed, good_lost, toxic_lost): for each set of filters applied (a bit for each) and each further one how many rows the part has before, and what it then removes.

    rows has a boolean column for each filter, true where a row fails it; null is no failure. Sets that leave a part
    nothing have no row. Counts are written to the shared folder, a small table for each set.
    """
    path = shared_dir(rows.sparkSession, "edges")
    fails = {f: F.coalesce(F.col(f), F.lit(False)) for f in filters}
    done: set[int] = set()

    def visit(state: int, alive: DataFrame) -> None:
        done.add(state)
        left = [(i, f) for i, f in enumerate(filters) if not state >> i & 1]
        if not left:
            return
        alive = alive.persist(StorageLevel.MEMORY_AND_DISK)
        each = [F.struct(F.lit(f).alias("filter"), F.count_if(fails[f]).alias("removed"), F.count_if(fails[f] & F.col(good)).alias("good_lost"), F.count_if(fails[f] & F.col(toxic)).alias("toxic_lost")) for _, f in left]
        counted = alive.groupBy(part).agg(F.count("*").alias("n"), F.array(*each).alias("_e"))
        counted.select(F.col(part).alias("part"), F.lit(state).alias("state"), "n", F.explode("_e").alias("_e")).select("part", "state", "_e.filter", "n", "_e.removed", "_e.good_lost", "_e.toxic_lost").write.mode("append").parquet(path)
        for i, f in left:
            if state | 1 << i not in done:
                visit(state | 1 << i, alive.where(~fails[f]))
        alive.unpersist()

    visit(0, rows)
    return rows.sparkSession.read.schema("part string, state int, filter string, n long, removed long, good_lost long, toxic_lost long").parquet(path)


def audited(edges: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    filter_order joins the filters' names. redundant rows fail the step's filter but were removed before, unique_fails fail it alone;
    shapley is what the filter removes, summed over all orders. Orders are listed, so there are at most six filters.
    """
    k = len(filters)
    if k > 6:
        raise ValueError(f"{k} filters have too many orders; at most 6")
    bit = {f: 1 << i for i, f in enumerate(filters)}
    steps = [("".join(p), i + 1, sum(bit[f] for f in p[:i]), p[i]) for p in permutations(filters) for i in range(k)]
    listed = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"f":"{f}"}}' for o, s, b, f in steps) + "]"), "array<struct<o:string,s:int,b:int,f:string>>")
    orders = F.element_at(F.array(*[F.lit(math.factorial(i) * math.factorial(max(k - 1 - i, 0))).cast("long") for i in range(k)]), F.bit_count("state").cast("int") + 1)
    alone = F.element_at(F.create_map(*[x for f in filters for x in (F.lit(f), F.lit((1 << k) - 1 - bit[f]))]), F.col("filter"))
    sums = edges.groupBy("part", "filter").agg(F.sum(F.when(F.col("state") == 0, F.col("removed")).otherwise(0)).alias("_fails"), F.sum(F.when(F.col("state") == alone, F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * orders).alias("shapley"))
    rows = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("filter", F.struct("_fails", "unique_fails", "shapley")))).alias("_sums"))  # a row for each filter
    rows = rows.select("part", "_sums", F.explode(listed).alias("x")).select("part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), F.col("x.b").alias("state"), F.col("x.f").alias("filter"), F.element_at("_sums", F.col("x.f")).alias("_t"))
    told = rows.join(edges, ["part", "state", "filter"], "left").na.fill(0, list(_COUNTS))
    return told.select("part", "filter_order", "step", "filter", (F.col("n") - F.col("removed")).alias("kept"), "removed", (F.col("_t._fails") - F.col("removed")).alias("redundant"), F.col("_t.unique_fails").alias("unique_fails"), "good_lost", "toxic_lost", F.col("_t.shapley").alias("shapley"))


#: The filters of op12, by name.
FILTERS = ("A", "B", "C", "D", "E")


def verdicts(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(part, good, toxic, A, B, C, D, E): whether each document fails each of five filters; written to the shared folder.

    A: under 200 words. B: fewer distinct words than half. C: over 3 % of the characters are A-Z. D: one of #$%&*|. E: a document with a
    smaller id has the same text; texts are told apart by SHA-256. Null text is empty, null lang an empty part; a null id
    is neither smaller nor larger than another, and has no label. Rows that repeat are rows of their own; where labels repeat, any counts.
    Texts are read once, into a row of flags; then a table of texts that stand twice or more is joined to those rows.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(t, SPACES), lambda x: x != "")
    few = let(words, lambda w: F.struct((F.size(w) < 200).alias("A"), (100 * F.size(F.array_distinct(w)).cast("long") < 50 * F.size(w).cast("long")).alias("B")))
    capitals = 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") > 3 * F.length(t).cast("long")
    measured = docs.select(F.col(f"`{key}`").alias("_id"), F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("part"), few.alias("_w"), capitals.alias("C"), F.regexp_like(t, F.lit("[#$%&*|]")).alias("D"), F.unhex(F.sha2(t, 256)).alias("_h"))
    measured = through_table(measured.select("_id", "part", "_w.A", "_w.B", "C", "D", "_h"), "measured")
    twice = through_table(measured.groupBy("_h").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "copied")
    marked = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    rows = measured.join(twice, "_h", "left").join(marked, "_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return through_table(rows.select("part", flag(F.col("good")).alias("good"), flag(F.col("toxic")).alias("toxic"), "A", "B", "C", "D", flag(F.col("_id") > F.col("_first")).alias("E")), "verdicts")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each language, order of the five filters and step."""
    rows = verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audited(trie_edges(rows, FILTERS), FILTERS).drop("filter")


_WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, len({_WORDS}) AS n, list_unique({_WORDS}) AS u, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
  l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
  v AS (SELECT w.part, coalesce(quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad, unnest([{{'f': 'A', 'x': n < 200}}, {{'f': 'B', 'x': 100 * u < 50 * n}}, {{'f': 'C', 'x': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)}}, {{'f': 'D', 'x': regexp_matches(t, '[#$%&*|]')}}, {{'f': 'E', 'x': coalesce(doc_id > first, false)}}]) AS e, row_number() OVER () AS id FROM w LEFT JOIN l USING (doc_id)),
  m AS (SELECT id, part, good, bad, coalesce(string_agg(e.f, '' ORDER BY e.f) FILTER (WHERE e.x), '') AS fails FROM v GROUP BY ALL),
  g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM m GROUP BY ALL),
  f(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
  o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON a.f <> b.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
  s AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
  r AS (SELECT part, filter_order, step, filter_order[step] AS f,
    sum(CASE WHEN translate(fails, filter_order[1:step], '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, filter_order[step]) AND translate(fails, filter_order[1:step - 1], '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, filter_order[step]) THEN n ELSE 0 END) AS fails_it, sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, filter_order[step]) AND translate(fails, filter_order[1:step - 1], '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, filter_order[step]) AND translate(fails, filter_order[1:step - 1], '') = fails THEN bad ELSE 0 END) AS toxic_lost FROM g, s GROUP BY ALL)
  SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, (fails_it - removed)::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
