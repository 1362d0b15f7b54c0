"""Registered queries over the driver tables and their SQL twins.

documents plays the fact table (lang its technique, source its split), labels its metadata,
conversations predictions and references, events counters and payloads, and lineitem and
orders volume. Queries read their tables whole. Those named _whole score whole texts, which beside
them are scored in ASCII, for SQL counts bytes there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import arrays, asm, metrics, rewrites, text
from quern.operators import batching, curate, external, nested, routing
from quern.sources import places, scans, sinks
from quern.sources.shipping import ship
from quern.streaming import increments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of table(name) -> DataFrame under its own name."""

    def wrap(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


# --- evaluation -------------------------------------------------------------

_TURNS = """WITH p AS (SELECT a.conv_id, a.turn, regexp_replace(a.text, '[^\\x00-\\x7F]', '', 'g') AS prediction, regexp_replace(u.text, '[^\\x00-\\x7F]', '', 'g') AS reference,
  'group' || (a.conv_id % 3) AS technique FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user')"""


def _whole_turns(t) -> DataFrame:
    """Assistant turns as predictions of the user turns before them."""
    a = t("conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"))
    u = t("conversations").where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return a.join(u, ["conv_id", "turn"]).withColumn("technique", F.concat(F.lit("group"), (F.col("conv_id") % 3).cast("string")))


def _turns(t) -> DataFrame:
    """The same in ASCII, for the engines differ in what a character is; queries named _whole score the whole texts."""
    fold = lambda c: F.regexp_replace(c, "[^\\x00-\\x7F]", "")
    return _whole_turns(t).withColumns({c: fold(c) for c in ("prediction", "reference")})


def _report(turns: DataFrame) -> DataFrame:
    pairs = turns.where(F.length(F.coalesce("reference", F.lit(""))) > 0)
    scored = pairs.withColumns({"d": metrics.ned(F.col("prediction"), F.col("reference")), "e": metrics.exact(F.col("prediction"), F.col("reference"))})
    return curate.overall(scored, [F.count("*").alias("n"), F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 6).alias("ned"), F.round(F.coalesce(F.avg("e"), F.lit(0.0)), 6).alias("exact_match")], "technique")


@query(_TURNS + """ SELECT coalesce(technique, 'ALL') AS technique, count(*) AS n,
  round(coalesce(avg(levenshtein(prediction, reference) / greatest(length(prediction), length(reference), 1)) FILTER (WHERE reference <> ''), 0), 6) AS ned,
  round(coalesce(avg(CASE WHEN regexp_replace(prediction, '^\\s+|\\s+$', '', 'g') = regexp_replace(reference, '^\\s+|\\s+$', '', 'g') THEN 100.0::DOUBLE ELSE 0 END), 0), 6) AS exact_match
  FROM p WHERE length(reference) > 0 GROUP BY GROUPING SETS ((), (technique))""")
def eval_report_grouped(t):
    return _report(_turns(t))


@query()
def eval_report_whole(t):
    return _report(_whole_turns(t))


_GRAMS = " UNION ALL ".join(f"SELECT conv_id, turn, technique, {n} AS n, side, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS i FROM w)" for n in range(1, 5))


def _text_of(c):
    """An array as text; engines print arrays in ways of their own."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "null")


def _sql_text(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda v: coalesce(v::VARCHAR, 'null')), ',')"


def _once(df: DataFrame, name: str) -> DataFrame:
    """df with the named column worked out once for a row: a generator isn't merged with what reads it."""
    return df.withColumn(name, F.explode(F.array(name)))


def _bleu(turns: DataFrame) -> DataFrame:
    parts = turns.withColumn("parts", metrics.bleu_parts(F.col("prediction"), F.col("reference")))
    return curate.overall(_once(parts.select("technique", "parts"), "parts"), [F.round(metrics.bleu_score(F.col("parts")), 6).alias("bleu")], "technique")


def _sql_13a(c: str) -> str:
    """The words of metrics.words_13a, for text in ASCII."""
    c = f"regexp_replace({c}, '\\s+$', '')"
    for at, (old, new) in enumerate(metrics.TOKENS_13A):
        c = f"(' ' || {c} || ' ')" if at == 7 else c
        c = f"regexp_replace({c}, '{old}', '{new.replace('$', chr(92))}', 'g')"
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


@query(_TURNS + f""", w AS (SELECT conv_id, turn, technique, 'p' AS side, {_sql_13a('prediction')} AS w FROM p
  UNION ALL SELECT conv_id, turn, technique, 'r', {_sql_13a('reference')} FROM p),
  g AS ({_GRAMS}),
  c AS (SELECT technique, n, count(*) FILTER (WHERE side = 'p') AS a, count(*) FILTER (WHERE side = 'r') AS b FROM g GROUP BY conv_id, turn, technique, n, gram),
  m AS (SELECT coalesce(technique, 'ALL') AS technique, n, sum(least(a, b)) AS hit, sum(a) AS total FROM c GROUP BY GROUPING SETS ((n), (technique, n))),
  h AS (SELECT *, CASE WHEN hit > 0 THEN hit ELSE pow(0.5, count(*) FILTER (WHERE hit = 0) OVER (PARTITION BY technique ORDER BY n)) END AS smooth FROM m),
  l AS (SELECT coalesce(technique, 'ALL') AS technique, sum(len(w)) FILTER (WHERE side = 'p') AS s, sum(len(w)) FILTER (WHERE side = 'r') AS r FROM w GROUP BY GROUPING SETS ((), (technique)))
  SELECT technique, round(CASE WHEN max(hit) FILTER (WHERE n = 1) = 0 OR max(total) FILTER (WHERE n = 4) = 0 THEN 0 ELSE 100 * (CASE WHEN any_value(s) >= any_value(r) THEN 1 ELSE exp(1 - any_value(r) / any_value(s)) END) * exp(sum(ln(smooth / total)) / 4) END, 6) AS bleu
  FROM h JOIN l USING (technique) GROUP BY technique""")
def eval_bleu_grouped(t):
    return _bleu(_turns(t))


@query()
def eval_bleu_whole(t):
    return _bleu(_whole_turns(t))


def _compared(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.levenshtein("prediction", "reference").cast("long").alias("chars"), (F.col("prediction") == F.col("reference")).alias("same"), F.size(text.tokens(F.col("prediction"))).alias("n_tokens"))


@query(_TURNS + """ SELECT conv_id, turn, levenshtein(prediction, reference) AS chars, (prediction = reference) AS same, len(list_filter(string_split_regex(prediction, '\\s+'), lambda x: x <> ''))::INTEGER AS n_tokens FROM p""")
def pair_metrics(t):
    return _compared(_turns(t))


@query()
def pair_metrics_whole(t):
    return _compared(_whole_turns(t))


@query()
def token_distance(t):
    return _whole_turns(t).select("conv_id", "turn", metrics.token_distance(F.col("prediction"), F.col("reference")).alias("edits"))


# --- enrichment -------------------------------------------------------------


@query("SELECT d.doc_id, d.lang, d.source, coalesce(l.quality::VARCHAR, '') AS quality, coalesce(l.toxic::VARCHAR, '') AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def augment_left_join(t):
    return curate.enriched(t("documents").select("doc_id", "lang", "source"), t("labels"), ["doc_id"], ["quality", "toxic"])


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def augment_semi_keys(t):
    return curate.reduced(t("documents").select("doc_id", "source", "lang"), t("labels"), "doc_id")


@query("SELECT DISTINCT source AS exebench_split, lang AS fname FROM documents WHERE coalesce(source, '') <> '' AND coalesce(lang, '') <> ''")
def needed_keys(t):
    return curate.keys_needed(t("documents").select(F.col("source").alias("exebench_split"), F.col("lang").alias("fname")), "exebench_split", "fname")


_LAST = "SELECT o_custkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 7919) % 10007 DESC, o_orderkey DESC) AS k FROM orders"


def _arriving(t, name: str) -> DataFrame:
    """Orders in files whose order isn't that of any column: (order key * 7919) % 10007."""
    place = (F.col("o_orderkey") * 7919) % 10007
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_orderkey", place.alias("_at"))
    path = places.scratch(o.sparkSession, name)
    o.repartitionByRange(5, "_at", "o_orderkey").sortWithinPartitions("_at", "o_orderkey").drop("_at").write.parquet(path)
    return o.sparkSession.read.parquet(path)


@query(f"SELECT c_custkey, coalesce(o_orderpriority, '') AS o_orderpriority, coalesce(nullif(o_orderstatus, 'P'), '') AS o_orderstatus FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) LEFT JOIN ({_LAST}) ON o_custkey = c_custkey AND k = 1")
def augment_last_wins(t):
    """The last order of a customer to arrive counts, also where its status is null; a third of the customers stand twice."""
    c = t("customer").select("c_custkey")
    return curate.enriched(c.unionByName(c.where("c_custkey % 3 = 0")), _arriving(t, "arriving"), ["c_custkey"], ["o_orderpriority", "o_orderstatus"])


@query(f"SELECT c_custkey, c_mktsegment, coalesce(o_orderpriority, '') AS o_orderpriority, coalesce(nullif(o_orderstatus, 'P'), '') AS o_orderstatus FROM customer LEFT JOIN ({_LAST}) ON o_custkey = c_custkey AND k = 1")
def augment_bucketed(t):
    """The same over tables bucketed by the key, which are joined again and again without a shuffle; their arrival is a column."""
    side = curate.in_arrival(_arriving(t, "arriving"))
    spark, n = side.sparkSession, 8
    tables = {}
    for name, df in (("customers", t("customer").select("c_custkey", "c_mktsegment")), ("orders", side)):
        path = places.scratch(spark, name)
        table = "quern_" + path.rpartition("/")[2].replace("-", "_")
        sinks.write_bucketed(df, table, path, ["c_custkey"], n)
        tables[name] = scans.bucketed(spark, table, path, "", ["c_custkey"], n)
    return curate.enriched(tables["customers"], tables["orders"], ["c_custkey"], ["o_orderpriority", "o_orderstatus"])


@query("SELECT source, doc_id, 'chunk' || (doc_id % 2) AS part FROM documents UNION ALL SELECT 'labels', doc_id, 'labels' FROM labels")
def union_shards(t):
    d = t("documents").select("source", "doc_id", F.concat(F.lit("chunk"), (F.col("doc_id") % 2).cast("string")).alias("part"))
    return curate.typed_union(d, t("labels").select("doc_id", F.lit("labels").alias("part"), F.lit("labels").alias("source")))


# --- splits, shards, slices -------------------------------------------------

_SPLIT = """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
  s AS (SELECT doc_id, lang, CASE WHEN k <= greatest(1, floor(n * 0.1)) THEN 'test' ELSE 'train' END AS split FROM r)"""


@query(_SPLIT + " SELECT * FROM s")
def stratified_split(t):
    return curate.stratified(t("documents").select("doc_id", "lang"), "lang", "doc_id", 0.1).select("doc_id", "lang", "split")


@query(_SPLIT + " SELECT split, lang, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM s GROUP BY split, lang")
def split_histogram(t):
    s = curate.stratified(t("documents").select("doc_id", "lang"), "lang", "doc_id", 0.1)
    return curate.shares(s, "split", "lang").withColumn("pct", F.round("pct", 6))


@query("""WITH u AS (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('42:' || l_orderkey), l_orderkey) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM u)
  SELECT l_returnflag, CASE WHEN k <= greatest(1, floor(n * 0.05)) THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT l_orderkey) AS n_groups FROM lineitem JOIN r USING (l_returnflag, l_orderkey) GROUP BY 1, 2""")
def group_safe_split(t):
    s = curate.stratified(t("lineitem").select("l_returnflag", "l_orderkey"), "l_returnflag", "l_orderkey", 0.05, group="l_orderkey")
    return s.groupBy("l_returnflag", "split").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_groups"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 5000)::BIGINT AS shard_id FROM orders")
def shard_assign(t):
    return curate.sharded(t("orders").select("o_orderkey"), "o_orderkey", 5000)


@query("WITH s AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 4000 AS k FROM orders) SELECT k::BIGINT AS shard_id, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM s GROUP BY k")
def shard_compaction(t):
    return curate.sharded(t("orders").select("o_orderkey"), "o_orderkey", 4000).groupBy("shard_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 300 OFFSET 500")
def chunk_slice(t):
    """From shards in the order of the key, by the index of their rows."""
    df = t("orders").select("o_orderkey", "o_custkey")
    path = places.scratch(df.sparkSession, "ordered")
    df.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return scans.chunk(df.sparkSession, path, 500, 300)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 300 OFFSET 500")
def chunk_by_key(t):
    return curate.chunk(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 300)


@query("SELECT doc_id, (row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id))::BIGINT AS place FROM documents")
def seeded_shuffle(t):
    return curate.shuffled(t("documents").select("doc_id"), "doc_id", 7).select("doc_id", F.col("place").cast("long").alias("place"))


@query("SELECT event_id, event_type FROM events WHERE value IS NOT NULL ORDER BY event_id DESC LIMIT 10")
def newest_rows(t):
    return curate.newest(t("events").where("value is not null").select("event_id", "event_type"), "event_id", 10)


# --- filters with reasons ---------------------------------------------------

_REASON = """CASE WHEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') = '' THEN 'missing' WHEN length(text) < 20 THEN 'too_short' WHEN length(text) > 8000 THEN 'too_long'
  WHEN length(text) - length(replace(text, chr(10), '')) + 1 > 60 THEN 'too_many_lines' WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 1024 THEN 'too_many_tokens' ELSE 'kept' END"""


def _reasons(t) -> DataFrame:
    d = t("documents")
    return curate.with_reason(d, [
        ("missing", text.clean_string(F.col("text")).isNull()), ("too_short", F.length("text") < 20), ("too_long", F.length("text") > 8000),
        ("too_many_lines", F.regexp_count("text", F.lit("\n")) + 1 > 60), ("too_many_tokens", F.size(text.tokens(F.col("text"))) > 1024),
    ])


@query(f"SELECT {_REASON} AS skip_reason, count(*) AS n FROM documents GROUP BY 1")
def skip_reason_counts(t):
    return curate.reason_counts(_reasons(t))


@query(f"SELECT doc_id, technique FROM (SELECT doc_id, {_REASON} AS r FROM documents), (VALUES ('Flatten'), ('EncodeArithmetic'), ('Flatten+EncodeArithmetic')) v(technique) WHERE r = 'kept'")
def transform_fanout(t):
    return curate.fanned_out(_reasons(t).where("skip_reason is null").select("doc_id"))


@query("SELECT lang, count(*) AS seen, count(*) FILTER (WHERE lang = 'en') AS evaluated FROM documents GROUP BY lang")
def category_filter(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("seen"), F.count_if(F.col("lang") == "en").alias("evaluated"))


@query("WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE length(text) >= 100), s AS (SELECT min(doc_id) AS stop FROM k WHERE rn > 50) SELECT least(50, (SELECT count(*) FROM k)) AS evaluated, (SELECT count(*) FROM documents WHERE stop IS NULL OR doc_id <= stop) AS seen FROM s")
def sample_stop(t):
    d = t("documents").select("doc_id", (F.length("text") >= 100).alias("fit"))
    return curate.overall_first(d, "doc_id", F.col("fit"), 50)


# --- statistics -------------------------------------------------------------


@query("""SELECT 'samples_per_transform.' || event_type AS name, count(*)::BIGINT AS total FROM events GROUP BY event_type
  UNION ALL SELECT 'rows_seen', count(*) FROM events UNION ALL SELECT 'failures', count(*) FILTER (WHERE value < 10) FROM events""")
def merge_chunk_stats(t):
    e = t("events").withColumn("chunk", F.col("event_id") % 7)
    maps = e.groupBy("chunk", "event_type").count().groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("samples_per_transform"))
    parts = e.groupBy("chunk").agg(F.count("*").alias("rows_seen"), F.count_if(F.col("value") < 10).alias("failures")).join(maps, "chunk")
    return curate.merged_stats(parts.select(F.struct("rows_seen", "failures", "samples_per_transform").alias("generation_stats")))


_CHECKS = """WITH c AS (SELECT event_id, event_type, user_id, event_id % 10 < 8 AS syntax_valid, event_id % 10 < 5 AS compiles, event_id % 10 < 2 AS links,
  CASE WHEN event_id % 10 < 2 THEN event_id % 4 <> 1 END AS functional_pass, (event_id % 6)::INTEGER AS io_pass_count, 5 AS io_total_count FROM events)"""
_SUMS = """count(*) AS total, count(*) FILTER (WHERE syntax_valid) AS syntax_valid, count(*) FILTER (WHERE compiles) AS compiles, count(*) FILTER (WHERE links) AS links,
  count(functional_pass) AS functional_tested, count(*) FILTER (WHERE functional_pass) AS functional_pass,
  coalesce(sum(io_pass_count) FILTER (WHERE functional_pass IS NOT NULL), 0)::BIGINT AS io_pass_total, coalesce(sum(io_total_count) FILTER (WHERE functional_pass IS NOT NULL), 0)::BIGINT AS io_tested_total"""
_RATES = ", ".join(f"round(100 * {a} / greatest({b}, 1), 6) AS {n}" for a, b, n in (("syntax_valid", "total", "syntax_valid_pct"), ("compiles", "total", "compiles_pct"), ("links", "total", "links_pct"), ("functional_pass", "functional_tested", "functional_pass_pct"), ("io_pass_total", "io_tested_total", "io_pass_pct")))


def _checks(t) -> DataFrame:
    k = F.col("event_id") % 10
    return t("events").select("event_id", "event_type", "user_id", (k < 8).alias("syntax_valid"), (k < 5).alias("compiles"), (k < 2).alias("links"), F.when(k < 2, F.col("event_id") % 4 != 1).alias("functional_pass"), (F.col("event_id") % 6).cast("int").alias("io_pass_count"), F.lit(5).alias("io_total_count"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("_pct")})


@query(_CHECKS + f", s AS (SELECT {_SUMS} FROM c) SELECT *, {_RATES} FROM s")
def check_stats(t):
    return _rounded(curate.check_stats(_checks(t)))


@query(_CHECKS + f", s AS (SELECT coalesce(event_type, 'ALL') AS event_type, {_SUMS} FROM c GROUP BY GROUPING SETS ((), (event_type))) SELECT *, {_RATES} FROM s")
def check_stats_by_group(t):
    return _rounded(curate.check_stats(_checks(t), "event_type"))


@query(_CHECKS + " SELECT event_id AS seq, CASE WHEN NOT syntax_valid THEN 'syntax' ELSE 'compile' END AS level, CASE WHEN NOT syntax_valid THEN 's' ELSE 'c' END || user_id AS error FROM c WHERE NOT syntax_valid OR NOT compiles ORDER BY event_id LIMIT 20")
def first_errors(t):
    user = F.col("user_id").cast("string")
    return curate.first_errors(_checks(t).withColumns({"syntax_error": F.concat(F.lit("s"), user), "compile_error": F.concat(F.lit("c"), user)}), "event_id")


@query(_CHECKS + " SELECT round(100 * avg(syntax_valid::INTEGER), 6) AS syntax_pct, round(100 * avg(compiles::INTEGER), 6) AS compile_pct FROM c")
def validity_rates(t):
    return _checks(t).agg(F.round(100 * F.avg(F.col("syntax_valid").cast("int")), 6).alias("syntax_pct"), F.round(100 * F.avg(F.col("compiles").cast("int")), 6).alias("compile_pct"))


@query(f"SELECT user_id % 50 AS seed, count(*) AS n, {_sql_text('list_sort(list(event_id))')} AS ids FROM events GROUP BY 1")
def group_by_seed(t):
    return curate.grouped_lists(t("events"), F.col("user_id") % 50, "event_id").withColumn("ids", _text_of(F.col("ids")))


@query("SELECT round(sum(value * (event_id % 5)) / greatest(sum(event_id % 5), 1), 6) AS mean_loss, count(*) AS n FROM events")
def weighted_loss(t):
    return t("events").withColumn("w", F.col("event_id") % 5).agg(F.round(curate.weighted_mean("value", "w"), 6).alias("mean_loss"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(count(*) / (date_diff('second', min(ts), max(ts)) + 1), 9) AS per_second FROM events GROUP BY 1")
def throughput_metrics(t):
    span = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp")) + 1
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.count("*") / span, 9).alias("per_second"))


@query("SELECT sum(length(text))::BIGINT AS chars_before, sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')))::BIGINT AS chars_after, round(100.0 - 100 * sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) / greatest(sum(length(text)), 1), 6) AS saved_pct FROM documents")
def size_report(t):
    return _rounded(curate.size_report(t("documents").select("text", text.stripped(F.col("text")).alias("clean")), "text", "clean"))


_STREAKS = "WITH r AS (SELECT event_id, user_id, value < 30 AS bad FROM events), i AS (SELECT *, sum((NOT bad)::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM r), k AS (SELECT *, sum(bad::INTEGER) OVER (PARTITION BY user_id, g ORDER BY event_id) AS run FROM i) SELECT user_id, min(event_id) AS stop_at FROM k WHERE run >= 3 GROUP BY 1"


@query(_STREAKS)
def fail_streak_stop(t):
    return curate.fail_streak_stop(t("events"), "event_id", F.col("value") < 30, 3, group="user_id")


# --- preference selection ---------------------------------------------------

_CANDIDATES = "WITH c AS (SELECT conv_id, turn, text, CASE WHEN length(text) % 3 = 0 THEN 0 WHEN length(text) % 2 = 0 THEN 1 ELSE 2 END AS score FROM conversations), b AS (SELECT conv_id, arg_max(text, score * 1000000 - turn) AS best, max(score) AS best_score, arg_min(text, score * 1000000 - turn) AS worst, min(score) AS worst_score FROM c GROUP BY 1)"


def _ranked(t) -> DataFrame:
    n = F.length("text")
    scored = t("conversations").withColumn("score", metrics.candidate_score(n % 3 != 0, n % 2 != 0))
    return curate.best_worst(scored, "conv_id", "score", "turn", "text")


@query(_CANDIDATES + " SELECT conv_id, CASE WHEN best_score > worst_score THEN best ELSE 'truth' END AS chosen, worst AS rejected, CASE WHEN best_score > worst_score THEN best_score ELSE 99 END AS score_chosen, worst_score AS score_rejected, CASE WHEN best_score > worst_score THEN 'ranked' ELSE 'fallback' END AS branch FROM b WHERE best_score > worst_score OR best_score = 0")
def preference_pairs(t):
    return curate.preferences(_ranked(t).withColumn("truth", F.lit("truth")), "truth").select("conv_id", "chosen", "rejected", "score_chosen", "score_rejected", "branch")


@query(_CANDIDATES + " SELECT best_score, count(*) AS n FROM b GROUP BY 1")
def score_hist(t):
    return _ranked(t).groupBy("best_score").agg(F.count("*").alias("n"))


_LOSS = "WITH v AS (SELECT event_type, -value / 10 AS pc, -value / 8 AS pr, -value / 9 - (event_id % 7) / 10 AS rc, -value / 9 AS rr FROM events), z AS (SELECT *, 0.1 * ((pc - rc) - (pr - rr)) AS z FROM v)"


@query(_LOSS + " SELECT event_type, round(avg(ln(1 + exp(-z)) - 0.1 * pc), 6) AS sigmoid, round(avg(pow(z - 5, 2) - 0.1 * pc), 6) AS ipo, round(avg(0.1 * (pc - rc)), 6) AS chosen_reward, round(100 * avg((pc - rc > pr - rr)::INTEGER), 6) AS accuracy FROM z GROUP BY 1")
def pref_loss(t):
    v = F.col("value")
    d = t("events").select("event_type", (-v / 10).alias("pc"), (-v / 8).alias("pr"), (-v / 9 - (F.col("event_id") % 7) / 10).alias("rc"), (-v / 9).alias("rr"))
    own = [F.col(c) for c in ("pc", "pr", "rc", "rr")]
    return d.groupBy("event_type").agg(
        F.round(F.avg(metrics.preference_loss(*own)), 6).alias("sigmoid"), F.round(F.avg(metrics.preference_loss(*own, kind="ipo")), 6).alias("ipo"),
        F.round(F.avg(0.1 * (F.col("pc") - F.col("rc"))), 6).alias("chosen_reward"), F.round(100 * F.avg((F.col("pc") - F.col("rc") > F.col("pr") - F.col("rr")).cast("int")), 6).alias("accuracy"),
    )


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN i % 3 = 1 THEN x::DOUBLE ELSE 0 END)) / 22, 6) AS logp FROM embeddings")
def masked_logps(t):
    keep = F.transform("embedding", lambda x, i: (i % 3 == 0).cast("int"))
    return t("embeddings").select("vec_id", F.round(metrics.masked_mean(F.transform("embedding", lambda x: x.cast("double")), keep), 6).alias("logp"))


# --- batching and padding ---------------------------------------------------

_TOKENS = "SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::INTEGER AS n_tokens FROM documents"


def _sized(t) -> DataFrame:
    return t("documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query(f"WITH k AS ({_TOKENS}), r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM k), b AS (SELECT *, (rn - 1) // 32 AS buf FROM r), s AS (SELECT *, row_number() OVER (PARTITION BY buf ORDER BY n_tokens, rn) - 1 AS p FROM b) SELECT doc_id, n_tokens, buf::BIGINT AS buf, (buf * 4 + p // 8)::BIGINT AS batch_id, (p % 8)::BIGINT AS slot FROM s")
def length_buckets(t):
    return batching.length_batches(_sized(t), "doc_id", "n_tokens", 8).select("doc_id", "n_tokens", "buf", "batch_id", F.col("slot").cast("long").alias("slot"))


_VECTORS = "SELECT vec_id, vec_id // 8 AS batch, list_transform(embedding[1:(vec_id % 9) + 1], lambda x: (floor(abs(x) * 100) + 2)::INTEGER) AS ids, list_transform(embedding[1:(vec_id % 5) + 2], lambda x: (floor(abs(x) * 50) + 3)::INTEGER) AS labels FROM embeddings"


def _vectors(t) -> DataFrame:
    cut = lambda n, k, plus: F.transform(F.slice("embedding", F.lit(1), (F.col("vec_id") % n + k).cast("int")), lambda x: (F.floor(F.abs(x) * plus[0]) + plus[1]).cast("int"))
    return t("embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("batch"), cut(9, 1, (100, 2)).alias("ids"), cut(5, 2, (50, 3)).alias("labels"))


_PADDED = "list_concat(ids, list_transform(range(mi - len(ids)), lambda x: 1))"
_MASK = "list_concat(list_transform(ids, lambda x: 1), list_transform(range(mi - len(ids)), lambda x: 0))"
_LABELS = "list_concat(labels, list_transform(range(ml - len(labels)), lambda x: -100))"
_DECODER = "list_concat([2], labels, list_transform(range(ml - len(labels)), lambda x: 1))[1:ml]"


@query(f"WITH v AS ({_VECTORS}), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS mi, max(len(labels)) OVER (PARTITION BY batch) AS ml FROM v) SELECT vec_id, {_sql_text(_PADDED)} AS input_ids, {_sql_text(_MASK)} AS attention_mask, {_sql_text(_LABELS)} AS labels FROM m")
def pad_batches(t):
    return batching.collated(_vectors(t), "batch", "ids", "labels").select("vec_id", *[_text_of(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query(f"WITH v AS ({_VECTORS}), m AS (SELECT *, max(len(labels)) OVER (PARTITION BY batch) AS ml FROM v WHERE vec_id % 10 <> 3) SELECT vec_id, {_sql_text(_LABELS)} AS chosen_labels, {_sql_text(_DECODER)} AS chosen_decoder_input_ids FROM m")
def preference_collate(t):
    some = lambda c: F.when(F.col("vec_id") % 10 != 3, F.col(c))
    rows = _vectors(t).select("vec_id", "batch", some("ids").alias("prompt"), some("labels").alias("chosen"), some("ids").alias("rejected"))
    return batching.preference_collated(rows, "batch").select("vec_id", *[_text_of(F.col(c)).alias(c) for c in ("chosen_labels", "chosen_decoder_input_ids")])


# --- text -------------------------------------------------------------------


def _doc(t, new) -> DataFrame:
    return t("documents").select("doc_id", new.alias("t"))


_STRUCTS = "replace(text, ' th', ' %struct.th')"


@query(f"WITH s AS (SELECT doc_id, {_STRUCTS} AS t FROM documents), m AS (SELECT *, regexp_extract_all(t, '%struct\\.[a-zA-Z0-9_]+') AS ms, string_split_regex(t, '%struct\\.[a-zA-Z0-9_]+') AS bt FROM s), n AS (SELECT *, list_filter(ms, lambda x, i: list_position(ms, x) = i) AS ns FROM m) SELECT doc_id, CASE WHEN t = '' THEN '' ELSE array_to_string(list_transform(bt, lambda b, i: b || CASE WHEN i <= len(ms) THEN '%struct.struct' || (list_position(ns, ms[i]) - 1) ELSE '' END), '') || chr(10) END AS t FROM n")
def struct_rename(t):
    return _doc(t, text.normalize_structs(F.replace(F.col("text"), F.lit(" th"), F.lit(" %struct.th"))))


def _module_column():
    return F.concat(F.lit("; ModuleID\n%struct.a = type { i32 }\ndefine i32 @f() {\n"), F.col("text"), F.lit("\n}\ndeclare void @g() #1\n!0 = !{}"))


@query("SELECT doc_id, '%struct.a = type { i32 }' || chr(10) || 'define i32 @f() {' || chr(10) || text || chr(10) || '}' AS t FROM documents")
def strip_blocks(t):
    return _doc(t, text.strip_ir_noise(_module_column()))


@query("SELECT doc_id, '; ModuleID' || chr(10) || '%struct.a = type { i32 }' || chr(10) || 'define i32 @f() {' || chr(10) || text || chr(10) || '}' AS t FROM documents")
def truncate_block(t):
    return _doc(t, text.truncate_ir(_module_column()))


def _sql_lines(c: str) -> str:
    """The lines of text.every_line."""
    ends = "\\r\\n|[\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
    return f"string_split(regexp_replace(regexp_replace({c}, '{ends}', chr(10), 'g'), '\\n\\z', ''), chr(10))"


def _sql_joined(c: str) -> str:
    return f"array_to_string({c}, chr(10))"


_MARKED = "'/* BEGIN FUNCTION-DEF f' || doc_id || ' */' || chr(10) || regexp_replace(text, '\\n$', '') || chr(10) || '/* END FUNCTION-DEF f' || doc_id || ' */'"


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN {_sql_joined(_sql_lines(_MARKED))} END AS t FROM documents")
def span_extract(t):
    d = t("documents").withColumn("name", F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    begin = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("head\n/* BEGIN FUNCTION-DEF "), F.col("name"), F.lit("1 */\n/* BEGIN FUNCTION-DEF "), F.col("name"), F.lit(" */\n"))).otherwise(F.lit(""))
    body = F.concat(begin, F.regexp_replace("text", "\\n$", ""), F.lit("\n/* END FUNCTION-DEF "), F.col("name"), F.lit(" */\ntail"))
    return d.select("doc_id", text.extract_marked(body, F.col("name")).alias("t"))


_LINES = _sql_lines("text")


@query(f"SELECT doc_id, CASE WHEN len(k) = 0 THEN '' ELSE array_to_string(k, chr(10)) || chr(10) END AS t FROM (SELECT doc_id, list_filter(list_transform({_LINES}, lambda x: regexp_replace(x, '\\s+$', '')), lambda x: x <> '') AS k FROM documents)")
def line_clean(t):
    return _doc(t, text.clean_whitespace(F.col("text")))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform({_LINES}, lambda x: regexp_replace(split_part(x, '#', 1), '\\s+$', '')), lambda x: x <> ''), chr(10)) AS t FROM documents")
def comment_strip(t):
    return _doc(t, text.strip_comments(F.col("text"), F.lit(False)))


@query(f"SELECT doc_id, {_sql_joined("list_filter(ls, lambda x: NOT regexp_matches(x, '^(" + '|'.join(text.UNWANTED_DIRECTIVES) + ")'))")} AS t FROM (SELECT doc_id, {_sql_lines("text || chr(10) || chr(9) || '.cfi_endproc'")} AS ls FROM documents)")
def directive_drop(t):
    return t("documents").select("doc_id", text.drop_directives(F.concat(F.lit("\t.file \"a.c\"\n\t.text\n"), F.col("text"), F.lit("\n\t.cfi_endproc\n.Lfunc_end0:\n\t.size f, .-f"))).alias("t"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '.global f' || chr(10) || '.type f, %function' ELSE '.globl f' || chr(10) || '.type f, @function' END || chr(10) || {_sql_joined(_sql_lines("'f:' || chr(10) || text"))} AS t FROM documents")
def header_normalize(t):
    body = F.concat(F.lit("\t.globl\tf\n\t.type\tf,@function\nf:\n"), F.col("text"))
    return _doc(t, text.normalize_header(body, F.lit("f"), F.col("doc_id") % 2 == 0))


@query("SELECT doc_id, 'int x;' || chr(10) || text AS t FROM documents")
def deps_clean(t):
    return _doc(t, text.clean_deps(F.concat(F.lit("typedef int bool;\nint x;\n# define true 1\n"), F.col("text"))))


def _sql_score(*tests: str) -> str:
    """The lines of ls that pass, summed over the tests; other than ASCII counts as letters."""
    return " + ".join(f"coalesce(list_sum(list_transform(ls, lambda x: ({test})::INTEGER)), 0)" for test in tests)


_TRIM = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(9) || 'sub' || chr(9) || 'sp, sp, #16' || chr(10) WHEN 1 THEN chr(9) || 'pushq' || chr(9) || '%rbp' || chr(10) WHEN 2 THEN '# ' ELSE chr(9) || 'ret' || chr(10) END || text AS code FROM documents),
  l AS (SELECT doc_id, list_transform({_sql_lines("code")}[1:{text.LOOKED_AT}], lambda x: regexp_replace(x, '[^\\x00-\\x7F]', 'Z', 'g')) AS ls FROM c)
  SELECT doc_id, {_sql_score(f"regexp_matches(x, '{text.AARCH64_OPS}')", f"regexp_matches(x, '{text.AARCH64_REGISTERS}')", f"starts_with({_TRIM}, '//') OR ends_with({_TRIM}, '//')")}
  > {_sql_score(f"regexp_matches(x, '{text.X86_REGISTERS}')", f"starts_with({_TRIM}, '#') AND NOT starts_with({_TRIM}, '#include')")} AS t FROM l""")
def arch_detect(t):
    k = F.col("doc_id") % 4
    code = F.concat(F.when(k == 0, "\tsub\tsp, sp, #16\n").when(k == 1, "\tpushq\t%rbp\n").when(k == 2, "# ").otherwise("\tret\n"), F.col("text"))
    return _doc(t, text.detect_aarch64(code))


_FRAMED = "string_split('.globl f' || chr(10) || 'f:' || chr(10) || chr(9) || '.cfi_startproc' || chr(10) || text || chr(10) || chr(9) || '.cfi_endproc' || chr(10) || '.size f', chr(10))"


@query(f"""WITH l AS (SELECT doc_id, {_FRAMED} AS ls FROM documents), c AS (SELECT *, 3 + list_position(list_transform(ls[4:], lambda x: regexp_matches(x, '^[ \\t\\n\\x0b\\f\\r]*\\.cfi_endproc')), true) AS stop FROM l)
  SELECT doc_id, {_sql_joined("ls[1:3]")} AS header, {_sql_joined("ls[4:stop - 1]")} AS body, {_sql_joined("ls[stop:]")} AS footer FROM c""")
def function_split(t):
    body = F.concat(F.lit(".globl f\nf:\n\t.cfi_startproc\n"), F.col("text"), F.lit("\n\t.cfi_endproc\n.size f"))
    s = t("documents").select("doc_id", text.split_function(body).alias("s"))
    return s.select("doc_id", *[text.joined(F.col(f"s.{c}")).alias(c) for c in ("header", "body", "footer")])


@query("""WITH l AS (SELECT doc_id, list_transform(""" + _LINES + """, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ls FROM documents), k AS (SELECT doc_id, list_filter(ls, lambda x: NOT regexp_matches(x, '^(;|source_filename|target datalayout|target triple|attributes|!)')) AS ls FROM l)
  SELECT doc_id, array_to_string(list_filter(list_transform(ls, lambda x: regexp_replace(regexp_replace(regexp_replace(x, ',?\\s*![a-zA-Z0-9]+(\\s+![0-9]+)?', '', 'g'), '#[0-9]+', '', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS t FROM k""")
def ir_normalize(t):
    return _doc(t, text.normalize_ir(F.col("text")))


@query(f"SELECT doc_id, {_sql_text("list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')")} AS tokens FROM documents")
def whitespace_tokens(t):
    return t("documents").select("doc_id", _text_of(text.tokens(F.col("text"))).alias("tokens"))


def _sql_replaced(c: str, pairs) -> str:
    for old, new in pairs:
        shown = "".join({"\n": "' || chr(10) || '", "\t": "' || chr(9) || '"}.get(x, x) for x in new)
        c = f"replace({c}, '{old}', '{shown}')"
    return c


_MARK = "'# (/\\w+)*', '', 'g'"


@query(f"""SELECT doc_id, replace(regexp_replace({_sql_replaced(f"regexp_replace({_sql_replaced("'<s>a<eol> b<tab> return x 0x 1' || text || '</s><pad><mask:0> # /a inline'", text.DECODED)}, {_MARK})", text.DECODED_AFTER)}, {_MARK}), '__attribute__((used))', '') AS t FROM documents""")
def detokenize_clean(t):
    return _doc(t, text.detokenized(F.concat(F.lit("<s>a<eol> b<tab> return x 0x 1"), F.col("text"), F.lit("</s><pad><mask:0> # /a inline"))))


_MODULE = "'; ModuleID' || chr(10) || '%struct.a = type { i32 }' || chr(10) || 'define i32 @f() {' || chr(10) || text || chr(10) || '}' || chr(10) || 'declare void @g() #1' || chr(10) || 'attributes #1 = {}' || chr(10) || '!0 = !{}'"


@query(f"""SELECT doc_id, regexp_replace(regexp_replace({_sql_joined(f"list_filter({_sql_lines(_MODULE)}, lambda x: x <> '' AND NOT regexp_matches(x, '{text.NO_CODE}'))")}, '#\\S+', '', 'g'), ',?\\s*![a-zA-Z0-9]+', '', 'g') AS t FROM documents""")
def module_filter(t):
    body = F.concat(F.lit("; ModuleID\n%struct.a = type { i32 }\ndefine i32 @f() {\n"), F.col("text"), F.lit("\n}\ndeclare void @g() #1\nattributes #1 = {}\n!0 = !{}"))
    return _doc(t, text.filtered_module(body))


_DEFINITION = "regexp_replace(regexp_replace('static inline ' || text, '__attribute__\\s*\\(\\s*\\(\\s*used\\s*\\)\\s*\\)\\s*', '', 'g'), '\\bstatic\\s+inline\\b', '', 'g')"


@query(f"SELECT doc_id, '{text.DEPS_BEGIN}' || chr(10) || 'int q;' || chr(10) || '{text.DEPS_END}' || chr(10) || chr(10) || {_DEFINITION} || CASE WHEN regexp_matches(text, '\\b(int|void)\\s+main\\s*\\(') THEN '' ELSE chr(10) || chr(10) || '{text.EMPTY_MAIN}' END AS t FROM documents")
def translation_units(t):
    unit = text.translation_unit(F.concat(F.lit("static inline "), F.col("text")), F.lit("typedef int bool;\nint q;"))
    return _doc(t, F.regexp_replace(unit, "(?s)\\A.*?(?=/\\* --- )", ""))


@query("SELECT doc_id, 'f' || regexp_extract(text, '[A-Za-z]+') AS t FROM documents")
def head_names(t):
    """Names of functions that are called after the first letters of the texts, from their heads."""
    return _doc(t, text.name_from_head(F.concat(F.lit("static int *f"), F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("(int a)"))))


@query("SELECT page_id, len(regexp_extract_all(html, '<a[ >]')) AS n_links, length(html) AS n FROM pages")
def page_symbols(t):
    return t("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(<a[ >])"))).cast("long").alias("n_links"), F.length("html").cast("long").alias("n"))


# --- nested values ----------------------------------------------------------

def _arrays(t) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_linestatus", "l_partkey")))
    g = t("lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    return g.select("l_orderkey", F.transform("r", lambda x: F.concat(x["l_linestatus"], (x["l_partkey"] % 3).cast("string"))).alias("target"), F.transform("r", lambda x: F.when(x["l_partkey"] % 5 != 0, x["l_partkey"].cast("string"))).alias("code"))


_ARRAYS = "WITH a AS (SELECT l_orderkey, list(l_linestatus || (l_partkey % 3) ORDER BY l_linenumber, l_linestatus, l_partkey) AS target, list(CASE WHEN l_partkey % 5 <> 0 THEN l_partkey::VARCHAR END ORDER BY l_linenumber, l_linestatus, l_partkey) AS code FROM lineitem GROUP BY 1)"


@query(_ARRAYS + " SELECT l_orderkey, code[list_position(target, 'F1')] AS code, coalesce(code[list_position(target, 'O2')], 'none') AS fallback FROM a")
def array_lookup(t):
    keys, values = F.col("target"), F.col("code")
    return _arrays(t).select("l_orderkey", arrays.lookup(keys, values, F.lit("F1")).alias("code"), arrays.lookup_or(keys, values, F.lit("O2"), F.lit("none")).alias("fallback"))


@query(_ARRAYS + f""" SELECT l_orderkey, {_sql_text("list_transform(code, lambda c, i: CASE WHEN i = list_position(target, 'F1') THEN 'new' ELSE c END)")} AS code FROM a""")
def array_update(t):
    return _arrays(t).select("l_orderkey", _text_of(arrays.updated(F.col("target"), F.col("code"), F.lit("F1"), F.lit("new"))).alias("code"))


@query(_ARRAYS + f""" SELECT l_orderkey, {_sql_text("list_sort(list_distinct(list_concat(list_transform(target, lambda x: x || '_O3'), list_transform(target, lambda x: x || '_O0'))))")} AS needed FROM a""")
def required_targets(t):
    marked = F.transform("target", lambda x: F.concat(x, F.lit("_O3")))
    return _arrays(t).select("l_orderkey", _text_of(F.array_sort(arrays.with_unoptimized(marked))).alias("needed"))


@query(_ARRAYS + f" SELECT l_orderkey, {_sql_text('target')} AS target, len(code)::INTEGER AS n, least(len(target), 2)::INTEGER AS capped FROM a")
def struct_flip(t):
    rows = _arrays(t).select("l_orderkey", F.arrays_zip("target", "code").alias("r"))
    flat = rows.select("l_orderkey", arrays.columns_of(F.col("r"), "target", "code").alias("s"))
    return flat.select("l_orderkey", _text_of(F.col("s.target")).alias("target"), F.size("s.code").alias("n"), F.size(arrays.capped(F.col("s.target"), F.col("s.code"), 2)).alias("capped"))


@query("SELECT event_id, props->>'k' AS k, len(json_keys(props)) = 1 AS one_key FROM events")
def json_roundtrip(t):
    parsed = F.from_json("props", "map<string,string>")
    again = F.to_json(parsed)
    return t("events").select("event_id", F.get_json_object(again, "$.k").alias("k"), arrays.same_keys(F.map_keys(parsed), F.array(F.lit("k"))).alias("one_key"))


@query("SELECT event_id, abs(value - (value + (event_id % 3)::DOUBLE * 7 / 10000 * value)) <= 1e-3 * greatest(abs(value), abs(value + (event_id % 3)::DOUBLE * 7 / 10000 * value)) AS near FROM events")
def io_compare(t):
    v = F.col("value")
    return t("events").select("event_id", arrays.close(v, v + (F.col("event_id") % 3).cast("double") * 7 / 10000 * v).alias("near"))


@query("SELECT event_id, event_id % 5 < 3 AND event_id % 7 <> 0 AS same FROM events")
def io_compare_nested(t):
    a = F.concat(F.lit('{"a": [1, 2.0, {"p": '), F.col("props"), F.lit("}]}"))
    near = (F.lit(2.0) + F.col("event_id") % 5 * 0.0008).cast("string")  # off by four ten-thousandths for each
    key = F.when(F.col("event_id") % 7 == 0, "q").otherwise("p")
    b = F.concat(F.lit('{"a": [1.0, '), near, F.lit(', {"'), key, F.lit('": '), F.col("props"), F.lit("}]}"))
    return nested.json_alike(t("events").select("event_id", a.alias("a"), b.alias("b")), "a", "b").select("event_id", "same")


@query("""SELECT event_id, '{"x": ' || event_id || ', "s": "' || event_type || '"}' AS t FROM events""")
def io_decode(t):
    names, values = F.array(F.lit("x"), F.lit("s")), F.array(F.col("event_id").cast("string"), F.concat(F.lit("'"), F.col("event_type"), F.lit("'")))
    return t("events").select("event_id", asm.udf(asm.literals_to_json, "string")(names, values).alias("t"))


# --- routing ----------------------------------------------------------------


@query("SELECT doc_id, '<intel> <opt3> ' || lang || ' <opt3> </intel> <c> <mask:0> </c>' AS right_form, '<c> <mask:0> </c> <intel> <opt3> ' || lang || ' <opt3> </intel>' AS left_form FROM documents")
def wrapped_samples(t):
    own = routing.wrapped(F.col("lang"), "opt3")
    masked = routing.wrapped(F.lit("<mask:0>"), "c")
    left, _ = routing.sample_texts(F.col("lang"), F.col("source"), "opt3_c-c")
    return t("documents").select("doc_id", F.concat_ws(" ", own, masked).alias("right_form"), left.alias("left_form"))


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


_KEY = "'angha_' || {} || '_' || {}.key"


@query(f"""WITH p(source, target, pair) AS ({_values(map(str.split, routing.PAIRS.strip().splitlines()))}), k(code, key) AS ({_values(routing.CODES.items())}),
  r AS (SELECT *, replace(split_part(pair, '-', 1), split_part(pair, '-', 2), '') AS rest, split_part(pair, '-', 2) AS lang, pair IN ({", ".join(f"'{x}'" for x in routing.SOURCE_BY_TARGET_COMPILER.split())}) AS swapped FROM p),
  c AS (SELECT *, CASE WHEN contains(rest, 'ir') THEN 'clang' ELSE 'gcc' END AS own, CASE WHEN contains(rest, 'ir') OR contains(lang, 'ir') THEN 'clang' ELSE 'gcc' END AS other FROM r),
  f AS (SELECT c.pair, CASE WHEN c.source = 'c' THEN '' ELSE {_KEY.format("CASE WHEN swapped THEN other ELSE own END", "s")} END AS source, CASE WHEN c.target = 'c' THEN '' ELSE {_KEY.format("other", "g")} END AS target
    FROM c LEFT JOIN k s ON s.code = c.source LEFT JOIN k g ON g.code = c.target WHERE (c.source = 'c' OR s.key IS NOT NULL) AND (c.target = 'c' OR g.key IS NOT NULL))
  SELECT pair, count(*) AS n, sum(length(text) + length(f.source))::BIGINT AS source_chars, sum(length(text) + length(f.target))::BIGINT AS target_chars, min(f.source || text) AS least_source, max(f.target || text) AS most_target FROM f, documents GROUP BY pair""")
def routed_pairs(t):
    """Every routed pair over every document, whose code under a key is the key and the text."""
    names = sorted({f"angha_{c}_{k}" for c in ("gcc", "clang") for k in routing.CODES.values()})
    held = F.struct(F.array(*map(F.lit, names)).alias("target"), F.transform(F.array(*map(F.lit, names)), lambda k: F.concat(k, F.col("text"))).alias("code"))
    d = t("documents").select(F.col("text").alias("func_def"), held.alias("asm"))
    routes = [r for p in routing.PAIRS.split()[2::3] if not (r := routing.route(p)).missing]
    texts = {key: c for r in routes for key, c in zip((r.source, r.target), routing.routed(r.pair), strict=True)}  # pairs share their keys
    at = {key: i for i, key in enumerate(texts)}
    wide = d.select(*[c.alias(f"t{at[key]}") for key, c in texts.items()])
    sums = [a.alias(f"{n}{i}") for i in at.values() for n, a in (("chars", F.sum(F.length(f"t{i}"))), ("least", F.min(f"t{i}")), ("most", F.max(f"t{i}")))]
    row = wide.agg(F.count("*").alias("n"), *sums).where("n > 0")  # without a group texts aren't sorted, nor rows multiplied by pairs
    of = lambda r: {"source_chars": f"chars{at[r.source]}", "target_chars": f"chars{at[r.target]}", "least_source": f"least{at[r.source]}", "most_target": f"most{at[r.target]}"}
    each = [F.struct(F.lit(r.pair).alias("pair"), "n", *[F.col(c).alias(name) for name, c in of(r).items()]) for r in routes]
    return row.select(F.explode(F.array(*each)).alias("e")).select("e.*")


# --- assembly and programs --------------------------------------------------


def _adds():
    """An instruction for each word of a text, which adds the word's length."""
    return text.joined(F.transform(text.tokens(F.col("text")), lambda w: F.concat(F.lit("\tadd\tx0, x0, #"), F.least(F.length(w), F.lit(4095)).cast("string"))))


def _unit():
    """A unit whose function has an instruction for each word of the text, which stands in a comment, too."""
    return F.concat(F.lit("\t.text\n\t.globl\tf\n\t.type\tf,@function\nf: // -- begin\n\t.cfi_startproc\n\tsub\tsp, sp, #16\n\tstr\tw0, [sp, 12] // "), F.regexp_replace("text", "\\s+", " "), F.lit("\n"), _adds(), F.lit("\n\tret\n\t.cfi_endproc\n\t.size\tf, .-f\n"))


_ADDS = "array_to_string(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda w: '~add~x0, x0, #' || least(length(w), 4095)), '|') || CASE WHEN regexp_matches(text, '\\S') THEN '|' ELSE '{}' END"
_LINES = "replace(replace({}, '~', chr(9)), '|', chr(10))"


@query("SELECT doc_id, " + _LINES.format("'.global f|.type f, %function|f:|~.cfi_startproc|~sub~sp, sp, #16|~str~w0, [sp, 12]|' || " + _ADDS.format("") + " || '~ret|~.cfi_endproc|'") + " AS t FROM documents")
def asm_preprocess(t):
    return _doc(t, asm.preprocessed(_unit(), F.lit("f")))


_WORD = re.compile(r"\S+", re.ASCII)
#: Texts are rewritten together up to about so many characters, and longer ones alone.
_TOGETHER = 1 << 18
_ADDED = [f"\tadd x0, x0, #{n}" for n in range(4096)]


def _sum_of_words(text_: str | None) -> list[str]:
    """The lines of a function that adds the lengths of a text's words, one by one."""
    steps = [_ADDED[min(len(w), 4095)] for w in _WORD.findall(text_ or "")]
    return ["f:", "\t.cfi_startproc", "\tmov x0, #7", "\tmov x1, x0", *steps, "\tcmp x0, #3", "\tret", "\t.cfi_endproc"]


@query("SELECT doc_id, (7 + coalesce(list_sum(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda w: least(length(w), 4095))), 0))::BIGINT AS x0, 7::BIGINT AS x1, true AS longer FROM documents")
def asm_transforms(t):
    """What rewritten functions compute when a machine runs them: the same as before, though their texts are longer."""

    def ran(batches):
        for rows in batches:
            size = rows["text"].str.len().fillna(0).cumsum() // _TOGETHER
            for _, part in rows.groupby(size, sort=False):
                code = rewrites.Code([_sum_of_words(x) for x in part["text"]])
                before = code.lengths()
                rewrites.rewrite_all(code, part["seed"])
                ends = pd.DataFrame(rewrites.runs(code), columns=["x0", "x1"])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "x0": ends["x0"], "x1": ends["x1"], "longer": code.lengths() >= before})

    ship()
    return t("documents").select("doc_id", "text", curate.seeds(F.col("doc_id")).alias("seed")).mapInPandas(ran, "doc_id bigint, x0 bigint, x1 bigint, longer boolean")


@query("SELECT doc_id, chr(9) || '.global' || chr(9) || 'f' || chr(10) || chr(9) || '.type' || chr(9) || 'f, %function' || chr(10) || 'f:' || chr(10) || chr(9) || 'ret ' || text || chr(10) || chr(9) || '.size' || chr(9) || 'f, .-f' AS t FROM documents")
def asm_function_by_type(t):
    return _doc(t, asm.function_by_type(F.concat(F.lit("\t.type\tf, %function\nf:\n\tret "), F.col("text"), F.lit("\n\t.size\tf, .-f\nrest")), F.lit("f")))


@query("SELECT doc_id, " + _LINES.format("'~.text|~.globl~f|~.type~f,@function|'") + " AS pre, " + _LINES.format("'.global f|.type f, %function|f:|~.cfi_startproc|~sub~sp, sp, #16|~str~w0, [sp, 12] |' || " + _ADDS.format("|") + " || '~ret|~.cfi_endproc'") + " AS func, chr(9) || '.size' || chr(9) || 'f, .-f' || chr(10) AS post FROM documents")
def asm_unit_parts(t):
    return t("documents").select("doc_id", asm.parts_of_unit(F.regexp_replace(_unit(), ": // -- begin", ":"), F.lit("f"), "arm", "//").alias("p")).select("doc_id", "p.pre", "p.func", "p.post")


@query("SELECT doc_id, chr(9) || 'adrp x0, .LC0' || chr(10) || '.LC0: ' || regexp_extract(chr(9) || '.string \"' || text || '\"', '^[^\\r\\n]+') || chr(10) AS t FROM documents")
def asm_literals(t):
    unit = F.concat(F.lit(".LC0:\n\t.string \""), F.col("text"), F.lit("\"\n"))
    return _doc(t, asm.with_literals(unit, F.lit("\tadrp x0, .LC0")))


@query("SELECT 42::BIGINT AS n_builds, 42 * count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_failed FROM documents")
def build_matrix(t):
    def stub(source: str, build: external.Build) -> str:
        if build.key == "gcc_x86_O0":
            raise ValueError("stub")
        return f"{build.key}:{len(source)}"

    rows = external.built(t("documents").select(F.col("doc_id").cast("string").alias("fname"), F.col("lang").alias("func_def")), stub)
    return rows.agg(F.countDistinct("target").alias("n_builds"), F.count("*").alias("n_rows"), F.count_if(F.col("code").isNull()).alias("n_failed"))


# --- extensions over events -------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(t):
    return increments.windowed_counts(t("events"), "ts", "event_type")


_SESSIONS = "WITH o AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE AS gap FROM events), s AS (SELECT *, sum(coalesce(gap, false)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k"


@query(_SESSIONS)
def session_windows(t):
    return increments.sessions(t("events"), "ts", "user_id")


# --- round trips through files ----------------------------------------------


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def shards_roundtrip(t):
    df = t("orders").select("o_orderkey", "o_orderpriority")
    path = places.scratch(df.sparkSession, "shards")
    sinks.write_shards(df, path, 3000)
    return scans.shards(df.sparkSession, [path, path + "-none"], df.schema, "part-*.parquet")


@query("SELECT shard_id, count(*) AS n FROM (SELECT ((row_number() OVER (ORDER BY o_orderkey) - 1) // 6000)::INTEGER AS shard_id FROM orders) GROUP BY 1")
def exact_shards_roundtrip(t):
    df = t("orders").select("o_orderkey", "o_orderpriority")
    path = places.scratch(df.sparkSession, "exact")
    sinks.write_exact_shards(df, path, "o_orderkey", 6000)
    return df.sparkSession.read.parquet(path).groupBy(F.col("shard_id").cast("int").alias("shard_id")).agg(F.count("*").alias("n"))


@query(_SPLIT + " SELECT doc_id, lang FROM s WHERE split = 'test'")
def splits_roundtrip(t):
    df = curate.stratified(t("documents").select("doc_id", "lang"), "lang", "doc_id", 0.1)
    path = places.scratch(df.sparkSession, "splits")
    sinks.write_splits(df, path)
    return scans.split(df.sparkSession, path, "test").select("doc_id", "lang")


@query("SELECT conv_id::VARCHAR AS fname, role AS technique, text AS prediction, NULL::VARCHAR AS reference FROM conversations")
def predictions_roundtrip(t):
    df = t("conversations").select(F.col("conv_id").cast("string").alias("fname"), F.col("role").alias("technique"), F.col("text").alias("prediction"), F.lit(None).cast("string").alias("reference"))
    path = places.scratch(df.sparkSession, "log")
    sinks.write_json_lines(df, path)
    return scans.predictions(df.sparkSession, path)


@query("SELECT event_type, event_id, batch FROM (SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 16 AS batch, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE (batch + 1) * 16 <= n")
def full_batches(t):
    return curate.full_batches(t("events").select("event_type", "event_id"), ["event_id"], 16, "event_type")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS seen, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def progress_counters(t):
    rows = curate.running(t("events").select("user_id", "event_id", "value"), "event_id", "value", "user_id")
    return rows.select("user_id", "event_id", "seen", F.round("running", 4).alias("running"))
