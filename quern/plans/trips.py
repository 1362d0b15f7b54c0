"""Registered queries of files, jobs and programs over the driver tables, and their SQL twins.

Each writes to a scratch folder what a source then reads, or runs a whole job. Models and programs are
small functions here, so that SQL can say what they answer.
"""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import arrays, metrics, text
from quern.operators import batching, curate, external, routing
from quern.plans import jobs
from quern.plans.catalog import _ARRAYS, _SESSIONS, _SPLIT, _STREAKS, _TURNS, ORACLES, _arrays, _once, _sized, _sql_text, _text_of, _turns, _values, query
from quern.schemas import blank_metadata
from quern.sources import places, scans, sinks
from quern.streaming import increments


def _spark(t) -> SparkSession:
    return t("region").sparkSession


def _saved(df: DataFrame, name: str) -> str:
    path = places.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def _file() -> Column:
    """The file that a row was read from."""
    return F.col("_metadata.file_name").alias("file")


# --- sources ----------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS fname, text AS func_def, lang || source AS code, true AS no_deps FROM documents")
def corpus_read(t):
    d = t("documents").select(F.col("doc_id").cast("string").alias("fname"), F.col("text").alias("func_def"), F.struct(F.array("lang").alias("target"), F.array(F.concat("lang", "source")).alias("code")).alias("asm"))
    rows = scans.functions(d.sparkSession, _saved(d, "corpus"))
    return rows.select("fname", "func_def", arrays.lookup(F.col("asm.target"), F.col("asm.code"), F.get("asm.target", F.lit(0))).alias("code"), F.col("synth_deps").isNull().alias("no_deps"))


@query("SELECT doc_id::VARCHAR AS fname, n_chars::BIGINT AS tigress_seed, '' AS c_deps, true AS no_asm FROM documents")
def old_pairs_read(t):
    d = t("documents").select(F.col("doc_id").cast("string").alias("fname"), F.col("n_chars").cast("int").alias("tigress_seed"))
    rows = blank_metadata(scans.pairs(d.sparkSession, _saved(d, "pairs")))
    return rows.select("fname", "tigress_seed", "c_deps", F.col("clean_asm").isNull().alias("no_asm"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def all_splits_read(t):
    d = t("documents")
    paths = {"even": _saved(d.where("doc_id % 2 = 0").select("lang"), "even"), "odd": _saved(d.where("doc_id % 2 <> 0").select("lang", "source"), "odd")}
    return scans.all_splits(d.sparkSession, paths).groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders")
def damaged_shards_read(t):
    df = t("orders").select("o_orderkey")
    path = places.scratch(df.sparkSession, "damaged")
    sinks.write_shards(df, path, 2000)
    sinks.write_file(df.sparkSession, f"{path}/part-none.parquet", "no parquet at all")
    return scans.shards(df.sparkSession, [path], df.schema, "part-*.parquet", tolerant=True)


@query("SELECT 'read' AS what, '' AS file, count(*) AS n FROM orders UNION ALL SELECT 'by footers', '', count(*) FROM orders UNION ALL VALUES ('left out', 'part-none.parquet', 1), ('left out', 'part-empty.parquet', 1)")
def damaged_shards_reported(t):
    df = t("orders").select("o_orderkey")
    spark, path = df.sparkSession, places.scratch(df.sparkSession, "damaged")
    sinks.write_shards(df, path, 2000)
    sinks.write_file(spark, f"{path}/part-none.parquet", "no parquet at all")
    sinks.write_file(spark, f"{path}/part-empty.parquet", "")
    told = lambda rows, what, n, file="": rows.agg(n.cast("long").alias("n")).select(F.lit(what).alias("what"), F.lit(file).alias("file"), "n")
    read = told(scans.shards(spark, [path], df.schema, "part-*.parquet", tolerant=True), "read", F.count("*"))
    footers = told(scans.probed(spark, [path], "part-*.parquet"), "by footers", F.sum("rows"))
    left = scans.skipped_shards(spark, [path], "part-*.parquet").select(F.lit("left out").alias("what"), F.element_at(F.split("file", "/"), -1).alias("file"), F.lit(1).cast("long").alias("n"))
    return read.unionByName(footers).unionByName(left)


@query("SELECT 'rows_seen' AS name, count(*)::BIGINT AS total FROM events UNION ALL SELECT 'failures', count(*) FILTER (WHERE value < 10) FROM events UNION ALL SELECT 'samples_per_transform.' || event_type, count(*) FROM events GROUP BY event_type")
def sidecars_merged(t):
    e = t("events").withColumn("chunk", F.col("event_id") % 5)
    kinds = e.groupBy("chunk", "event_type").count().groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("samples_per_transform"))
    parts = e.groupBy("chunk").agg(F.count("*").alias("rows_seen"), F.count_if(F.col("value") < 10).alias("failures")).join(kinds, "chunk")
    path = places.scratch(e.sparkSession, "sidecars")
    parts.select(F.struct("rows_seen", "failures", "samples_per_transform").alias("generation_stats")).write.option("maxRecordsPerFile", 1).json(path)
    sinks.write_file(e.sparkSession, f"{path}/odd.json", "not json")
    totals = curate.merged_stats(scans.sidecars(e.sparkSession, [path, f"{path}-none"], name="*.json"))
    return totals.where(F.col("name").isin("rows_seen", "failures") | F.col("name").startswith("samples_per"))


@query("SELECT count(*) AS n_rows, sum(length(text) + 1)::BIGINT AS chars FROM documents")
def texts_roundtrip(t):
    d = t("documents").select("text")
    path = places.scratch(d.sparkSession, "texts")
    sinks.write_texts(d, path, "text")
    rows = scans.rows_in(d.sparkSession, _saved(d, "counted"))
    return scans.whole_texts(d.sparkSession, path, "part-*").agg(F.lit(rows).cast("long").alias("n_rows"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT o_orderstatus, 'old' AS version, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_orderstatus, 'latest', count(*) FROM orders GROUP BY 1")
def versions_read(t):
    df = t("orders").select("o_orderkey", "o_orderstatus")
    path, spark = places.scratch(df.sparkSession, "versions"), df.sparkSession
    df.where("o_orderkey % 2 = 0").write.parquet(f"{path}/v1")
    df.write.parquet(f"{path}/v2")
    sinks.write_file(spark, f"{path}/LATEST", "v2\n")
    read = lambda label, v: scans.versioned(spark, path, v).groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("version", F.lit(label))
    return read("old", "v1").unionByName(read("latest", None))


@query("SELECT n_name AS name, 'int ' || n_name AS c, 'define ' || n_regionkey AS ll FROM nation WHERE n_nationkey <> 3")
def cases_read(t):
    rows = t("nation").select("n_name", "n_regionkey", "n_nationkey").collect()  # 25
    path, spark = places.scratch(_spark(t), "cases"), _spark(t)
    for r in rows:
        sinks.write_file(spark, f"{path}/{r.n_name}.c", f"int {r.n_name}")
        if r.n_nationkey != 3:
            sinks.write_file(spark, f"{path}/{r.n_name}.ll", f"define {r.n_regionkey}")
    return scans.cases(spark, path, [".c", ".ll"])


# --- sinks and jobs ---------------------------------------------------------


@query("WITH k AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 4000 AS k, o_orderkey FROM orders) SELECT 'shard-' || lpad(k::VARCHAR, 5, '0') || '.parquet' AS file, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, 2 * (SELECT count(*) FROM orders)::BIGINT AS rows_seen FROM k GROUP BY k")
def merge_job(t):
    df = t("orders").select("o_orderkey", "o_orderpriority")
    spark, path = df.sparkSession, places.scratch(df.sparkSession, "merge")
    for k in (0, 1):
        sinks.write_shards(df.where(F.col("o_orderkey") % 2 == k), f"{path}/in{k}", 700)
        sinks.write_file(spark, f"{path}/in{k}/dataset_info.json", json.dumps({"generation_stats": {"rows_seen": df.count()}}))
    totals = jobs.merge(spark, [f"{path}/in0", f"{path}/in1"], f"{path}/out", "o_orderkey", target_rows=4000)
    seen = totals.where("name = 'rows_seen'").select(F.col("total").alias("rows_seen"))
    files = spark.read.parquet(f"{path}/out/data").select("*", _file()).groupBy("file").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
    return files.join(F.broadcast(seen))  # one row


@query(_SPLIT + ", n AS (SELECT split, count(*) AS n, (count(*) + 99) // 100 AS files FROM s GROUP BY split), f AS (SELECT *, unnest(range(files)) AS i FROM n) SELECT split || '-' || lpad(i::VARCHAR, 5, '0') || '-of-' || lpad(files::VARCHAR, 5, '0') || '.parquet' AS file, least(100, n - 100 * i)::BIGINT AS n FROM f")
def split_job(t):
    d = t("documents").select("doc_id", "lang")
    path = places.scratch(d.sparkSession, "named")
    jobs.split(d, path, "lang", "doc_id", 0.1, shard_rows=100)
    return d.sparkSession.read.option("recursiveFileLookup", "true").parquet(path).select(_file()).groupBy("file").agg(F.count("*").alias("n"))


def _marked(t) -> DataFrame:
    d = t("documents").select("doc_id", "text", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("fname"))
    code = F.concat(F.lit("x\n/* BEGIN FUNCTION-DEF "), F.col("fname"), F.lit(" */\n"), F.col("text"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("\n/* END FUNCTION-DEF "), F.col("fname"), F.lit(" */\nrest"))).otherwise(F.lit("")))
    return d.select("doc_id", "fname", code.alias("obfuscated_c"))


@query("SELECT CASE WHEN doc_id % 3 <> 0 THEN 'kept' ELSE 'no_function' END AS skip_reason, count(*) AS n, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS written FROM documents GROUP BY 1")
def clean_job(t):
    rows = _marked(t)
    path = places.scratch(rows.sparkSession, "clean")
    counts = jobs.clean(rows.sparkSession, rows, path, 500)
    return counts.withColumn("written", F.lit(scans.rows_in(rows.sparkSession, f"{path}/data")).cast("long"))


@query("SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN '' ELSE (2 - doc_id % 3) || coalesce(lang, '') END AS c_deps, count(*) OVER () AS n FROM (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE doc_id % 2 = 0)")
def augment_job(t):
    """Each key has three source rows, of which the last to arrive holds the least, the middle or the greatest value; half of the rows' keys stand twice."""
    d = t("documents").select("doc_id", F.col("source").alias("exebench_split"), F.col("doc_id").cast("string").alias("fname"), "lang")
    rows = d.select("doc_id", "exebench_split", "fname", F.lit(None).cast("string").alias("c_deps"))
    path = places.scratch(d.sparkSession, "source")
    three = d.withColumn("_at", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("c_deps", F.concat(F.pmod(F.col("_at") - F.col("doc_id"), F.lit(3)).cast("string"), F.coalesce("lang", F.lit(""))))
    three.repartitionByRange(6, "_at", "fname").sortWithinPartitions("_at", "fname").select("exebench_split", "fname", "c_deps").write.parquet(path)
    out = jobs.augmented(rows.unionByName(rows.where("doc_id % 2 = 0")), d.sparkSession.read.parquet(path), ["c_deps"])
    return out.join(out.agg(F.count("*").alias("n"))).select("doc_id", "c_deps", "n")  # one row


@query("SELECT sum(length(text) + 47 + 2 * length('f' || doc_id) + 10)::BIGINT AS chars_before, count(*) AS files FROM documents WHERE doc_id % 3 <> 0")
def prepare_tests_job(t):
    rows = _marked(t)
    path = places.scratch(rows.sparkSession, "tests")
    report = jobs.prepare_tests(rows.sparkSession, [rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 <> 0")], path)
    return report.select((F.col("chars_before") + 0).alias("chars_before"), F.lit(scans.rows_in(rows.sparkSession, path)).cast("long").alias("files"))


@query("""SELECT 'rows_seen' AS name, count(*) AS total FROM documents UNION ALL SELECT 'samples_written', 2 * count(*) FROM documents WHERE length(text) >= 40
  UNION ALL SELECT 'failures', 3 * count(*) - 2 * count(*) FILTER (WHERE length(text) >= 40) FROM documents UNION ALL SELECT 'samples_per_transform.' || v, CASE WHEN v = 'Flatten' THEN 0 ELSE (SELECT count(*) FROM documents WHERE length(text) >= 40) END FROM (VALUES ('Flatten'), ('EncodeArithmetic'), ('Flatten+EncodeArithmetic')) x(v)""")
def generate_job(t):
    def tool(source: str, technique: str, seed: int) -> str:
        if technique == "Flatten":
            raise ValueError("stub")
        if not 0 <= seed < 1 << 31:
            return ""
        return source if len(source) >= 48 else ""

    d = t("documents").select(F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("fname"), "text").select("fname", F.concat("fname", F.col("text")).alias("func_def"))
    return jobs.generate(d, tool, places.scratch(d.sparkSession, "generated"), least_chars=48)


def _half(said: str, fine):
    return lambda text_, suffix: (fine(text_), said)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE length(text) % 3 <> 0) AS syntax_valid, count(*) FILTER (WHERE length(text) % 3 <> 0 AND length(text) % 2 = 0) AS compiles, round(100 * count(*) FILTER (WHERE length(text) % 3 <> 0) / greatest(count(*), 1), 6) AS syntax_rate, round(100 * count(*) FILTER (WHERE length(text) % 3 <> 0 AND length(text) % 2 = 0) / greatest(count(*), 1), 6) AS compile_rate, count(*) FILTER (WHERE length(text) % 3 = 0) AS said FROM documents")
def recheck_job(t):
    d = t("documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("prediction"))
    path = places.scratch(d.sparkSession, "recheck")
    summary = jobs.rechecked(d, path, lambda row: external.check(row, 2, assembler=_half("bad", lambda x: len(x) % 3 != 0), compiler=_half("odd", lambda x: len(x) % 2 == 0)))
    details = d.sparkSession.read.schema(external.CHECKED).json(f"{path}/details").agg(F.count_if(F.col("syntax_error") == "bad").alias("said"))
    return summary.withColumns({c: F.round(c, 6) for c in ("syntax_rate", "compile_rate")}).join(details)  # one row each


class _Copy(external.Tool):
    """A compiler that copies, or a linker that makes the copy a program."""

    def there(self) -> bool:
        return True


@query("SELECT n_nationkey::BIGINT AS seq, n_nationkey % 5 <> 4 AS links, CASE WHEN n_nationkey % 5 <> 4 THEN n_nationkey % 2 = 0 END AS functional_pass, CASE WHEN n_nationkey % 5 = 4 THEN 0 WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS io_pass_count, CASE WHEN n_nationkey % 5 = 4 THEN 0 ELSE 2 END::INTEGER AS io_total_count FROM nation")
def linked_programs(t):
    """Programs linked with their wrappers and run on two inputs each; they swap 1 for 2 and, where they should, 3 for 4."""
    n = F.col("n_nationkey")
    script = F.concat(F.lit("#!/bin/sh\nsed -e 's/1/2/' "), F.when(n % 2 == 0, "-e 's/3/4/' ").otherwise(""), F.lit("$1 > $2"))
    rows = t("nation").select(n.cast("long").alias("seq"), script.alias("prediction"), F.lit("int x;").alias("c_deps"), F.lit("int f(int)").alias("func_c_signature"), F.when(n % 5 != 4, 'extern "C" { }').otherwise("none").alias("cpp_wrapper"))
    pairs = json.dumps({"input": [{"a": 1}, {"a": 3}], "output": [{"a": 2}, {"a": 4}]})
    fine, copy = external.Tool("true", ()), _Copy("cp", ("{input}", "{output}"))
    link = _Copy("sh", ("-c", "cp {input} {output} && chmod +x {output} && grep -q deps.c {wrapper}"))
    work = lambda row: external.check({**row, "io_pairs": pairs}, 3, assembler=fine, compiler=copy, linker=link)
    return external.run(rows, work, external.CHECKED).select("seq", "links", "functional_pass", "io_pass_count", "io_total_count")


@query(_TURNS + """, q AS (SELECT conv_id, technique, reference AS source, prediction AS reference FROM p), f AS (SELECT * FROM q WHERE regexp_replace(source, '\\s+', '', 'g') <> '' AND regexp_replace(reference, '\\s+', '', 'g') <> '' AND len(list_filter(string_split_regex(source, '\\s+'), lambda x: x <> '')) <= 60)
  SELECT coalesce(technique, 'ALL') AS technique, count(*) AS n, round(avg(levenshtein(source, reference) / greatest(length(source), length(reference), 1)), 6) AS ned,
  count(*) FILTER (WHERE length(source) % 2 = 0) AS syntax_valid, (SELECT count(*) FROM q) - (SELECT count(*) FROM f) AS skipped FROM f GROUP BY GROUPING SETS ((), (technique))""")
def evaluate_job(t):
    """A model that answers with its source, over user turns, against the assistant's; and checks of what it says."""
    rows = _turns(t).select(F.xxhash64("conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("fname"), "technique", F.col("reference").alias("source"), F.col("prediction").alias("reference"))
    check = lambda row: external.check(row, 1, assembler=_half("odd", lambda x: len(x) % 2 == 0))
    _, report, skipped = jobs.evaluated(rows, list, by=["technique"], most_tokens=60, check=check)
    lost = skipped.where("skip_reason <> 'kept'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("skipped"))
    return report.select("technique", "n", F.round("ned", 6).alias("ned"), "syntax_valid").join(lost)  # one row


@query("""WITH p AS (SELECT DISTINCT text AS prompt FROM conversations), c AS (SELECT prompt, i, prompt || repeat('!', i) AS t FROM p, range(5) r(i)), s AS (SELECT *, CASE WHEN length(t) % 3 = 0 THEN 0 WHEN length(t) % 2 = 1 THEN 1 ELSE 2 END AS score FROM c),
  b AS (SELECT prompt, max(score) AS best_score FROM s GROUP BY 1) SELECT best_score::INTEGER AS best_score, count(*) AS n, (SELECT count(*) FROM p) AS pairs, least(10, (SELECT count(*) FROM p)) AS shown FROM b GROUP BY 1""")
def preference_job(t):
    c = t("conversations").select(F.col("text").alias("prompt")).distinct().withColumns({"fname": F.md5("prompt"), "truth": F.lit("truth")})
    spark, path = c.sparkSession, places.scratch(c.sparkSession, "preferences")
    check = lambda row: external.check(row, 2, assembler=_half("bad", lambda x: len(x) % 3 != 0), compiler=_half("odd", lambda x: len(x) % 2 == 0))
    hist = jobs.preference_set(c, lambda prompt, n: [prompt + "!" * i for i in range(n)], check, path)
    pairs = scans.preferences(spark, f"{path}/data")
    shown = spark.read.json(f"{path}/sample").count()
    return hist.join(pairs.agg(F.count("*").alias("pairs"))).withColumn("shown", F.lit(shown).cast("long"))  # one row


@query("SELECT doc_id AS id, 'f' AS fname, CASE WHEN doc_id % 4 = 0 THEN 'no such function' END AS error, CASE WHEN doc_id % 4 <> 0 THEN 'define i32 @f() {' || chr(10) || '  ret i32 ' || (doc_id % 10) || chr(10) || '}' END AS ir FROM documents")
def lift_job(t):
    """Units cut, cleaned and wrapped, then lifted by a model that reads one number out of them."""
    d = t("documents")
    name = F.when(F.col("doc_id") % 4 == 0, "g").otherwise("f")
    unit = F.concat(F.lit("\t.text\n\t.globl\t"), name, F.lit("\n"), name, F.lit(":\n\t.cfi_startproc\n\tmov\tw0, #"), (F.col("doc_id") % 10).cast("string"), F.lit("\n\tret // "), F.regexp_replace("text", "\\s+", " "), F.lit("\n\t.cfi_endproc\n"))
    answer = lambda xs: ["define i32 @f() {\n  ret i32 " + x.partition("#")[2].split()[0] + "\n}\nmore" if x.startswith("<arm> ") and "//" not in x else "bad" for x in xs]
    return jobs.lifted_units(d.select(F.col("doc_id").alias("id"), F.lit("f").alias("fname"), unit.alias("asm")), answer)


@query("WITH k AS (SELECT doc_id, 9 + len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n, len(list_filter(string_split_regex(lang, '\\s+'), lambda x: x <> '')) AS m FROM documents), f AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM k WHERE n <= 300 AND m >= 1), b AS (SELECT *, (rn - 1) // 32 AS buf FROM f), s AS (SELECT *, row_number() OVER (PARTITION BY buf ORDER BY n, rn) - 1 AS p FROM b) SELECT doc_id AS id, n::INTEGER AS n, m::INTEGER AS m, (buf * 4 + p // 8)::BIGINT AS batch_id FROM s")
def training_job(t):
    d = t("documents").select(F.col("doc_id").alias("id"), "text", "lang")
    rows = jobs.training_samples(d, F.col("text"), F.col("lang"), "opt3_ir_opt3-ir_opt3", most=300)
    return rows.select("id", "n", F.size("target_ids").alias("m"), "batch_id")


@query(f"SELECT doc_id, {_sql_text("list_filter(string_split_regex('<c> <mask:0> </c> <intel> <opt3> ' || text || ' <opt3> </intel>', '\\s+'), lambda x: x <> '')[1:50]")} AS source_ids, lang AS target_ids FROM documents")
def pair_tokens(t):
    ids = t("documents").select("doc_id", routing.tokenized(F.col("text"), F.col("lang"), "opt3_c-c", most=50).alias("s"))
    return ids.select("doc_id", _text_of(F.col("s.source_ids")).alias("source_ids"), _text_of(F.col("s.target_ids")).alias("target_ids"))


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) BETWEEN 1 AND 40 GROUP BY 1")
def preference_samples(t):
    c = t("conversations").select("conv_id", F.col("text").alias("prompt"), F.col("text").alias("chosen"), F.lit("no").alias("rejected"))
    return jobs.preference_samples(c, most=40).groupBy("conv_id").agg(F.count("*").alias("n"))


@query(ORACLES["length_buckets"])
def length_buckets_by_function(t):
    """The buffers of length_buckets, cut into batches by a table function that SQL calls with partitions in order."""
    sized = curate.numbered(_sized(t), "doc_id", dear=True).withColumn("buf", F.floor((F.col("rn") - 1) / 32))
    spark = sized.sparkSession
    batching.register_places(spark)
    return spark.sql("SELECT doc_id, n_tokens, buf, buf * 4 + batch AS batch_id, slot FROM placed_in_batches(TABLE({sized}) PARTITION BY buf ORDER BY (n_tokens, rn), 8)", sized=sized)


# --- publishing -------------------------------------------------------------


@query("SELECT lang, count(*) AS n, 2::BIGINT AS gone FROM documents GROUP BY 1")
def publish_roundtrip(t):
    d = t("documents").select("doc_id", "lang")
    spark, path = d.sparkSession, places.scratch(d.sparkSession, "published")
    for rows in (d.where("doc_id % 2 = 0"), d):
        rows.write.parquet(f"{path}/new")
        sinks.published(spark, f"{path}/new", f"{path}/live")
    for k in (1, 2):
        sinks.write_file(spark, f"{path}/stale-{k}.txt", "x")
    return spark.read.parquet(f"{path}/live").groupBy("lang").agg(F.count("*").alias("n")).withColumn("gone", F.lit(sinks.deleted(spark, path, "stale-*")).cast("long"))


@query("SELECT lang, 'between' AS seen, count(*) AS n, true AS refused FROM documents WHERE doc_id % 2 = 0 GROUP BY 1 UNION ALL SELECT lang, 'after', count(*), true FROM documents GROUP BY 1")
def publish_by_pointer(t):
    """A reader between a version's two steps finds the one before; a second publisher after the same pointer is refused."""
    d = t("documents").select("doc_id", "lang")
    spark, path = d.sparkSession, places.scratch(d.sparkSession, "pointed")
    first = sinks.publish(d.where("doc_id % 2 = 0"), path, "v1")
    d.write.parquet(f"{path}/v2")
    seen = lambda label: scans.versioned(spark, path).groupBy("lang").agg(F.count("*").alias("n")).withColumn("seen", F.lit(label))
    between = seen("between")
    sinks.point(spark, path, "v2", first)
    try:
        sinks.publish(d.where("doc_id % 3 = 0"), path, "v3", first)
        refused = False
    except FileExistsError:
        refused = not scans.exists(spark, f"{path}/v3")
    return between.unionByName(seen("after")).withColumn("refused", F.lit(refused))


@query(ORACLES["eval_bleu_grouped"])
def eval_incremental(t):
    """Scores from stored sums of shards, which arrive in three lots; those that were added are gone when the next come, so only new ones are read."""
    turns = _turns(t).select("conv_id", "turn", "technique", "prediction", "reference")
    spark, path = turns.sparkSession, places.scratch(turns.sparkSession, "sums")

    def sums(rows: DataFrame) -> DataFrame:
        parts = _once(rows.select("shard", "technique", metrics.bleu_parts(F.col("prediction"), F.col("reference")).alias("parts")), "parts")
        return parts.groupBy("shard", "technique").agg(metrics.bleu_sums(F.col("parts")).alias("parts"))

    for lot in range(3):
        sinks.add_partials(spark, _saved(turns.where(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == lot), "lot"), path, sums)
    return curate.overall(scans.partials(spark, path), [F.round(metrics.bleu_score(F.col("parts")), 6).alias("bleu")], "technique")


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(CASE WHEN doc_id % 10 = 0 THEN -doc_id ELSE doc_id END)::BIGINT AS ids FROM documents GROUP BY 1")
def partitions_replaced(t):
    d = t("documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"))
    path = places.scratch(d.sparkSession, "replaced")
    sinks.write_splits(d, path)
    sinks.replace_partitions(d.where("split = 'test'").withColumn("doc_id", -F.col("doc_id")), path, "split")
    return d.sparkSession.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""SELECT '# Documents' || chr(10) || chr(10) || 'By language.' || chr(10) || chr(10) || '| lang | rows |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || lang || ' | ' || format('{:,}', n) || ' |' || chr(10), '' ORDER BY lang) || '| total | ' || format('{:,}', sum(n)::BIGINT) || ' |' || chr(10) || chr(10)
  || '## Columns' || chr(10) || chr(10) || '| column | type |' || chr(10) || '|---|---|' || chr(10) || '| doc_id | bigint |' || chr(10) || '| lang | string |' || chr(10) || chr(10) || '## Use' || chr(10) || chr(10) || 'Read it.' || chr(10) AS card FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)""")
def table_card(t):
    d = t("documents").select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    made = sinks.card(d.groupBy("lang").agg(F.count("*").alias("n")), "Documents", split="lang", about="By language.", schema=d.schema, notes={"Use": "Read it."}).replace("| split |", "| lang |", 1)
    path = places.scratch(d.sparkSession, "card")
    sinks.write_file(d.sparkSession, f"{path}/README.md", made)
    return scans.whole_texts(d.sparkSession, path, "*.md").select(F.col("text").alias("card"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def metrics_roundtrip(t):
    m = t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    path = places.scratch(m.sparkSession, "metrics")
    sinks.write_json_lines(sinks.metrics_map(m, "event_type"), path)
    read = m.sparkSession.read.schema("per_group map<string, struct<n: bigint, mean: double>>").json(path)
    return read.select(F.explode("per_group").alias("event_type", "v")).select("event_type", "v.n", "v.mean")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def stream_roundtrip(t):
    d = t("documents").select("doc_id", "lang")
    source = _saved(d.repartition(3), "arriving")
    path = places.scratch(d.sparkSession, "arrived")
    q = increments.maintained(increments.arrivals(d.sparkSession, source, d.schema), lambda b: b.where("lang is not null"), f"{path}/out", f"{path}/marks")
    q.awaitTermination()
    return d.sparkSession.read.parquet(f"{path}/out").groupBy("lang").agg(F.count("*").alias("n"))


def _streamed(t, name: str, of) -> tuple[DataFrame, int]:
    """What a streaming operator makes of events that arrive in three parts, each a run of its own, and how many late rows it dropped.

    Within a part events come in any order. With the second part come seven events of ten days before the first, of users 1 to 7; the last
    part has, ten days after all others, one of user -1, so that the watermark passes them.
    """
    e = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    spark = e.sparkSession
    source, out, marks = (places.scratch(spark, f"{name}-{x}") for x in ("in", "out", "marks"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) / 3 * k for k in (1, 2)]
    odd = lambda users, ts: spark.createDataFrame([(-u, ts, u, 0.0) for u in users], e.schema)
    day = timedelta(days=10)
    parts = (e.where(F.col("ts") < cuts[0]), e.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])).unionByName(odd(range(1, 8), first - day)), e.where(F.col("ts") >= cuts[1]).unionByName(odd([-1], last + day)))
    dropped = 0
    for p in parts:
        p.repartition(2).write.mode("append").parquet(source)
        q = increments.maintained(of(increments.arrivals(spark, source, e.schema)), lambda b: b, out, marks)
        q.awaitTermination()
        dropped += increments.late_dropped(q)
    return spark.read.parquet(out).drop("batch"), dropped


@query(_SESSIONS.replace("SELECT user_id, min(ts)", "SELECT 7::BIGINT AS late, user_id, min(ts)"))
def stream_sessions(t):
    rows, late = _streamed(t, "sessions", lambda s: increments.sessions(s, "ts", "user_id"))
    return rows.withColumn("late", F.lit(late).cast("long"))


@query(f"SELECT *, 7::BIGINT AS late FROM ({_STREAKS})")
def stream_streaks(t):
    rows, late = _streamed(t, "streaks", lambda s: increments.streaks(s, "ts", "user_id", "event_id", F.col("value") < 30, 3))
    return rows.select(F.col("key").alias("user_id"), "stop_at", F.lit(late).cast("long").alias("late"))


@query("SELECT user_id, count(DISTINCT date_trunc('day', ts)) AS n FROM events GROUP BY 1")
def stream_distinct(t):
    """The first event of each user and day."""
    rows, _ = _streamed(t, "distinct", lambda s: increments.deduplicated(s.withColumn("day", F.to_date("ts")), "ts", "user_id", "day"))
    first = t("events").agg(F.min("ts").cast("date")).first()[0]  # a late event comes from before it
    return rows.where((F.col("user_id") >= 0) & (F.col("day") >= F.lit(first))).groupBy("user_id").agg(F.count("*").alias("n"))


# --- small functions --------------------------------------------------------


def _paired_documents(t, rows: list[tuple], names: str) -> DataFrame:
    """Every document with the row of its pair, to which it goes by its id: rows has one for each pair."""
    pairs = _spark(t).createDataFrame([(i, *r) for i, r in enumerate(rows)], f"place long, {names}")
    return t("documents").select((F.col("doc_id") % len(rows)).alias("place")).join(F.broadcast(pairs), "place")  # a few


_PAIRS = routing.PAIRS.split()[2::3]


@query(f"WITH i(place, pair) AS ({_values(enumerate(_PAIRS))}), p(source, target, pair) AS ({_values(map(str.split, routing.PAIRS.strip().splitlines()))}), s AS (SELECT pair, split_part(pair, '-', 1) AS lft, split_part(pair, '-', 2) AS target FROM p WHERE contains(split_part(pair, '-', 1), split_part(pair, '-', 2))), r AS (SELECT pair, target, regexp_replace(lft, '^(.*)' || target || '(.*)$', '\\1\\2') AS rest FROM s) SELECT r.pair, d.n, rest[1:-2] AS source, target, r.pair IN ({', '.join(repr(x) for x in (routing.TARGET_FIRST + routing.TARGET_FIRST_NEWER).split())}) AS target_left FROM r JOIN (SELECT i.pair, count(*) AS n FROM i, documents WHERE doc_id % {len(_PAIRS)} = place::INTEGER GROUP BY 1) d ON d.pair = r.pair")
def pair_languages(t):
    """What the names of pairs say of their languages, for the documents that go to each pair: those with the target in the source's name."""
    named = lambda p: p.split("-")[1] in p.split("-")[0]
    rows = [(p, *routing.languages(p), routing.target_left(p)) if named(p) else (p, None, None, None) for p in _PAIRS]
    dealt = _paired_documents(t, rows, "pair string, source string, target string, target_left boolean")
    return dealt.where("target is not null").groupBy("pair", "source", "target", "target_left").agg(F.count("*").alias("n"))


_CODES = ", ".join(f"'{x}'" for x in ("c", *routing.CODES))


@query(f"""WITH i(place, source, target, pair) AS ({_values((i, *x.split()) for i, x in enumerate(routing.PAIRS.strip().splitlines()))}) SELECT pair, count(*) AS n, any_value(i.source NOT IN ({_CODES}) OR i.target NOT IN ({_CODES})) AS missing
  FROM i, documents WHERE doc_id % {len(_PAIRS)} = place::INTEGER GROUP BY pair""")
def route_table(t):
    """The documents that go to each pair, and whether it has a key for either side missing."""
    return _paired_documents(t, [(p, routing.route(p).missing) for p in _PAIRS], "pair string, missing boolean").groupBy("pair", "missing").agg(F.count("*").alias("n"))


@query("SELECT doc_id, text AS t FROM documents")
def main_dropped(t):
    return t("documents").select("doc_id", text.without_main(F.concat(F.col("text"), F.lit("\n  int main (int n) {\n  return n;\n}\n"))).alias("t"))


@query(_ARRAYS + " SELECT l_orderkey, least(len(target), 2)::INTEGER AS n, target[1] AS first_target, code[len(target) - list_position(list_reverse(target), 'F1') + 1] AS last_code FROM a")
def array_rows(t):
    rows = arrays.rows_of(a=F.col("target"), b=F.slice("code", F.lit(1), F.least(F.size("code"), F.lit(2))))
    return _arrays(t).select("l_orderkey", F.size(rows).alias("n"), F.get(rows, F.lit(0))["a"].alias("first_target"), F.try_element_at(jobs.io_maps(F.col("target"), F.col("code")), F.lit("F1")).alias("last_code"))


@query("SELECT event_type, round_even(count(*) FILTER (WHERE value < 10) / count(*) * 100, 2) AS pct, round_even(sum(floor(value)) / count(*), 4) AS mean, round_even(count(*)::DOUBLE / 8, 2) AS eighths FROM events GROUP BY 1")
def report_digits(t):
    n = F.count("*")
    return t("events").groupBy("event_type").agg(metrics.shown(F.count_if(F.col("value") < 10) / n * 100, 2).alias("pct"), metrics.shown(F.sum(F.floor("value")) / n).alias("mean"), metrics.shown(n.cast("double") / 8, 2).alias("eighths"))


@query("SELECT n_nationkey, n_nationkey % 3 = n_regionkey % 3 AS same FROM nation")
def equal_programs(t):
    """Two programs for each nation, which print and return a number."""
    run = lambda row: [{"n_nationkey": row["n_nationkey"], "same": external.same_runs(["sh", "-c", f"echo {row['n_nationkey'] % 3}; exit 1"], ["sh", "-c", f"printf '{row['n_regionkey'] % 3}\\n'; exit 1"])[0]}]
    return external.run(t("nation").select("n_nationkey", "n_regionkey"), run, "n_nationkey bigint, same boolean, error string").select("n_nationkey", "same")


@query("SELECT l_orderkey, l_linenumber, ((greatest(l_partkey % 12 + 1, 5) + l_linenumber - 1) // l_linenumber * l_linenumber)::BIGINT AS beams, ((l_partkey % 12 + 1) * l_linenumber * 2)::BIGINT AS rows_of_update FROM lineitem")
def training_numbers(t):
    """Beams and rows of an update for each line's own candidates and groups."""
    c, g = F.col("l_partkey") % 12 + 1, F.col("l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", metrics.beams(c, g).alias("beams"), metrics.effective_batch(c, g, 2).cast("long").alias("rows_of_update"))


@query("SELECT doc_id, 'f,' || lang || ',g' AS symbols FROM documents WHERE lang IS NOT NULL")
def unit_symbols(t):
    unit = F.concat(F.lit("\t.globl f\n\t.global\t"), F.col("lang"), F.lit("\nf:\n\tbl g\n\tbl "), F.col("lang"), F.lit("\n\tcall f\n// "), F.regexp_replace("text", "\\s+", " "))
    return t("documents").where("lang is not null").select("doc_id", F.array_join(jobs.symbols(unit), ",").alias("symbols"))


@query("SELECT n_nationkey::VARCHAR AS fname, 'int ' || n_name AS func_def, n_name AS technique FROM nation")
def sources_in_memory(t):
    rows = t("nation").orderBy("n_nationkey").collect()  # 25
    d = scans.in_memory(_spark(t), [(str(r.n_nationkey), f"int {r.n_name}") for r in rows])
    known = curate.checked([r.n_name for r in rows], [r.n_name for r in rows])
    return curate.fanned_out(d, known).where(F.col("func_def") == F.concat(F.lit("int "), F.col("technique"))).select("fname", "func_def", "technique")
