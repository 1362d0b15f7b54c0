"""Order of arrival, co-located joins, chunks by an index, passes over the input, and the package on workers."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern.operators import curate
from quern.plans import catalog, jobs
from quern.sources import scans, sinks

ROOT, SF = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def saved(df, path):
    df.write.mode("append").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


# --- arrival ---


def test_the_last_to_arrive_wins_and_rows_stay(spark, tmp_path):
    order = [("a", "z"), ("b", "1"), ("a", None), ("a", "y"), ("b", None), (None, "n"), ("c", "k"), ("c", "a")]
    spark.createDataFrame([(*x, i) for i, x in enumerate(order)], "k string, v string, i int").repartitionByRange(3, "i").sortWithinPartitions("i").drop("i").write.parquet(str(tmp_path / "side"))
    side = spark.read.parquet(str(tmp_path / "side"))
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3), ("c", 4), (None, 5), ("d", 6)], "k string, n int")
    got = curate.enriched(left, side, ["k"], ["v"], default="-").collect()
    assert sorted((r.k or "", r.n, r.v) for r in got) == [("", 5, "-"), ("a", 1, "y"), ("a", 1, "y"), ("b", 2, "-"), ("c", 3, "a"), ("c", 4, "a"), ("d", 6, "-")]
    cut = curate.reduced(curate.in_arrival(side), left.where("k = 'a'"), "k")
    assert cut.columns == ["k", "v", curate.ARRIVAL] and {r.v for r in curate.enriched(left.where("k = 'a'"), cut, ["k"], ["v"]).collect()} == {"y"}
    assert curate.enriched(left, side.where("k = 'none'"), ["k"], ["v"]).count() == 7
    with pytest.raises(AnalysisException):
        curate.enriched(left, left.groupBy("k").agg(F.max("n").alias("v")), ["k"], ["v"]).collect()


def test_a_table_augments_itself_without_multiplying(spark, tmp_path):
    rows = [("s", "f", "old"), ("s", "f", "mid"), ("s", "f", "aaa"), ("s", "g", None), ("", "h", "x")]
    df = saved(spark.createDataFrame(rows, "exebench_split string, fname string, c_deps string").coalesce(1), tmp_path / "own")
    got = jobs.augmented(df, df, ["c_deps"]).collect()
    assert sorted((r.fname, r.c_deps) for r in got) == [("f", "aaa")] * 3 + [("g", ""), ("h", "")]
    by_column = jobs.augmented(df, df, ["c_deps"], order="c_deps").collect()
    assert {r.c_deps for r in by_column if r.fname == "f"} == {"old"}


# --- co-located joins and chunks ---


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 300).alias("k"), F.col("id").alias("n"))
    side = spark.range(900).select((F.col("id") % 450).alias("k"), F.col("id").alias("v"))
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in (("t_rows", rows), ("t_side", side)):
            sinks.write_bucketed(df, name, str(tmp_path / name), ["k"], 4)
        joined = curate.enriched(spark.table("t_rows"), spark.table("t_side"), ["k"], ["v"], order="v")
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
        spark.sql("DROP TABLE t_side")  # another session's catalog doesn't know it
        again = scans.bucketed(spark, "t_side", str(tmp_path / "t_side"), "k bigint, v bigint", ["k"], 4)
        told = curate.enriched(scans.bucketed(spark, "t_rows", "", "", ["k"], 4), again, ["k"], ["v"], order="v")
        assert "Exchange" not in plan(told)
        want = {k: str(k + 450) for k in range(300)}
        for df in (joined, told):
            got = df.collect()
            assert len(got) == 2000 and all(r.v == want[r.k] for r in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
        for name in ("t_rows", "t_side"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_chunk_opens_only_the_files_that_hold_it(spark, tmp_path):
    path = str(tmp_path / "a b%20c")
    spark.range(1000).repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(path)
    index = scans.row_index(spark, path)
    parts = index.orderBy("before").collect()
    assert sum(r["rows"] for r in parts) == 1000 and [r.before for r in parts] == [sum(x["rows"] for x in parts[:i]) for i in range(len(parts))]
    index.write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    for skip, most in ((0, 5), (95, 20), (990, 50), (2000, 3), (0, 1000), (7, 0)):
        rows = scans.chunk(spark, path, skip, most, stored)
        assert sorted(r.id for r in rows.collect()) == list(range(1000))[skip : skip + most]
        assert "Exchange" not in plan(rows)
    assert len(scans.chunk(spark, path, parts[3].before, 2, stored).inputFiles()) == 1


# --- one pass ---


def counting(df, path):
    """df, and how many of its rows have gone by."""

    def each(batches):
        for b in batches:
            with open(path, "a") as f:
                f.write("x" * len(b))
            yield b

    return df.mapInPandas(each, df.schema), lambda: Path(path).stat().st_size


def test_writing_and_counting_are_one_pass(spark, tmp_path):
    code = F.when(F.col("id") % 3 != 0, F.concat(F.lit("/* BEGIN FUNCTION-DEF f */\n"), F.col("id").cast("string"), F.lit("\n/* END FUNCTION-DEF f */"))).otherwise("none")
    rows = spark.range(60).select(F.lit("f").alias("fname"), code.alias("obfuscated_c"))
    own, seen = counting(rows, tmp_path / "clean")
    assert {r.skip_reason: r.n for r in jobs.clean(spark, own, str(tmp_path / "c"), 7).collect()} == {"kept": 40, "no_function": 20}
    assert seen() == 60 and scans.rows_in(spark, str(tmp_path / "c/data")) == 40
    assert json.loads(spark.read.text(str(tmp_path / "c/info")).first()[0]) == {"kept": 40, "no_function": 20}
    own, seen = counting(rows, tmp_path / "tests")
    report = jobs.prepare_tests(spark, [own], str(tmp_path / "t")).first()
    one = rows.where("obfuscated_c <> 'none'").agg(F.sum(F.length("obfuscated_c"))).first()[0]
    assert seen() == 60 and report.chars_before == one == report.chars_after and report.saved_pct == 0
    own, seen = counting(spark.range(30).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("fname"), F.concat(F.lit("int f"), F.col("id").cast("string")).alias("func_def")), tmp_path / "generate")
    asked = tmp_path / "asked"

    def tool(source, technique, seed):
        with open(asked, "a") as f:
            f.write("x")
        return source if technique == "A" else ""

    stats = {r.name: r.total for r in jobs.generate(own, tool, str(tmp_path / "g"), ["A", "B"], least_chars=1).collect()}
    assert stats == {"samples_per_transform.A": 30, "samples_per_transform.B": 0, "rows_seen": 30, "samples_written": 30, "failures": 30}
    assert seen() == 30 and asked.stat().st_size == 60
    nothing = jobs.clean(spark, rows.where("fname = 'none'"), str(tmp_path / "e"))
    assert nothing.isEmpty()


def test_a_model_is_asked_once_for_a_row(spark, tmp_path):
    """A model that never says the same twice: what is reported is about what is saved."""
    asked = str(tmp_path / "asked")

    def predict(texts):
        import uuid

        with open(asked, "a") as f:
            f.write("x" * len(texts))
        return [uuid.uuid4().hex for _ in texts]

    def check(row):
        with open(asked + "-checks", "a") as f:
            f.write("x")
        return [{"seq": row["seq"], "syntax_valid": row["prediction"][0] in "01234567", "compiles": False}]

    rows = spark.range(40).select("id", F.col("id").cast("string").alias("fname"), F.lit("a b").alias("source"), F.lit("c").alias("reference"))
    told, report, skipped = jobs.evaluated(rows, predict, check=check)
    valid = sum(r.prediction[0] in "01234567" for r in told.collect())
    assert report.first().syntax_valid == valid and report.first().n == 40 and {r.prediction for r in told.collect()} == {r.prediction for r in told.collect()}
    assert skipped.first().n == 40 and Path(asked).stat().st_size == 40
    prompts = spark.range(10).select(F.col("id").cast("string").alias("fname"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"), F.lit("t").alias("truth"))
    Path(asked + "-checks").unlink()
    hist = jobs.preference_set(prompts, lambda p, n: [p + "0" * i for i in range(n)], lambda row: check({**row, "prediction": "0"}), str(tmp_path / "p"), n=3)
    assert [(r.best_score, r.n) for r in hist.collect()] == [(1, 10)] and Path(asked + "-checks").stat().st_size == 30


# --- workers ---


def test_workers_get_the_package(tmp_path):
    """From another folder, with nothing that leads Python to the repository but the driver's own path."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from quern.plans import catalog, trips
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("build_matrix", "io_decode", "linked_programs"):
    assert catalog.QUERIES[name](spark, {SF!r}).collect(), name
from quern.operators import routing
from pyspark.sql import functions as F
import public_tokenizers
ids = spark.range(1).select(routing.encoded(F.lit("a b"), public_tokenizers.path("byte_bpe_50k.json")).alias("ids")).first().ids
assert len(ids) == 2
"""
    import os

    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=False, timeout=200)
    assert not done.returncode, done.stderr[-2000:]


def test_queries_of_arrival_hold_rows_whose_last_is_not_the_greatest(spark):
    """Else the twin couldn't tell the last from the greatest."""
    o = spark.read.parquet(f"{SF}/orders.parquet")
    by = o.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct((F.col("o_orderkey") * 7919) % 10007, "o_orderkey")).alias("last"), F.max("o_orderpriority").alias("greatest"), F.max_by("o_orderpriority", "o_orderkey").alias("newest"))
    assert by.where("last <> greatest").count() > 10 and by.where("last <> newest").count() > 10
    assert catalog.QUERIES["augment_bucketed"](spark, SF).count() == spark.read.parquet(f"{SF}/customer.parquet").count()
