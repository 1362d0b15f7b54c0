"""Operators on small tables, sources and sinks, programs, and the registered queries against SQL."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.operators import batching, curate, external
from quern.sources import scans, sinks
from quern.streaming import increments


def test_enrichment_keeps_rows_and_takes_the_last(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3), (None, 4)], "k string, id int")
    side = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), (None, "never", 3)], "k string, v string, seq int")
    got = {r.id: r.v for r in curate.enriched(left, side, ["k"], ["v"], order="seq").collect()}
    assert got == {1: "new", 2: "new", 3: "", 4: ""}
    assert curate.reduced(side, left, "k").count() == 2


def test_split_is_exact_and_a_partition(spark):
    df = spark.range(997).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("fn"))
    s = curate.stratified(df, "g", "id", 0.1)
    assert s.count() == 997 and {r.n for r in s.where("split = 'test'").groupBy("g").agg(F.count("*").alias("n")).collect()} == {33}
    safe = curate.stratified(df, "g", "id", 0.1, group="fn")
    assert safe.groupBy("g", "fn").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    assert curate.stratified(df.limit(2).withColumn("g", F.lit(1)), "g", "id", 0.1).where("split = 'test'").count() == 1


def test_numbers_without_one_task(spark):
    df = spark.range(0, 20000, 2).select(F.col("id").alias("k"))
    got = curate.numbered(df.repartition(3), "k")
    ties = curate.numbered(df.select((F.col("k") % 4).alias("k")), "k")
    assert {r["count"] for r in ties.groupBy("k").count().collect()} == {5000} and ties.select("rn").distinct().count() == 10000
    assert got.where("rn <> k / 2 + 1").isEmpty() and got.count() == 10000
    assert [r.k for r in curate.chunk(df, "k", 3, 2).orderBy("k").collect()] == [6, 8]


def test_check_statistics(spark):
    assert curate.check_stats(spark.createDataFrame([], schemas.CHECKS)).first().syntax_valid_pct == 0
    rows = [(True, True, None, 0, 0), (True, False, None, 0, 0), (False, False, None, 0, 0), (True, True, True, 5, 5)]
    df = spark.createDataFrame([(a, "", b, "", b, "", c, "", d, e) for a, b, c, d, e in rows], schemas.CHECKS)
    s = curate.check_stats(df).first()
    assert (s.total, s.syntax_valid, s.compiles, s.functional_tested, s.io_pass_pct) == (4, 3, 2, 1, 100)
    many = spark.range(30).select(F.col("id").alias("seq"), F.lit(False).alias("syntax_valid"), F.lit("e").alias("syntax_error"), F.lit(False).alias("compiles"), F.lit("c").alias("compile_error"))
    assert curate.first_errors(many, "seq").count() == 20


def test_merged_statistics(spark, tmp_path):
    for i, body in enumerate(('{"generation_stats": {"rows_seen": 3, "samples_per_transform": {"a": 1}}}', '{"generation_stats": {"rows_seen": 4, "samples_per_transform": {"b": 2}}}', "{}", "not json")):
        (tmp_path / f"c{i}").mkdir()
        (tmp_path / f"c{i}" / "dataset_info.json").write_text(body)
    got = {r.name: r.total for r in curate.merged_stats(scans.sidecars(spark, [str(tmp_path), str(tmp_path / "none")])).collect()}
    assert got["rows_seen"] == 7 and got["samples_per_transform.a"] == 1 and got["samples_per_transform.b"] == 2 and got["failures"] == 0


def test_preferences(spark):
    rows = [("p", 0, 2, "x"), ("p", 1, 2, "y"), ("p", 2, 0, "u"), ("p", 3, 0, "v"), ("q", 0, 0, "a"), ("q", 1, 0, "b"), ("r", 0, 1, "a"), ("r", 1, 1, "b")]
    best = curate.best_worst(spark.createDataFrame(rows, "prompt string, pos int, score int, text string"), "prompt", "score", "pos", "text")
    got = {r.prompt: (r.chosen, r.rejected, r.score_chosen, r.score_rejected, r.branch) for r in curate.preferences(best.withColumn("ref", F.lit("T")), "ref").collect()}
    assert got == {"p": ("x", "v", 2, 0, "ranked"), "q": ("T", "b", 99, 0, "fallback")}
    assert curate.preferences(best.withColumn("ref", F.lit("T")), "ref", ground_truth=True).count() == 3


def test_failure_streaks(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate([1, 1, 0, 1, 1, 1, 0])], "i int, bad int")
    assert curate.fail_streak_stop(df, "i", F.col("bad") == 1, 3).first().stop_at == 5
    assert curate.fail_streak_stop(df, "i", F.col("bad") == 1, 4).isEmpty()
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), int(rng.random() < 0.8)) for i in range(600)] + [(1000 + i, "d", 1) for i in range(40)] + [(i, None, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "i int, g string, bad int").repartition(5)

    def stop(xs, most):
        run = 0
        for i, bad in xs:
            run = run + 1 if bad else 0
            if run == most:
                return i
        return None

    for most in (1, 4, 9, 35, 500):
        got = curate.fail_streak_stop(df, "i", F.col("bad") == 1, most, group="g").collect()
        want = {g: stop(sorted((i, b) for i, h, b in rows if h == g), most) for g in ("a", "b", "c", "d", None)}
        assert {r.g: r.stop_at for r in got} == {g: x for g, x in want.items() if x is not None}
        whole = curate.fail_streak_stop(df.where("g is not null"), "i", F.col("bad") == 1, most).collect()
        assert [r.stop_at for r in whole] == [x for x in [stop(sorted((i, b) for i, h, b in rows if h), most)] if x is not None]


def test_full_batches(spark):
    df = spark.range(103).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g")).repartition(4)
    got = curate.full_batches(df, ["id"], 8, "g").collect()
    want = {(g, k): ids[8 * k : 8 * k + 8] for g in (None, 1, 2) for ids in [[i for i in range(103) if (i % 3 or None) == g]] for k in range(len(ids) // 8)}
    found = {}
    for r in sorted(got, key=lambda r: r.id):
        found.setdefault((r.g, r.batch), []).append(r.id)
    assert found == want
    assert curate.full_batches(df, ["id"], 50).count() == 100 and curate.full_batches(df, ["id"], 200).isEmpty()


def test_loops_that_stop(spark):
    df = spark.range(100).select("id", (F.col("id") % 3 == 0).alias("fit"))
    assert tuple(curate.overall_first(df, "id", F.col("fit"), 5).first()) == (5, 16)
    assert tuple(curate.overall_first(df, "id", F.col("fit"), 500).first()) == (34, 100)


def test_collation(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [4, 5], [6, 7, 8]), (1, [1, 2], [4, 5, 6], [7]), (1, None, None, None)], "b int, prompt array<int>, chosen array<int>, rejected array<int>")
    rows = batching.preference_collated(df, "b").collect()
    assert len(rows) == 2
    short = next(r for r in rows if r.prompt == [1, 2])
    assert short.prompt_ids == [1, 2, 1] and short.rejected_labels == [7, -100, -100] and short.rejected_decoder_input_ids == [2, 7, 1]
    assert batching.preference_collated(df.where("prompt is null"), "b").isEmpty()
    got = batching.length_batches(spark.range(20).select("id", (20 - F.col("id")).alias("n")), "id", "n", 2, 4).collect()
    assert len({r.batch_id for r in got}) == 10 and all(r.buf == r.id // 8 for r in got)


def test_shards(spark, tmp_path):
    df = spark.range(95).select(F.col("id").alias("k"))
    sinks.write_exact_shards(df, str(tmp_path / "exact"), "k", 10)
    counts = spark.read.parquet(str(tmp_path / "exact")).groupBy("shard_id").count().orderBy("shard_id").collect()
    assert [r["count"] for r in counts] == [10] * 9 + [5]
    sinks.write_shards(df.coalesce(1), str(tmp_path / "some"), 40)
    assert sinks.compact(spark.read.parquet(str(tmp_path / "some")), str(tmp_path / "few"), "k", target_rows=50) == 2
    assert scans.rows_in(spark, str(tmp_path / "few")) == 95 and scans.rows_in(spark, str(tmp_path / "few" / "shard-00000.parquet")) == 50
    halves = df.withColumn("split", F.when(F.col("k") < 20, "test").otherwise("train"))
    assert sinks.write_named_splits(halves, str(tmp_path / "named"), 30, "k") == {"test": 1, "train": 3}
    assert sorted(p.name for p in (tmp_path / "named" / "train").glob("*.parquet")) == [f"train-{i:05d}-of-00003.parquet" for i in range(3)]
    assert [r.k for r in spark.read.parquet(str(tmp_path / "named" / "train" / "train-00002-of-00003.parquet")).orderBy("k").collect()] == list(range(80, 95))
    for k in (3, 7):
        df.limit(k).write.parquet(str(tmp_path / "staged"))
        sinks.published(spark, str(tmp_path / "staged"), str(tmp_path / "live"))
        assert spark.read.parquet(str(tmp_path / "live")).count() == k
    assert sinks.deleted(spark, str(tmp_path / "named"), "t*t") == 1 and not (tmp_path / "named" / "test").exists()
    for v in ("v1", "v2", "v10"):
        df.limit(int(v[1:])).write.parquet(str(tmp_path / "versions" / v))
    assert scans.versioned(spark, str(tmp_path / "versions"), "v1").count() == 1 and scans.versioned(spark, str(tmp_path / "versions")).count() == 2
    (tmp_path / "versions" / "LATEST").write_text("v10\n")
    assert scans.versioned(spark, str(tmp_path / "versions")).count() == 10
    assert scans.shards(spark, [str(tmp_path / "none")], schemas.PREDICTIONS).isEmpty()
    sinks.write_splits(df.withColumn("split", F.when(F.col("k") < 5, "test").otherwise("train")), str(tmp_path / "splits"))
    counts = spark.read.parquet(str(tmp_path / "splits")).groupBy("split").agg(F.count("*").alias("n"))
    assert "| test | 5 |" in sinks.card(counts, "t") and scans.split(spark, str(tmp_path / "splits"), "test").count() == 5
    (tmp_path / "p.jsonl").write_text('{"fname": "f", "prediction": "a", "reference": "b"}\n\n')
    assert scans.predictions(spark, str(tmp_path / "p.jsonl")).count() == 1
    sinks.write_metadata(spark, {"a": 1}, str(tmp_path / "meta"))
    assert json.loads(spark.read.text(str(tmp_path / "meta")).first()[0]) == {"a": 1}
    sinks.replace_partitions(df.limit(1).withColumn("split", F.lit("test")), str(tmp_path / "splits"), "split")
    assert scans.split(spark, str(tmp_path / "splits"), "train").count() == 90


def test_old_files_read_with_nulls(spark, tmp_path):
    spark.createDataFrame([("f", 3)], "fname string, tigress_seed int").write.parquet(str(tmp_path / "old"))
    row = schemas.blank_metadata(scans.pairs(spark, str(tmp_path / "old"))).first()
    assert row.tigress_seed == 3 and row.clean_asm is None and row.io_pairs == ""


def test_programs(spark):
    none = external.Tool("no-such-program-here", ("{input}",))
    assert external.check({"prediction": "x", "seq": 1}, assembler=none)[0]["syntax_valid"] is None
    true, false = external.Tool("true", ()), external.Tool("false", ())
    assert external.check({"prediction": "x", "seq": 1}, assembler=true, compiler=false)[0]["compiles"] is False
    df = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, prediction string")
    rows = external.run(df, lambda r: external.check(r, 1, assembler=true) if r["seq"] == 1 else 1 / 0, external.CHECKED).orderBy("seq").collect()
    assert rows[0].syntax_valid is True and "ZeroDivisionError" in rows[1].error
    assert external.io_verdict([(1, 1), (2, 3), (3, 3)], lambda x: x if x < 3 else 1 / 0) == {"functional_pass": False, "io_pass_count": 1, "io_total_count": 3}
    assert external.io_verdict([], abs)["functional_pass"] is None


def test_declarations():
    ir = "define i32 @f() {\n  %a = load i64, i64* @g\n  %b = call i8* @h(i32 1)\n  ret i32 0\n}"
    seen = []

    def tool(text, suffix):
        seen.append(text)
        for name in ("@g", "@h"):
            if not any(line.startswith(("declare", name)) and name in line for line in text.split("\n")):
                return False, f"x: error: use of undefined value '{name}'"
        if "declare i8* @h(...)" in text:
            return False, "error: '@h' defined with type 'i8* (...)*' but expected 'i8* (i32)*'"
        return True, ""

    text, fine, _ = external.with_declarations(ir, tool)
    assert fine and "@g = external global i64\n" in text and "declare i8* @h(i32)\n" in text and text.endswith(ir) and text.count("@h(") == 2
    assert external.with_declarations(ir, lambda t, s: (False, "other"))[1:] == (False, "other")
    assert external.declaration("@v", "[4 x i32]*", "") == "@v = external global [4 x i32]" and external.declaration("@n", None, "") == "declare void @n(...)"
    assert external.undeclared("declare void @a(...)\n@ab = external global i8\nx @a", "@a") == "@ab = external global i8\nx @a"
    uses = {"@p": ("%2 = call i32 (i8*, ...) @p(i8* %1)", "declare i32 @p(i8*, ...)"), "@q": ("tail call noalias i8* @q(i32 3)", "declare i8* @q(...)"), "@u": ("call void @f(<4 x i32>* @t, {i8, i32}* @u)", "@u = external global {i8, i32}"),
            "@o": ("store i32 3, ptr @o", "@o = external global i8"), "@s": ("load %struct.a*, %struct.a** @s", "@s = external global %struct.a*"), "%a": ("", "%a = type opaque")}
    assert {k: external.declaration(k, None, line) for k, (line, _) in uses.items()} == {k: v for k, (_, v) in uses.items()}


def test_linked_programs(tmp_path):
    """A text that is a shell program: assembling and compiling copy it, linking makes it a program beside its wrapper."""
    fine, copy = external.Tool("true", ()), external.Tool("cp", ("{input}", "{output}"))
    link = external.Tool("sh", ("-c", "cp {input} {output} && chmod +x {output} && grep -q deps.c {wrapper}"))
    row = {"seq": 1, "prediction": "#!/bin/sh\nsed 's/1/2/' $1 > $2", "c_deps": "int x;", "func_c_signature": "extern int f()", "cpp_wrapper": 'extern "C" {\n#include "x"\n}\nint main;', "io_pairs": json.dumps({"input": [{"a": 1}, {"a": 3}], "output": [{"a": 2}, {"a": 4}]})}
    tools = {"assembler": fine, "compiler": copy, "linker": link}
    got = external.check(row, 3, **tools)[0]
    assert (got["links"], got["io_pass_count"], got["io_total_count"], got["functional_pass"], got["functional_detail"]) == (True, 1, 2, False, "1 of 2 pairs agree")
    assert external.check(row | {"io_pairs": json.dumps({"input": [{"a": 1}], "output": [{"a": 2}]})}, 3, **tools)[0]["functional_pass"] is True
    assert external.check(row | {"cpp_wrapper": "no deps"}, 3, **tools)[0]["links"] is False
    assert external.check(row | {"cpp_wrapper": None}, 3, **tools)[0]["links"] is None
    assert external.check(row | {"prediction": "#!/bin/sh\nexit 3"}, 3, **tools)[0]["io_pass_count"] == 0
    missing = external.check(row, 3, **(tools | {"linker": external.Tool("no-such-program-here", ())}))[0]
    assert missing["tool_missing"] and missing["links"] is None


def test_same_runs():
    run = lambda text: ["sh", "-c", text]
    assert external.same_runs(run("echo a; exit 3"), run("printf 'a\\n'; exit 3")) == (True, "")
    assert external.same_runs(run("echo a"), run("echo b")) == (False, "printed other things")
    assert external.same_runs(run("exit 1"), run("exit 2")) == (False, "returned 1 and 2")
    assert not external.same_runs(run("sleep 5"), run("true"), seconds=1)[0]


def test_more_programs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, prediction string")
    src = spark.createDataFrame([("f", "int f;", 7), ("zed", "int x;", 8)], "fname string, func_def string, seed long")
    rows = external.rewritten(src, lambda text, kind, seed: 1 / 0 if kind == "bad" else f"{text}{kind}{seed}", ["good", "bad"]).collect()
    assert {(r.fname, r.technique): r.code for r in rows} == {("f", "good"): "int f;good7", ("f", "bad"): None, ("zed", "good"): None, ("zed", "bad"): None}
    assert len(external.builds()) == 42 and len({b.key for b in external.builds()}) == 42
    lifted = external.lifted(df.withColumn("batch_id", F.lit(0)), lambda xs: [x.upper() for x in xs], "prediction", 5).orderBy("seq").collect()
    assert [r.prediction for r in lifted] == ["A", "B"]


def test_reasons(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abcdef",), (None,)], "x string")
    out = curate.with_reason(df, [("missing", F.coalesce("x", F.lit("")) == ""), ("short", F.length("x") < 3)])
    assert {r.skip_reason: r.n for r in curate.reason_counts(out).collect()} == {"missing": 2, "short": 1, "kept": 1}
    with pytest.raises(ValueError):
        curate.checked(["x"], curate.TECHNIQUES)


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).write.parquet(src)
    s = increments.arrivals(spark, src, spark.range(1).schema)
    q = increments.maintained(s, lambda b: b.where("id > 4"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_running_counts_and_sums_cross_ranges(spark):
    """A group over many ranges, one of a row, and the null group, with values that lack."""
    rows = [("a", i, None if i % 7 == 0 else float(i)) for i in range(1, 3001)] + [("b", 5, None), (None, 2, 1.5), (None, 1, None)]
    got = {(r.g, r.o): (r.seen, r.running) for r in curate.running(spark.createDataFrame(rows, "g string, o long, v double").repartition(4), "o", "v", "g").collect()}
    want, n, total = {}, {}, {}
    for g, o, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        n[g] = n.get(g, 0) + 1
        total[g] = total.get(g) if v is None else (total.get(g) or 0) + v
        want[g, o] = (n[g], total[g])
    assert got == want


def test_dear_columns_are_worked_out_once(spark):
    """Of rows that are split, sharded or dealt; a counter in a Python function tells."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def length(x):
        seen.add(1)
        return len(x)

    df = spark.range(500).select("id", length(F.col("id").cast("string")).alias("n"))
    assert curate.numbered(df, "id", dear=True).agg(F.sum("n"), F.max("rn")).first() == (1390, 500) and seen.value == 500
    assert batching.length_batches(df, "id", "n", 8).count() == 500 and seen.value == 1000
