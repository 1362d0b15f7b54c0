"""Nested comparison against its definition, models kept by workers, and keyed state over streams."""

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.functions import asm
from quern.operators import curate, external, nested
from quern.streaming import increments


def value(rng, depth=3):
    kind = rng.choice("nnnsbzlo" if depth else "nnsbz")
    if kind == "l":
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if kind == "o":
        return {rng.choice(["a", "b", ".k1:a", "a.i0", ""]): value(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    return {"n": rng.choice([0, 1, 2, 2000, 2001, 2.0, 2000.0, 2.0005, -1.5, 1e300, 10**25, 10**25 + 1, 0.0]), "s": rng.choice(["", "x", "1", "true"]), "b": rng.random() < 0.5, "z": None}[kind]


def changed(rng, v):
    if isinstance(v, list) and v and rng.random() < 0.8:
        i = rng.randrange(len(v))
        return [changed(rng, x) if k == i else x for k, x in enumerate(v)]
    if isinstance(v, dict) and v and rng.random() < 0.8:
        i = rng.choice(list(v))
        return {k: changed(rng, x) if k == i else x for k, x in reversed(v.items())}
    if isinstance(v, float):
        return v * rng.choice([1.0005, 0.9995, 1.01, -1])
    return rng.choice([v, v, value(rng, 1)])


def test_nested_values_against_the_definition(spark):
    rng = random.Random(11)
    rows = [(i, json.dumps(a), json.dumps(changed(rng, a))) for i in range(250) if (a := value(rng)) is not None or True]
    rows += [(1000, "bad", "1"), (1001, "1", None), (1002, None, None), (1003, "bad", "bad"), (1004, "[1, 2]", "[1,2]"), (1004, "[[]]", "[{}]"), (1005, "true", "1"), (1006, "false", "0.0"), (1007, "[1]", "[1, null]")]
    df = spark.createDataFrame(rows, "id long, l string, r string").withColumn("path", F.lit("clash")).withColumn("side", F.lit(3))
    got = nested.json_alike(df, "l", "r")
    assert got.columns == [*df.columns, "same"]
    found = got.collect()
    assert len(found) == len(rows) and all(r.same == (None if r.l is None else asm.json_alike(r.l, r.r)) for r in found)
    assert {r.same for r in found} == {True, False, None} and sum(r.same is False for r in found) > 50
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert nested.json_alike(df.where("id < 0"), "l", "r").isEmpty()


def test_odd_json_texts_against_the_definition(spark):
    """What follows a value, numbers in no right form or as names, marks within strings, and numbers of any length."""
    odd = ["1 2", '{"a": 1} x', "[1],[2]", "[1]]", "[1]\x00", '1 "', "true1", "01", "[-]", "[1e]", "{1:2}", '["abc 1]', '[1"a"]', '["a"1]', "1e400", "1e401", "-1e400", "-0", "0", "-0.0", "1" * 40, "1" * 39 + "2", "1" * 39 + "2.0", '"2|2"', "2", '"|2"', '"#"', "[2]", '["#"]', '"\\u0061\\/"', '"a/"', "true", "1", "1.0005", "12345678901234567890.0", "12345678901234567891"]
    df = spark.createDataFrame([(a, b) for a in odd for b in odd], "l string, r string")
    found = nested.json_alike(df, "l", "r").collect()
    assert [r for r in found if r.same != asm.json_alike(r.l, r.r)] == [] and len(found) == len(odd) ** 2
    named = df.limit(3).toDF("_a", "_x")
    assert nested.json_alike(named, "_a", "_x").columns == ["_a", "_x", "same"]
    deep = ["[" * 1000 + x + "]" * 1000 for x in ("1.0", "1.0001", "2")]
    df = spark.createDataFrame([(deep[0], x) for x in (*deep, deep[0] + "]")], "l string, r string")
    assert [r.same for r in nested.json_alike(df, "l", "r").collect()] == [True, True, False, None]


def test_a_worker_keeps_its_model(spark, tmp_path):
    made, sizes = str(tmp_path / "made"), str(tmp_path / "sizes")

    def load():
        with open(made, "a") as f:
            f.write("x")

        def predict(texts):
            with open(sizes, "a") as f:
                f.write(f"{len(texts)} {min(map(len, texts))} {max(map(len, texts))}\n")
            return [t.upper() for t in texts]

        return predict

    text = F.when(F.col("id") % 50 == 7, F.lit(None)).when(F.col("id") % 50 == 8, F.lit("a b c d")).otherwise(F.repeat(F.lit("x"), (F.col("id") % 20 + 1).cast("int")))
    df = spark.range(0, 400, 1, 2).select(F.col("id").alias("seq"), text.alias("t")).withColumn("n", F.length("t"))
    got = external.lifted(df, None, "t", 3, batch=8, length="n", load=load)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
    rows = {r.seq: r.prediction for r in got.collect()}
    assert rows == {i: "" if i % 50 in (7, 8) else "X" * (i % 20 + 1) for i in range(400)}
    batches = [tuple(map(int, x.split())) for x in Path(sizes).read_text().split("\n") if x]
    assert sum(b[0] for b in batches) == 384 and max(b[0] for b in batches) == 8 and all(b[2] - b[1] <= 2 for b in batches)
    assert Path(made).stat().st_size <= spark.sparkContext.defaultParallelism + 2 < len(batches)


def test_streaks_wait_for_the_watermark(spark, tmp_path):
    """Runs cross arrivals, rows come in any order within a day, and a row later than that is dropped."""
    start, rng = datetime(2024, 1, 1), random.Random(2)
    rows = [(i, start + timedelta(hours=3 * i), rng.randrange(4), rng.random() < 0.6) for i in range(160)]
    schema = "id long, ts timestamp, k long, bad boolean"
    arrivals = [rows[:70], [*rows[78:120], *rows[70:78]], [*rows[120:], (900, start - timedelta(days=9), 1, True), (999, start + timedelta(days=90), 77, False)]]
    dropped = 0
    for part in arrivals:
        rng.shuffle(part)
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = increments.arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        q = increments.maintained(increments.streaks(stream, "ts", "k", "id", F.col("bad"), 4), lambda b: b, str(tmp_path / "out"), str(tmp_path / "marks"))
        q.awaitTermination()
        dropped += increments.late_dropped(q)
    got = {r.key: r.stop_at for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.k: r.stop_at for r in curate.fail_streak_stop(spark.createDataFrame(rows, schema), "id", F.col("bad"), 4, group="k").collect()}
    assert got == want and len(want) > 1 and dropped == 1


@pytest.mark.parametrize("name", ["stream_sessions", "stream_distinct"])
def test_streams_equal_tables(spark, name):
    import duckdb

    from quern.plans import catalog, trips  # noqa: F401

    con = duckdb.connect()
    con.sql("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
