"""That steps grow with their input, and no faster."""

import random
import sys

import pandas as pd
from pyspark.sql import functions as F

from quern.functions import asm, metrics, rewrites, text
from quern.operators import external
from quern.plans import catalog, trips  # noqa: F401  # trips registers its queries with the catalog's
from quern.sources import places, sinks
from quern.streaming import increments

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_functions_are_rewritten_once_for_a_row(spark):
    assert plan(catalog.QUERIES["asm_transforms"](spark, SF)).count("xxhash64(42") == 1


def test_lines_are_rewritten_together():
    text_ = "f:\n\t.cfi_startproc\n" + "\tadd x0, x0, #9\n" * 20_000 + "\tret\n\t.cfi_endproc"
    for seed in range(6):
        calls = []
        sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
        try:
            new = rewrites.obfuscated(text_, seed)
        finally:
            sys.setprofile(None)
        assert len(calls) < 4_000 and new.count("\n") > 20_000


def test_routed_texts_are_neither_multiplied_nor_sorted(spark):
    got = catalog.QUERIES["routed_pairs"](spark, SF)
    assert " Sort [" not in plan(got) and got.count() == 29


def test_a_large_table_is_not_written_by_one_task(spark, tmp_path):
    rows = lambda n: spark.range(n).select("id", F.repeat(F.md5(F.col("id").cast("string")), 8).alias("x"))
    for n, files in ((100, 1), (100_000, 2)):
        sinks.write_single(rows(n), str(tmp_path / str(n)))
        assert (len(list((tmp_path / str(n)).glob("part-*"))) > 1) == (files > 1)
        assert spark.read.parquet(str(tmp_path / str(n))).count() == n


def test_samples_by_whole_texts_are_those_by_lines(spark):
    parts = ["\t.globl f", ".global f ", "\t.type f, @function", "f: // -- a", "\t.cfi_startproc", "\tmov w0, #3 # x", "  ", "", "\t.text", "\t.size f, .-f", ".Lfunc_end0:", "\t.cfi_endproc // e", "\t.file \"a\"", "\tret\t ", "a\r\nb \x0b c ", "\t.section x", "$%rax"]
    rng = random.Random(5)
    rows = [("\n".join(rng.choice(parts) for _ in range(rng.randrange(14))), name) for name in ("f", "$f", "f\\") for _ in range(300)]
    df = spark.createDataFrame([(t.replace(" f", f" {n}"), n) for t, n in rows], "t string, n string")
    t, n, a = F.col("t"), F.col("n"), F.col("a")
    old = text.clean_whitespace(text.normalize_header(text.drop_directives(text.strip_comments(t, a)), n, a))
    got = df.withColumn("a", F.explode(F.array(F.lit(True), F.lit(False)))).select("t", "n", old.alias("old"), text.sample_form(t, n, a).alias("new"))
    assert [r for r in got.collect() if r.old != r.new] == []
    assert "lambdafunction(NOT RLIKE" not in plan(df.select(asm.preprocessed(t, n)))


def test_units_are_cut_once_for_lifting(spark):
    assert plan(catalog.QUERIES["lift_job"](spark, SF)).count("cfi_endproc") == 0


class Bare:
    """A table that gives back the function it would map, and its session."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInPandas(self, f, schema):
        return f


def test_results_are_given_on_before_a_batch_is_through(spark):
    each = external.run(Bare(spark), lambda row: [{"id": row["id"], "k": k} for k in range(42)], "id bigint, k bigint, error string")
    parts = list(each(iter([pd.DataFrame({"id": range(1000)})])))
    assert sum(map(len, parts)) == 42_000 and max(map(len, parts)) <= 42 * external.SLICE


def test_a_batch_of_a_key_is_one_entry_of_state():
    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def get(self):
            return None

        def exists(self):
            return False

        def __getattr__(self, what):
            return lambda *a: calls.append((self.name, what))

    class Handle:
        def getListState(self, name, schema):
            return State(name)

        getValueState = getListState

        def registerTimer(self, at):
            calls.append(("timer", at))

    one = increments._Streaks(3)
    one.init(Handle())
    list(one.handleInputRows((1,), iter([pd.DataFrame({"at_": range(500), "place_": range(500), "bad_": [True] * 500})]), None))
    assert calls == [("waiting", "appendValue"), ("timer", 500)]


def test_matches_are_sorted_without_a_function(spark):
    df = spark.createDataFrame([("a b a", "a b c")], "p string, r string")
    got = df.select(metrics.bleu_parts(F.col("p"), F.col("r")).alias("b"))
    assert "array_sort(" not in plan(got) and list(got.first().b.match) == [2, 1, 0, 0]


def test_nested_values_are_compared_within_their_row(spark, monkeypatch):
    monkeypatch.setattr(places, "scratch", None)  # nothing is written
    got = plan(catalog.QUERIES["io_compare_nested"](spark, SF))
    assert "Exchange" not in got and "Sort" not in got
