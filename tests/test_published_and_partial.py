"""Files that are left out and named, publishing by pointer, and partial aggregates that grow by shard."""

import pytest
from pyspark.sql import functions as F

from quern.functions import metrics
from quern.plans import jobs
from quern.sources import scans, sinks


def test_damaged_shards_are_named(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("k"))
    root = tmp_path / "some shards"  # a blank in the path
    df.coalesce(1).write.parquet(str(root / "a"))
    whole = next((root / "a").glob("part-*.parquet"))
    (root / "a" / "part-cut.parquet").write_bytes(whole.read_bytes()[:-20])
    (root / "a" / "part-empty.parquet").write_bytes(b"")
    df.where("k < 0").coalesce(1).write.parquet(str(root / "b"))  # no rows: not damaged
    told = {r.file.rsplit("/", 1)[1]: (r.rows, r.reason) for r in scans.probed(spark, [str(root), str(tmp_path / "none")], "part-*.parquet").collect()}
    assert told[whole.name] == (50, None) and len(told) == 4
    bad = {r.file.rsplit("/", 1)[1] for r in scans.skipped_shards(spark, [str(root)], "part-*.parquet").collect()}
    assert bad == {"part-cut.parquet", "part-empty.parquet"} and all(told[b][0] is None and told[b][1] for b in bad)
    assert scans.shards(spark, [str(root)], df.schema, "part-*.parquet", tolerant=True).count() == 50
    with pytest.raises(Exception, match="part-cut"):
        scans.shards(spark, [str(root)], df.schema, "part-*.parquet").collect()
    assert scans.probed(spark, [str(tmp_path / "none")]).isEmpty() and scans.skipped_sidecars(spark, [str(tmp_path / "none")]).isEmpty()


def test_merging_names_what_it_left_out(spark, tmp_path):
    spark.range(30).select(F.col("id").alias("k")).coalesce(1).write.parquet(str(tmp_path / "a"))
    (tmp_path / "a" / "broken.parquet").write_text("no parquet")
    (tmp_path / "a" / "dataset_info.json").write_text('{"generation_stats": {}}')
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "dataset_info.json").write_text("no json")
    jobs.merge(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "out"), "k").collect()
    assert scans.rows_in(spark, str(tmp_path / "out" / "data")) == 30
    left = {"/".join(r.file.split("/")[-2:]) for r in spark.read.json(str(tmp_path / "out" / "skipped")).collect()}
    assert left == {"a/broken.parquet", "b/dataset_info.json"}


def test_pointers(spark, tmp_path):
    root, df = str(tmp_path / "t"), spark.range(9)
    assert scans.pointer(spark, root) == (0, None)
    assert sinks.publish(df.limit(1), root, "v1") == 1 and scans.versioned(spark, root).count() == 1
    assert sinks.publish(df.limit(2), root, "a2", 1) == 2 and scans.versioned(spark, root).count() == 2  # not by name
    for after in (0, 1, 5):
        with pytest.raises(FileExistsError):
            sinks.publish(df, root, "late", after)
        assert not (tmp_path / "t" / "late").exists() and scans.versioned(spark, root).count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.point(spark, root, "never", 2)
    (tmp_path / "t" / "_pointers" / "00000003").write_text("")  # its publisher is still at it, or was lost
    assert scans.pointer(spark, root) == (3, "a2") and scans.versioned(spark, root).count() == 2
    with pytest.raises(FileExistsError):
        sinks.publish(df, root, "second", 2)
    assert sinks.publish(df, root, "v4") == 4 and scans.versioned(spark, root).count() == 9 and scans.versioned(spark, root, "v1").count() == 1


def test_two_publishers_at_one_time(spark, tmp_path, monkeypatch):
    """Both saw the same last pointer when they came to put theirs: the file system lets one."""
    root = str(tmp_path / "t")
    sinks.publish(spark.range(1), root, "v1")
    monkeypatch.setattr(scans, "pointer", lambda *a: (1, "v1"))
    assert sinks.publish(spark.range(2), root, "v2", 1) == 2
    with pytest.raises(FileExistsError):
        sinks.publish(spark.range(3), root, "v3", 1)
    monkeypatch.undo()
    assert scans.pointer(spark, root) == (2, "v2") and not (tmp_path / "t" / "v3").exists()


def test_partials_grow_by_shard(spark, tmp_path):
    pairs = [("the cat sat on the mat today", "the cat sat on a mat today"), ("one two three four five", "one two three four six"), ("x", "y"), (None, "a b c d"), ("a b c d e", "a b c d e")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs * 4)], "k int, p string, r string")
    asked = []

    def step(rows):
        asked.append(rows.count())
        return rows.groupBy("shard").agg(metrics.bleu_sums(metrics.bleu_parts(F.col("p"), F.col("r"))).alias("parts"))

    path, shards = str(tmp_path / "sums"), tmp_path / "shards"
    assert scans.partials(spark, path) is None
    for lot in range(3):
        df.where(F.col("k") % 3 == lot).coalesce(1).write.mode("append").parquet(str(shards))
        assert len(sinks.add_partials(spark, str(shards), path, step)) == 1
    assert sinks.add_partials(spark, str(shards), path, step) == [] and asked == [7, 7, 6]
    want = df.agg(metrics.bleu_score(metrics.bleu_parts(F.col("p"), F.col("r")))).first()[0]
    assert scans.partials(spark, path).agg(metrics.bleu_score(F.col("parts"))).first()[0] == pytest.approx(want)
    next((tmp_path / "sums").glob("added=*/_SUCCESS")).unlink()  # an addition that never ended is read and added again
    assert scans.partials(spark, path).count() == 2 and len(sinks.add_partials(spark, str(shards), path, step)) == 1
    assert scans.partials(spark, path).agg(metrics.bleu_score(F.col("parts"))).first()[0] == pytest.approx(want)
