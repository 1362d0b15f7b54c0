"""Table functions that SQL calls."""

import pytest

from quern.operators import batching


def test_places_in_batches(spark):
    batching.register_places(spark)
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9), ("a", 2), (None, 5), (None, None)], "k string, n int")
    call = "SELECT * FROM placed_in_batches(TABLE({rows}) PARTITION BY k ORDER BY (n), %s)"
    got = {tuple(r) for r in spark.sql(call % 2, rows=rows).collect()}
    assert got == {("a", 1, 0, 0), ("a", 2, 0, 1), ("a", 3, 1, 0), ("b", 9, 0, 0), (None, None, 0, 0), (None, 5, 0, 1)}
    none = spark.sql(call % 2, rows=rows.where("n > 99"))
    assert none.columns == ["k", "n", "batch", "slot"] and none.isEmpty()
    for bad, size in ((rows, 0), (rows.withColumnRenamed("k", "slot").selectExpr("slot", "slot AS k", "n"), 2)):
        with pytest.raises(Exception, match="batch"):
            spark.sql(call % size, rows=bad).collect()
