"""Length-bucketed batches and padding."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quern.functions.arrays import mask, padded, shifted
from quern.operators.curate import numbered
from quern.sources.shipping import ship


def length_batches(df: DataFrame, key: str, length: str, batch: int, buffers: int = 4) -> DataFrame:
    """df with rn, buf, batch_id and slot: rows in arrival order fill buffers of so many batches, each sorted by length and cut.

    A buffer is a bounded group, so windows over it never grow with the data. df is worked out once: lengths are dear.
    """
    rows = numbered(df, key, dear=True).withColumn("buf", F.floor((F.col("rn") - 1) / (buffers * batch)))
    rank = F.row_number().over(Window.partitionBy("buf").orderBy(length, "rn")) - 1
    return rows.withColumn("_r", rank).withColumns({"batch_id": F.col("buf") * buffers + F.floor(F.col("_r") / batch), "slot": F.col("_r") % batch}).drop("_r")


def register_places(spark: SparkSession, name: str = "placed_in_batches") -> None:
    """A table function for SQL: name(TABLE(t) PARTITION BY p ORDER BY (o), n) gives t's rows with batch and slot, places in batches of n in each partition, from 0.

    It holds one row at a time. Its columns are those of t and these two; ValueError for a table that has one of them, or for n under 1.
    """
    ship(spark)

    class Places:
        def __init__(self) -> None:
            self.seen = 0

        @staticmethod
        def analyze(rows: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not isinstance(size.value, int) or size.value < 1:
                raise ValueError("give a table and a batch size of 1 or more")
            if {"batch", "slot"} & {f.name.lower() for f in rows.dataType.fields}:
                raise ValueError("the table has a column batch or slot already")
            return AnalyzeResult(T.StructType([*rows.dataType.fields, T.StructField("batch", T.LongType()), T.StructField("slot", T.LongType())]))

        def eval(self, row: Any, size: int) -> Iterator[tuple]:
            yield (*row, self.seen // size, self.seen % size)
            self.seen += 1

    spark.udtf.register(name, F.udtf(Places))


def collated(df: DataFrame, batch: str, ids: str, labels: str, pad: int = 1, ignored: int = -100) -> DataFrame:
    """input_ids, attention_mask and labels as long as their batch's longest."""
    by = Window.partitionBy(batch)
    wide = df.withColumns({"_i": F.max(F.size(ids)).over(by), "_l": F.max(F.size(labels)).over(by)})
    out = wide.withColumns({"input_ids": padded(F.col(ids), F.col("_i"), pad), "labels": padded(F.col(labels), F.col("_l"), ignored)})
    return out.withColumn("attention_mask", mask(F.col("input_ids"), pad)).drop("_i", "_l")


def preference_collated(df: DataFrame, batch: str, pad: int = 1, ignored: int = -100, start: int = 2) -> DataFrame:
    """Padded prompt, chosen and rejected ids (columns of those names) of rows where none is null, with decoder inputs."""
    by = Window.partitionBy(batch)
    some = df.na.drop(subset=["prompt", "chosen", "rejected"])
    wide = some.withColumns({f"_{c}": F.max(F.size(c)).over(by) for c in ("prompt", "chosen", "rejected")})
    out = wide.withColumns({"prompt_ids": padded(F.col("prompt"), F.col("_prompt"), pad), **{f"{c}_labels": padded(F.col(c), F.col(f"_{c}"), ignored) for c in ("chosen", "rejected")}})
    out = out.withColumns({"prompt_mask": mask(F.col("prompt_ids"), pad), **{f"{c}_decoder_input_ids": shifted(F.col(f"{c}_labels"), start, pad, ignored) for c in ("chosen", "rejected")}})
    return out.drop("_prompt", "_chosen", "_rejected")
