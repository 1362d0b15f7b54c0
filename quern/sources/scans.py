"""Reading corpora, shards, sidecars, logs and files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.schemas import FUNCTIONS, PAIRS, PREDICTIONS, PREFERENCES, SIDECAR, conformed
from quern.sources.shipping import ship


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def functions(spark: SparkSession, path: str) -> DataFrame:
    """The nested source corpus; columns that are missing read as null."""
    return spark.read.schema(FUNCTIONS).parquet(path)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """The flat corpus; older files with fewer columns read with nulls."""
    return conformed(spark.read.parquet(path), PAIRS)


def preferences(spark: SparkSession, path: str) -> DataFrame:
    """The preference set."""
    return spark.read.schema(PREFERENCES).parquet(path)


def split(spark: SparkSession, path: str, name: str, column: str = "split") -> DataFrame:
    """One split of a table with a split column (a partition column is pruned)."""
    return spark.read.parquet(path).where(F.col(column) == name)


def all_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Splits from folders of their own as one table with a split column."""
    frames = [spark.read.parquet(p).withColumn("split", F.lit(n)) for n, p in sorted(paths.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def shards(spark: SparkSession, folders: Sequence[str], schema: T.StructType | None = None, pattern: str = "shard-*.parquet", tolerant: bool = False) -> DataFrame:
    """All shards below the folders, at any depth. Missing folders are passed over; with tolerant so are files that can't be read, which probed() names."""
    there = [f for f in folders if exists(spark, f)]
    if not there:
        return spark.createDataFrame([], schema or T.StructType([]))
    if tolerant and schema is None:  # Spark would ask one file, which may be damaged
        whole = probed(spark, folders, pattern).where("reason is null").agg(F.min("file")).first()[0]
        schema = spark.read.parquet(unquote(whole)).schema if whole else T.StructType([])
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", str(tolerant).lower())
    return (reader.schema(schema) if schema is not None else reader).parquet(*there)


def probed(spark: SparkSession, folders: Sequence[str], pattern: str = "shard-*.parquet") -> DataFrame:
    """(file, rows, reason) of each file below the folders: its rows by its footer, or why that can't be read.

    Tasks read the footers and nothing else, through pyarrow's file systems; an unknown kind of path is an error, not a reason.
    The names are those of the driver's own listing, for a scan never opens a file of no bytes.
    """
    there = [f for f in folders if exists(spark, f)]
    if not there:
        return spark.createDataFrame([], "file string, rows long, reason string")
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        for b in batches:
            names, rows, reasons = b.column(0).to_pylist(), [], []
            for name in names:
                files, path = fs.FileSystem.from_uri(name)
                n = reason = None
                try:
                    with files.open_input_file(path) as f:
                        n = parquet.read_metadata(f).num_rows
                except (pa.ArrowException, OSError) as e:
                    reason = str(e) or type(e).__name__
                rows.append(n)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.int64()), pa.array(reasons, pa.string())], ["file", "rows", "reason"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(there).inputFiles()
    names = spark.createDataFrame([(x,) for x in listed], "file string").repartition(max(1, len(listed) // 100))
    return names.mapInArrow(run, "file string, rows long, reason string")


def skipped_shards(spark: SparkSession, folders: Sequence[str], pattern: str = "shard-*.parquet") -> DataFrame:
    """(file, reason) of the files that a tolerant read of the shards leaves out."""
    return probed(spark, folders, pattern).where("reason is not null").select("file", "reason")


def skipped_sidecars(spark: SparkSession, folders: Sequence[str], schema: T.StructType = SIDECAR, name: str = "dataset_info.json") -> DataFrame:
    """(file, reason) of the metadata files that sidecars() drops."""
    there = [f for f in folders if exists(spark, f)]
    if not there:
        return spark.createDataFrame([], "file string, reason string")
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(there, wholetext=True)
    told = F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"})
    rows = texts.select(F.col("_metadata.file_path").alias("file"), told.alias("told"))
    return rows.where("told is null or told._corrupt is not null").select("file", F.lit("no JSON object of the schema").alias("reason"))


def sidecars(spark: SparkSession, folders: Sequence[str], schema: T.StructType = SIDECAR, name: str = "dataset_info.json") -> DataFrame:
    """The metadata files below the folders; those that aren't JSON are dropped."""
    there = [f for f in folders if exists(spark, f)]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(there)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """A log of predictions, a JSON object on each line; blank lines are passed over."""
    return spark.read.schema(PREDICTIONS).json(path)


def rows_in(spark: SparkSession, path: str) -> int:
    """The number of rows, from the files' footers."""
    return spark.read.parquet(path).count()


def bucketed(spark: SparkSession, table: str, path: str, columns: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The table that sinks.write_bucketed left at a path; a session whose catalog doesn't know it is told its columns and buckets."""
    if not spark.catalog.tableExists(table):
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def row_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, before) of the Parquet files at path: how many rows each holds and those before it, by name, hold. From footers; no column is read.

    A row for each file: write it beside the table where chunks are taken again and again.
    """
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    below = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "rows", F.coalesce(F.sum("rows").over(below), F.lit(0)).alias("before"))


def chunk(spark: SparkSession, path: str, skip: int, most: int, index: DataFrame | None = None) -> DataFrame:
    """The rows after the first skip, so many at most, as the files at path hold them, by name: only files that hold some of them are opened, and nothing is shuffled.

    index is row_index() or what was stored of it.
    """
    index = row_index(spark, path) if index is None else index
    held = index.where((F.col("before") < skip + most) & (F.col("before") + F.col("rows") > skip)).select("file", "before").collect()  # files of the chunk
    if not held:
        return spark.read.parquet(path).where(F.lit(False))
    first = F.element_at(F.create_map(*[F.lit(x) for r in held for x in (r["file"], r["before"])]), F.col("_metadata.file_path"))
    rows = spark.read.schema(spark.read.parquet(path).schema).parquet(*[unquote(r["file"]) for r in held])
    return rows.where((first + F.col("_metadata.row_index")).between(skip, skip + most - 1))


def whole_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of each file below a path."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pointer(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The number of a table's last pointer, 0 without any, and the version that the newest whole one names (one that is being written is empty)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{root.rstrip('/')}/_pointers")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0, None
    there = {int(x.getPath().getName()): x for x in files.listStatus(folder) if x.getPath().getName().isdigit()}
    whole = [n for n, x in there.items() if x.getLen()]
    named = spark.read.text(there[max(whole)].getPath().toString(), wholetext=True).first()[0].strip() if whole else None
    return max(there, default=0), named


def partials(spark: SparkSession, path: str) -> DataFrame | None:
    """The partial aggregates that sinks.add_partials stored, None without any; additions that never ended are passed over."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    ended = hadoop.Path(f"{path.rstrip('/')}/added=*/_SUCCESS")
    found = ended.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(ended) or []
    return spark.read.parquet(*[x.getPath().getParent().toString() for x in found]) if len(found) else None


def versioned(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """A table as of a version: a folder of that name; without one that of the newest pointer, else that which the file LATEST names, else the last by name."""
    root = root.rstrip("/")
    version = version or pointer(spark, root)[1]
    if version is None:
        hadoop = spark._jvm.org.apache.hadoop.fs
        files = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        if exists(spark, f"{root}/LATEST"):
            version = spark.read.text(f"{root}/LATEST", wholetext=True).first()[0].strip()
        else:
            version = max(x.getPath().getName() for x in files.listStatus(hadoop.Path(root)) if x.isDirectory() and x.getPath().getName()[0] not in "._")
    return spark.read.parquet(f"{root}/{version}")


def cases(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> DataFrame:
    """(name, one column for each suffix without its dot): files that share a stem, where all of them are there."""
    files = whole_texts(spark, folder)
    stem = lambda s: F.regexp_extract("path", rf"([^/]+)\Q{s}\E$", 1)
    out: DataFrame | None = None
    for s in suffixes:
        part = files.where(stem(s) != "").select(stem(s).alias("name"), F.col("text").alias(s.strip("._").replace(".", "_")))
        out = part if out is None else out.join(part, "name")
    return out


def in_memory(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """(fname, func_def) rows for sources that are at hand."""
    return spark.createDataFrame(list(sources), "fname string, func_def string")


def key_of(path: Column) -> Column:
    """A shard's number from its file name."""
    return F.regexp_extract(path, "shard-(\\d+)", 1).cast("long")
