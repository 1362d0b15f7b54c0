"""Whole jobs over tables: augmenting, cleaning, splitting, merging, preparing tests, training samples, evaluating, rechecking, preferences, lifting.

Each is a composition of operators, sources and sinks, and returns a DataFrame or a few counts. Models and
programs are given as functions; nothing here loads one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.functions import arrays, asm, metrics, rewrites, text
from quern.operators import batching, curate, external, routing
from quern.schemas import METADATA
from quern.sources import places, scans, sinks


def augmented(rows: DataFrame, source: DataFrame, columns: Sequence[str] = METADATA, keys: Sequence[str] = ("exebench_split", "fname"), order: str | Sequence[str] = ()) -> DataFrame:
    """rows with metadata of the source corpus by split and name; the source is first cut down to the keys that rows need.

    Of source rows with one key the last by order counts; without an order the last to arrive of a source read from files.
    """
    source = source if order else curate.in_arrival(source)
    return curate.enriched(rows, curate.reduced(source, rows, *keys), list(keys), list(columns), order)


def _written(df: DataFrame, name: str) -> DataFrame:
    """df written to the scratch folder and read again."""
    path = places.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleaned(rows: DataFrame, code: str = "obfuscated_c", name: str = "fname", least: int = 1) -> DataFrame:
    """rows with their code cut to the marked function, and skip_reason where that is missing or too short."""
    out = rows.withColumn(code, text.extract_marked(F.col(code), F.col(name)))
    return curate.with_reason(out, [("no_function", F.col(code).isNull()), ("too_short", F.length(code) < least)])


def clean(spark: SparkSession, rows: DataFrame, path: str, shard_rows: int = 10_000, **options: Any) -> DataFrame:
    """cleaned() rows without a reason as shards in path/data, the counts of reasons as JSON in path/info; the counts. One pass writes and counts."""
    marked, seen = curate.reasons_observed(cleaned(rows, **options), ("no_function", "too_short"))
    sinks.write_shards(marked.where("skip_reason is null").drop("skip_reason"), f"{path}/data", shard_rows)
    counts = {reason: n for reason, n in seen.get.items() if n}
    sinks.write_metadata(spark, counts, f"{path}/info")
    return spark.createDataFrame(sorted(counts.items()), "skip_reason string, n long")


def split(rows: DataFrame, path: str, stratum: str, key: str, ratio: float = 0.05, shard_rows: int = 50_000, seed: int = 42, group: str | None = None) -> DataFrame:
    """Exact stratified splits as files NAME-i-of-n below path, and their histogram."""
    parts = curate.stratified(rows, stratum, key, ratio, seed, group)
    sinks.write_named_splits(parts, path, shard_rows, key)
    return curate.shares(parts, "split", stratum)


def merge(spark: SparkSession, folders: Sequence[str], path: str, *by: str, target_rows: int = 50_000, pattern: str = "*.parquet") -> DataFrame:
    """All shards below the folders as few files of exactly so many rows, and the sums of the folders' statistics; path/skipped names the shards and metadata files left out, and why."""
    skipped = scans.skipped_shards(spark, folders, pattern).unionByName(scans.skipped_sidecars(spark, folders))
    sinks.write_json_lines(skipped, f"{path}/skipped")
    sinks.compact(scans.shards(spark, folders, pattern=pattern, tolerant=True), f"{path}/data", *by, target_rows=target_rows)
    totals = curate.merged_stats(scans.sidecars(spark, folders))
    sinks.write_metadata(spark, {r["name"]: r["total"] for r in totals.collect()}, f"{path}/info")  # a row for each counter
    return totals


def prepare_tests(spark: SparkSession, parts: Sequence[DataFrame], path: str, code: str = "obfuscated_c", name: str = "fname") -> DataFrame:
    """The union of test sets, with marked functions only, as one file (sinks.write_single(): several where they are large); and how much that saved, counted as it is written."""
    whole = curate.typed_union(*parts)
    sized = cleaned(whole.withColumn("_before", F.col(code)), code, name).where("skip_reason is null")
    sized, report = curate.sizes_observed(sized, "_before", code)
    sinks.write_single(sized.drop("_before", "skip_reason"), path)
    return report()


def generate(source: DataFrame, tool: Callable[[str, str, int], str], path: str, techniques: Sequence[str] = curate.TECHNIQUES, seed: int = 42, shard_rows: int = 5000, least_chars: int = 100) -> DataFrame:
    """Each function of the source under each technique, as shards in path/data; and statistics: rows seen, samples written, failures, samples of each technique.

    The statistics are observed in the pass that writes, so the tool is asked once for each row and technique.
    """
    read, made = Observation(), Observation()
    seeded = source.withColumn("seed", curate.seeds(F.col("fname"), seed=seed)).observe(read, F.count("*").alias("rows_seen"))
    fine = F.col("code").isNotNull()
    rows = external.rewritten(seeded, tool, techniques, least=least_chars).observe(made, *[F.count_if(fine & (F.col("technique") == t)).alias(t) for t in techniques])
    sinks.write_shards(rows.where(fine).select("fname", "technique", "code"), f"{path}/data", shard_rows)
    counts = {t: made.get.get(t, 0) for t in techniques}
    seen, written = read.get.get("rows_seen", 0), sum(counts.values())
    totals = {**{f"samples_per_transform.{t}": n for t, n in counts.items()}, "rows_seen": seen, "samples_written": written, "failures": seen * len(techniques) - written}
    return source.sparkSession.createDataFrame(list(totals.items()), "name string, total long")


def training_samples(rows: DataFrame, source: Column, target: Column, pair: str, tokenizer: str | None = None, most: int = 1024, batch: int = 8, order: str = "id", epoch: int | None = None) -> DataFrame:
    """Padded batches of a pair's samples: wrapped, tokenized, without those of more than so many tokens on either side.

    With an epoch the source is rewritten anew, by a seed of the row's order and the epoch.
    """
    if epoch is not None:
        source = asm.udf(rewrites.obfuscated, "string")(source, curate.seeds(F.col(order)), F.lit(epoch))
    ids = rows.select(order, routing.tokenized(source, target, pair, tokenizer).alias("s")).select(order, "s.*")
    fit = ids.where(F.size("source_ids").between(1, most) & F.size("target_ids").between(1, most)).withColumn("n", F.size("source_ids"))
    return batching.length_batches(fit, order, "n", batch)


def preference_samples(rows: DataFrame, tokenizer: str | None = None, most: int = 1024) -> DataFrame:
    """Preference rows with prompt, chosen and rejected as ids, without those that are empty or too long in any of the three."""
    names = ("prompt", "chosen", "rejected")
    ids = rows.withColumns({c: routing.encoded(F.col(c), tokenizer) for c in names})
    fit = F.lit(True)
    for c in names:
        fit &= F.size(c).between(1, most)
    return ids.where(fit)


def evaluated(rows: DataFrame, predict: Callable[[Sequence[str]], Sequence[str]] | None = None, *, load: Callable[[], Callable[[Sequence[str]], Sequence[str]]] | None = None, source: str = "source", reference: str = "reference", key: str = "fname", by: Sequence[str] = (), order: str = "id", most_tokens: int = 1024, batch: int = 8, check: Callable[[dict[str, Any]], Sequence[dict[str, Any]]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, metrics, skipped): a model, or what loads one in a worker, over batches of about equally long rows with a source and a reference.

    Rows without either, or of too many tokens, are skipped for a reason, and counted. metrics has BLEU,
    edit distance and exact matches, and with a check also its counts and rates, over all rows and for
    each value of by. The model's answers are written first, so that it is asked once for a row and
    all that is reported is about the same answers.
    """
    marked = curate.with_reason(rows, [
        ("missing_source", text.clean_string(F.col(source)).isNull()), ("missing_reference", text.clean_string(F.col(reference)).isNull()), ("too_many_tokens", F.size(text.tokens(F.col(source))) > most_tokens),
    ])
    fit = marked.where("skip_reason is null").withColumn("_n", F.size(text.tokens(F.col(source))))
    answers = external.lifted(fit.withColumn("seq", F.col(order).cast("long")), predict, source, most_tokens, batch, length="_n", load=load).withColumnRenamed("seq", order)
    told = _written(fit.select(order, key, *by, F.col(reference).alias("reference")).join(answers, order), "answers")
    scored = told.withColumns({"_d": metrics.ned(F.col("prediction"), F.col("reference")), "_e": metrics.exact(F.col("prediction"), F.col("reference")), "_b": metrics.bleu_parts(F.col("prediction"), F.col("reference"))})
    sums = [F.count("*").alias("n"), metrics.bleu_score(F.col("_b")).alias("bleu"), F.coalesce(F.avg("_d"), F.lit(0.0)).alias("ned"), F.coalesce(F.avg("_e"), F.lit(0.0)).alias("exact_match")]
    report = curate.overall(scored.withColumn("_b", F.explode(F.array("_b"))), sums, *by)
    if check is not None:
        checks = external.run(told.select(F.col(order).cast("long").alias("seq"), "prediction"), check, external.CHECKED)
        stats = curate.check_stats(checks.join(told.select(F.col(order).cast("long").alias("seq"), *by), "seq"), *by)
        report = report.join(stats, list(by)) if by else report.join(F.broadcast(stats))  # without by one row each
    return told.select(key, *by, "prediction", "reference"), report, curate.reason_counts(marked)


def rechecked(predictions: DataFrame, path: str, check: Callable[[dict[str, Any]], Sequence[dict[str, Any]]]) -> DataFrame:
    """Saved predictions (with seq) checked again; the summary and each row's result are written as JSON below path."""
    spark = predictions.sparkSession
    sinks.write_json_lines(external.run(predictions.select("seq", "prediction"), check, external.CHECKED), f"{path}/details")
    details = spark.read.schema(external.CHECKED).json(f"{path}/details")
    summary = curate.check_stats(details).select("total", "syntax_valid", "compiles", F.col("syntax_valid_pct").alias("syntax_rate"), F.col("compiles_pct").alias("compile_rate"))
    sinks.write_metadata(spark, summary.first().asDict(), f"{path}/summary")
    return summary


def preference_set(prompts: DataFrame, generate: Callable[[str, int], Sequence[str]], check: Callable[[dict[str, Any]], Sequence[dict[str, Any]]], path: str, *, n: int = 5, ground_truth: bool = False, level: int = 2) -> DataFrame:
    """prompts (fname, prompt, truth): so many candidates each, checked, scored and ranked; pairs in path/data, ten to look at in path/sample; counts by best score.

    Candidates are written first, and then what the check says of them, so that both are asked once.
    """
    spark = prompts.sparkSession
    external.candidates(prompts, generate, n).where("text is not null").write.mode("overwrite").parquet(f"{path}/candidates")
    made = spark.read.parquet(f"{path}/candidates").withColumn("seq", F.xxhash64("prompt", "position"))
    external.run(made.select("seq", F.col("text").alias("prediction")), check, external.CHECKED).write.mode("overwrite").parquet(f"{path}/checks")
    results = spark.read.schema(external.CHECKED).parquet(f"{path}/checks")
    scored = made.join(results.select("seq", "syntax_valid", "compiles"), "seq").withColumn("score", metrics.candidate_score(F.coalesce("syntax_valid", F.lit(False)), F.coalesce("compiles", F.lit(False)), level))
    best = curate.best_worst(scored, "prompt", "score", "position", "text")
    chosen = curate.preferences(best.join(prompts, "prompt"), "truth", ground_truth)
    sinks.write_shards(chosen.select("prompt", "chosen", "rejected", "score_chosen", "score_rejected", "fname"), f"{path}/data")
    sinks.sample_json(spark.read.parquet(f"{path}/data"), f"{path}/sample")
    return best.groupBy("best_score").agg(F.count("*").alias("n"))


def lifted_units(units: DataFrame, predict: Callable[[Sequence[str]], Sequence[str]] | None = None, *, load: Callable[[], Callable[[Sequence[str]], Sequence[str]]] | None = None, code: str = "asm", name: str = "fname", pair: str = "arm_ir-ir", most_tokens: int = 1024, batch: int = 8, order: str = "id") -> DataFrame:
    """(id, fname, ir, error): a function of each unit cut out, cleaned, wrapped for a pair and lifted; what can't be has an error."""
    own, _ = routing.languages(pair)
    cut = _written(units.select(order, name, asm.preprocessed(F.col(code), F.col(name)).alias("_c")), "cut")  # read twice
    prepared = cut.withColumn("_p", routing.wrapped(F.col("_c"), own)).withColumn("_n", F.size(text.tokens(F.col("_p"))))
    prepared = prepared.withColumn("error", F.when(F.col("_c").isNull(), "no such function").when(F.col("_n") > most_tokens, "too long"))
    fit = prepared.where("error is null")
    answers = external.lifted(fit.withColumn("seq", F.col(order).cast("long")), predict, "_p", most_tokens, batch, length="_n", load=load)
    done = _written(answers.select(F.col("seq").alias(order), text.truncate_ir(F.col("prediction")).alias("ir")), "lifted")
    return prepared.select(order, name, "error").join(done, order, "left")


def symbols(unit: Column) -> Column:
    """The names that an assembly unit declares global or calls, each once, in order of appearance: declared ones first."""
    found = lambda p: F.regexp_extract_all(unit, F.lit(p))
    return F.array_union(found("(?m)^\\s*\\.glob[al]l?\\s+([\\w.$]+)"), found("(?m)^\\s*(?:bl|call)\\s+([\\w.$]+)"))


def required_asms(pairs: Sequence[str], prefix: str = "angha") -> list[str]:
    """The keys that the routes of pairs read, with the unoptimized variant of each, sorted."""
    keys = {k for p in pairs for k in (routing.route(p, prefix).source, routing.route(p, prefix).target) if k}
    return sorted(keys | {k.rsplit("_O", 1)[0] + "_O0" for k in keys if "_O" in k})


def io_maps(names: Column, values: Column) -> Column:
    """Parallel arrays of variables and literal values as a map; of a repeated name the last counts."""
    return arrays.paired_map(names, values)
