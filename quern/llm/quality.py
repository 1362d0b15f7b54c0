"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule has a measure and a test of it. On a sample of rows by hash, every rule's measure is
timed, on as many copies of the rows as make the time tell, and the share of rows that it rejects is
counted; the rules are then tried in falling order of rejections per second. A measure is only worked out for rows that no earlier rule
rejects, so dear rules see only what cheap ones let through. The verdict of a conjunction
doesn't depend on the order: it moves cost only.

Null or empty text has no words and fails the base rules. Repeated rows are judged each
alone, and ties in the order of rules fall back to their names. Very long texts are held as
one row's arrays. Input columns are never read but for the text and the id, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.binding import let
from quern.llm.common import SPACES, packed, table, through_table, unpacked

#: The base limits, and those of the cascade's rules.
MIN_WORDS, WINDOW, REPEATS_PERCENT = 20, 8, 30
SYMBOLS_PER_100_WORDS, DUP_LINES_PERCENT, UPPER_PERCENT = 30, 50, 70
MIN_MEAN_WORD, MAX_MEAN_WORD = 1.5, 25.0
#: Times apart that estimated rejections per second must be to tell.
ALIKE = 1.5
SYMBOLS, BLANKS = "[#*$%&|<>]", "[\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rule:
    """measure gives a value from _t, _words and n_words; rejects tests it."""

    name: str
    measure: Callable[[], Column]
    rejects: Callable[[Column], Column]


def letters() -> Column:
    """Upper- and lower-case Latin letters; the latter are counted only where the former are there."""
    upper = F.regexp_count("_t", F.lit("[A-Z]"))
    return let(upper, lambda n: F.struct(n.alias("upper"), F.when(n > 0, F.length(F.regexp_replace("_t", "[^a-z]+", ""))).otherwise(0).alias("lower")))


def line_counts() -> Column:
    """Lines with a word, and those of them that repeat an earlier one."""
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("repeated")))


def _paired(h: Column, step: int) -> Column:
    """Each hash with that step places on."""
    n = F.size(h) - step
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash stands twice; windows begin at each word but the last few."""
    sorted_ = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(again: Column) -> Column:
        same = lambda s, i: F.coalesce(F.get(again, i)["h"] == s["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(again, lambda s, i: same(s, i - 1) | same(s, i + 1)), lambda s: s["i"]))

    def union(at: Column) -> Column:
        parts = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))).cast("long"))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(sorted_, places), union)


def repeat_words() -> Column:
    """Words in 8-word windows found twice or more. Words are hashed once, and the hashes paired three times."""
    hashes = F.transform("_words", lambda x: F.xxhash64(x))
    windows = let(let(let(hashes, lambda h: _paired(h, 1)), lambda h: _paired(h, 2)), lambda h: _paired(h, 4))
    some = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)))
    return F.coalesce(F.when(F.col("n_words") > WINDOW, some), F.lit(0).cast("long"))


def default_rules() -> list[Rule]:
    """The base rules, and five more."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rule("too_few_words", lambda: F.col("n_words"), lambda n: n < MIN_WORDS),
        Rule("repeats", repeat_words, lambda n: 100 * n > REPEATS_PERCENT * F.col("n_words")),
        Rule("symbols", lambda: F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"), lambda n: 100 * n > SYMBOLS_PER_100_WORDS * words),
        Rule("duplicate_lines", line_counts, lambda m: 100 * m["repeated"] > DUP_LINES_PERCENT * m["lines"]),
        Rule("word_length", lambda: F.length(F.array_join("_words", "")).cast("long"), lambda n: ~(n / words).between(MIN_MEAN_WORD, MAX_MEAN_WORD)),
        Rule("shouting", letters, lambda m: 100 * m["upper"] > UPPER_PERCENT * F.greatest(m["upper"] + m["lower"], F.lit(1))),
    ]


def _worded(packs: DataFrame) -> DataFrame:
    """Packed rows with their words, which every rule may use."""
    return packs.withColumn("_words", F.filter(F.split("_t", SPACES), lambda x: x != "")).withColumn("n_words", F.size("_words").cast("long"))


def sampled(packs: DataFrame, rows: int) -> DataFrame:
    """About so many rows at most, those of the smallest hashes of id and text, as a table of their own."""
    reach, h = 2 * rows / max(packs.count(), 1), F.xxhash64("_id", "_t")
    edge = (1 << 63) - 1 if reach >= 1 else int((1 << 64) * reach) - (1 << 63)
    return through_table(packs.select("_id", "_t", h.alias("_h")).where(F.col("_h") <= edge).orderBy("_h").limit(rows), "quality-sample")


def _seconds(df: DataFrame) -> float:
    """How long all of df takes to work out."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def costs(rows: DataFrame, measures: Mapping[str, Column], *, least: float = 0.25, times: int = 3) -> dict[str, tuple[float, float]]:
    """(seconds, spread) of each measure for one copy of rows, beyond those of reading the rows and their words.

    A run of so few rows is mostly the launch of a job, so each row is copied, as often as makes a run with the
    measure take the least seconds longer than one without copies. Runs with the measure and without it take turns;
    whatever else the machine does only adds, so the fastest of each kind count, and spread is that of their differences.
    What is less than a hundredth of a run can't be told from none and counts as that much.
    """
    touched = (F.size("_words") + F.octet_length("_t")).alias("_r")  # both ways read the same
    copied = lambda n, *more: rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(touched, *more)
    launch = min(_seconds(copied(1)) for _ in range(3))
    out = {}
    for name, measure in measures.items():
        n = 1
        _seconds(copied(n, measure.alias("_m")))  # compiles
        while n < 1 << 16 and (beyond := _seconds(copied(n, measure.alias("_m"))) - launch) < least:
            n *= max(2, min(16, int(least / max(beyond, 1e-3)) + 1))
        ways = [copied(n), copied(n, measure.alias("_m"))]
        runs = [[_seconds(w) for w in ways] for _ in range(times)]
        without, whole = (min(r[i] for r in runs) for i in (0, 1))
        taken = [b - a for a, b in runs]
        out[name] = (max(whole - without, whole / 100) / n, (max(taken) - min(taken)) / n)
    return out


def estimates(packs: DataFrame, rules: list[Rule], sample_rows: int = 500, free: Collection[str] = ()) -> dict[str, tuple[float, float]]:
    """(seconds, share rejected) of each rule on a sample.

    Seconds are 0 for those that are free, whose measures are there in any case, and nothing is timed unless
    two rules or more aren't: the others come first, and one alone comes last.
    """
    rows = _worded(sampled(packs, sample_rows))
    share = rows.select(*[F.avg(F.coalesce(r.rejects(r.measure()), F.lit(False)).cast("double")) for r in rules]).first()
    dear = {r.name: r.measure() for r in rules if r.name not in free}
    took = costs(rows, dear) if len(dear) > 1 else dict.fromkeys(dear, (1.0, 0.0))
    return {r.name: (took[r.name][0] if r.name in took else 0.0, share[i] or 0.0) for i, r in enumerate(rules)}


def ordered_rules(packs: DataFrame, rules: list[Rule], sample_rows: int = 500, known: Mapping[str, tuple[float, float]] | None = None, free: Collection[str] = ()) -> list[Rule]:
    """The rules by rejections per second, as estimated on a sample or as known, those that take none first; it moves cost, not verdicts.

    Estimates less than ALIKE times apart count as equal and go by name, so that the order repeats.
    """
    found = estimates(packs, rules, sample_rows, free) if known is None else known
    rate = {name: share / seconds for name, (seconds, share) in found.items() if seconds > 0}
    out = sorted((r for r in rules if r.name not in rate), key=lambda r: (-found[r.name][1], r.name))
    rest = sorted((r for r in rules if r.name in rate), key=lambda r: (-rate[r.name], r.name))
    while rest:
        alike = [r for r in rest if rate[r.name] * ALIKE >= rate[rest[0].name]]
        out += sorted(alike, key=lambda r: r.name) if known is None else alike
        rest = rest[len(alike) :]
    return out


def _judged(rows: DataFrame, rules: list[Rule], known: Mapping[str, Column]) -> DataFrame:
    """rows with failed_rule, tried in order; a measure that isn't known is worked out only where no earlier rule rejects."""
    rows = rows.withColumn("failed_rule", F.lit(None).cast("string"))
    for i, r in enumerate(rules):
        so_far = F.col("failed_rule")
        value = known.get(r.name)
        if value is None:
            rows = rows.withColumn("_m", F.when(so_far.isNull(), r.measure()) if i else r.measure())
            value = F.col("_m")
        rows = rows.withColumn("failed_rule", F.when(so_far.isNotNull(), so_far).when(r.rejects(value), F.lit(r.name)))
    return rows.drop("_m")


def quality_cascade(df: DataFrame, rules: list[Rule] | None = None, *, text: str = "text", key: str = "doc_id", sample_rows: int = 500, known: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Packed rows with the five measures, base_failed, failed_rule (the first that rejects, null if none does) and kept.

    The five are asked for of every row, so rules of the default ones' names use them and are not measured again.
    """
    packs = packed(df, text, key)
    given = {"too_few_words": "n_words", "repeats": "n_repeat_words", "symbols": "n_symbols", "duplicate_lines": "_line", "word_length": "word_chars"}
    rules = ordered_rules(packs, default_rules() if rules is None else rules, sample_rows, known, given)
    rows = _worded(packs).withColumns({"word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"), "_line": line_counts(), "n_repeat_words": repeat_words()})
    rows = rows.withColumn("n_dup_lines", F.col("_line.repeated"))
    out = _judged(rows, rules, {k: F.col(c) for k, c in given.items()})
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATS_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()).drop("_words", "_line")


def keep_good(df: DataFrame, rules: list[Rule] | None = None, *, text: str = "text", key: str = "doc_id", sample_rows: int = 500, known: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """The rows of df that no rule rejects, with df's columns; the rules must hold the base's to keep to the base.

    Dropped by explode(), not where(): a filter would be pushed below the projections, each
    of whose steps would then be written out anew wherever the next one uses it.
    """
    packs = packed(df, text, key)
    rules = ordered_rules(packs, default_rules() if rules is None else rules, sample_rows, known)
    judged = _judged(_worded(packs), rules, {}).select("_doc", "failed_rule")
    return judged.select(F.explode(F.when(F.col("failed_rule").isNull(), F.array("_doc"))).alias("_doc")).select(*unpacked(df.columns))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the measures and verdicts of every document."""
    out = quality_cascade(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) >= 2),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, t, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0b\f\r]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lo
  FROM w LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATS_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > {SYMBOLS_PER_100_WORDS} * greatest(n_words, 1) OR 100 * n_dup_lines > {DUP_LINES_PERCENT} * n_lines
  OR word_chars / greatest(n_words, 1) NOT BETWEEN {MIN_MEAN_WORD} AND {MAX_MEAN_WORD} OR 100 * up > {UPPER_PERCENT} * greatest(up + lo, 1)) AS kept
FROM v"""
