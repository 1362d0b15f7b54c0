"""Words that are spelling variants of commoner words: Aho-Corasick automata over the halves of words.

If one code point is put in, left out or replaced, one half of a word stays as it is, at the word's beginning or at its end. So
every word's two halves are stored in automata, and all words are scanned: a hit whose place and whose word's length
fit is a candidate, and the distance decides. Automata are shards: a half goes to the shard of its hash, and a word to
the shards of the beginnings and ends that a half near it can have, two of each. Where so many words meet
at one half that a task would have to hold too much, the rest of the word is halved in the same way and one
of its halves, too, must be there: the halves grow until few words share them, and no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ship, table, through_table

#: Letters of words, A-Z already lowered.
LETTERS = "[a-z\u00c0-\u00ff]"

#: Rows of a shard (about half of them stored in its automaton), rows that may meet at one half, distinct words that a task counts before it passes them on.
SHARD_ROWS, MOST_AT_HALF, MOST_COUNTED = 20_000, 4_000, 300_000


def word_counts(df: DataFrame, *, least: int = 7, times: int = 2, slip: int = 31, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): how often each word of at least so many code points occurs, if that often; written to the shared folder.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lowered. Of a run for which slip divides h, the crc32 of "id:run", the
    code point h % length is left out first. Null text has no words, a null id counts as an empty one. Tasks pass counts on, not occurrences.
    """
    ship(df.sparkSession)
    find = re.compile(f"{LETTERS}{{{least},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_py()
                if not raw:
                    continue
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(find(raw.encode().lower().decode())).items():  # of bytes only A-Z are lowered
                    h = zlib.crc32(word.encode(), head)
                    if h % slip == 0:
                        if len(word) == least:
                            continue
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                    total[word] += n
                if len(total) >= MOST_COUNTED:
                    yield told()
        yield told()

    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return through_table(counted.where(F.col("n") >= times), "words")


def _halved() -> Column:
    """The rows that a row becomes whose word is not in its key yet from start to stop.

    A word has a row for each beginning and each end that is a half of something of its length, one more or one less: there it is
    scanned. It is stored, too, where that is its own half and it was stored before. An empty half leaves the half before in place.
    """
    key, word, start, stop = map(F.col, ("key", "word", "start", "stop"))
    size = stop - start

    def row(side: str, a: Column, b: Column, first: Column, last: Column, own: Column) -> Column:
        piece = F.substring(word, a + 1, b - a)
        empty = b <= a
        return F.struct(F.concat(key, F.lit(side), piece).alias("key"), F.when(empty, F.col("half")).otherwise(piece).alias("half"), F.when(empty, F.col("at")).otherwise(a).alias("at"), first.alias("start"), last.alias("stop"), (F.col("stored") & own).alias("stored"))

    lower = lambda n: F.greatest(F.floor(n / 2), F.lit(0)).cast("int")
    upper = lambda n: F.greatest(F.least(F.ceil(n / 2), size), F.lit(0)).cast("int")
    front = lambda h: row("<", start, start + h, start + h, stop, h == lower(size))
    back = lambda h: row(">", stop - h, stop, start, stop - h, h == upper(size))
    lengths = lambda of: F.array_distinct(F.array(of(size - 1), of(size), of(size + 1)))
    return F.concat(F.transform(lengths(lower), front), F.transform(lengths(upper), back))


def _routes(words: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Every word (half, at, start, stop, word, n, stored) under the keys it is scanned and perhaps stored with, and about how many rows that are.

    A key has at most so many rows, unless its words differ in one place only. Only words at keys of more rows are written, to be halved again.
    """
    rows = words.select(F.lit("").alias("key"), F.lit("").alias("half"), F.lit(0).alias("at"), F.lit(0).alias("start"), F.length("word").alias("stop"), "word", "n", F.lit(True).alias("stored"))
    done, total = None, 0
    while True:
        total += 4 * rows.count()
        rows = rows.select("word", "n", F.explode(_halved()).alias("_r")).select("_r.*", "word", "n")
        open_ = F.count_if(F.col("stop") - F.col("start") > 2)
        sizes = rows.groupBy("key").agg(F.count("*").alias("_n"), F.count_if("stored").alias("_s"), open_.alias("_open"))
        many = through_table(sizes.where((F.col("_n") > most) & (F.col("_s") > 0) & (F.col("_open") > 0)).select("key"), "shared")
        last = many.isEmpty()
        settled = rows if last else rows.join(many, "key", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done, total
        rows = through_table(rows.join(many, "key", "left_semi"), "halves")


def one_edit(a: str, b: str, same: int = 0) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes a into b; that they begin with so many of the same is known."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k, n = same, len(a)
    while k < n and a[k] == b[k]:
        k += 1
    return a[k + (n == len(b)) :] == b[k + 1 :]


def _scanned(shard: pa.Table) -> pa.Table:
    """(word, near, near_n): the stored words one edit from each scanned one, of one shard.

    A half's words are held by where it stands in them and by their length, so that a hit meets those alone that it fits; and of
    these by the two halves of what is left of them, one of which must be there as well before the distance is worked out.
    """
    import ahocorasick

    half, at, start, stop, word, n, stored = (shard.column(c).to_pylist() for c in ("half", "at", "start", "stop", "word", "n", "stored"))
    held: dict[str, dict[int, dict[int, dict[tuple[int, int], tuple[dict, dict]]]]] = {}
    for k, is_stored in enumerate(stored):
        if is_stored:
            w, s, e = word[k], start[k], stop[k]
            places = held.setdefault(half[k], {}).setdefault(at[k], {}).setdefault(len(w), {})
            fronts, backs = places.setdefault((s, e), ({}, {}))
            middle = s + (e - s) // 2
            fronts.setdefault(w[s:middle], []).append((w, n[k]))
            backs.setdefault(w[middle:e], []).append((w, n[k]))
    found: set[tuple[str, str, int]] = set()
    if held:
        automaton = ahocorasick.Automaton()
        for h, places in held.items():
            automaton.add_word(h, (len(h), places))
        automaton.make_automaton()
        for v in set(word):
            size = len(v)
            for end, (long, places) in automaton.iter(v):
                here = end + 1 - long
                for a in (here - 1, here, here + 1):
                    by_length = places.get(a)
                    if by_length is None:
                        continue
                    for length in (size - 1, size, size + 1) if a == here else (size + a - here,):
                        for (s, e), (fronts, backs) in by_length.get(length, {}).items():
                            middle, more = s + (e - s) // 2, size - length
                            same = long if not a and not here else 0
                            for w, m in fronts.get(v[s:middle], ()):
                                if one_edit(v, w, same):
                                    found.add((v, w, m))
                            for w, m in backs.get(v[max(middle + more, 0) : e + more], ()):
                                if one_edit(v, w, same):
                                    found.add((v, w, m))
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table({"word": pa.array(columns[0], pa.string()), "near": pa.array(columns[1], pa.string()), "near_n": pa.array(columns[2], pa.int64())})


def near_words(words: DataFrame, *, shard_rows: int = SHARD_ROWS, most: int = MOST_AT_HALF) -> DataFrame:
    """(word, near, near_n): every two words (word, n) that are one inserted, deleted or replaced code point apart, both ways, each once. Words have two code points or more, and stand once."""
    ship(words.sparkSession)
    routes, total = _routes(words, most)
    rows = routes.withColumn("_shard", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // shard_rows))))).drop("key")
    pairs = rows.groupBy("_shard").applyInArrow(_scanned, "word string, near string, near_n long")
    return pairs.repartition("word").dropDuplicates(["word", "near"])  # one shuffle, which grouping by word and joining on it use as well


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): where following the forms ends. A form's n is ten times its word's, so twenty steps are enough: five doublings."""
    now = through_table(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(5):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            break
        now = through_table(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return now


def variants(words: DataFrame, *, ratio: int = 10, **options: int) -> DataFrame:
    """words (word, n) with n_near (near words), form (that of largest n, ties going to the first in code-point order, if its n is ratio times the word's at least), form_n and root (the last of the forms of forms, the word itself without one).

    ratio is 2 or more, so that forms end. No words give no rows.
    """
    best = F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))
    near = near_words(words, **options).groupBy("word").agg(F.count("*").alias("n_near"), F.min(best).alias("_best"))
    near = near.select("word", "n_near", F.col("_best.w").alias("_w"), (-F.col("_best.m")).alias("_m"))
    fits = F.col("_m") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("_w")).alias("form"), F.when(fits, F.col("_m")).alias("form_n"))
    rows = through_table(rows, "forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its commoner form, root, n, n_near and form_n."""
    return variants(word_counts(table(spark, sf_dir, "documents")))
