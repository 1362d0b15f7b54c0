"""Similarity metrics, preference arithmetic and rates as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.binding import let
from quern.functions.text import stripped, tokens


def ned(prediction: Column, reference: Column) -> Column:
    """Edit distance over the longer one's length; null where the reference is empty, so that avg() skips it."""
    longest = F.greatest(F.length(prediction), F.length(reference), F.lit(1))
    return F.when(reference != "", F.levenshtein(prediction, reference) / longest)


def exact(prediction: Column, reference: Column) -> Column:
    """100 where both are the same but for white space at their ends, else 0."""
    return F.when(stripped(prediction) == stripped(reference), F.lit(100.0)).otherwise(F.lit(0.0))


#: The replacements of the 13a tokenization, in order.
TOKENS_13A = (
    ("<skipped>", ""), ("-\\n", ""), ("\\n", " "), ("&quot;", "\""), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ("([\\x7B-\\x7E\\x5B-\\x60\\x20-\\x26\\x28-\\x2B\\x3A-\\x40\\x2F])", " $1 "), ("([^0-9])([.,])", "$1 $2 "), ("([.,])([^0-9])", " $1 $2"), ("([0-9])(-)", "$1 $2 "),
)


def words_13a(c: Column) -> Column:
    """Words as the usual corpus score counts them: entities decoded, punctuation apart but within numbers."""
    out = F.regexp_replace(c, "(?U)\\s+\\z", "")
    for at, (old, new) in enumerate(TOKENS_13A):
        out = F.concat(F.lit(" "), out, F.lit(" ")) if at == 7 else out  # the patterns look at a character on either side
        out = F.regexp_replace(out, old, new)
    return F.filter(F.split(out, "(?U)\\s+"), lambda x: x != "")


def _paired(shorter: Column, words: Column, n: int) -> Column:
    """Hashes of the runs of n words, of those of the runs of one less; none where there are fewer."""
    some = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(shorter, F.lit(1), some), F.slice(words, F.lit(n), some), lambda a, b: F.xxhash64(a, b))


def _matches(p: Column, r: Column) -> Column:
    """How many hashes of p are in r, each as often as r has it: one walk over both, sorted together."""
    tag = lambda xs, side: F.transform(xs, lambda h: F.struct(h.alias("h"), F.lit(side).alias("side")))
    start = F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        left = F.when(a["h"] == x["h"], a["left"]).otherwise(F.lit(0).cast("long"))
        hit = (x["side"] == 1) & (left > 0)
        return F.struct(x["h"].alias("h"), F.when(x["side"] == 0, left + 1).when(hit, left - 1).otherwise(left).alias("left"), F.when(hit, a["n"] + 1).otherwise(a["n"]).alias("n"))

    return F.aggregate(F.sort_array(F.concat(tag(r, 0), tag(p, 1))), start, step)["n"]  # array_sort() would call a function for each comparison


def bleu_parts(prediction: Column, reference: Column, words=words_13a) -> Column:
    """struct(sys_len, ref_len, match: 4 counts, total: 4 counts) of a pair: what corpus BLEU adds up. Words are hashed to 64 bits; the work is that of sorting them."""

    def orders(p: Column, r: Column, hp: Column, hr: Column, n: int, found: list[Column]) -> Column:
        found = [*found, _matches(hp, hr)]
        if n < 4:
            return let(_paired(hp, p, n + 1), lambda a: let(_paired(hr, r, n + 1), lambda b: orders(p, r, a, b, n + 1, found)))
        total = [F.greatest(F.size(p) - k, F.lit(0)).cast("long") for k in range(4)]
        return F.struct(F.size(p).cast("long").alias("sys_len"), F.size(r).cast("long").alias("ref_len"), F.array(*found).alias("match"), F.array(*total).alias("total"))

    hashed = lambda c: F.transform(words(c), lambda x: F.xxhash64(x))
    return let(hashed(prediction), lambda p: let(hashed(reference), lambda r: orders(p, r, p, r, 1, [])))


def bleu_score(parts: Column) -> Column:
    """Aggregate: corpus BLEU (0 to 100), four-grams, exponentially smoothed: each order in turn without a match counts as half of what the last such one did, from a half.

    0 where nothing matches, or no prediction has four words.
    """
    match, total = ([F.sum(parts[name][n]).cast("double") for n in range(4)] for name in ("match", "total"))
    logs, misses = F.lit(0.0), F.lit(0)
    for n in range(4):
        misses = misses + F.when(match[n] == 0, 1).otherwise(0)
        logs = logs + F.log(F.when(match[n] == 0, F.pow(F.lit(0.5), misses)).otherwise(match[n]) / total[n])
    sys_len, ref_len = F.sum(parts["sys_len"]), F.sum(parts["ref_len"])
    brevity = F.when(sys_len >= ref_len, F.lit(1.0)).otherwise(F.exp(1 - ref_len / F.greatest(sys_len, F.lit(1))))
    return F.when((match[0] > 0) & (total[3] > 0), 100 * brevity * F.exp(logs / 4)).otherwise(F.lit(0.0))


def bleu_sums(parts: Column) -> Column:
    """Aggregate: the sums of bleu_parts(), of the same type, so that bleu_score() takes sums of shards as it takes single texts."""
    add = lambda name: F.array(*[F.sum(parts[name][n]) for n in range(4)]).alias(name)
    return F.struct(F.sum(parts["sys_len"]).alias("sys_len"), F.sum(parts["ref_len"]).alias("ref_len"), add("match"), add("total"))


def token_distance(a: Column, b: Column, words=tokens) -> Column:
    """Edits between the words of two texts: each distinct word stands for one character of its own. A null second text has no words."""

    def far(x: Column, y: Column, known: Column) -> Column:
        # code points from 256 on, without the surrogates; four bytes each
        code = lambda w: let(F.array_position(known, w) + 255, lambda n: F.lpad(F.hex(F.when(n < 0xD800, n).otherwise(n + 0x800)), 8, "0"))
        text = lambda ws: F.decode(F.unhex(F.array_join(F.transform(ws, code), "")), "UTF-32")
        return F.levenshtein(text(x), text(y))

    words_of = words(F.coalesce(b, F.lit("")))
    return let(words(a), lambda x: let(words_of, lambda y: let(F.array_distinct(F.concat(x, y)), lambda known: far(x, y, known))))


def effective_batch(per_device: int | Column, accumulation: int | Column, devices: int = 1) -> int | Column:
    """Rows that one update of a model sees."""
    return per_device * accumulation * devices


def rate(part: Column, whole: Column) -> Column:
    """A percentage; 0 of nothing is 0."""
    return 100 * part / F.greatest(whole, F.lit(1))


def shown(c: Column, digits: int = 4) -> Column:
    """A number as reports show it: halves go to the even digit."""
    return F.bround(c, digits)


def preference_loss(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, *, beta: float = 0.1, smoothing: float = 0.0, kind: str = "sigmoid", sft_weight: float = 0.1) -> Column:
    """The loss of a preference pair's log-probabilities; ValueError for an unknown kind."""
    logit = beta * ((policy_chosen - ref_chosen) - (policy_rejected - ref_rejected))
    if kind == "sigmoid":
        z = logit * (1 - 2 * smoothing)
        loss = F.when(z >= 0, F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)) - z)  # stable on both sides
    elif kind == "ipo":
        loss = F.pow(logit - 1 / (2 * beta), F.lit(2))
    else:
        raise ValueError(f"unknown loss {kind!r}")
    return loss - sft_weight * policy_chosen


def masked_mean(values: Column, keep: Column) -> Column:
    """The mean of the values where keep is 1; over at least 1."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    kept = F.zip_with(values, keep, lambda v, k: v * k.cast("double"))
    return add(kept) / F.greatest(add(F.transform(keep, lambda k: k.cast("double"))), F.lit(1.0))


def candidate_score(syntax: Column, compiles: Column, level: int = 2) -> Column:
    """0 for bad syntax, 1 for good syntax alone, 2 for what compiles too."""
    return F.when(~syntax, 0).when(F.lit(level < 2) | ~compiles, 1).otherwise(2)


def beams(candidates: int | Column, groups: int | Column) -> int | Column:
    """Beams for at least five candidates, a multiple of the groups."""
    if isinstance(candidates, Column) or isinstance(groups, Column):
        each = F.lit(groups) if isinstance(groups, int) else groups
        return (F.ceil(F.greatest(F.lit(candidates) if isinstance(candidates, int) else candidates, F.lit(5)) / each) * each).cast("long")
    return -(-max(candidates, 5) // groups) * groups
