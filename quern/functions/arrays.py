"""Lookups and updates in parallel arrays, padding, and reshaping of nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.binding import let


def lookup(keys: Column, values: Column, key: Column) -> Column:
    """The value at the first place of key; null where the key is absent, the value missing, null or empty."""
    at = F.nullif(F.array_position(keys, key), F.lit(0)).cast("int")
    return F.nullif(F.try_element_at(values, at), F.lit(""))


def lookup_or(keys: Column, values: Column, key: Column, *others: Column) -> Column:
    """lookup(), else the first of the others that isn't null."""
    return F.coalesce(lookup(keys, values, key), *others)


def updated(keys: Column, values: Column, key: Column, new: Column) -> Column:
    """values with new at the first place of key; as they were where it is absent."""
    return let(F.array_position(keys, key), lambda at: F.transform(values, lambda v, i: F.when(i == at - 1, new).otherwise(v)))


def columns_of(rows: Column, *fields: str) -> Column:
    """An array of structs as a struct of arrays."""
    return F.struct(*[F.transform(rows, lambda r: r[name]).alias(name) for name in fields])


def rows_of(**arrays: Column) -> Column:
    """Parallel arrays as one array of structs, as long as the shortest."""
    n = F.least(*[F.size(a) for a in arrays.values()]) if len(arrays) > 1 else F.size(next(iter(arrays.values())))
    return F.slice(F.arrays_zip(*[a.alias(k) for k, a in arrays.items()]), F.lit(1), n)


def capped(a: Column, b: Column, most: int = 5) -> Column:
    """Both arrays' pairs, at most so many."""
    return F.slice(F.arrays_zip(a, b), F.lit(1), F.least(F.size(a), F.size(b), F.lit(most)))


def padded(ids: Column, size: Column, pad: int) -> Column:
    """ids up to the size, filled with pad."""
    return F.concat(ids, F.array_repeat(F.lit(pad), size - F.size(ids)))


def mask(ids: Column, pad: int) -> Column:
    """1 where an id isn't pad."""
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def shifted(labels: Column, start: int = 2, pad: int = 1, ignored: int = -100) -> Column:
    """Decoder inputs for labels: the start id, then all labels but the last; ignored ones become pad."""
    moved = F.concat(F.array(F.lit(start)), F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))))
    return F.when(F.size(labels) == 0, labels).otherwise(F.transform(moved, lambda x: F.when(x == ignored, F.lit(pad)).otherwise(x)))


def same_keys(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same set."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def with_unoptimized(targets: Column) -> Column:
    """Targets and the unoptimized variant of each, each once."""
    return F.array_distinct(F.concat(targets, F.transform(targets, lambda t: F.regexp_replace(t, "_O3|_Os|_Oz", "_O0"))))


def paired_map(keys: Column, values: Column) -> Column:
    """A map of parallel arrays; of a repeated key the last value counts."""
    last = F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda s: ~F.exists(F.slice(keys, s["i"] + 2, F.size(keys)), lambda x: x == s["k"]))
    return F.map_from_entries(F.transform(last, lambda s: F.struct(s["k"].alias("key"), F.get(values, s["i"]).alias("value"))))


def close(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    """Whether numbers agree to a relative tolerance."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
