"""Comparing nested values of JSON texts within their row, read as VARIANT on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.binding import let

_REST = r'[^"\\]*+(?:\\.[^"\\]*+)*+'  # the inside of a string
_DIGITS = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?+[0-9]++)?+"
_TOKENS = rf'(?s)"({_REST})"|(?<![-+.eE0-9])(?=([-0-9]))({_DIGITS})(?![-+.eE0-9]|[ \t\r\n]*+:)'  # strings, and numbers but in place of a name
_NUMBERS = rf'\G((?:[^"tf]++|"\|{_REST}")*+)("[-0-9]\|[^"]*+"|true|false)'  # what is before the next number of a sorted form, and the number


def _marked(text: Column) -> Column:
    """A JSON text with its numbers as strings, so that reading keeps every digit: "|x" for a string x, "2|2.50" for 2.50.

    What isn't JSON stays unreadable: numbers in no right form, or in place of a name, are left as they are.
    """
    return F.regexp_replace(text, F.lit(_TOKENS), F.lit('"$2|$1$3"'))


def _sorted_form(marked: Column) -> Column:
    """A marked text in one form: names in order, no white space, one way of escapes. Of several values the first alone."""
    return F.to_json(F.try_parse_json(marked))


def _bones(marked: Column) -> Column:
    """What is outside the strings of a marked text, with a quote for each of them and without white space."""
    return F.regexp_replace(marked, F.lit(rf'(?s)(")(?:{_REST})"|[ \t\r\n]++'), F.lit("$1"))


def _alone(marked: Column) -> Column:
    """The sorted form of a marked text after a bracket; null if it can't be read or more follows the first value."""
    return let(_sorted_form(marked), lambda form: F.when(F.length(_bones(marked)) == F.length(_bones(form)), F.concat(F.lit("["), form)))


def _frame(form: Column) -> Column:
    """A sorted form with a # in place of each number; strings begin with a quote, so that nothing else looks the same."""
    return F.regexp_replace(form, F.lit(_NUMBERS), F.lit("$1#"))


def _numbers(form: Column) -> Column:
    """The numbers of a sorted form as they were written; true and false are the whole numbers 1 and 0, and -0 is 0."""
    plain = lambda v: F.when(v == "true", "1").when(v.isin("false", '"-|-0"'), "0").otherwise(v.substr(F.lit(4), F.length(v) - 4))
    return F.transform(F.regexp_extract_all(form, F.lit(_NUMBERS), F.lit(2)), plain)


def _agree(a: Column, b: Column, tolerance: float) -> Column:
    x, y = a.cast("double"), b.cast("double")
    apart = F.abs(x - y)
    near = (x == y) | ((apart < float("inf")) & (apart <= tolerance * F.greatest(F.abs(x), F.abs(y))))
    return (a == b) | ((a.rlike("[.eE]") | b.rlike("[.eE]")) & near)


def json_alike(df: DataFrame, left: str, right: str, name: str = "same", tolerance: float = 1e-3) -> DataFrame:
    """df with whether two JSON texts hold the same: equal kinds but for numbers, which agree to a relative tolerance where one has a fraction or exponent, lists in order, objects by their entries. Null where either can't be read.

    asm.json_alike is the definition, but that an object with a name twice, NaN and infinities can't be read, that depth
    is up to 1,000, that whole numbers have any length, and that lone halves of surrogate pairs are all alike.
    Each row is worked out by itself, without a shuffle or scratch files: two texts agree if their sorted forms do
    but for the numbers, and those pair by pair.
    """
    ma, mb, v, x, y = own = ["_" * max(map(len, df.columns)) + k for k in "abvxy"]  # longer than any name of df
    rows = df.withColumns({ma: _marked(F.col(left)), mb: _marked(F.col(right))})
    # both are read at once; no marked string is ".", so that each text is one value if these are second and fourth
    rows = rows.withColumn(v, F.try_parse_json(F.concat(F.lit("["), ma, F.lit(',".",'), mb, F.lit(',"."]'))))
    fine = (F.try_variant_get(v, "$[1]", "string") == ".") & (F.try_variant_get(v, "$[3]", "string") == ".")
    rows = rows.withColumn(v, F.when(fine, F.to_json(v)))
    first, second = F.substring_index(v, ',".",', 1), F.concat(F.lit("["), F.substring_index(F.substring_index(v, ',".",', -1), ',"."]', 1))
    # alone where they can't be read at once: by an error in one, or too deep or long
    rows = rows.withColumns({x: F.coalesce(first, _alone(F.col(ma))), y: F.coalesce(second, _alone(F.col(mb)))})
    pairs = F.zip_with(_numbers(F.col(x)), _numbers(F.col(y)), lambda a, b: _agree(a, b, tolerance))
    differ = _frame(F.col(x)) != _frame(F.col(y))
    verdict = F.when(F.col(x) == F.col(y), True).when(differ, False).otherwise(F.forall(pairs, lambda p: p))
    return rows.withColumn(name, verdict).drop(*own)
