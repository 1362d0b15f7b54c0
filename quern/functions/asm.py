"""Functions of assembly units, on arrays of lines on the JVM's side; and recursive comparisons as Arrow-batched functions.

Null stays null. Of the comparisons the plain Python functions are the definitions; udf() wraps one for
columns. Each works on one cell and holds nothing between rows.
"""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.binding import let
from quern.functions.text import every_line, joined, lines, stripped
from quern.sources.shipping import ship


def udf(f: Callable, returns: str) -> Callable[..., Column]:
    """f as an Arrow-batched column function; null where the first argument is null."""
    ship()

    def each(*series: pd.Series) -> list:
        return [None if x[0] is None else f(*x) for x in zip(*series, strict=True)]

    def cells(*series: pd.Series) -> pd.Series:
        return pd.Series(each(*series), dtype=object)

    def records(*series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([x or {} for x in each(*series)])

    run = records if returns.startswith("struct") else cells
    run.__annotations__ = {"series": pd.Series, "return": pd.DataFrame if run is records else pd.Series}
    return F.pandas_udf(run, returns)


def _places(rows: Column, test: Callable[[Column], Column]) -> Column:
    """The numbers of the lines that pass a test, from 0."""
    return F.filter(F.transform(rows, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def _first(places: Column, test: Callable[[Column], Column] | None = None) -> Column:
    """The least place, that passes a test if one is given; null if there is none."""
    return F.array_min(F.filter(places, test) if test else places)


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("\\Q"), name, F.lit("\\E"))


def _span(rows: Column, start: Column, stop: Column) -> Column:
    """Lines from start to before stop."""
    return F.slice(rows, start + 1, F.greatest(stop - start, F.lit(0)))


def function_by_scope(asm: Column, name: Column) -> Column:
    """From name's .globl or .global line to .cfi_endproc; without that mark to before .size or .Lfunc_end, else the end. Null if absent."""
    within = lambda p: F.lit(p.replace("\\s", "[^\\S\\n]"))  # white space, but no line feed
    first = F.concat(within("(?d)\\A(?>(?s:.*?)(?m:^)(?=\\s*+\\.glob[al]l?\\s+"), _quoted(name), F.lit("\\b))"))
    closes = F.concat(within("\\s*+(?:\\.size\\s+"), _quoted(name), within("\\s*,|\\.Lfunc_end\\d+:)"))
    framed = F.concat(first, F.lit("([^\\n]*+\\n(?s:.*?)\\.cfi_endproc[^\\n]*+)"))
    bare = F.concat(first, F.lit("([^\\n]*+(?:\\n(?!"), closes, F.lit(")[^\\n]*+)*+)"))
    cut = lambda p: F.nullif(F.call_function("regexp_extract", asm, p, F.lit(1)), F.lit(""))
    return F.coalesce(cut(framed), cut(bare))


def function_by_type(asm: Column, name: Column) -> Column:
    """The scope and .type lines of name, with .align lines after the latter, then from its label to its .size line (or the end); null without a label after a .type line.

    A scope line is put in front where a .type line comes first.
    """
    line = lambda *parts: F.concat(F.lit("^\\s*"), *parts)
    kind = line(F.lit("\\.type\\s+"), _quoted(name), F.lit("\\s*,\\s*[%@]function"))
    scope = line(F.lit("\\.(?:global|globl)\\s+"), _quoted(name), F.lit("\\s*$"))
    size = line(F.lit("\\.size\\s+"), _quoted(name), F.lit("\\s*,"))

    def cut(rows: Column, typed: Column, label: Column) -> Column:
        before = F.filter(F.transform(_span(rows, F.lit(0), label), lambda x, i: F.when(F.regexp_like(x, kind) | F.regexp_like(x, scope) | ((i > typed) & x.rlike("^\\s*\\.align\\s+\\d+")), x)), lambda x: x.isNotNull())
        stop = F.coalesce(_first(_places(rows, lambda x: F.regexp_like(x, size)), lambda i: i > label) + 1, F.size(rows))
        front = lambda head: F.when(F.regexp_like(F.get(head, F.lit(0)), kind), F.array(F.concat(F.lit("\t.global\t"), name))).otherwise(F.array().cast("array<string>"))
        return F.when(label.isNotNull(), let(before, lambda head: joined(F.concat(front(head), head, _span(rows, label, stop)))))

    def labelled(rows: Column, typed: Column) -> Column:
        label = _first(_places(rows, lambda x: stripped(x) == F.concat(name, F.lit(":"))), lambda i: i > typed)
        return let(label, lambda at: cut(rows, typed, at))

    return let(lines(asm), lambda rows: let(_first(_places(rows, lambda x: F.regexp_like(x, kind))), lambda typed: labelled(rows, typed)))


def parts_of_unit(asm: Column, name: Column, arch: str, comment: str) -> Column:
    """struct(pre, func, post): a unit's lines before, in and after a function; the function with its own header and without comments or blank lines.

    It begins at its label and ends with .cfi_endproc, or in riscv units without that mark with the return. Its scope line leaves pre.
    """
    arm = arch == "arm"
    scope = F.concat(F.lit(".global " if arm else ".globl "), name)
    header = F.array(scope, F.concat(F.lit(".type "), name, F.lit(", %function" if arm else ", @function")))

    def cut(rows: Column, start: Column) -> Column:
        returns = lambda x: x.rlike("jr\tra|ret|jr ra") if arch == "riscv" else F.lit(False)
        framed = F.contains(asm, F.lit(".cfi_endproc"))
        ends = _places(rows, lambda x: F.contains(x, F.lit(".cfi_endproc")) | (~framed & returns(x)))
        size = F.size(rows)
        head = F.coalesce(start, size)
        tail = F.coalesce(_first(ends, lambda i: i >= start) + 1, size)
        pre = F.filter(_span(rows, F.lit(0), head), lambda x: ~F.contains(x, scope))
        func = F.filter(F.transform(F.concat(header, _span(rows, head, tail)), lambda x: F.substring_index(x, comment, 1)), lambda x: x.rlike("\\S"))
        post = F.when(start.isNotNull(), _span(rows, tail, size)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(joined(pre), F.lit("\n")).alias("pre"), joined(func).alias("func"), F.concat(joined(post), F.lit("\n")).alias("post"))

    start = lambda rows: _first(_places(rows, lambda x: x.startswith(F.concat(name, F.lit(":")))))
    return let(every_line(asm), lambda rows: let(start(rows), lambda at: cut(rows, at)))


def with_literals(unit: Column, func: Column) -> Column:
    """func followed by the constants it names, each with the first line that defines it; in order of appearance."""
    named = lambda pattern: F.array_distinct(F.regexp_extract_all(func, F.lit(f"({pattern})")))
    line = lambda n: F.call_function("regexp_extract", unit, F.concat(_quoted(n), F.lit(":[\\r\\n]+([^\\r\\n]+)")), F.lit(1))
    found = F.transform(F.concat(named("\\.LC[0-9]*"), named("a\\.[0-9]*")), lambda n: let(line(n), lambda x: F.when(x != "", F.concat(n, F.lit(": "), x))))
    return F.concat(func, F.lit("\n"), joined(F.filter(found, lambda x: x.isNotNull())), F.lit("\n"))


def alike(a: Any, b: Any) -> bool:
    """Whether two decoded values agree: same types but for numbers, floats to a relative 1e-3, lists in order, objects by their keys."""
    numbers = isinstance(a, int | float) and isinstance(b, int | float)
    if numbers and (isinstance(a, float) or isinstance(b, float)):
        return math.isclose(a, b, rel_tol=1e-3)
    if numbers:
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(alike, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(alike(a[k], b[k]) for k in a)
    return a == b


def json_alike(a: str, b: str | None) -> bool | None:
    """alike() of two JSON texts; None where either can't be read."""
    try:
        return alike(json.loads(a), json.loads(b or ""))
    except ValueError:
        return None


def literals_to_json(names: list, values: list | None) -> str | None:
    """{name: value} as JSON of parallel arrays, the values being literals; None where one can't be read."""
    try:
        return json.dumps({k: ast.literal_eval(v) for k, v in zip(names, values if values is not None else [], strict=False)})
    except (ValueError, SyntaxError, TypeError):
        return None


def preprocessed(asm: Column, name: Column, aarch64: Column | None = None) -> Column:
    """A function of a unit as a training sample: cut out, without comments and unwanted directives, header and white space in one form; null if absent."""
    arm = text.detect_aarch64 if aarch64 is None else lambda unit: aarch64
    return let(asm, lambda unit: let(function_by_scope(unit, name), lambda cut: let(arm(unit), lambda a: text.sample_form(cut, name, a))))
