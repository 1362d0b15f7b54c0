"""Language pairs: which column of a row is source and which is target, and how each is wrapped.

A pair is written source_target-target. Routes are rows of a small table that joins broadcast
with data, or Python dictionaries on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.arrays import lookup
from quern.functions.text import tokens
from quern.sources.shipping import ship

#: Codes and the architecture and level of their keys.
CODES = {
    "x86": "x86_O0", "s": "x86_O0", "opt": "x86_Os", "opt3": "x86_O3",
    "arm": "arm_O0", "arm_opts": "arm_Os", "arm_opt3": "arm_O3",
    "riscv": "riscv_O0", "riscv_opts": "riscv_Os", "riscv_opt3": "riscv_O3",
    "ir": "ir_O0", "ir_opts": "ir_Os", "ir_optz": "ir_Oz", "ir_opt3": "ir_O3",
    "arm32": "arm32_O0", "arm32_opt3": "arm32_O3",
}
#: The routed pairs, as source code, target code and pair; c is the function's own text.
PAIRS = """
c x86 c_s-s
c arm c_arm-arm
arm armopt arm_armopt-armopt
x86 c s_c-c
x86 opt s_opt-opt
x86 arm s_arm-arm
opt3 c opt3_c-c
arm c arm_c-c
arm_opts c arm_opts_c-c
arm_opt3 c arm_opt3_c-c
opt3 x86 opt3_s-s
x86 x86 s_s-s
x86 opt3 s_opt3-opt3
riscv ir riscv_ir-ir
riscv_opts ir riscv_opts_ir_opts-ir_opts
riscv_opt3 ir_opt3 riscv_opt3_ir_opt3-ir_opt3
x86 ir s_ir-ir
opts ir_opts opts_ir_opts-ir_opts
opt3 ir_opt3 opt3_ir_opt3-ir_opt3
opt3 ir opt3_ir-ir
opt3 ir_optz opt3_ir_optz-ir_optz
arm ir arm_ir-ir
arm_opts ir arm_opts_ir_opt3-ir_opts
arm_opt3 ir_opt3 arm_opt3_ir_opt3-ir_opt3
arm_opt3 ir arm_opt3_ir-ir
riscv_opt3 ir riscv_opt3_ir-ir
arm32 ir arm32_ir-ir
arm32_opts ir arm32_opts_ir_opts-ir_opts
arm32_opt3 ir_opt3 arm32_opt3_ir_opt3-ir_opt3
opt3 arm_opt3 opt3_arm_opt3-arm_opt3
arm_opt3 ir_optz arm_opt3_ir_optz-ir_optz
riscv_opt3 ir_optz riscv_opt3_ir_optz-ir_optz
"""
#: Pairs whose masked target stands before the source.
TARGET_FIRST = """
opt3_c-c arm_s-s s_c-c arm_c-c arm_opt3_c-c riscv_c-c riscv_opt3_c-c s_ir-ir arm_ir-ir riscv_ir-ir riscv_opt3_ir_opt3-ir_opt3
arm_opt3_ir_opt3-ir_opt3 opt3_ir_opt3-ir_opt3 arm_opt3_ir_optz-ir_optz riscv_opt3_ir_optz-ir_optz
"""
#: Two more, unless the older order is asked for.
TARGET_FIRST_NEWER = "opt3_ir_optz-ir_optz opt3_ir-ir"
#: Pairs whose source too is looked up under the target's compiler.
SOURCE_BY_TARGET_COMPILER = "opt3_arm_opt3-arm_opt3 arm_opt3_ir_optz-ir_optz riscv_opt3_ir_optz-ir_optz"


def asm_key(code: str, prefix: str = "angha", compiler: str = "gcc", pic: bool = False) -> str:
    """The key of a code's text; KeyError for an unknown code."""
    return f"{prefix}_{compiler}_{CODES[code]}" + "_fPIC" * pic


def languages(pair: str) -> tuple[str, str]:
    """(source, target) of a pair: the left side without its last mention of the target."""
    left, target = pair.split("-")
    at = left.rfind(target)
    if at < 0:
        raise ValueError(f"{pair!r} doesn't name its target twice")
    return (left[:at] + left[at + len(target) :])[:-1], target


def wrapping(language: str, legacy: bool = False) -> tuple[str, str, list[tuple[str, str]]]:
    """(start, end, modifiers) of a language: its marks and those that go inside them."""
    clang = "clang_" in language
    name = language.replace("clang_", "")
    marks = ["clang"] * clang
    if name in ("s", "opt", "opt3"):
        token = "intel"
        marks += [name] * (name != "s")
    else:
        token = "c" if name == "c" else next((t for t in ("arm", "riscv", "ir") if t in name), None)
        if token is None:
            raise ValueError(language)
        marks += [m for m in ("opts", "opt3", "oz") if m in name][:1]
    both = lambda m: (f"<{m}>", "</opt>" if legacy and m == "opt3" else f"</{m}>")
    return *both(token), [both(m) for m in marks]


def target_left(pair: str, legacy: bool = False) -> bool:
    """Whether the masked target stands before the source."""
    return pair in TARGET_FIRST.split() or (not legacy and pair in TARGET_FIRST_NEWER.split())


@dataclass(frozen=True)
class Route:
    """What a pair reads; None is the function's own text. missing says that a code has no key: the text is then empty."""

    pair: str
    source: str | None
    target: str | None
    missing: bool


def route(pair: str, prefix: str = "angha", pic: bool = False) -> Route:
    """The keys of a pair; ValueError for one that isn't routed."""
    left, target_lang = pair.split("-")
    rest = left.replace(target_lang, "")
    source_compiler = "clang" if "clang" in rest or "ir" in rest else "gcc"
    target_compiler = "clang" if source_compiler == "clang" or "clang" in target_lang or "ir" in target_lang else "gcc"
    plain = pair.replace("clang_", "")
    table = {p: (s, t) for s, t, p in map(str.split, PAIRS.strip().splitlines())}
    if plain not in table:
        raise ValueError(pair)
    source, target = table[plain]
    if plain in SOURCE_BY_TARGET_COMPILER.split():
        source_compiler = target_compiler
    missing = any(c != "c" and c not in CODES for c in (source, target))
    key = lambda c, compiler: None if c == "c" or c not in CODES else asm_key(c, prefix, compiler, pic)
    return Route(pair, key(source, source_compiler), key(target, target_compiler), missing)


def routed(pair: str, *, own: str = "func_def", asm: str = "asm", prefix: str = "angha", pic: bool = False, parity: bool = False) -> tuple[Column, Column]:
    """(source, target) columns of a pair; null where a text is missing, or empty with parity. ValueError for codes without a key, unless parity."""
    r = route(pair, prefix, pic)
    if r.missing and not parity:
        raise ValueError(f"{pair!r} names a code without a key")
    plain = {p: (s, t) for s, t, p in map(str.split, PAIRS.strip().splitlines())}[pair.replace("clang_", "")]

    def text(key: str | None, code: str) -> Column:
        c = F.col(own) if code == "c" else F.lit(None).cast("string") if key is None else lookup(F.col(f"{asm}.target"), F.col(f"{asm}.code"), F.lit(key))
        if pic and key:
            c = F.coalesce(c, lookup(F.col(f"{asm}.target"), F.col(f"{asm}.code"), F.lit(key.removesuffix("_fPIC"))))
        return F.coalesce(c, F.lit("")) if parity else c

    return text(r.source, plain[0]), text(r.target, plain[1])


def wrapped(text: Column, language: str, *, legacy_modifiers: bool = True, legacy: bool = False) -> Column:
    """A text between its language's marks; with legacy_modifiers the closing modifiers repeat the opening ones."""
    start, end, marks = wrapping(language, legacy)
    opening = [a for a, _ in marks]
    closing = [a if legacy_modifiers else b for a, b in reversed(marks)]
    return F.concat_ws(" ", F.lit(" ".join([start, *opening])), text, F.lit(" ".join([*closing, end])))


def sample_texts(source: Column, target: Column, pair: str, **options) -> tuple[Column, Column]:
    """(source with the masked target, target) as they go to a tokenizer."""
    s, t = languages(pair)
    masked = wrapped(F.lit("<mask:0>"), t, **options)
    own = wrapped(source, s, **options)
    return (F.concat_ws(" ", masked, own) if target_left(pair) else F.concat_ws(" ", own, masked)), target


@lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoded(c: Column, tokenizer: str | None = None) -> Column:
    """A text as token ids of a tokenizers file, normalized as that says and without added marks; without a file as its words between white space. Null stays null."""
    if tokenizer is None:
        return tokens(c)
    ship()

    def ids(texts: pd.Series) -> pd.Series:
        some = texts.notna()
        found = iter(_tokenizer(tokenizer).encode_batch(texts[some].tolist(), add_special_tokens=False))
        return pd.Series([next(found).ids if x else None for x in some], index=texts.index, dtype=object)

    ids.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(ids, "array<int>")(c)


def tokenized(source: Column, target: Column, pair: str, tokenizer: str | None = None, most: int | None = None, **options) -> Column:
    """struct(source_ids, target_ids) of a pair: the wrapped source with the masked target beside it, and the bare target; of over most tokens the first so many."""
    given, wanted = sample_texts(source, target, pair, **options)
    cut = (lambda c: c) if most is None else (lambda c: F.slice(c, F.lit(1), most))
    return F.struct(cut(encoded(given, tokenizer)).alias("source_ids"), cut(encoded(wanted, tokenizer)).alias("target_ids"))
