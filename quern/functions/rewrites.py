"""Rewrites of AArch64 functions that change the text and keep what it computes, and a small machine to hold them to it.

A rewrite only writes to registers that the function never names, and never to the flags, so it may
stand anywhere in straight-line code. Where no register is free, forms without one are used. Choices come
from a seed, so the same text, seed and epoch give the same result on any worker.
"""

from __future__ import annotations

import hashlib
import operator
import random
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of the rewrites, and the registers that a callee needn't keep.
TRANSFORMS = ("dead_code", "insn_sub", "opaque_pred", "junk_comp")
TEMPORARY = range(9, 16)

_MNEMONIC = re.compile(r"\s+([a-z][a-z0-9.]*)(?:\s|$)")
_LEAVING = {"b", "bl", "br", "blr", "ret", "cbz", "cbnz", "tbz", "tbnz"}
_REGISTER = re.compile(r"\b[xw]([0-9]+)\b")
_PLAIN = re.compile(r"[xw][0-9]+")
_MARK = ".Lway_"
_OWN_LABEL = re.compile(rf"\s*{re.escape(_MARK)}([0-9]{{1,18}}):")
_CUT = re.compile(rf"(.*(?:#|{re.escape(_MARK)}))(0|[1-9][0-9]{{0,17}})(:?)", re.DOTALL)
#: The instructions that write one register and read one: a name and its greatest number, 0 without one, -1 where the source stands twice; and the shares of the names, whose four kinds are equally likely.
_STEPS = [("add", 4095), ("sub", 4095), *[(n, 63) for n in ("lsl", "lsr", "asr", "ror")], *[(n, 0) for n in ("mvn", "neg", "rev")], *[(n, -1) for n in ("eor", "orr", "and", "mul")]]
_SHARES = np.repeat(np.arange(13), [6, 6, 3, 3, 3, 3, 4, 4, 4, 3, 3, 3, 3])
_MOST = np.array([most for _, most in _STEPS])
#: Of how many heads a worker remembers what it knows; functions repeat theirs.
_REMEMBERED = 1 << 15


def mnemonic(line: str) -> str | None:
    """An indented instruction's name; None for labels, directives and blank lines."""
    m = _MNEMONIC.match(line)
    return m[1] if m else None


def is_branch(line: str) -> bool:
    """Whether an instruction may leave the straight line."""
    name = mnemonic(line)
    return name is not None and (name in _LEAVING or name.startswith("b."))


def is_instruction(line: str) -> bool:
    """Whether a line is an instruction."""
    return mnemonic(line) is not None


class Head(NamedTuple):
    """A line but for its number: what stands before and after it, that with the line's end, the length of both; whether it is an instruction that stays in the straight line, which registers it names (as bits), and the number of an own label that stands there with more than itself."""

    before: str
    after: str
    end: str
    size: int
    straight: bool
    named: int
    label: int


@lru_cache(_REMEMBERED)
def _head(before: str, after: str = "") -> Head:
    named = {int(n) for n in _REGISTER.findall(before)}
    m = _OWN_LABEL.match(before)
    return Head(before, after, after + "\n", len(before) + len(after) + 1, is_instruction(before) and not is_branch(before), sum(1 << n for n in named if n < 31), int(m[1]) if m else 0)


def _step_text(name: str, most: int, target: int, source: int) -> str:
    return f"\t{name} x{target}, x{source}" + (", #" if most > 0 else f", x{source}" if most else "")


#: The heads that rewrites make by the thousand, and where they are: steps by name, target and source, moves by target, tests by kind and target, labels, no instruction, a test of zero.
_TESTS = ("cbz x{}, ", "tbz x{}, #0, ", "cbnz x{}, ", "tbnz x{}, #0, ")
_OWN = [
    *[_head(_step_text(name, most, t, s)) for name, most in _STEPS for t in TEMPORARY for s in range(16)],
    *[_head(f"\tmov x{t}, #") for t in TEMPORARY],
    *[_head(f"\t{test.format(t)}{_MARK}") for test in _TESTS for t in TEMPORARY],
    *[_head(_MARK, ":"), _head("\tnop"), _head(f"\tcbnz xzr, {_MARK}")],
]
_PLACES = {h[:2]: i for i, h in enumerate(_OWN)}
_STEP_AT = np.arange(len(_STEPS) * len(TEMPORARY) * 16).reshape(len(_STEPS), len(TEMPORARY), 16)
_MOVE_AT = _STEP_AT.size + np.arange(len(TEMPORARY))
_TEST_AT = _STEP_AT.size + len(TEMPORARY) * (1 + np.arange(len(_TESTS))[:, None]) + np.arange(len(TEMPORARY))
_LABEL, _NOP, _ZERO_TEST = range(len(_OWN) - 3, len(_OWN))
_OWN_COLUMNS = {name: np.array([getattr(h, name) for h in _OWN], dtype=object if name in ("before", "after", "end") else None) for name in Head._fields}
#: The free ones of the temporary registers by their bits, and how many they are.
_FREE = np.array([(f := [i for i in range(len(TEMPORARY)) if bits >> i & 1]) + [0] * (len(TEMPORARY) - len(f)) for bits in range(1 << len(TEMPORARY))])
_N_FREE = np.array([bits.bit_count() for bits in range(1 << len(TEMPORARY))])
_POWERS = 10 ** np.arange(19)
#: The texts of no number and of small ones.
_DIGITS = np.array(["", *map(str, range(65536))], dtype=object)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at starts, one run after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class Code:
    """Functions' lines in columns: the head, as a place among the rewrites' own and then those of these functions, the number, -1 where there is none, the function, and whether the line is of its body.

    Rewrites work on all touched lines of all functions at once. What is drawn depends on a function's key and the line's place in it, not on the functions beside it.
    """

    def __init__(self, functions: Sequence[Sequence[str]]):
        self.heads: list[Head] = []
        self.places: dict[tuple[str, str], int] = {}
        rows = [row for f in functions for row in f]
        distinct = {row: i for i, row in enumerate(dict.fromkeys(rows))}
        where = np.fromiter(map(distinct.__getitem__, rows), np.int64, len(rows))
        lines = np.array([self.line(row) for row in distinct], dtype=np.int64).reshape(-1, 2)
        self.head, self.number = lines[where, 0], lines[where, 1]
        self.ends = np.cumsum([len(f) for f in functions])  # a function has a line at least
        self.of = np.repeat(np.arange(len(functions)), np.diff(self.ends, prepend=0))
        self.body = np.ones(len(rows), dtype=bool)
        self.keys = np.zeros(len(functions), dtype=np.uint64)

    @property
    def begins(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]])

    def line(self, row: str) -> tuple[int, int]:
        """A line's head and number."""
        m = _CUT.fullmatch(row)
        if m and (m[1] == _MARK if m[3] else not m[1].startswith(_MARK)):
            return self.place(m[1], m[3]), int(m[2])
        return self.place(row), -1

    def place(self, before: str, after: str = "") -> int:
        """Where a head is; it is added if it is new."""
        at = _PLACES.get((before, after))
        if at is None:
            at = self.places.get((before, after))
        if at is None:
            at = self.places[before, after] = len(_OWN) + len(self.heads)
            self.heads.append(_head(before, after))
        return at

    def first(self, word: str, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The functions with a line that begins with a word, from a place on that is given for each function, and where the first such line is."""
        heads = [i for i, h in enumerate(self.heads, len(_OWN)) if h.before.lstrip().startswith(word)]
        at = np.flatnonzero(np.isin(self.head, heads))
        at = at[at >= least[self.of[at]]]
        functions, firsts = np.unique(self.of[at], return_index=True)
        return functions, at[firsts]

    def bound(self) -> None:
        """Sets bodies to what stands between .cfi_startproc and the next .cfi_endproc, where there is such a beginning."""
        begin, end = self.begins, self.ends.copy()
        started, at = self.first(".cfi_startproc", begin)
        begin[started] = at + 1
        stopped, at = self.first(".cfi_endproc", begin)
        has = np.isin(stopped, started)
        end[stopped[has]] = at[has]
        here = np.arange(len(self.head))
        self.body = (here >= begin[self.of]) & (here < end[self.of])

    def draws(self, at: np.ndarray, salt: int) -> np.ndarray:
        """63 random bits for each of some lines; remainders of them are as good as even."""
        of = self.of[at]
        z = self.keys[of] + np.uint64(salt * 0xD1342543DE82EF95 & _FULL) + (at - self.begins[of]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return ((z ^ z >> np.uint64(31)) >> np.uint64(1)).astype(np.int64)

    def column(self, name: str) -> np.ndarray:
        """A property of all heads."""
        own = _OWN_COLUMNS[name]
        return np.concatenate([own, np.array([getattr(h, name) for h in self.heads], dtype=own.dtype)])

    def lengths(self) -> np.ndarray:
        """The lengths of the texts."""
        digits = np.where(self.number < 0, 0, np.maximum(np.searchsorted(_POWERS, self.number, "right"), 1))
        return np.add.reduceat(self.column("size")[self.head] + digits, self.begins) - 1

    def texts(self) -> list[str]:
        pieces = np.empty((len(self.head), 3), dtype=object)
        pieces[:, 0], pieces[:, 2] = self.column("before")[self.head], self.column("end")[self.head]
        small = self.number < len(_DIGITS) - 1
        pieces[:, 1] = _DIGITS[np.where(small, self.number, -1) + 1]
        if not small.all():
            pieces[~small, 1] = [str(n) for n in self.number[~small].tolist()]
        flat = pieces.ravel().tolist()
        return ["".join(flat[3 * a : 3 * b])[:-1] for a, b in zip(self.begins.tolist(), self.ends.tolist(), strict=True)]

    def rewrite(self, kinds: np.ndarray, intensity: np.ndarray, keys: np.ndarray) -> None:
        """One rewrite of each body, by its place among TRANSFORMS (-1 for none), with registers and labels that the body doesn't name."""
        if not ((intensity >= 0) & (intensity <= 1)).all():
            raise ValueError(f"intensity {intensity} is not within 0 and 1")
        self.keys = keys
        begins = self.begins
        at = np.flatnonzero(self.column("straight")[self.head] & self.body & (kinds >= 0)[self.of])
        touched = at[(self.draws(at, 0) >> 10) * 2.0**-53 < intensity[self.of[at]]]
        if not len(touched):
            return
        free = ~np.bitwise_or.reduceat(np.where(self.body, self.column("named")[self.head], 0), begins) >> TEMPORARY[0] & (1 << len(TEMPORARY)) - 1
        n, r = np.maximum(_N_FREE[free], 1), self.draws(begins, 1)
        one, other = r % n, (r % n + 1 + (r >> 20) % np.maximum(n - 1, 1)) % n
        of = self.of[touched]
        own, has = np.stack([_FREE[free, one], _FREE[free, other]], axis=1)[of], np.minimum(_N_FREE[free], 2)[of]
        d, kind = self.draws(touched, 2), kinds[of]
        chosen = {name: np.flatnonzero(kind == i) for i, name in enumerate(TRANSFORMS)}
        sizes = np.ones(len(touched), dtype=np.int64)
        sel = chosen["dead_code"]
        sizes[sel] = 2 + d[sel] % 3
        sel = chosen["junk_comp"]
        sizes[sel] = 3 + d[sel] % 4
        sel = chosen["opaque_pred"]
        sizes[sel] = np.where(has[sel] > 0, 4 + (d[sel] & 1), 3)
        known = np.maximum.reduceat(np.where(self.head == _LABEL, self.number, self.column("label")[self.head]), begins)
        labels = 1 + known[of[sel]] + np.arange(len(sel)) - np.searchsorted(of[sel], of[sel])
        sel = chosen["insn_sub"]
        words = self.other_words(touched[sel], d[sel], own[sel], has[sel])
        sizes[sel] = 1 + ((words[0] > 0) & (words[0] < _SAID))
        start = self.spread(touched, sizes)
        for name, more in (("dead_code", ()), ("junk_comp", ()), ("opaque_pred", (labels,)), ("insn_sub", words)):
            if len(sel := chosen[name]):
                getattr(self, name)(start[sel], d[sel], own[sel], has[sel], *more)

    def spread(self, touched: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Makes so many copies of each touched line, for others to be written over; returns where they begin."""
        counts = np.ones(len(self.head), dtype=np.int64)
        counts[touched] = sizes
        self.head, self.number, self.of, self.body = (np.repeat(c, counts) for c in (self.head, self.number, self.of, self.body))
        through = np.cumsum(counts)
        self.ends = through[self.ends - 1]
        return (through - counts)[touched]

    def put(self, at: np.ndarray, heads: np.ndarray | int, numbers: np.ndarray | int = -1) -> None:
        self.head[at], self.number[at] = heads, numbers

    def steps(self, at: np.ndarray, targets: np.ndarray, sources: np.ndarray) -> None:
        """Instructions that each write a register of the temporary ones alone and read a register alone."""
        r = self.draws(at, 4)
        names = _SHARES[r % 48]
        most = _MOST[names]
        self.put(at, _STEP_AT[names, targets, sources], np.where(most > 0, 1 + r // 48 % np.maximum(most, 1), -1))

    def dead_code(self, start: np.ndarray, d: np.ndarray, own: np.ndarray, has: np.ndarray) -> None:
        """One to three instructions after the line, whose results nobody reads."""
        extra = 1 + d % 3
        at, by = _runs(start + 1, extra), np.repeat(np.arange(len(start)), extra)
        r = self.draws(at, 3)
        self.put(at, _NOP)
        live = (has[by] > 0) & (r % 5 > 0)
        at, by, r = at[live], by[live], r[live] // 5
        self.steps(at, own[by, (r & 1) % has[by]], (r >> 1) % 9)

    def junk_comp(self, start: np.ndarray, d: np.ndarray, own: np.ndarray, has: np.ndarray) -> None:
        """A computation of two to five instructions before the line, each on the result of the one before."""
        n = 1 + d % 4
        some, none = has > 0, has == 0
        self.put(_runs(start[none], n[none] + 1), _NOP)
        at, x = _runs(start[some] + 1, n[some]), own[some, 0]
        self.put(start[some], _MOVE_AT[x], 1 + (d[some] >> 2) % 65535)
        x = np.repeat(x, n[some])
        self.steps(at, x, TEMPORARY[0] + x)

    def opaque_pred(self, start: np.ndarray, d: np.ndarray, own: np.ndarray, has: np.ndarray, labels: np.ndarray) -> None:
        """The line behind a test that always goes one way: past it a branch that is never taken, or one that always is over a line that never runs."""
        none, some = has == 0, has > 0
        self.put(start[none], _ZERO_TEST, labels[none])
        self.put(start[none] + 2, _LABEL, labels[none])
        start, d, x, labels = start[some], d[some], own[some, 0], labels[some]
        self.put(start, _MOVE_AT[x], (1 + (d >> 2) % 32767) * 2 + 1)  # odd, so neither zero nor without its lowest bit
        self.put(start + 1, _TEST_AT[2 * (d & 1) + (d >> 1 & 1), x], labels)
        always = (d & 1) == 1
        self.steps(start[always] + 2, x[always], TEMPORARY[0] + x[always])
        self.put(start + 3, _LABEL, labels)

    def other_words(self, touched: np.ndarray, d: np.ndarray, own: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, ...]:
        """How lines are said otherwise (0 for not at all), and by which one or two heads."""
        bare = len(TEMPORARY)
        pairs, at = np.unique(self.head[touched] * (bare + 1) + np.where(has > 0, own[:, 0], bare), return_inverse=True)
        every = [self.in_other_words(head, None if x == bare else TEMPORARY[x]) for head, x in zip(*(p.tolist() for p in np.divmod(pairs, bare + 1)), strict=True)]
        least, most, ways = (np.array([e[i] for e in every], dtype=np.int64) for i in range(3))
        n, (how, one, two) = self.number[touched], ways.reshape(-1, 2, 3)[at, d & 1].T
        return np.where((n < least[at]) | (n > most[at]) | ((how == _PARTED) & (n < 2)), 0, how), one, two

    def insn_sub(self, start: np.ndarray, d: np.ndarray, own: np.ndarray, has: np.ndarray, how: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """The line in other words; itself where there are none."""
        n = self.number[start]
        part = 1 + (d >> 1) % np.maximum(np.where(how == _MADE, np.minimum(n, 4095), n - 1), 1)
        nothing = np.full(len(n), -1)
        for kind, first, second in ((_MOVED, n, nothing), (_PARTED, part, n - part), (_MADE, n - part, part), (_SAID, nothing, None), (_PLUS_ZERO, nothing + 1, None)):
            sel = how == kind
            self.put(start[sel], one[sel], first[sel])
            if second is not None:
                self.put(start[sel] + 1, two[sel], second[sel])

    def in_other_words(self, head: int, spare: int | None) -> tuple[int, int, list[tuple[int, int, int]]]:
        """Of a head: the least and the greatest number that it can be said otherwise with, and two equally likely ways: how, and one or two heads."""
        h = _OWN[head] if head < len(_OWN) else self.heads[head - len(_OWN)]
        least, most, ways = _other_words(h.before, spare)
        return least, most, [(how, *(self.place(x) for x in texts), *[0] * (2 - len(texts))) for how, *texts in ways]


#: How a line is said otherwise: by two lines, a number moved to a register, parted in two or made by an addition; by one line, or one that adds zero.
_MOVED, _PARTED, _MADE, _SAID, _PLUS_ZERO = range(1, 6)


@lru_cache(_REMEMBERED)
def _other_words(before: str, spare: int | None) -> tuple[int, int, list[tuple]]:
    """What in_other_words says, with texts for heads."""
    name, args = parsed(before)
    a, plain = args[0] if args else "", [_PLAIN.fullmatch(x) is not None for x in args]
    width = "w" if a.startswith("w") else "x"
    own = None if spare is None else f"{width}{spare}"
    no = (0,)
    if args[-1:] == ["#"]:
        if name in ("add", "sub") and len(args) == 3:
            parted = (_PARTED, f"\t{name} {a}, {args[1]}, #", f"\t{name} {a}, {a}, #") if plain[0] else no
            return 1, 4095, [(_MOVED, f"\tmov {own}, #", f"\t{name} {a}, {args[1]}, {own}") if own else parted, parted]
        if name == "mov" and len(args) == 2 and plain[0]:
            return 1, 65535, [(_MADE, f"\tmov {a}, #", f"\tadd {a}, {a}, #")] * 2
        if name == "cmp" and len(args) == 2 and plain[0] and own:
            return 0, 4095, [(_MOVED, f"\tmov {own}, #", f"\tcmp {a}, {own}")] * 2
        if name == "lsl" and len(args) == 3 and plain[1]:
            return 1, 1, [(_SAID, f"\tadd {a}, {args[1]}, {args[1]}")] * 2
    elif name == "mov" and plain == [True, True]:
        return -1, -1, [(_PLUS_ZERO, f"\tadd {a}, {args[1]}, #"), (_SAID, f"\teor {a}, {args[1]}, {width}zr")]
    elif name == "neg" and plain == [True, True]:
        return -1, -1, [(_SAID, f"\tsub {a}, {width}zr, {args[1]}")] * 2
    return 0, 0, [no, no]


def parsed(row: str) -> tuple[str, list[str]]:
    """An instruction's name and operands."""
    name, *rest = row.split(None, 1)
    return name, [a.strip() for a in rest[0].split(",")] if rest else []


def transformed(rows: list[str], kind: str, intensity: float, rng: random.Random) -> list[str]:
    """Lines under one rewrite; each instruction that stays in the straight line is touched with the chance intensity (0 to 1, else ValueError)."""
    if kind not in TRANSFORMS:
        raise ValueError(f"unknown transform {kind!r}")
    code = Code([rows or [""]])
    code.rewrite(np.array([TRANSFORMS.index(kind)]), np.array([intensity]), np.array([rng.getrandbits(64)], dtype=np.uint64))
    return code.texts()[0].split("\n") if rows else []


def rewrite_all(code: Code, seeds: Sequence[int], epoch: int = 0, least: int = 1, most: int = 3, intensity: tuple[float, float] = (0.1, 0.5)) -> None:
    """Brings functions under random choices of rewrites of their bodies, each as it would be alone."""
    most = min(most, len(TRANSFORMS))
    shape = (most, len(seeds))
    kinds, chances, keys = np.full(shape, -1), np.zeros(shape), np.zeros(shape, dtype=np.uint64)
    for i, seed in enumerate(seeds):
        rng = random.Random(int.from_bytes(hashlib.blake2b(f"{seed}:{epoch}".encode(), digest_size=8).digest(), "big"))
        for k, kind in enumerate(rng.sample(range(len(TRANSFORMS)), rng.randint(least, most))):
            kinds[k, i], chances[k, i], keys[k, i] = kind, rng.uniform(*intensity), rng.getrandbits(64)
    code.bound()
    for one in zip(kinds, chances, keys, strict=True):
        code.rewrite(*one)


def obfuscated(asm: str, seed: int, epoch: int = 0, least: int = 1, most: int = 3, intensity: tuple[float, float] = (0.1, 0.5)) -> str:
    """A function under a random choice of rewrites of its body. The same text, seed and epoch give the same result; no body, no change."""
    code = Code([asm.split("\n")])
    rewrite_all(code, [seed], epoch, least, most, intensity)
    return code.texts()[0]


def usage(before: Column, after: Column) -> list[Column]:
    """Aggregates over rewritten rows: calls, changed, lines_before and lines_after."""
    n = lambda c: F.coalesce(F.sum(F.regexp_count(c, F.lit("\n")) + 1), F.lit(0)).cast("long")
    return [F.count("*").alias("calls"), F.count_if(before != after).alias("changed"), n(before).alias("lines_before"), n(after).alias("lines_after")]


# --- the machine ------------------------------------------------------------

_FULL = (1 << 64) - 1
_CONDITIONS: Mapping[str, Callable[[int], bool]] = {"eq": lambda d: d == 0, "ne": lambda d: d != 0, "lt": lambda d: d < 0, "ge": lambda d: d >= 0, "gt": lambda d: d > 0, "le": lambda d: d <= 0}


def _signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) & 1 else value


_BINARY: Mapping[str, Callable[[int, int], int]] = {"add": operator.add, "sub": operator.sub, "and": operator.and_, "orr": operator.or_, "eor": operator.xor, "mul": operator.mul}
_SHIFTS: Mapping[str, Callable[[int, int, int], int]] = {"lsl": lambda a, b, n: a << b % n, "lsr": lambda a, b, n: a >> b % n, "asr": lambda a, b, n: _signed(a, n) >> b % n, "ror": lambda a, b, n: a >> b % n | a << (n - b % n)}
_UNARY: Mapping[str, Callable[[int, int], int]] = {"mov": lambda a, n: a, "mvn": lambda a, n: ~a, "neg": lambda a, n: -a, "rev": lambda a, n: int.from_bytes(a.to_bytes(n // 8, "little"), "big")}
#: Places beside the registers: what reads as zero, what is written to be lost, the last comparison. And where ret leads.
_ZERO, _LOST, _FLAG, _END = "xzr", "lost", "flag", ""
#: What a line of a number does to the registers; it returns the label to go on from (an own one by its number), or None for the next line.
Act = Callable[[dict[str, int], int], str | int | None]


def _register(a: str, written: bool = False) -> tuple[str, int, int]:
    """Where a register is, its mask and its bits."""
    n = 32 if a.startswith("w") else 64
    name = (_LOST if written else _ZERO) if a in ("xzr", "wzr") else a if a == "sp" else "x" + a[1:]
    return name, (1 << n) - 1, n


def _idle(x: dict[str, int], n: int) -> None:
    """What labels, directives, comments and nop do."""


def _two(name: str, target: str, a: str, last: str) -> Act:
    """An operation on two values."""
    (t, mask, bits), (s, own, _) = _register(target, True), _register(a)
    f = _BINARY[name] if name in _BINARY else lambda a, b: _SHIFTS[name](a, b, bits)
    whole = mask == own == _FULL  # what registers and lines hold is no wider
    if last == "#" and whole:

        def act(x: dict[str, int], n: int) -> None:
            x[t] = f(x[s], n) & _FULL
    elif last == "#":

        def act(x: dict[str, int], n: int) -> None:
            x[t] = f(x[s] & own, n & mask) & mask
    else:
        r, wide, _ = _register(last)
        if whole and wide == _FULL:

            def act(x: dict[str, int], n: int) -> None:
                x[t] = f(x[s], x[r]) & _FULL
        else:

            def act(x: dict[str, int], n: int) -> None:
                x[t] = f(x[s] & own, x[r] & wide) & mask

    return act


def _one(name: str, target: str, last: str) -> Act:
    """An operation on a value."""
    (t, mask, bits), f = _register(target, True), _UNARY[name]
    if last == "#":

        def act(x: dict[str, int], n: int) -> None:
            x[t] = f(n & mask, bits) & mask
    else:
        r, wide, _ = _register(last)

        def act(x: dict[str, int], n: int) -> None:
            x[t] = f(x[r] & wide, bits) & mask

    return act


def _compared(a: str, last: str) -> Act:
    """A comparison."""
    (s, mask, bits), (r, wide, _) = _register(a), _register(_ZERO if last == "#" else last)

    def act(x: dict[str, int], n: int) -> None:
        x[_FLAG] = _signed(x[s] & mask, bits) - _signed(n & mask if last == "#" else x[r] & wide, bits)

    return act


def _tested(a: str, zero: bool, bit: str, last: str) -> Act:
    """A branch by a register, or by one of its bits."""
    s, mask, _ = _register(a)
    if bit:
        mask &= 1 << int(bit.removeprefix("#"), 0)
    if last == _MARK:
        return (lambda x, n: None if x[s] & mask else n) if zero else lambda x, n: n if x[s] & mask else None
    return lambda x, n: last if (x[s] & mask == 0) == zero else None


def _with(act: Act, number: int) -> Act:
    return lambda x, n: act(x, number)


@lru_cache(_REMEMBERED)
def _act(before: str, after: str) -> Act:
    """What the lines of a head do."""
    row = before.strip()
    if not row or (after or row[-1]) == ":" or row[0] == "." or row.startswith("//"):
        return _idle
    name, args = parsed(row)
    k = len(args)
    try:
        if k and args[-1][:1] == "#" != args[-1]:  # a number in other forms
            number = int(args[-1][1:], 0)
            return _with(_act(before[: before.rindex("#") + 1], ""), number)
        if name == "nop":
            return _idle
        if name == "ret":
            return lambda x, n: _END
        if k == 3 and (name in _BINARY or name in _SHIFTS):
            return _two(name, *args)
        if k == 2 and name in _UNARY:
            return _one(name, *args)
        if k == 2 and name == "cmp":
            return _compared(*args)
        if k == 2 and name in ("cbz", "cbnz"):
            return _tested(args[0], name == "cbz", "", args[1])
        if k == 3 and name in ("tbz", "tbnz"):
            return _tested(args[0], name == "tbz", *args[1:])
        if k == 1 and (name == "b" or (name.startswith("b.") and name[2:] in _CONDITIONS)):
            holds = _CONDITIONS.get(name[2:], lambda d: True)
            return lambda x, n: (n if args[0] == _MARK else args[0]) if holds(x[_FLAG]) else None
    except ValueError:  # no number
        pass

    def unknown(x: dict[str, int], n: int) -> None:
        raise ValueError(f"unknown instruction {row!r}")

    return unknown


_OWN_ACTS = [_act(*h[:2]) for h in _OWN]


def executed(asm: str, registers: Mapping[str, int] | None = None, steps: int = 10_000_000) -> dict[str, int]:
    """The registers (x0 to x30, sp) after a function of integer instructions has run, from its first line to ret or the end.

    Comparisons keep the signed difference, which is all that the conditions here ask for. Unknown
    instructions raise ValueError, and so do more steps than allowed; labels and nop aren't counted.
    """
    return next(runs(Code([asm.split("\n")]), registers, steps))


def runs(code: Code, registers: Mapping[str, int] | None = None, steps: int = 10_000_000) -> Iterator[dict[str, int]]:
    """What executed says of each function, one after the other."""
    acts = [*_OWN_ACTS, *(_act(*h[:2]) for h in code.heads)]
    named = {i: h.before.strip()[:-1] for i, h in enumerate(code.heads, len(_OWN)) if h.before.rstrip()[-1:] == ":"}
    found = np.isin(code.head, [_LABEL, *named])
    idle = found | (code.head == _NOP)
    through = np.concatenate([[0], np.cumsum(~idle)])
    lines, numbers = [*map(acts.__getitem__, code.head[~idle].tolist())], code.number[~idle].tolist()
    places: list[dict[str | int, int]] = [{} for _ in code.ends]
    for f, h, n, i in zip(*(c[found].tolist() for c in (code.of, code.head, code.number, through[1:])), strict=True):
        places[f][named.get(h, n)] = i
    beside = dict.fromkeys((_ZERO, _LOST, _FLAG), 0)
    first = dict.fromkeys([*(f"x{n}" for n in range(31)), "sp"], 0) | {k: v & _FULL for k, v in (registers or {}).items()}
    for at, end, of in zip(through[code.begins].tolist(), through[code.ends].tolist(), places, strict=True):
        x, left, start = first | beside, steps, at
        while at < end:
            to = lines[at](x, numbers[at])
            at += 1
            if to is not None:
                left -= at - start
                start = at
                if left < 0 or to is _END:
                    break
                start = at = of[to]
        if left < at - start:
            raise ValueError("too many steps")
        yield {k: v for k, v in x.items() if k not in beside}
