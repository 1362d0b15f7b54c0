"""Personal data: base patterns, and a skip-chain conditional random field over what looks like data.

The base finds emails, IP addresses, card and phone numbers by pattern and check. The field
labels tokens (runs of non-blanks) that hold a digit or an at sign: their shapes and the words
before them give node potentials, tokens side by side share a chain potential, and tokens of a
document that repeat or have the same shape share a skip potential, however far apart. Loopy
sum-product passing, until the messages settle, makes their labels agree. Each token is tied to the next one like it, so
links grow with the tokens, not with their pairs. Tokens that it labels with confidence
and that no base span covers are added as spans.

The weights are fitted in numpy by pseudo-likelihood on a bounded sample of documents, whose
labels are the base spans and, for secrets, long hexadecimal values after an equals sign or
a colon.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ship, table

#: The kinds in their order, other than O; the first four are the base's.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
CERTAIN, DAMPING = 0.9, 0.5
#: Passing stops once no message moves by more than this, or after so many passes, which damped messages on long loops may need.
SETTLED, MOST_PASSES = 1e-3, 200
#: Tokens whose features are in memory at once.
SLICE = 20_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEED = re.compile(r"[=:]\s{0,3}[\"']?([0-9A-Fa-f]{32,})(?![0-9A-Za-z])")
_ANY = re.compile("[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGES = "\"'()[]{}<>.,;:!?*$%&#|=`"

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the card checksum."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def _byte(digits: str) -> bool:
    """Whether digits, however many zeros lead them, are 255 at most."""
    short = digits.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and short <= "255")


def _ips(text: str) -> list[Span]:
    return [(m.start() + x.start(), m.start() + x.end()) for m in _DOTTED.finditer(text) if m[0].count(".") > 2 for x in _IP.finditer(m[0]) if all(_byte(p) for p in x[0].split("."))]


def _cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() > 12 and 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]


def _phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    """The base's spans by kind: code points, end exclusive."""
    digits = _ANY.search(text) is not None
    return {"email": _emails(text) if "@" in text else [], "ip": _ips(text) if digits else [], "card": _cards(text) if digits else [], "phone": _phones(text) if "+" in text else []}


@dataclass
class Tokens:
    """Candidate tokens of one document: spans, words before, and next[i]: whether token i + 1 directly follows i."""

    spans: list[Span]
    before: list[str]
    text: list[str]
    next: list[bool]


def candidates(text: str) -> Tokens:
    """Runs of non-blanks with a digit or an at sign, without punctuation at their ends; a plus or parenthesis at a number's front stays."""
    out, at, end_of_last = Tokens([], [], [], []), 0, -1
    while m := _ANY.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        word = _TOKEN.match(text, start)
        at = word.end()
        raw = word[0]
        core = raw.strip(_EDGES)
        if not core:
            continue
        b = start + raw.index(core)
        head = text[max(0, start - 40) : start].rstrip()
        out.spans.append((b, b + len(core)))
        out.text.append(core)
        out.before.append(head.rsplit(None, 1)[-1].lower() if head else "")
        out.next.append(False)
        if len(out.spans) > 1:
            out.next[-2] = text[end_of_last:start].isspace()
        end_of_last = at
    return out


def shape(token: str) -> str:
    """Digits as 0, hexadecimal mixtures as h, letters as a, runs of letters shortened; what similar tokens share."""
    if len(token) >= 16 and re.fullmatch("[0-9A-Fa-f]+", token) and re.search("[A-Fa-f]", token):
        return f"h{len(token)}"
    return re.sub("[^\\W\\d_]+", "a", re.sub("[0-9]", "0", token))


#: Features of a token: a bias, hashed shapes, hashed words before, and tests.
_SHAPES, _WORDS, _TESTS = 64, 64, 24
WIDTH = _SHAPES + _WORDS + _TESTS


def _hash(s: str, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % n


def features(t: Tokens, start: int = 0, stop: int | None = None) -> np.ndarray:
    """One row for each token from start to stop."""
    rows = range(start, min(len(t.text), len(t.text) if stop is None else stop))
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, k in enumerate(rows):
        s, before = t.text[k], t.before[k]
        d = sum(c.isdigit() for c in s)
        plain = re.sub("[ -]", "", s)
        parts = s.split(".")
        letters = sum(c.isalpha() for c in s)
        tests = (
            True, "@" in s, "@" in s and "." in s.rpartition("@")[2], s[0] == "+", s[0] == "(", s.count("-") == 1, "(" in s, d == len(s), d == 0, d < 3, 3 <= d < 9, 9 <= d < 13, 13 <= d < 20, d >= 20,
            13 <= len(plain) < 20 and plain.isascii() and plain.isdigit() and luhn(plain), len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and _byte(p) for p in parts), "." in s, letters > 0, letters > 8,
            bool(re.fullmatch("[0-9A-Fa-f]{32,}", s)), before.endswith(("=", ":")), before.startswith("+"), len(s) > 24, t.next[k],
        )
        x[i, _hash(shape(s), _SHAPES)] = 1
        x[i, _SHAPES + _hash(before, _WORDS)] = 0.5
        x[i, _SHAPES + _WORDS :] = tests
    return x


def edges(t: Tokens) -> tuple[list[Span], list[Span]]:
    """(chain, skip): neighbours, and each token with the next that repeats it or has its shape."""
    chain = [(i, i + 1) for i, y in enumerate(t.next) if y]
    skip, last = set(), {}
    for i, s in enumerate(t.text):
        for k in (("same", s.lower()), ("like", shape(s))):
            if k in last:
                skip.add((last[k], i))
            last[k] = i
    return chain, sorted(skip - set(chain))


@dataclass
class Field:
    """Weights of features and labels; potentials of label pairs over chain and skip edges (both symmetric in use)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def potentials(self, t: Tokens) -> np.ndarray:
        """Each token's own potentials; features are worked out some tokens at a time."""
        return np.concatenate([np.zeros((0, len(KINDS) + 1)), *(features(t, at, at + SLICE) @ self.unary for at in range(0, len(t.text), SLICE))])

    def marginals(self, t: Tokens) -> np.ndarray:
        """Each token's label probabilities after damped sum-product passing over both kinds of edges, until the messages settle."""
        chain, skip = edges(t)
        return passed(self.potentials(t), chain, skip, self.chain, self.skip)


def passed(node: np.ndarray, chain: list[Span], skip: list[Span], chain_pot: np.ndarray, skip_pot: np.ndarray, most: int = MOST_PASSES) -> np.ndarray:
    """Marginals by loopy sum-product: node potentials (tokens by labels), edges, and one potential matrix for each kind of edge.

    Exact where the edges have no loop. Messages that have settled are not worked out again, so
    that the cost of long texts follows the stretches where labels still move.
    """
    pairs = np.array(chain + skip, np.int64).reshape(-1, 2)
    node = node.astype(float)
    if len(pairs):
        a, b = pairs.T
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        tables = np.stack([chain_pot, skip_pot, chain_pot.T, skip_pot.T])  # [from label, to label]
        kind = np.repeat([0, 1], [len(chain), len(skip)])
        kind = np.concatenate([kind, kind + 2])
        back = (np.arange(len(src)) + len(a)) % len(src)
        msg = np.zeros((len(src), node.shape[1]))
        live = np.arange(len(src))
        total = node.copy()
        for _ in range(most):
            moved, change = np.zeros(len(node), bool), np.zeros((len(live), node.shape[1]))
            for at in range(0, len(live), SLICE):
                e = live[at : at + SLICE]
                out = (total[src[e]] - msg[back[e]])[:, :, None] + tables[kind[e]]
                top = out.max(1)
                new = top + np.log(np.exp(out - top[:, None]).sum(1))
                new -= new.max(1, keepdims=True)
                change[at : at + SLICE] = (1 - DAMPING) * (new - msg[e])
            msg[live] += change
            np.add.at(total, dst[live], change)
            far = np.abs(change).max(1) > SETTLED * (1 - DAMPING)
            if not far.any():
                break
            moved[dst[live[far]]] = True
            again = moved[src]
            again[live[far]] = True
            live = np.flatnonzero(again)
        node = total
    p = np.exp(node - node.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def seeds(text: str, base: dict[str, list[Span]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of what the training takes as true."""
    return [(a, b, 1 + KINDS.index(k)) for k, spans in base.items() for a, b in spans] + [(*m.span(1), len(KINDS)) for m in _SEED.finditer(text)]


def labels_of(t: Tokens, true: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of each token: of the last seed, as they are given, that covers most of it; else 0."""
    y, place = np.zeros(len(t.spans), np.int64), np.full(len(t.spans), -1)
    ends = np.array([b for _, b in t.spans])
    for n, (c, d, k) in enumerate(true):
        i = int(np.searchsorted(ends, c, "right"))
        while i < len(t.spans) and t.spans[i][0] < d:
            a, b = t.spans[i]
            if 2 * (min(b, d) - max(a, c)) > b - a and n > place[i]:
                y[i], place[i] = k, n
            i += 1
    return y


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document with candidates: its features, labels, and edges, packed."""
    for b in batches:
        for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = candidates(text)
            if t.spans:
                chain, skip = edges(t)
                y = labels_of(t, seeds(text, base_spans(text)))
                sums = _sums(t, y, chain, skip)
                yield pa.RecordBatch.from_arrays([pa.array([h]), *(pa.array([v.tobytes()], pa.binary()) for v in sums)], ["h", "x", "n"])


def _sums(t: Tokens, y: np.ndarray, chain: list[Span], skip: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, times): the distinct rows of a document's tokens, with what pseudo-likelihood needs (features, neighbours' labels by kind of edge, own label), and how often each is there.

    Rows that repeat weigh by their number, so a long text costs its distinct rows; none is left out.
    """
    n_labels = len(KINDS) + 1
    seen = np.zeros((len(y), 2 * n_labels), np.float16)
    for k, pairs in enumerate((chain, skip)):
        for a, b in pairs:
            seen[a, k * n_labels + y[b]] += 1
            seen[b, k * n_labels + y[a]] += 1
    parts = []
    for at in range(0, len(y), SLICE):
        x = np.hstack([features(t, at, at + SLICE).astype(np.float16), seen[at : at + SLICE], y[at : at + SLICE, None].astype(np.float16)])
        parts.append(np.unique(x, axis=0, return_counts=True))
    rows, times = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if len(parts) > 1:
        rows, spot = np.unique(rows, axis=0, return_inverse=True)
        times = np.bincount(spot.ravel(), times)
    return rows, times.astype(np.float64)


def fit(rows: np.ndarray, times: np.ndarray, rounds: int = 200) -> Field:
    """Weights by pseudo-likelihood: each token's label given its features and its neighbours' labels; ridge, accelerated descent. rows and times are _sums()' of all documents."""
    n_labels = len(KINDS) + 1
    if not len(rows):
        return Field(np.zeros((WIDTH, n_labels)), np.zeros((n_labels, n_labels)), np.zeros((n_labels, n_labels)))
    full, y = rows[:, :-1].astype(np.float32), rows[:, -1].astype(np.int64)
    target = np.eye(n_labels, dtype=np.float32)[y]
    weight = (times * (1 / np.sqrt(np.maximum(np.bincount(y, times, n_labels), 1)))[y]).astype(np.float32)
    weight /= weight.sum()
    w = ahead = np.zeros((full.shape[1], n_labels), np.float32)
    step = 2 / max(float((full**2).sum(1).max()), 1)
    for k in range(rounds):
        z = full @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - step * (full.T @ (weight[:, None] * (p - target)) + 1e-4 * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    chain, skip = w[WIDTH : WIDTH + n_labels], w[WIDTH + n_labels :]
    return Field(w[:WIDTH].astype(float), (chain + chain.T).astype(float) / 2, (skip + skip.T).astype(float) / 2)


def train(df: DataFrame, *, text: str = "text", key: str = "doc_id", rows: int = 3000) -> Field:
    """A field fitted on the whole texts of at most rows documents with candidates: those of smallest hashes of id and text.

    Labels come from the patterns alone. The driver adds up one document's distinct rows at a time.
    """
    ship(df.sparkSession)
    docs = df.select(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = docs.count()
    # hashes spread evenly, so twice the share holds enough rows for certain but for tables with few documents of their own
    reach = min(1.0, 2 * rows / max(n, 1) + 100 / max(n, 1))
    edge = (1 << 63) - 1 if reach == 1 else int(-(1 << 63) + reach * (1 << 64))
    some = docs.where(F.col("h") <= edge).mapInArrow(_gathered, "h long, x binary, n binary").orderBy("h", F.md5("x")).limit(rows)
    width, held, times = WIDTH + 2 * (len(KINDS) + 1) + 1, [np.zeros((0, WIDTH + 2 * (len(KINDS) + 1) + 1), np.float16)], [np.zeros(0)]
    for r in some.toLocalIterator():
        held.append(np.frombuffer(r["x"], np.float16).reshape(-1, width))
        times.append(np.frombuffer(r["n"], np.float64))
        if len(held) > 256:
            held, times = _merged(held, times)
    held, times = _merged(held, times)
    return fit(held[0], times[0])


def _merged(held: list[np.ndarray], times: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rows, spot = np.unique(np.concatenate(held), axis=0, return_inverse=True)
    return [rows], [np.bincount(spot.ravel(), np.concatenate(times), len(rows))]


def added_spans(text: str, field: Field, base: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
    """What the field labels with confidence and no base span touches; tokens side by side with one label are one span."""
    t = candidates(text)
    if not t.spans:
        return []
    p = field.marginals(t)
    label = np.where(p[:, 1:].max(1) >= CERTAIN, p[:, 1:].argmax(1) + 1, 0)
    taken = sorted(s for spans in base.values() for s in spans)
    out: list[tuple[str, int, int]] = []
    k, joins = 0, False
    for i, (a, b) in enumerate(t.spans):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        # base spans of two kinds may overlap, so a few before k matter too
        free = label[i] and not any(c < b and a < d for c, d in taken[max(0, k - 3) : k + 4])
        if free and joins and out[-1][0] == KINDS[label[i] - 1]:
            out[-1] = (out[-1][0], out[-1][1], b)
        elif free:
            out.append((KINDS[label[i] - 1], a, b))
        joins = bool(free) and t.next[i]
    return out



def detected(df: DataFrame, field: Field, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, base and added: arrays of kind, start and end) for every row of df.

    Null and empty texts have none. Repeated rows are each searched. Only the given columns are read.
    """
    ship(df.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, added = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                found = base_spans(t)
                base.append([{"kind": k, "start": a, "end": e} for k in BASE for a, e in found[k]])
                added.append([{"kind": k, "start": a, "end": e} for k, a, e in added_spans(t, field, found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(added, kind)], ["doc_id", "base", "added"])

    spans = "array<struct<kind: string, start: long, end: long>>"
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id long, base {spans}, added {spans}")


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest and joined spans of detected()'s rows."""

    def text_of(spans):  # each is sorted by kind, then start
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    place = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(v) for kv in place.items() for v in kv])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(every).alias("spans"))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans go as one, by the first's kind."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return digest(detected(docs, train(docs)))
