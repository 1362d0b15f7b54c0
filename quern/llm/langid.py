"""Language identification by hierarchical discrimination.

A text becomes the square roots of its hashed byte-trigram shares (ASCII letters lowered, bytes of
other characters as they are, runs of the rest of ASCII as one gap). A linear support vector machine for each family against the rest
picks the family; within it, one-versus-one machines vote between its languages. Everything
is fitted in numpy on a bounded sample of labelled rows; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import id_crc, ship, slices, table, utf8
from quern.llm.decontaminate import plain

#: Rows whose features are in memory at once, and languages that a model tells apart at most; more are an error.
ROWS, MOST_LANGUAGES = 512, 300
#: Hashed trigrams, and languages of a family; others are each a family of their own.
WIDTH = 4096
FAMILIES = {
    "germanic": "af da de en is lb nb nl nn no sv",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa ur",
    "turkic": "az kk ky tr uz",
}
FAMILY = {x: f for f, xs in FAMILIES.items() for x in xs.split()}

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = regex.compile(r"\p{L}")


def lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a character of Unicode's category L; null has none."""
    data, offsets = utf8(column)
    ascii_letters = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))])
    out = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 1)).tolist():
        out[i] = _LETTER.search(column[i].as_py()) is not None
    return out


def features(column: pa.Array) -> np.ndarray:
    """Unit rows of square-root trigram shares."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    flat = plain(data)
    flat[_DIGIT[flat]] = 32
    row = np.repeat(np.arange(n), np.diff(offsets))
    letter = flat != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap after each run
    flat, row = flat[keep].astype(np.uint32), row[keep]
    if len(flat) < 3:
        return np.zeros((n, WIDTH), np.float32)
    h = (flat[:-2] * np.uint32(0x9E3779B1) + flat[1:-1] * np.uint32(0x85EBCA6B) + flat[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
    same = row[:-2] == row[2:]
    counts = np.bincount(row[:-2][same] * WIDTH + h[same], minlength=n * WIDTH).reshape(n, WIDTH)
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, classes balanced; y is -1 or 1, x has a last column of ones. Accelerated gradient descent."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1 / (1 / c + 2 * 2.0)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        miss = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead / (c * 50) - 2 * x.T @ (weight * y * miss))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The scale a of sigmoid(a * margin) that suits the labels best, of a few."""
    scales = np.array([0.5, 1, 2, 4, 8, 16])
    loss = [np.logaddexp(0, -a * y * margin).mean() for a in scales]
    return float(scales[int(np.argmin(loss))])


@dataclass
class Model:
    """families in order with their machines and scales; for each family its languages and pairs (i, j, w, scale)."""

    families: list[str]
    top: np.ndarray
    scales: np.ndarray
    languages: list[list[str]]
    pairs: list[list[tuple[int, int, np.ndarray, float]]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each row."""
        one = np.hstack([x, np.ones((len(x), 1), np.float32)])
        p = 1 / (1 + np.exp(-self.scales * np.clip(one @ self.top.T, -60, 60)))
        p = p / np.maximum(p.sum(1, keepdims=True), 1e-12)
        best = p.argmax(1)
        lang, score = np.full(len(x), "und", object), p.max(1)
        for f, names in enumerate(self.languages):
            at = np.flatnonzero(best == f)
            votes, belief = np.zeros((len(at), len(names))), np.zeros((len(at), len(names)))
            for i, j, w, a in self.pairs[f]:
                q = 1 / (1 + np.exp(-a * np.clip(one[at] @ w, -60, 60)))
                votes[:, i] += q >= 0.5
                votes[:, j] += q < 0.5
                belief[:, i] += q
                belief[:, j] += 1 - q
            pick = (votes + belief / (len(names) + 1)).argmax(1)  # a tied vote goes to the larger belief
            lang[at] = np.array(names, object)[pick]
            if len(names) > 1:
                score[at] *= belief[np.arange(len(at)), pick] / (len(names) - 1)
        return lang, np.clip(score, 0, 1)


def fit(x: np.ndarray, langs: np.ndarray) -> Model:
    """A model of labelled rows, at least one; x has a last column of ones."""
    used = np.flatnonzero(x.any(0))  # the weight of a trigram that no row has stays 0
    wide, x = x.shape[1], x[:, used]

    def spread(w: np.ndarray) -> np.ndarray:
        out = np.zeros(wide, np.float32)
        out[used] = w
        return out

    names = sorted(set(langs))
    families = sorted({FAMILY.get(n, n) for n in names})
    group = np.array([FAMILY.get(n, n) for n in langs])
    top, scales, languages, pairs = [], [], [], []
    for f in families:
        y = np.where(group == f, 1, -1).astype(np.float32)
        w = linear_svm(x, y) if len(families) > 1 else np.append(np.zeros(x.shape[1] - 1, np.float32), np.float32(1))
        top.append(spread(w))
        scales.append(slope(x @ w, y))
        own = [n for n in names if FAMILY.get(n, n) == f]
        languages.append(own)
        pairs.append([])
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                at = np.flatnonzero((langs == own[i]) | (langs == own[j]))
                y = np.where(langs[at] == own[i], 1, -1).astype(np.float32)
                part = x[at]
                w = linear_svm(part, y)
                pairs[-1].append((i, j, spread(w), slope(part @ w, y)))
    return Model(families, np.array(top), np.array(scales), languages, pairs)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, part in slices(b.column(2), rows=ROWS):
            ok = lettered(part)
            x, keep = features(part), pa.array(ok)
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(part)).filter(keep) for k in (0, 1)), pa.array([r.astype(np.float16).tobytes() for r in x[ok]], pa.binary())], ["lang", "h", "x"])


def train(df: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = 6000) -> Model | None:
    """A model of about rows / (number of languages) labelled rows of each language; None without any.

    The rows are those with the smallest hashes of their ids and texts, of which repeats count
    once, so partitions don't matter. Only their hashed features come to the driver. Every
    language is learned; over MOST_LANGUAGES of them raise ValueError.
    """
    ship(df.sparkSession)
    own = [F.col(f"`{c}`") for c in (key, text)]
    labelled = df.select(F.col(f"`{lang}`").alias("lang"), F.xxhash64(*own).alias("h"), own[1].alias("text")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().take(MOST_LANGUAGES + 1)}
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: group them first")
    each = max(20, rows // len(counts))
    at = F.pmod("h", F.lit(1_000_000))
    reach = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, int(1_000_000 * each / n) + 1)])
    picked = labelled.where(at < F.element_at(reach, F.col("lang"))).dropDuplicates(["lang", "h"])
    got = picked.mapInArrow(_sampled, "lang string, h long, x binary").orderBy(at, "h", "lang").limit(2 * each * len(counts)).toArrow()
    if not got.num_rows:
        return None
    langs, x = np.array(got["lang"].to_pylist(), object), np.ones((got.num_rows, WIDTH + 1), np.float32)
    for i, row in enumerate(got["x"]):
        x[i, :WIDTH] = np.frombuffer(row.as_buffer(), np.float16)
    del got
    return fit(x, langs)


def identified(df: DataFrame, model: Model | None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of df, repeats and null ids too; other columns are not read.

    und with score 0: null, without a letter (Unicode's category L), or nothing was learned. An empty table gives no rows.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in slices(b.column(1), rows=ROWS):
                x, ok = features(part), lettered(part)
                lang, score = model.predict(x) if model else (np.full(len(x), "und", object), np.zeros(len(x)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(np.where(ok, lang, "und"), pa.string()), pa.array(np.where(ok, score, 0.0), pa.float64())], ["doc_id", "lang_pred", "score"])

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from three folds of four by the id's checksum.

    Null ids are in no fold: not learned from, and held_out is false. Labels that differ between
    repeated rows are all learned from. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(id_crc() % 4 != 2))
    return identified(docs, model).select("doc_id", F.coalesce(id_crc() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
