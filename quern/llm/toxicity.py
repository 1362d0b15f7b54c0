"""Toxicity: bags of subword embeddings, averaged, into a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams, boundaries included, and of itself, so an unseen
misspelling shares most of its vectors with the word it stems from. A long document hides a
few words among thousands, so what is averaged is the bag of a document's few most telling
distinct words; training picks them anew as it goes, of clean documents too, where they
are the hardest examples. Only documents' labels are known to it.
The plain average of all words, and that of windows of words with the highest one taken, were tried
too; the README has their figures.

The softmax of an average of vectors is linear in the n-grams, so for scoring each bucket is
folded to one number. Scale, length term and shift of the score are set on documents that
the vectors were not trained on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import id_crc, ship, slices, table, through_table, utf8, word_hashes
from quern.llm.decontaminate import plain

#: N-gram lengths, buckets of n-grams, bits of whole words' buckets, dimensions, telling words of a document, and the threshold.
GRAMS, BUCKETS, WORD_BITS, DIM, TELLING, THRESHOLD = (3, 4, 5, 6), 1 << 16, 18, 8, 4, 0.7
ALL_BUCKETS = BUCKETS + (1 << WORD_BITS)
#: Bytes of training texts whose n-grams a task holds at once.
PART = 500_000


@dataclass
class Bags:
    """buckets and the words that they are of, the words' hashes and number, and each text's first word (n + 1)."""

    bucket: np.ndarray
    word: np.ndarray
    whole: np.ndarray
    n_words: int
    first: np.ndarray


def bags(column: pa.Array) -> Bags:
    """The n-grams of every word of the texts: bytes of letters and digits, lowered, with a boundary at both ends."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    # every text gets a blank of its own at the front, so that words of two texts never touch
    flat = np.full(len(data) + n + 1, 32, np.uint8)
    flat[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = plain(data)
    gap = flat == 32
    begins = ~gap[1:] & gap[:-1]
    word = np.cumsum(begins)  # at a word's leading blank: its number from 1
    n_words = int(word[-1]) if len(word) else 0
    first = np.concatenate([[0], word])[offsets[:-1] + np.arange(n)] if len(word) else np.zeros(n, np.int64)
    wide = flat.astype(np.uint32)
    blanks = np.concatenate([[0], np.cumsum(gap)])
    out_b, out_w = [], []
    h = wide.copy()
    for k in range(2, max(GRAMS) + 1):
        h = h[: len(flat) - k + 1] * np.uint32(0x01000193) + wide[k - 1 :]
        if k in GRAMS and len(h):
            # no blank within, but at the ends
            m = len(flat) - k + 1
            at = np.flatnonzero(blanks[k - 1 : k - 1 + m] - blanks[1 : m + 1] == 0)
            mixed = h[at] ^ (h[at] >> np.uint32(15))
            out_b.append(((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int32))
            out_w.append((word[np.minimum(at, len(word) - 1)] - 1).astype(np.int32))
    whole = np.zeros(0, np.uint64)
    if n_words:
        whole = word_hashes(flat, np.array([0, len(flat)]))[0]
        out_b.append((BUCKETS + (whole >> np.uint64(64 - WORD_BITS)).astype(np.int64)).astype(np.int32))
        out_w.append(np.arange(n_words, dtype=np.int32))
    return Bags(np.concatenate(out_b) if out_b else np.zeros(0, np.int32), np.concatenate(out_w) if out_w else np.zeros(0, np.int32), whole, n_words, np.append(first, n_words).astype(np.int64))


def weights(b: Bags) -> np.ndarray:
    """The share of each n-gram in its word's vector: the whole word half, its n-grams the rest alike."""
    n = np.bincount(b.word, minlength=b.n_words)
    return np.where(b.bucket >= BUCKETS, np.where(n > 1, 0.5, 1.0)[b.word], 0.5 / np.maximum(n - 1, 1)[b.word])


def telling(b: Bags, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, value, text) of each text's few distinct words that speak most for toxic, text by text."""
    word = np.bincount(b.word, value[b.bucket] * weights(b), minlength=b.n_words)
    at = np.flatnonzero(word > 0)
    text = np.searchsorted(b.first, at, "right") - 1
    order = np.lexsort((b.whole[at], -word[at], text))  # equal words stand side by side
    at, text = at[order], text[order]
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (b.whole[at[1:]] != b.whole[at[:-1]])
    at, text = at[new], text[new]
    top = np.arange(len(at)) - np.searchsorted(text, text) < TELLING
    return at[top], word[at[top]], text[top]


@dataclass
class Model:
    """A number for each bucket; of the score's logit, the factors of the telling words' mean and of the logarithm of the words' number, and the rest."""

    value: np.ndarray
    scale: float = 0.0
    length: float = 0.0
    shift: float = 0.0

    def measured(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(mean value of the telling words, number of words) of each text; words that speak for clean count as nothing."""
        b = bags(column)
        _, value, text = telling(b, self.value)
        return np.bincount(text, value, minlength=len(b.first) - 1) / TELLING, np.diff(b.first)

    def score(self, column: pa.Array) -> np.ndarray:
        """From 0 to 1."""
        mean, words = self.measured(column)
        return 1 / (1 + np.exp(-np.clip(self.scale * mean + self.length * np.log1p(words) + self.shift, -60, 60)))


def log_odds(n1: np.ndarray, n0: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How much likelier a bucket, found in n1 toxic documents and n0 others, is in the former, as a logarithm; shrunk to 0 where that may be chance."""
    odds = np.log((n1 + 0.5) / (toxic.sum() + 1)) - np.log((n0 + 0.5) / ((1 - toxic).sum() + 1))
    z = np.abs(odds) / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    return odds * np.maximum(0, 1 - 1.5 / np.maximum(z, 1e-9))


def fit(found: np.ndarray, toxic: np.ndarray, told: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], *, epochs: int = 3, rate: float = 0.05, seed: int = 7) -> Model:
    """A model, not yet scaled, of documents and their labels.

    found has for each bucket the number of clean and of toxic documents with it; told gives, by
    the buckets' values, the documents' first cell (n + 1) and the buckets and shares of
    the cells of their telling words. Embeddings start along one direction by the buckets'
    log-odds; then embeddings and softmax are trained together.
    """
    odds = log_odds(found[1], found[0], toxic.astype(float))
    rng = np.random.default_rng(seed)
    out = rng.standard_normal((2, DIM)) / np.sqrt(2 * DIM)
    u = out[1] - out[0]
    emb = np.outer(odds, u / (u @ u))
    off = np.array([0.0, -float(TELLING)])
    seen_emb, seen_out, seen_off = np.full((ALL_BUCKETS, 1), 1e-3), np.full(out.shape, 1e-3), np.full(2, 1e-3)
    balance = np.array([0.5 / max((toxic == k).mean(), 1e-6) for k in (0, 1)])
    for _ in range(epochs):
        first, cell_bucket, cell_share = told(emb @ (out[1] - out[0]))
        ids = rng.permutation(len(toxic))
        for at in range(0, len(ids), 128):
            part = ids[at : at + 128]
            size = first[part + 1] - first[part]
            cells = np.arange(size.sum()) + np.repeat(first[part] - (np.cumsum(size) - size), size)
            row = np.repeat(np.arange(len(part)), size)
            used, w = cell_bucket[cells], cell_share[cells]
            vectors = emb[used]
            mean = np.stack([np.bincount(row, vectors[:, d] * w, minlength=len(part)) for d in range(DIM)], 1)  # TELLING times the average
            z = mean @ out.T + off
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = toxic[part].astype(int)
            p[np.arange(len(part)), y] -= 1
            g = p * (balance[y][:, None] / len(part))
            gm, g_out, g_off = g @ out, g.T @ mean, g.sum(0)
            touched, spot = np.unique(used, return_inverse=True)
            g_emb = np.stack([np.bincount(spot, gm[row, d] * w, minlength=len(touched)) for d in range(DIM)], 1)
            seen_emb[touched] += (g_emb**2).mean(1, keepdims=True)
            seen_out += g_out**2
            seen_off += g_off**2
            emb[touched] -= rate * g_emb / np.sqrt(seen_emb[touched])
            out -= rate * g_out / np.sqrt(seen_out)
            off -= rate * g_off / np.sqrt(seen_off)
    return Model(emb @ (out[1] - out[0]))


def calibrated(m: Model, mean: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> Model:
    """m with the logistic curve that suits documents' telling words and lengths, by Newton's method with a weak prior, shifted so that the threshold parts the two kinds best."""
    spread = max(mean.std(), 1e-6)
    x = np.stack([mean / spread, np.log1p(words), np.ones_like(mean)], 1)
    w, prior = np.array([2.0, 0.0, -2.0]), np.array([2.0, 0.0, -2.0])
    stiff = np.array([0.05, 0.05, 0.01])
    weight = np.where(toxic > 0, 1.0, np.sqrt(max(toxic.sum(), 1) / max((1 - toxic).sum(), 1)))  # between the classes' own shares and equal ones
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(stiff), x.T @ (weight * (p - toxic)) + stiff * (w - prior))
    return Model(m.value, w[0] / spread, w[1], w[2] + np.log(THRESHOLD / (1 - THRESHOLD)) - parting(x @ w, toxic))


def parting(z: np.ndarray, toxic: np.ndarray) -> float:
    """Where to part toxic logits from others: in the middle of the gap above which most of the former and, weighed five times, least of the latter are; of equal gaps the widest. The curve's own point without both."""
    if not 0 < toxic.sum() < len(toxic):
        return float(np.log(THRESHOLD / (1 - THRESHOLD)))
    order = np.argsort(-z, kind="stable")
    z, hit = z[order], toxic[order]
    gain = np.cumsum(hit) / hit.sum() - 5 * np.cumsum(1 - hit) / (1 - hit).sum()
    gap = np.append(z[:-1] - z[1:], 0.0)
    gain[gap <= 0] = -np.inf
    if not np.isfinite(gain).any():
        return float(np.log(THRESHOLD / (1 - THRESHOLD)))
    at = max(np.flatnonzero(gain >= gain.max() - 1e-12), key=lambda i: gap[i])
    return float(z[at] - gap[at] / 2)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, bucket, n): in how many documents (toxic, text) of each label a bucket is."""
    n = np.zeros((2, ALL_BUCKETS), np.int64)
    for batch in batches:
        for i, part in slices(batch.column(1), PART):
            b = bags(part)
            text = np.repeat(np.arange(len(part)), np.diff(b.first))[b.word]
            label = batch.column(0).slice(i, len(part)).to_numpy()
            pair = np.unique(text * ALL_BUCKETS + b.bucket)
            n += np.bincount(label[pair // ALL_BUCKETS] * ALL_BUCKETS + pair % ALL_BUCKETS, minlength=2 * ALL_BUCKETS).reshape(n.shape)
    label, bucket = np.nonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[label, bucket])], ["toxic", "bucket", "n"])


def _told(value: np.ndarray):
    """A function that gives for documents (doc_id, tie, text) the buckets and shares of their telling words' cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in slices(batch.column(2), PART):
                b = bags(part)
                at, _, text = telling(b, value)
                place = np.full(b.n_words, -1)
                place[at] = np.arange(len(at))
                cells = np.flatnonzero(place[b.word] >= 0)
                cells = cells[np.argsort(place[b.word[cells]], kind="stable")]
                first = np.searchsorted(text[place[b.word[cells]]], np.arange(len(part) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (b.bucket[cells], weights(b)[cells])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), batch.column(1).slice(i, len(part)), *lists], ["doc_id", "tie", "buckets", "shares"])

    return run


def train(df: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", toxic: str = "toxic", toxic_rows: int = 3000, clean_rows: int = 5000) -> Model:
    """A model of the whole texts of at most toxic_rows and clean_rows labelled documents.

    Documents are taken by the hashes of their ids; a fourth of them only sets the score's
    curve. Tasks read the texts anew for each pass; the driver holds counts of buckets and
    the documents' few telling words only. A document with labels of both kinds counts as toxic; null
    labels and ids are left out. Of rows that share an id one text is learned from, the one of the least hash. Without labels of both kinds every score is 0.5.
    """
    spark = df.sparkSession
    ship(spark)
    known = labels.where(F.col(f"`{toxic}`").isin(0, 1)).groupBy(F.col(f"`{key}`").cast("long").alias("doc_id")).agg(F.max(f"`{toxic}`").cast("int").alias("toxic")).where("doc_id is not null")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    blank = Model(np.zeros(ALL_BUCKETS))
    if len(counts) < 2:
        return blank
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    picked = [known.where((F.col("toxic") == k) & (at < int(1_200_000 * most / counts[k]) + 1)).orderBy(at, "doc_id").limit(most) for k, most in ((0, clean_rows), (1, toxic_rows))]
    picked = picked[0].union(picked[1])
    texts = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "doc_id")
    sample = through_table(texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxicity-sample")
    apart = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    learnt = sample.where(~apart).select("doc_id", "toxic", F.xxhash64("text").alias("tie"), "text")
    rows = learnt.select("doc_id", "tie", "toxic").toPandas().sort_values(["doc_id", "tie"], kind="stable")
    if rows["toxic"].nunique() < 2:
        return blank
    n = learnt.select("toxic", "text").mapInArrow(_found, "toxic int, bucket int, n long").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros((2, ALL_BUCKETS))
    found[n["toxic"].to_numpy(), n["bucket"].to_numpy()] = n["n"].to_numpy()

    def told(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = learnt.select("doc_id", "tie", "text").mapInArrow(_told(value), "doc_id long, tie long, buckets array<int>, shares array<double>").toArrow().sort_by([("doc_id", "ascending"), ("tie", "ascending")]).combine_chunks()
        size = pc.list_value_length(got["buckets"]).to_numpy()
        return np.concatenate([[0], np.cumsum(size)]), pc.list_flatten(got["buckets"]).to_numpy(), pc.list_flatten(got["shares"]).to_numpy()

    m = fit(found, rows["toxic"].to_numpy(), told)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part in slices(b.column(2)):
                mean, words = m.measured(part)
                yield pa.RecordBatch.from_arrays([pa.array(mean), pa.array(words), b.column(1).slice(i, len(part))], ["mean", "words", "toxic"])

    held = sample.where(apart).mapInArrow(judge, "mean double, words long, toxic int").toPandas().sort_values(["mean", "words", "toxic"])
    return calibrated(m, held["mean"].to_numpy(), held["words"].to_numpy(), held["toxic"].to_numpy().astype(float)) if len(held) else m


def scored(df: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) of every row of df, repeats and null ids too; other columns are not read.

    Null and empty texts have the score of no words at all. An empty table gives no rows.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in slices(b.column(1)):
                s = model.score(part)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; learned from two folds of three by the id's checksum."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(id_crc() % 3 != 1))
    return scored(docs, model).select("doc_id", F.coalesce(id_crc() % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")
