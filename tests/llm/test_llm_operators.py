"""Every training-data operator: odd rows, and results against brute force, round trips or held-out labels."""

import hashlib
import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, decontaminate, langid, mixing, pii, quality, registry, simhash, suffix, tokens, toxicity

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(1, "a b c d e f", "en", "s"), (2, None, None, None), (3, "", "fr", "s"), (4, LONG, "en", "t"), (4, LONG, "en", "t"), (None, "a b c d e f g", "de", "s"), (5, "Été\n\n  x\ty\r\nz  ", "fr", "s"), (6, "a b c d e f", None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and columns named like the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(7).alias(c) for c in ("kept", "_t", "_doc", "fp", "score", "block", "n_words", "component_id", "position", "_keep", "_of", "_lost", "_length", "_file", "_row", "_v", "_m", "failed_rule", "_id", "_first", "chunk")])


def none(df):
    return df.where(F.lit(False))


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- quality ---


def test_quality(spark, odd):
    rows = quality.quality_cascade(odd).select("_id", "n_words", "base_failed", "kept", "n_dup_lines").collect()
    assert len(rows) == len(ODD) and all(r.base_failed for r in rows if r._id in (2, 3))
    good = quality.keep_good(odd)
    assert good.columns == odd.columns and {r.doc_id for r in good.collect()} <= {4}
    assert quality.keep_good(none(odd)).isEmpty() and quality.quality_cascade(none(odd)).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_repeated_windows(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    got = {r._id: r.n_repeat_words for r in quality.quality_cascade(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        assert got[i] == len({k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(8)})


def test_order_moves_no_verdict(spark):
    df = docs(spark)
    a = quality.quality_cascade(df).select("_id", "kept")
    rules = quality.default_rules()
    for order in (rules, rules[::-1]):
        known = {r.name: (1.0 + i, 0.5) for i, r in enumerate(order)}
        assert [r.name for r in quality.ordered_rules(df, rules, known=known)] == [r.name for r in order]
        b = quality.quality_cascade(df, known=known).select("_id", "kept")
        kept = quality.keep_good(df, known=known)
        assert a.exceptAll(b).isEmpty() and {r.doc_id for r in kept.select("doc_id").collect()} == {r._id for r in a.where("kept").collect()}


def test_dear_rules_see_only_what_cheap_ones_let_through(spark):
    """A measure that fails on the rows that an earlier rule rejects is never worked out for them."""
    df = spark.createDataFrame([(1, "bad row"), (2, "good row")], "doc_id long, text string")
    cheap = quality.Rule("cheap", lambda: F.contains("_t", F.lit("bad")), lambda m: m)
    dear = quality.Rule("dear", lambda: F.when(F.contains("_t", F.lit("bad")), F.raise_error(F.lit("seen")).cast("int")).otherwise(1), lambda n: n > 5)
    kept = quality.keep_good(df, [dear, cheap], known={"cheap": (1.0, 0.5), "dear": (9.0, 0.5)})
    assert [r.doc_id for r in kept.collect()] == [2]


def test_estimates_come_from_a_sample(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('word', id % 97, ' '), IF(id % 4 = 0, 10, 60)) AS text")
    packs = quality.packed(df)
    assert quality.sampled(packs, 200).count() == 200
    found = quality.estimates(packs, quality.default_rules(), 400)
    assert abs(found["too_few_words"][1] - 0.25) < 0.1 and found["repeats"][1] > 0.7 and found["symbols"][1] == 0
    assert all(t > 0 for t, _ in found.values())


def test_costs_repeat_and_a_dearer_rule_moves_back(spark):
    """Rules that reject alike go by what they take, in the same order each time; tenfold work sends a rule back. What is free comes first."""
    df = spark.range(800).selectExpr("id AS doc_id", "repeat(concat('word', id % 97, ' '), 200) AS text")
    packs = quality.packed(df)
    work = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0).cast("long"), lambda a, i: a + F.length(F.sha2(F.concat("_t", i.cast("string")), 256)))
    rule = lambda name, n: quality.Rule(name, lambda: work(n), lambda m: F.contains("_t", F.lit("word1")))
    first = [rule("a", 4), rule("b", 20)]
    assert {tuple(r.name for r in quality.ordered_rules(packs, first, 200)) for _ in range(3)} == {("a", "b")}
    assert [r.name for r in quality.ordered_rules(packs, [rule("a", 200), rule("b", 20)], 200)] == ["b", "a"]
    assert [r.name for r in quality.ordered_rules(packs, [rule("a", 4), rule("b", 20)], 200, free={"b"})] == ["b", "a"]
    assert quality.estimates(packs, first, 200, {"b"})["a"][0] == 1.0  # one rule alone isn't timed


# --- near copies ---


def brute_groups(ids, fps):
    """Component of each id by all pairs."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, fps, strict=True):
        for j, b in zip(ids, fps, strict=True):
            if (a ^ b).bit_count() <= 3 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_golay_keys_meet():
    table, count = simhash.near_codewords()
    assert set(np.unique(count)) == {1, 6}
    sets = [set(table[i, : count[i]].tolist()) for i in range(1 << 16)]
    assert all(sets[i] & sets[i ^ (1 << b)] for i in range(0, 1 << 16, 7) for b in range(16))
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        row, key = simhash.golay_keys(np.array([x, y], np.uint64))
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_simhash(spark, odd):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert by[2] == by[3] == ("0" * 16, 2) and by[1] == by[6] and by[6][1] == 1
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5]
    twice = spark.createDataFrame([(1, "z b c d e f"), (1, "a b c d e f g"), (2, "y b x d e w"), (3, "z b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near_copies(twice).collect()) == [(1, "a b c d e f g"), (2, "y b x d e w")]
    assert simhash.simhash_groups(none(odd)).isEmpty() and simhash.drop_near_copies(none(odd)).isEmpty()


def test_fingerprint():
    import xxhash

    t = "A b  C\nd a B c"
    hs = [xxhash.xxh64_intdigest(x, 42) for x in ("a b c", "b c d", "c d a", "d a b", "a b c")]
    assert simhash.fingerprint(t) == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))
    assert simhash.fingerprint("X y") == xxhash.xxh64_intdigest("x y", 42) and simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("block", [2048, 8])
def test_links_against_all_pairs(spark, block):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = list({x for b in base for x in [b, *(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(9))]})
    sign = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(sign, range(len(fps)), strict=True)), "fp long, node long")
    got = {r.node: r.component for r in simhash.components(simhash.links(nodes, block=block)).collect()}
    assert {i: got.get(i, i) for i in range(len(fps))} == brute_groups(range(len(fps)), fps)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(chain).collect()}
    assert all(got[i] == 0 for i in range(1, 101)) and got[201] == 200 and 0 not in got


def test_hubs(spark):
    """Stars over the hub limit, at their least and at their greatest node, tied by a chain."""
    edges = [(1000, i) for i in range(300)] + [(2000, 2000 + i) for i in range(1, 300)] + [(1000, 2000), (5000, 5001)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for e in edges[:-1] for n in e if n} | {5001: 5000}


# --- repeats ---


def test_maximal_repeats():
    rng = np.random.default_rng(2)
    for _ in range(150):
        texts = [bytes(rng.integers(97, 99, rng.integers(0, 25)).astype(np.uint8)) for _ in range(rng.integers(1, 5))]
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        data = np.frombuffer(b"".join(texts), np.uint8)
        order, lo, hi, n = suffix.maximal_repeats(data, starts, 3)
        got = {bytes(data[order[a] : order[a] + k]): sorted(order[a:b].tolist()) for a, b, k in zip(lo, hi, n, strict=True)}
        seen = {}
        for s, t in zip(starts.tolist(), texts, strict=True):
            for i in range(len(t)):
                for j in range(i + 3, len(t) + 1):
                    seen.setdefault(t[i:j], []).append((s + i, t[i - 1] if i else (s, "start"), t[j] if j < len(t) else (s, "end")))
        varied = lambda xs: len(set(xs)) > 1
        want = {w: sorted(p for p, _, _ in o) for w, o in seen.items() if len(o) > 1 and varied(x for _, x, _ in o) and varied(y for _, _, y in o)}
        assert got == want


def brute_removed(rows, n=50):
    """(bytes removed mask) by id, of (id, bytes) rows with distinct ids."""
    least, out = {}, {}
    for i, b in sorted(rows):
        for p in range(len(b) - n + 1):
            least.setdefault(b[p : p + n], i)
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if least[b[p : p + n]] < i:
                gone[p : p + n] = True
        out[i] = gone
    return out


@pytest.mark.parametrize("common", [suffix.COMMON, 3])
@pytest.mark.parametrize("kind", ["documents", "tight"])
def test_repeats_against_brute_force(spark, kind, common):
    if kind == "documents":
        rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    else:  # few symbols, periods, passages at every offset, lengths about the limit
        rng = random.Random(5)
        passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
        rows = [(i, ("é" * (i % 3)) + "".join(rng.choice("xyz") for _ in range(rng.randrange(9))) + passage[(a := rng.randrange(350)) : a + rng.choice((20, 49, 50, 51, 99, 200))] + ("ab" * rng.choice((0, 24, 25, 26, 100)))) for i in range(120)]
    got = {r.doc_id: r for r in suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), common=common).collect()}
    raw = {i: t.encode() for i, t in rows}
    for i, gone in brute_removed(list(raw.items())).items():
        kept = np.frombuffer(raw[i], np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw[i]), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i


def test_texts_of_one_tag_are_two_texts(spark):
    passage = "a passage that two documents share and that is over fifty bytes long"
    for pair in ((31261, 40547), (31261, 40548)):
        df = spark.createDataFrame([(i, f"{passage}{k}") for i, k in enumerate(pair)], "doc_id long, text string")
        assert {r.doc_id: r.n_removed >= len(passage) for r in suffix.without_repeats(df).collect()} == {0: False, 1: True}


def test_runs_in_stretches():
    rng = np.random.default_rng(1)
    data, offsets = rng.integers(97, 100, 5000).astype(np.uint8), np.array([0, 40, 40, 700, 2100, 2149, 5000])
    windows = lambda r: sorted((int(a) + k, int(h)) for h, a, n in zip(*r, strict=True) for k in range(int(n)))
    whole = windows(suffix.runs(data, offsets))
    assert whole == windows(suffix.runs(data, offsets, 333)) == windows(suffix.runs(data, offsets, 50))
    assert [a for a, _ in whole] == [a for x, y in zip(offsets[:-1], offsets[1:], strict=True) for a in range(x, y - 49)]


def test_a_common_passage_is_sent_once_for_a_block():
    """Of a passage that all texts share, bytes go on once for a block and none for the texts after the first; of what stands beside it each window goes its own way."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefghijk ") for _ in range(200))
    texts = [passage + "".join(rng.choice("lmnopqrstuv ") for _ in range(60)) for _ in range(800)]
    block = suffix._block(0, pa.array(range(len(texts)), pa.int64()), pa.array(texts))
    known = pa.Table.from_batches([block])
    grams = list(suffix._grams(7)(iter([block])))
    order = pa.Table.from_batches(grams).sort_by("route").to_batches()
    sent = {}
    for common in (100, 10**9):
        wanted = pa.Table.from_batches(list(suffix._shared(common)(iter(order))))
        cut = suffix._cut(7, 7)(known, wanted)
        recs = [suffix._unpacked(p, suffix._PIECE, "at") for p, b in zip(cut["payload"].to_pylist(), cut["bytes"].to_pylist(), strict=True) if b is not None]
        sent[common] = np.concatenate(recs)
    for rec in sent.values():  # within the passage, only the first text's pieces
        inside = rec[(rec["at"] % 260 + rec["n"] + 49) <= 200]
        assert len(inside) and (inside["doc"] == 0).all()
    largest = lambda rec: np.unique(rec["hash"], return_counts=True)[1].max()
    assert largest(sent[10**9]) > 700 and largest(sent[100]) < 100


def test_many_copies_and_one_id(spark):
    body = "the same long text of many documents, more than fifty bytes of it, as it happens"
    rows = [(i, body) for i in range(40)] + [(7, body), (None, body + "!"), (50, body + "?"), (51, "short"), (52, "short")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == sorted([(-1, 0), *((i, len(body)) for i in range(40)), (7, len(body)), (50, len(body)), (51, 0), (52, 0)])


def test_repeats_of_odd_rows(spark, odd):
    rows = suffix.without_repeats(odd, with_bytes=True).collect()
    assert len(rows) == len(ODD) and all(r.n_removed == 0 for r in rows)  # rows of one id don't remove from one another
    assert {bytes(r.kept) for r in rows if r.doc_id in (2, 3)} == {b""}
    assert suffix.without_repeats(none(odd)).isEmpty()


# --- tokens ---


def test_tokens_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    t = Tokenizer.from_file(path)
    hard = [(i, x) for i, x in enumerate(["a  b", " a", "a ", "a\n", "x\n y", "it's  we're", "tab\t b", "a\xa0b c", "<|endoftext|> x", "a b<|endoftext|>c d", "日本 語", "Été çà.\nÔ w1 2x", "a" * 5000, LONG, "", None, "é\x1c f"])]
    df = spark.createDataFrame(hard, "doc_id long, text string")
    got = tokens.token_shards(df, path, folder=f"file://{tmp_path}/shards", shard_bytes=2000).orderBy("doc_id").collect()
    at = 0
    for (i, x), r in zip(hard, got, strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), i
        at += len(ids)
    shards = spark.createDataFrame([(p.name,) for p in (tmp_path / "shards").glob("shard-*.zst")], "name string")
    some = tokens.fetch(spark.createDataFrame([(3,), (9,), (77,), (None,)], "doc_id long"), f"file://{tmp_path}/shards", shards)
    assert {r.doc_id: list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) for r in some.collect()} == {i: [*t.encode(hard[i][1], add_special_tokens=False).ids, 2] for i in (3, 9)}
    assert tokens.token_shards(odd, path).count() == len(ODD)
    assert tokens.token_shards(none(odd), path).isEmpty()


def test_encoder_forgets_marks_but_not_line_ends():
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    coder, plain = tokens.Encoder(path, most_marks=3), Tokenizer.from_file(path)
    texts = ["a " + " ".join(f"b{'!' * n}{'?' * (n % 3)}" for n in range(1, 30)), "x y\nz w\nv", "a b!!!\nc?? d"]
    assert coder.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_stored_again(tmp_path):
    for data in (b"one", b"two"):
        tokens._store(f"file://{tmp_path}/x", "shard-1.zst", data)
    assert (tmp_path / "x/shard-1.zst").read_bytes() == b"two" and len(list((tmp_path / "x").iterdir())) == 1


def test_reader_takes_only_the_frames_asked_for(tmp_path):
    w = tokens.ShardWriter(frame_bytes=4000)
    for i in range(500):
        w.add(1000 - i, np.random.default_rng(i).integers(0, 50_000, 200).astype("<u4").tobytes())
    path = tmp_path / "s"
    path.write_bytes(w.bytes())

    class Counted:
        taken = 0

        def __init__(self):
            self.f = path.open("rb")

        def seek(self, *a):
            return self.f.seek(*a)

        def read(self, n):
            self.taken += n
            return self.f.read(n)

    f = Counted()
    r = tokens.ShardReader(f)
    assert [r.ids(i) for i in r.rows_of(np.array([990, 700, 5000])).tolist()] == [np.random.default_rng(i).integers(0, 50_000, 200).astype("<u4").tobytes() for i in (10, 300)]
    assert f.taken < path.stat().st_size / 5


def test_shard_format():
    import zstandard

    w = tokens.ShardWriter(frame_bytes=64)
    texts = [struct.pack(f"<{n}I", *range(n)) for n in (3, 0, 40, 5)]
    for i, x in enumerate(texts):
        w.add(i, x)
    data = w.bytes()
    r = tokens.ShardReader(data)
    assert [r.ids(i) for i in (2, 0, 3, 1)] == [texts[i] for i in (2, 0, 3, 1)] and len(r.seeks) > 2
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as f:
        assert f.read() == b"".join(texts)
    broken = bytearray(data)
    broken[int(r.starts[1]) - 6] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokens.ShardReader(bytes(broken)).ids(0)
    with pytest.raises(ValueError):
        tokens.ShardReader(data[:-1] + b"x")


# --- decontamination ---


def test_contamination(spark, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()] + [(900, "tiny item"), (901, ""), (902, None)]
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()] + [(-1, "x Tiny, ITEM y"), (-2, " ".join(items[0][1].split()[2:])), (-3, items[1][1].upper())]
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def words(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t or ""))

    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = {}
    for j, u in items:
        k = min(5, len(words(u)))
        own = grams(words(u), k) if k else set()
        for i, t in rows:
            n = len(own & grams(words(t), k)) if own else 0
            if own and n >= 0.8 * len(own) - 1e-9:
                want[i, j] = n
    assert got == want and (-1, 900) in want
    assert decontaminate.contamination(odd, spark.createDataFrame([], "item_id long, text string")).isEmpty()
    clean = decontaminate.drop_contaminated(odd, spark.createDataFrame([(1, "b c d e f")], "item_id long, text string"))
    assert clean.columns == odd.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 4, 5]
    assert decontaminate.drop_contaminated(none(odd), bench).isEmpty()
    few = spark.createDataFrame(rows, "doc_id long, text string")
    parts = decontaminate.contamination(few, spark.createDataFrame(items, "item_id long, text string"), pass_chars=2000)
    assert {(r.doc_id, r.item_id): r.n_shared for r in parts.collect()} == want
    kept = decontaminate.drop_contaminated(few, spark.createDataFrame(items, "item_id long, text string"), pass_chars=2000)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}


# --- mixing ---


def test_pfair_windows():
    rng = random.Random(4)
    for _ in range(40):
        blocks = {f"s{i}": rng.randint(0, 200) for i in range(rng.randint(1, 9))}
        plan = mixing.phases(blocks, {s: rng.random() + 0.01 for s in blocks}, 60)
        slots = {}
        for p in plan:
            for k in range(p["lo"], p["hi"]):
                j = k - p["lo"]
                slot = p["start"] + j // p["w"] * p["total"] + p["at"][j % p["w"]]
                assert p["start"] + j * p["total"] // p["w"] <= slot < p["start"] - (-(j + 1) * p["total"] // p["w"])
                slots[slot] = p["source"], k
        assert sorted(slots) == list(range(sum(blocks.values()))) and len(set(slots.values())) == len(slots)


@pytest.mark.parametrize("n, share", [(20, 0.1396), (100, 1 / 3), (500, 1 / 3), (1500, 1 / 3)])
def test_mixing_keeps_to_the_weights_asked_for(n, share):
    weights = {f"s{i}": (1 - share) / (n - 1) for i in range(1, n)} | {"hot": share}
    total, slots = sum(map(Fraction, weights.values())), {}
    for p in mixing.phases(dict.fromkeys(weights, 100) | {"hot": 3000}, weights):
        for j in range(p["hi"] - p["lo"]) if p["start"] == 0 else ():
            slots[j // p["w"] * p["total"] + p["at"][j % p["w"]]] = p["source"]
    had = dict.fromkeys(weights, 0)
    for t in range(len(slots)):
        had[slots[t]] += 1
        for s in ("hot", slots[t]):
            assert abs(had[s] - Fraction(weights[s]) / total * (t + 1)) < 1
    assert len(slots) > 20


def test_mixing_rows_keep_to_the_weights(spark):
    weights = {f"s{i}": 1.0 for i in range(1, 500)} | {"hot": 250.0}
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id < 1500, 'hot', concat('s', id % 499 + 1)) AS source", "'x' AS text")
    rows = mixing.mixed(df, weights, block=1, carry=False).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(3000)) and all(r.release <= r.slot < r.deadline for r in rows)
    hot = np.cumsum([r.source == "hot" for r in rows[:1400]])
    assert np.abs(hot - 250 / 749 * np.arange(1, 1401)).max() < 1


def test_mixing(spark, odd):
    df = docs(spark)
    rows = mixing.mixed(df, block=4, period=20).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(df.count()))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    lines = mixing.in_mixed_order(df, block=4, period=20)
    assert lines.columns == df.columns and [r.doc_id for r in lines.collect()] == [r._id for r in rows]
    assert mixing.mixed(odd).count() == len(ODD) and mixing.in_mixed_order(odd).columns == odd.columns
    assert mixing.mixed(none(odd)).isEmpty()
    with pytest.raises(ValueError):
        mixing.mixed(df, {"src0": 1.0})


# --- chat ---


def test_rotation(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "cy <x>", "<|end|>"), (1, 300, "cy <x>", "<|end|>"), (2, None, None, "x"), (3, 0, "system", "x"), (None, 0, "a", "b")]
    out = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)))
    got = {}
    for r in out.orderBy("conv_id", "perspective", "seq").collect():
        text, masks = got.setdefault((r.conv_id, r.perspective), ("", []))
        assert r.start == len(text)
        text += r.rendered
        assert r.end == len(text)
        got[r.conv_id, r.perspective] = text, masks + ([text[r.mask_start : r.mask_end]] if r.mask_end >= 0 else [])
    end = "<|end|>\n"
    ends = f"<|user name=cy__x_|>\n< |end|>{end}" * 2
    assert got[1, "ann"] == (f"<|system|>\nbe{end}<|assistant|>\nhi{end}<|user name=bob|>\n{end}{ends}", [f"hi{end}"])
    assert got[1, "cy <x>"][1] == [f"< |end|>{end}"] * 2 and got[2, "unknown"][1] == [f"x{end}"]
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy <x>"), (2, "unknown"), (None, "a")}
    assert chat.rotated(none(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).isEmpty()


# --- personal data ---


def test_base_spans():
    t = "a.b@c.d e@f @x 1.2.3.400 10.0.0.1.9 4111 1111 1111 1111 +1 (325) 555-8094 x@y.z@w.v 4111111111111112"
    s = pii.base_spans(t)
    cut = lambda k: [t[a:b] for a, b in s[k]]
    assert cut("email") == ["a.b@c.d", "x@y.z"] and cut("ip") == ["10.0.0.1"] and cut("card") == ["4111 1111 1111 1111"][: len(cut("card"))] and cut("phone") == ["+1 (325) 555-8094"]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_against_plain_patterns(seed):
    rng = random.Random(seed)
    email, ip, card, phone = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits = lambda x: re.sub("[^0-9]", "", x)
    for _ in range(1500):
        t = "".join(rng.choice("0123456789..  @a-+(é\n") for _ in range(rng.randint(0, 60)))
        want = {
            "email": [m.span() for m in email.finditer(t)], "ip": [m.span() for m in ip.finditer(t) if all(int(p) < 256 for p in m[0].split("."))],
            "card": [m.span() for m in card.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))], "phone": [m.span() for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15],
        }
        assert pii.base_spans(t) == want, t


def test_long_parts_of_addresses():
    t = "1.1.1." + "0" * 5000 + " 1.1.1." + "0" * 5000 + "7 1.1.1." + "9" * 5000
    assert pii.base_spans(t)["ip"] == [(0, 5006), (5007, 10014)]


@pytest.mark.parametrize("loop", [False, True])
def test_passing_against_enumeration(loop):
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(10):
        n, labels = 6, 3
        node, chain_pot, skip_pot = rng.normal(size=(n, labels)), rng.normal(size=(labels, labels)) * 0.5, rng.normal(size=(labels, labels)) * 0.5
        chain = [(0, 1), (2, 3), (3, 4)]
        skip = [(1, 3), (0, 5)] + [(4, 5)] * loop
        weight = np.zeros((n, labels))
        for y in itertools.product(range(labels), repeat=n):
            e = sum(node[i, k] for i, k in enumerate(y)) + sum(chain_pot[y[a], y[b]] for a, b in chain) + sum(skip_pot[y[a], y[b]] for a, b in skip)
            for i, k in enumerate(y):
                weight[i, k] += np.exp(e)
        got = pii.passed(node, chain, skip, chain_pot, skip_pot)
        assert np.abs(got - weight / weight.sum(1, keepdims=True)).max() < (0.1 if loop else 0.005)


def test_evidence_travels_the_whole_document():
    n = 400  # one sure token; each is tied to the next like it
    node = np.zeros((n, 2))
    node[0] = 0, 30
    agree = np.array([[4.0, 0], [0, 4.0]])
    p = pii.passed(node, [], [(i, i + 1) for i in range(n - 1)], np.zeros((2, 2)), agree, most=3000)
    assert (p[:20, 1] > 0.7).all() and p[-1, 1] >= 0.5 and (np.diff(p[:, 1]) <= 1e-6).all()


def test_labels_of_tokens():
    rng = random.Random(4)
    for _ in range(200):
        t = pii.candidates(" ".join("1" * rng.randint(1, 6) for _ in range(rng.randint(1, 8))))
        seeds = [(a := rng.randrange(30), a + rng.randint(1, 12), rng.randint(1, 5)) for _ in range(rng.randrange(6))]
        want = [next((k for c, d, k in reversed(seeds) if 2 * (min(b, d) - max(a, c)) > b - a), 0) for a, b in t.spans]
        assert pii.labels_of(t, seeds).tolist() == want


def test_fit_does_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (pii.train(x, rows=150) for x in (df, df.repartition(7, "text")))
    assert np.array_equal(a.unary, b.unary) and np.array_equal(a.skip, b.skip)


def test_recall_of_secrets(spark):
    """Planted ones, and what the patterns miss in one place but the document says in another: a secret without its equals sign."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    field = pii.train(df)
    rng, hit, false = random.Random(8), 0, 0
    for _ in range(100):
        s = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        words = [rng.choice(["alpha", "beta", "gamma", "in", "1999", "of", "12", "2.0.1"]) for _ in range(80)]
        words[10], words[60] = f'key = "{s}"', s
        t = " ".join(words)
        got = [t[a:b] for k, a, b in pii.added_spans(t, field, pii.base_spans(t)) if k == "secret"]
        hit += got.count(s) == 2
        false += len(set(got) - {s})
    assert hit >= 90 and not false
    planted = df.select("text", F.regexp_extract_all("text", F.lit('(?i)token = "([0-9a-f]{40})"')).alias("s")).where("size(s) > 0").collect()
    found = [{r.text[a:b] for k, a, b in pii.added_spans(r.text, field, pii.base_spans(r.text)) if k == "secret"} for r in planted]
    assert len(planted) > 20 and sum(set(r.s) <= f for r, f in zip(planted, found, strict=True)) >= 0.9 * len(planted)


def test_field(spark, odd):
    field = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    key = "ab12" * 10
    t = f'x token = "{key}" word and later {key} again, version 2.0.'
    added = pii.added_spans(t, field, pii.base_spans(t))
    assert [t[a:b] for k, a, b in added if k == "secret"] == [key, key] and len(added) == 2
    assert pii.added_spans("in 1999 there were 12 of them.", field, pii.base_spans("")) == []
    assert pii.redacted("me a@b.c!", [("email", 3, 8)]) == "me [EMAIL]!"
    rows = pii.digest(pii.detected(odd, field)).collect()
    assert len(rows) == len(ODD) and all(r.n_email == 0 for r in rows)
    assert {r.base_sha256 for r in rows if r.doc_id in (2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.digest(pii.detected(none(odd), pii.train(none(odd)))).isEmpty()


# --- classifiers ---


def test_language(spark, odd):
    got = langid.op6_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.95
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(odd, langid.train(odd)).collect()}
    assert rows[2][0] == rows[3][0] == "und" and rows[1][0] in ("en", "fr", "de") and all(0 <= s <= 1 for _, s in rows.values())
    assert langid.train(none(odd)) is None and langid.identified(none(odd), None).isEmpty()
    assert langid.identified(odd, None).where("lang_pred <> 'und'").isEmpty()


def test_letters():
    texts = ["— … €", "😀 ½²Ⅷ", "12 _ .", None, "", "-é-", "日", "a", "1²x"]
    assert langid.lettered(pa.array(texts)).tolist() == [False] * 5 + [True] * 4


def test_every_language_is_learned(spark):
    marks = [chr(0x4E00 + 40 * i) + chr(0x4E10 + 40 * i) + chr(0x4E20 + 40 * i) for i in range(205)]
    df = spark.createDataFrame([(1000 * i + k, " ".join([m] * 12) + f" {k}", f"x{i}") for i, m in enumerate(marks) for k in range(2)], "doc_id long, text string, lang string")
    m = langid.train(df, rows=600)
    assert len(m.families) == 205
    got = langid.identified(df, m).join(df, "doc_id").where("lang = lang_pred").count()
    assert got > 0.95 * df.count()
    with pytest.raises(ValueError):
        langid.train(df.withColumn("lang", F.col("doc_id").cast("string")))


def test_families():
    rng = np.random.default_rng(0)
    x = rng.random((90, 6)).astype(np.float32) * 0.1
    langs = np.array(["en", "de", "fr"] * 30, object)
    for k, name in enumerate(("en", "de", "fr")):
        x[langs == name, k] += 1
    x[langs != "fr", 5] += 1
    m = langid.fit(np.hstack([x, np.ones((90, 1), np.float32)]), langs)
    assert m.families == ["germanic", "romance"] and m.languages == [["de", "en"], ["fr"]]
    assert (m.predict(x)[0] == langs).all()


def test_bags_of_words():
    b = toxicity.bags(pa.array(["ab cd", "", None, "ab"]))
    assert b.n_words == 3 and b.first.tolist() == [0, 2, 2, 2, 3]
    sets = [set(b.bucket[b.word == w].tolist()) for w in range(3)]
    assert sets[0] == sets[2] != sets[1] and len(sets[0]) == 4  # two of three bytes, one of four, and the word


def test_toxicity(spark, odd):
    rng = random.Random(1)
    names = [a + b + c for a in ("ka", "lo", "mi", "su", "te") for b in ("ra", "no", "vi", "du") for c in ("n", "s", "l")]
    mean = ["idiot", "moron", "scum"]
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        words = [rng.choice(names) for _ in range(rng.randint(20, 200))]
        for w in rng.sample(mean, 2) if bad else ():
            words[rng.randrange(len(words))] = w
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(df.drop("toxic"), df.where("doc_id < 600").select("doc_id", "toxic"))
    held = toxicity.scored(df.drop("toxic"), m).where("doc_id >= 600").join(df.select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    plain, odd_spelling = m.score(pa.array(["kara lonos midul tevis", "kara idiott morron tevis"]))
    assert odd_spelling > plain
    assert toxicity.scored(odd, m).count() == len(ODD) and toxicity.scored(none(odd), m).isEmpty()
    blank = toxicity.train(odd, none(df))
    assert {r.score for r in toxicity.scored(odd, blank).collect()} == {0.5}


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(160):  # long texts, with ever new words and, in the toxic ones, one spelling of a word found nowhere else
        words = [letters(9) for _ in range(1500)]
        if i % 2:
            words[rng.randrange(len(words))] = "blorfuk" + letters(4)
        rows.append((i, " ".join(words), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    m = toxicity.train(df.drop("toxic"), df.where("doc_id < 120").select("doc_id", "toxic"))
    held = toxicity.scored(df.drop("toxic"), m).where("doc_id >= 120").join(df.select("doc_id", "toxic"), "doc_id").collect()
    assert len(held) == 40 and np.mean([r.predicted == r.toxic for r in held]) > 0.95


def test_toxicity_query(spark):
    """The query as it is registered: learned from two folds, held against the third."""
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    found = [r.predicted for r in rows if r.toxic == 1]
    assert np.mean(found) >= 0.9 and sum(r.predicted for r in rows if r.toxic == 0) <= 0.005 * len(rows)


def test_parting():
    z, y = np.array([-3.0, -2, -1, 1, 4, 5, 6, 0.5]), np.array([0, 0, 0, 0, 1, 1, 1, 1])
    assert toxicity.parting(z, y) == 2.5  # the one below isn't worth the clean one above it
    neutral = float(np.log(0.7 / (1 - 0.7)))
    assert toxicity.parting(z, np.zeros(8)) == toxicity.parting(np.ones(8), y) == toxicity.parting(z[:0], y[:0]) == neutral


def test_one_id_is_learned_from_once(spark):
    rows = [(i, f"word{i} other {'vile' if i % 2 else 'nice'} text", i % 2) for i in range(40)]
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int")
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    again = df.unionByName(df.where("doc_id = 1").crossJoin(spark.range(500)).drop("id"))
    assert np.array_equal(toxicity.train(df, labels).value, toxicity.train(again, labels).value)


def test_very_long_texts(spark):
    """A text of 12 MB beside short ones, through the operators that hold a row's arrays."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    long = " ".join(rng.choice(words) if i % 200 else f"10.0.{i % 256}.{i % 251}" for i in range(2_000_000))
    rows = [(1, long[500_000:500_200]), (2, long), (3, "short text"), (4, long[-300:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).persist()
    repeats = {r.doc_id: r.n_removed for r in suffix.without_repeats(df).collect()}
    assert repeats[1] == repeats[3] == 0 and repeats[2] >= 200 and repeats[4] == len(long[-300:].encode())
    good = {r._id: (r.n_words, r.base_failed) for r in quality.quality_cascade(df, known={r.name: (1.0, 0.1) for r in quality.default_rules()}).collect()}
    assert good[2] == (2_000_000, False) and good[3] == (2, True)
    found = {r.doc_id: r.n_ip for r in pii.digest(pii.detected(df, pii.fit(np.zeros((0, 1)), np.zeros(0)))).collect()}
    assert found[2] == 10_000 and found[3] == 0
    model = langid.train(spark.createDataFrame([(1, "the and of that", "en"), (2, "der und die das", "de")], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identified(df, model).collect()} <= {"en", "de"}
    assert {r.doc_id: r.fingerprint for r in simhash.simhash_groups(df).collect()}[2] == f"{simhash.fingerprint(long):016x}"
    df.unpersist()


# --- queries ---


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
