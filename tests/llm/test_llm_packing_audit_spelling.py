"""Packing, the filter audit and spelling variants against brute force, and their odd rows."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations as subsets
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import audit, packing, registry, spelling

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(1, "a b c d e f", "en"), (2, None, None), (3, "", "fr"), (4, LONG, "en"), (4, LONG, "en"), (None, "a b c d e f g", "de"), (None, "a b c d e f g", "de"), (5, "Été\n\n  x\ty\r\nz  <|endoftext|> it's é á", "fr"), (6, "a b c d e f", None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and columns named like the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(7).alias(c) for c in ("piece", "start", "length", "ids", "_part", "_place", "part", "good", "A", "_h", "_id", "word", "n", "key", "half", "at", "stored")])


def none(df):
    return df.where(F.lit(False))


# --- packing ---


def whole_ids(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
    return struct.pack(f"<{len(ids)}I", *ids)


def check_packing(rows, docs, capacity=packing.CAPACITY):
    """Every document's ids in pieces that are whole but for the last, in sequences without gaps; returns their number."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for doc, text in docs:
        ids = whole_ids(text, tokenizer)
        for start in range(0, len(ids), 4 * capacity):
            part = ids[start : start + 4 * capacity]
            want[doc, start // 4 // capacity, start // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_of_the_table(spark):
    rows = registry.QUERIES["op11_slack_packing"](spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(rows, docs) == -(-sum(r.length for r in rows) // packing.CAPACITY)  # no fewer are possible


@pytest.mark.parametrize("capacity", [4096, 500])
def test_odd_rows_are_packed(spark, odd, capacity):
    pieces = packing.cut(odd, packing.default_tokenizer(), capacity=capacity)
    placed = packing.packed(pieces, capacity=capacity)
    rows = placed.withColumn("ids_crc32", F.crc32("ids")).collect()
    n = check_packing(rows, [(r[0], r[1]) for r in ODD], capacity)
    made = packing.sequences(placed).collect()
    assert len(made) == n
    for s in made:
        assert len(s.ids) == 4 * sum(d["length"] for d in s.docs)
        for r in (r for r in rows if r.sequence_id == s.sequence_id):
            assert bytes(s.ids[4 * r.offset : 4 * (r.offset + r.length)]) == bytes(r.ids)
    empty = packing.packed(packing.cut(none(odd), packing.default_tokenizer()))
    assert empty.isEmpty() and packing.sequences(empty).isEmpty()


def test_words_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    plain, coder, rng = Tokenizer.from_file(packing.default_tokenizer()), packing.WordEncoder(packing.default_tokenizer(), most=50), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", "é", "'s", " ", "  ", "\n", "\t", " ", " ", "12", "?!", "<|endoftext|>", "Σ", "ß", "x" * 70, "́", "😀"]) for _ in range(rng.randint(0, 25)))
        assert coder.encode(text) == struct.pack(f"<{len(ids)}I", *ids) if (ids := plain.encode(text, add_special_tokens=False).ids) else coder.encode(text) == b""


@pytest.mark.parametrize("seed", range(20))
def test_combinations_are_the_fullest(seed):
    rng = random.Random(seed)
    capacity = rng.randint(5, 40)
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 14)))
    left = Counter(counts)
    for times, used in packing.combinations(counts, capacity, longest=False):
        for _ in range(times):
            items = sorted(left.elements())
            best = max(s for k in range(len(items) + 1) for c in subsets(items, k) if (s := sum(c)) <= capacity) if len(items) < 13 else None
            assert best is None or sum(n * u for n, u in used.items()) == best
            left -= Counter(used)
    assert not left
    for way in (packing.combinations(counts, capacity), packing.best_combinations(counts, capacity)):
        total = Counter()
        for times, used in way:
            assert sum(n * u for n, u in used.items()) <= capacity and times > 0
            for n, u in used.items():
                total[n] += times * u
        assert total == counts


def test_the_number_of_combinations_follows_lengths_not_pieces():
    rng = random.Random(1)
    few = {n: rng.randint(1, 1000) for n in range(1, 400)}
    many = {n: c * 10**9 for n, c in few.items()}
    a, b = packing.best_combinations(few, 400), packing.best_combinations(many, 400)
    assert max(len(a), len(b)) <= 400 * 7
    assert sum(t for t, _ in b) <= sum(t for t, _ in a) * 10**9


# --- audit ---


def failing(rows):
    """For each row the letters that it fails."""
    out = []
    for doc, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), bool(set(t) & set("#$%&*|")), doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _ in rows)), strict=True) if x})
    return out


def brute_audit(rows, labels):
    fails, out = failing(rows), set()
    for part in {r[2] or "" for r in rows}:
        own = [(r, f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        shap, told = Counter(), []
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                shap[f] += len(gone)
                lost = lambda k: sum(labels.get(r[0], (0, 0))[k] == 1 for r, _ in gone)  # noqa: B023, E731
                told.append((part, "".join(order), step, len(alive), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), lost(0), lost(1), f))
        out |= {(*t[:-1], shap[t[-1]]) for t in told}
    return out


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 1, 1), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = audit.audited(audit.trie_edges(audit.verdicts(odd, labels), audit.FILTERS), audit.FILTERS).collect()
    want = brute_audit(ODD, {1: (1, 1), 4: (1, 1), 6: (0, 0)})
    assert {tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(want)
    nothing = audit.verdicts(none(odd), none(labels))
    assert audit.audited(audit.trie_edges(nothing, audit.FILTERS), audit.FILTERS).isEmpty()


def test_audit_agrees_with_sql(spark):
    got = registry.QUERIES["op12_filter_audit"](spark, SF).select(*COLUMNS).collect()
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.sql(registry.ORACLES["op12_filter_audit"]).project(", ".join(COLUMNS)).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) % 600 == 0


def test_audit_runs_each_set_once(spark):
    rows = spark.createDataFrame([("p", True, None, i % 2 == 0, i % 3 == 0, None) for i in range(12)], "part string, good boolean, toxic boolean, X boolean, Y boolean, Z boolean")
    edges = audit.trie_edges(rows, ["X", "Y", "Z"])
    found = {(r.state, r["filter"]): (r.n, r.removed, r.good_lost, r.toxic_lost) for r in edges.collect()}
    assert len(found) == 3 * 2 ** (3 - 1) == edges.count()
    assert found[0, "X"] == (12, 6, 6, 0) and found[1, "Y"] == (6, 2, 2, 0) and found[3, "Z"] == (4, 0, 0, 0) and found[2, "X"] == (8, 4, 4, 0)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    with pytest.raises(ValueError):
        audit.audited(edges, list("ABCDEFG"))


# --- spelling ---


def brute_words(rows):
    n = Counter()
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def neighbours(w, n):
    letters = sorted({c for x in n for c in x})
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    made = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return {v for v in made if v in n and v != w}


def brute_variants(n):
    near = {w: neighbours(w, n) for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def told(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_spelling_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_words(rows))
    assert told(registry.QUERIES["op13_spelling_variants"](spark, SF)) == want and any(f for _, f, *_ in want)


@pytest.mark.parametrize("most", [4, 1000])
@pytest.mark.parametrize("seed", range(3))
def test_variants_against_all_neighbours(spark, seed, most):
    """Short alphabets, so that words repeat letters and many share a half; with small groups halves must grow."""
    rng = random.Random(seed)
    n = {"".join(rng.choice("abé"[: 2 + seed % 2]) for _ in range(rng.choice((2, 3, 5, 7, 8, 9, 15)))): rng.choice((2, 3, 20, 25, 250, 2500)) for _ in range(250)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert told(spelling.variants(words, most=most, shard_rows=300)) == brute_variants(n)


def test_chains_of_forms_end_at_the_root(spark):
    n = {"a" * 7 + "b" * k: 2 * 10**k for k in range(12)}
    got = told(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute_variants(n) and all(r == "a" * 7 + "b" * 11 for _, _, r, *_ in got)


def test_one_edit():
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    for a in words:
        for b in words:
            assert spelling.one_edit(a, b) == (b in neighbours(a, dict.fromkeys(words, 1)))


def test_words_of_odd_rows(spark, odd):
    rows = [(9, "Straße straße STRASSE Déjà-vu DÉJÀVU déjàvus ÷÷÷÷×××× ÷÷÷÷××××"), (None, "straßenbahn Straßenbahn"), (7, " ".join(["colours"] * 300 + [f"word{i}" for i in range(9)])), *[(i, f"colours coloures umbrellas{i} umbrellas") for i in range(200)], *[(i, t) for i, t, _ in ODD]]
    words = spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.word: r.n for r in words.collect()} == brute_words(rows)
    empty = spelling.word_counts(none(odd))
    assert empty.isEmpty() and spelling.variants(empty).isEmpty()
    assert spelling.variants(spelling.word_counts(odd)).count() == len(brute_words([(r[0], r[1]) for r in ODD]))
