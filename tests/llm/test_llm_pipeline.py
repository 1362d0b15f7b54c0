"""The pipeline against each stage done by brute force."""

import importlib.util
import re
import struct
import zlib

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from quern.llm import mixing, quality, simhash, tokens

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = dict(con.sql(f"SELECT doc_id, text FROM documents SEMI JOIN (SELECT doc_id FROM ({quality.ORACLE}) WHERE kept) USING (doc_id)").fetchall())
    fps = {i: simhash.fingerprint(t) for i, t in kept.items()}
    root = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for i in kept:
            for j in kept:
                if root[j] < root[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[i], changed = root[j], True
    kept = {i: t for i, t in kept.items() if root[i] == i}

    def grams(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [grams(t) for (t,) in con.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    kept = {i: t for i, t in kept.items() if not any(len(s & grams(t)) >= 0.8 * len(s) for s in items if s)}
    df = spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id IN ({','.join(map(str, kept))})")
    order = [r._id for r in mixing.mixed(df, carry=False).orderBy("position").collect()]
    coder, at, want = tokens.Encoder(tokens.default_tokenizer()), 0, []
    for i in order:
        ids = coder.encode([kept[i]])[0] + struct.pack("<I", 2)
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).isEmpty()
    assert corpus_pipeline.token_shards(spark, docs.limit(0), SF, by_files=False).isEmpty()


def test_stages_take_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (None, text + " more", None, None), (3, None, None, "t"), (4, "", "en", "t"), (5, text + " again and more of it", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *[F.lit(1).alias(c) for c in ("_keep", "_length", "_file", "_row", "_doc", "_t", "_id", "kept", "name", "at", "position")])
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        out = stage(spark, docs, SF)
        assert name == "token_shards" or out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() >= 2 and {r.doc_id for r in docs.collect()} <= {1, -1, 5}
