"""The pipeline against its stages done by brute force, and the registration of its parts."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lorespark.llm import bpe, decontaminate as D, oracles, pseudonyms
from lorespark.llm.common import cut
from tests.compare import connect
from tests.llm.test_near_copies import brute_roots


def test_stages(spark, sf):
    con = connect(sf)
    rows = {r[0]: list(r) for r in con.execute("select doc_id, text, lang, source, n_chars from documents").fetchall()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = []
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, sf)
        made.append([r.asDict() for r in df.collect()])
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert df.columns == docs.columns and dict(df.dtypes) == dict(docs.dtypes)
            docs = spark.createDataFrame([tuple(r.values()) for r in made[-1]], docs.schema)
    kept = {r[0] for r in con.execute(f"select doc_id from ({oracles.OP10}) where kept").fetchall()}
    assert {r["doc_id"] for r in made[0]} == kept and len(kept) < len(rows)
    roots = brute_roots({i: rows[i][1] for i in kept})
    assert {r["doc_id"] for r in made[1]} == set(roots.values())
    items = [(str(a), b) for a, b in con.execute("select item_id, text from benchmark").fetchall()]
    win = D.windows_of(items, 10)
    cut = 0
    for r in made[2]:
        w = D.words_of(r["text"])
        assert not any(tuple(w[i : i + 10]) in win for i in range(len(w)))
        assert r["n_chars"] == len(r["text"])
        before = rows[r["doc_id"]][1]
        b = D.words_of(before)
        if not any(tuple(b[i : i + 10]) in win for i in range(len(b))):
            assert r["text"] == before
        else:
            cut += 1
    assert cut > 0
    third = {r["doc_id"]: r["text"] for r in made[2]}
    again = pseudonyms.scrub(spark.createDataFrame(list(third.items()), "doc_id long, text string")).collect()
    fourth = {r["doc_id"]: r["text"] for r in made[3]}
    assert fourth == {r.doc_id: r.text for r in again} and fourth != third
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in made[4]:
        ids = e.encode_ordinary(fourth[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(fourth[r["doc_id"]].encode()).hexdigest()
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()} == {r["doc_id"]: r["ids"] for r in made[4]}


def test_registration():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(oracles.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert duckdb.__version__


def test_empty_documents(spark, sf, tmp_path):
    import shutil

    for t in ("benchmark", "documents"):
        shutil.copy(f"{sf}/{t}.parquet", tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_columns_nulls_and_repeated_rows(spark, sf):
    """Every stage takes clashing and dotted names, null ids and texts, and repeated rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    more = docs.unionByName(docs.limit(7)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    wide = more.select("*", F.lit(1).alias("a.b"), F.lit("x").alias("TEXT"), F.lit(2).alias("N_CHARS"), F.col("doc_id").alias("_id"), F.lit(None).cast("string").alias("key"))
    plain, fat = docs, wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, fat = cut(stage(spark, plain, sf), "plain"), stage(spark, fat, sf)
        assert fat.columns == wide.columns
        fat = cut(fat, "fat")
    by_place = lambda df: sorted(tuple(r)[:2] + tuple(r)[4:5] for r in df.toDF(*[f"c{i}" for i in range(len(df.columns))]).collect())
    assert by_place(plain) == by_place(fat) and len(by_place(plain)) > 20
    tokens = corpus_pipeline.STAGES[-1][1]
    assert sorted(r.ids_sha256 for r in tokens(spark, fat, sf).collect()) == sorted(r.ids_sha256 for r in tokens(spark, plain, sf).collect())
