"""The pipeline's stages against brute force, and its registration."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from keystrata.llm import queries, secrets
from keystrata.llm.tokenizing import tokenizer

from ..conftest import TESTDATA
from .conftest import ODD, SCHEMA
from .test_jaccard import brute, copies

SMALL = f"{TESTDATA}/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", f"s{(k or 0) % 3}", len(t or "")) for k, t in rows], SCHEMA).repartition(3)


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "source_mixing", "bpe_coding"]


def test_stages_keep_columns_and_take_odd_rows(spark, empty):
    for docs, n in ((spark.createDataFrame(ODD, SCHEMA).repartition(2), len(ODD)), (empty, 0)):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, SMALL)
            assert out.count() <= 2 * n
            if name != "bpe_coding":
                assert out.columns == list(corpus_pipeline.COLUMNS)


def test_nothing_to_learn_from(spark):
    """Without a label, texts without a letter go all the same, and the rest keep what they have."""
    texts = {1: "plain words", 2: None, 3: "", 4: "12 _ 34 !?", 5: "日本", 6: "٣٤ ²", 7: "5 é", 8: " \n"}
    docs = spark.createDataFrame([(k, t, None, "s", 1) for k, t in texts.items()] + [(9, None, "de", "s", 0)], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["lang"]) for r in stage("language_id")(spark, docs, SMALL).collect()}
    assert got == {k: (texts[k], None) for k in (1, 5, 7)}
    # labels that may not be learned from stay
    ids = [i for i, held in spark.range(60).select("id", queries.held_out(F.col("id"))).collect() if held]
    held = spark.createDataFrame([(i, "ein Satz", "de", "s", 8) for i in ids], SCHEMA)
    assert {r["lang"] for r in stage("language_id")(spark, held, SMALL).collect()} == {"de"}


def test_near_duplicates_keep_one_of_each(spark):
    rows = copies(5, 8, 6)
    out = stage("near_duplicates")(spark, documents(spark, rows), SMALL)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})


def test_secrets_are_replaced(spark):
    out = stage("secret_scan")(spark, documents(spark, [(1, 'token = "3f9a0c27be41d58e6a7c90b1d2e3f40516a7b8c9" end'), (2, "clean text")]), SMALL)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    text = f'token = "{secrets.REDACTED}" end'
    assert got == {1: (text, len(text)), 2: ("clean text", 10)}


def test_mix_repeats_documents(spark):
    rows = [(i, f"w{i} x y") for i in range(300)]
    docs = documents(spark, rows)
    out = stage("source_mixing")(spark, docs, SMALL)
    per = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    # 150% of 900 words by 5, 2, 1, at most 600 a source: 600, 500, 250 words of 3
    assert abs(per["s0"] - 200) <= 1 and abs(per["s1"] - 166) <= 1 and abs(per["s2"] - 83) <= 1
    assert max(r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()) <= 2


def test_run_on_the_smallest_table(spark):
    out = corpus_pipeline.run(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    own = tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    kept = {c for _, _, c in brute(list(docs.items()), 5, 80)}
    assert {r["doc_id"] for r in out} <= kept and len({r["doc_id"] for r in out}) > 0.7 * len(kept)
    for r in out:
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        if "token =" not in docs[r["doc_id"]]:
            assert r["ids"] == own.encode(docs[r["doc_id"]], add_special_tokens=False).ids


def test_weights_by_code_point_null_last(spark):
    docs = spark.createDataFrame([("b",), (None,), ("a",), ("Z",), ("é",)], "source string")
    got = {r["source"]: r["weight"] for r in queries.source_weights(docs).collect()}
    assert got == {"Z": 5, "a": 2, "b": 1, "é": 5, None: 2}
