"""What workers keep, and how large the batches are that reach them."""

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from keystrata.llm import shared, tokenizing

from .conftest import SCHEMA

RECORDS, BYTES = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))


@pytest.fixture
def batches(spark):
    """Sets rows and bytes of a batch; the session's own come back."""
    own = {k: spark.conf.get(k) for k in (RECORDS, BYTES)}

    def put(*values):
        for k, v in zip(own, values):
            spark.conf.set(k, v)

    yield put
    put(*own.values())


@pytest.mark.parametrize("stage", ["language_id", "near_duplicates", "bpe_coding"])
def test_batches_of_a_stage_are_bounded(spark, batches, stage):
    batches("10000", "64m")
    docs = spark.createDataFrame([(i, f"a few words {i}", "en", "s", 1) for i in range(3000)], SCHEMA).repartition(1)
    dict(corpus_pipeline.STAGES)[stage](spark, docs, "")

    def sizes(parts):
        for b in parts:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) == shared.BATCH_ROWS
    long = spark.range(100).selectExpr("repeat('x', 1 << 20) text").repartition(1)
    assert max(r["n"] for r in long.mapInArrow(sizes, "n long").collect()) <= shared.BATCH_BYTES >> 20


def test_smaller_batches_stay(spark, batches):
    batches("100", "1m")
    shared.small_batches(spark)
    assert (spark.conf.get(RECORDS), spark.conf.get(BYTES)) in (("100", "1m"), ("100", "1048576b"))
    # no limit of rows
    batches("0", "64m")
    shared.small_batches(spark)
    assert [spark.conf.get(k).rstrip("b") for k in (RECORDS, BYTES)] == [str(shared.BATCH_ROWS), str(shared.BATCH_BYTES)]


def test_tokenizers_go_with_their_operator(monkeypatch):
    """A tokenizer stays for tasks of one module and goes when a task of another begins."""
    held = []

    def run(module):
        def step(_):
            held.append(len(tokenizing._loaded))
            yield from ()

        step.__module__ = module
        list(shared.freeing(step)(iter([])))

    monkeypatch.setattr(shared, "_operator", "")
    run("bpe")
    tokenizing.byte_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    run("bpe")
    run("jaccard")
    assert held == [0, 2, 0]
