"""Language ID: gradients, held-out accuracy, defined odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import language, queries

from ..conftest import TESTDATA
from .conftest import ODD


def test_gradients_by_differences():
    draw = np.random.default_rng(0)
    own = language.Network(["a", "b", "c"], 3)
    own.w = {k: v.astype(np.float64) for k, v in own.w.items()}
    windows = draw.integers(0, 255, (4, 9)).astype(np.uint8)
    windows[1, 5:] = language.PAD
    label = np.array([0, 1, 2, 1])

    def loss():
        total = n = 0
        for byte, p in own.positions(windows):
            real = byte != language.PAD
            total, n = total - np.log(p[np.arange(4), label])[real].sum(), n + real.sum()
        return total / n

    for name, grad in own._gradients(windows, label).items():
        at = (windows[0, 3], 2) if name[0] == "E" else tuple(draw.integers(0, d) for d in grad.shape)
        was = own.w[name][at]
        own.w[name][at] = was + 1e-4
        up = loss()
        own.w[name][at] = was - 1e-4
        down = loss()
        own.w[name][at] = was
        assert grad[at] == pytest.approx((up - down) / 2e-4, rel=1e-4, abs=1e-8)


def test_windows_hold_every_byte():
    for n in (0, 1, 127, 128, 129, 1000):
        w = language.windows_of(b"x" * n)
        assert (w != language.PAD).sum() == n and w.shape[1] == language.WINDOW


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    out = queries.op10_language_id(spark, f"{TESTDATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert held[0] >= 0.97 and held[1] > 200 and 0 <= held[2] and held[3] <= 1
    assert out.count() == docs.count()


def test_odd_rows_and_nothing(spark, odd, empty):
    assert language.train(empty, F.lit(True)) is None
    got = language.identify(odd, None, keep=["score", "lang"])
    assert got.count() == len(ODD) and {r[0] for r in got.select("lang_pred").distinct().collect()} == {"und"}
    own = language.train(odd, F.lit(True))
    assert own.labels == ["de", "en", "fr"]
    rows = {(r["key"], r["lang_pred"] == "und", r["score"] == 0) for r in language.identify(odd, own).collect()}
    assert {k for k, und, zero in rows if und and zero} == {2, 3, 4, -9}
    assert language.identify(empty, own).count() == 0


def test_positions_equal_a_plain_recurrence():
    """Every byte's probabilities against one state at a time, without batches or steps in place."""
    network = language.Network(["a", "b", "c"], hidden=3, seed=5)
    w = {k: v.astype(float) for k, v in network.w.items()}
    windows = np.random.default_rng(1).integers(32, 127, (4, 9)).astype(np.uint8)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(direction, row):
        h, out = np.zeros(3), {}
        for t in range(len(row)) if direction == "f" else reversed(range(len(row))):
            e = w["E" + direction][row[t]]
            r = sigmoid(e[:3] + h @ w["U" + direction][:, :3])
            z = sigmoid(e[3:6] + h @ w["U" + direction][:, 3:])
            c = np.tanh(e[6:] + (r * h) @ w["V" + direction])
            h = z * h + (1 - z) * c
            out[t] = h
        return out

    sums = network.pooled(windows)
    for i, row in enumerate(windows):
        ahead, back, total = states("f", row), states("b", row), np.zeros(3)
        for t in range(len(row)):
            p = np.exp(np.concatenate([ahead[t], back[t]]) @ w["O"] + w["c"])
            total += p / p.sum()
        assert np.allclose(sums[i], total, atol=1e-4)
