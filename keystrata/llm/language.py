"""Language ID: a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes (the last one
padded).  In each window one recurrent pass runs forward and one backward, so
every byte is labelled from the context on both sides; a document's probabilities
are the mean over all its bytes.  The network is trained here, in numpy, by
backpropagation through time with Adam, on a bounded sample of labelled rows:
at most ``SAMPLE_DOCS`` documents, about as many of each language, drawn by hash,
and ``SAMPLE_WINDOWS`` windows of each.

Applying it is one pass over each row by itself, in batches of windows: no
shuffle, and memory for one Arrow slice.  The weights (some 60 KB) travel with
the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import freeing, pieces_of, small, small_batches, stored

WINDOW = 128
HIDDEN = 8
PAD = 255  # no byte of UTF-8
BATCH = 4096
SAMPLE_DOCS, SAMPLE_WINDOWS = 1600, 2
STEPS, TRAIN_BATCH, RATE = 160, 192, 0.02
SEED = 7
UNDETERMINED = "und"
OUT = "key long, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")


def windows_of(raw: bytes) -> np.ndarray:
    """(windows, WINDOW) bytes, padded at the end."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw + bytes([PAD]) * (n * WINDOW - len(raw)), np.uint8).reshape(n, WINDOW)


class Network:
    """Weights of both directions (table of input terms by byte, U for both gates, V for the state) and the output layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        draw = np.random.default_rng(seed)
        small = lambda *shape: draw.normal(0, 0.3, shape).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.w = {}
        for d in "fb":
            self.w |= {f"E{d}": small(256, 3 * hidden), f"U{d}": small(hidden, 2 * hidden), f"V{d}": small(hidden, hidden)}
        self.w |= {"O": small(2 * hidden, len(labels)), "c": np.zeros(len(labels), np.float32)}

    def _pass(self, d: str, steps, bytes_by_step: np.ndarray, keep: list | None = None):
        """The states of one direction, step by step."""
        h, (E, U, V), n = np.zeros((bytes_by_step.shape[1], self.hidden), np.float32), (self.w[k + d] for k in "EUV"), self.hidden
        for t in steps:
            g = E[bytes_by_step[t]]
            a = h @ U
            a += g[:, : 2 * n]
            a *= 0.5
            np.tanh(a, out=a)
            a *= 0.5
            a += 0.5
            rh = a[:, :n] * h
            c = rh @ V
            c += g[:, 2 * n :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, h, a, rh, c))
            z = a[:, n:]
            h = z * (h - c)
            h += c
            yield t, h

    def positions(self, windows: np.ndarray):
        """For each step (from the last) the label probabilities of all windows."""
        by_step = np.ascontiguousarray(windows.T)
        n, ahead = self.hidden, [h for _, h in self._pass("f", range(len(by_step)), by_step)]
        Of, Ob = self.w["O"][:n], self.w["O"][n:]
        for t, h in self._pass("b", range(len(by_step) - 1, -1, -1), by_step):
            p = ahead[t] @ Of
            p += h @ Ob
            p += self.w["c"]
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(axis=1, keepdims=True)
            yield by_step[t], p

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Sums of the probabilities of each window's bytes."""
        out = np.zeros((len(windows), len(self.labels)))
        for at in range(0, len(windows), BATCH):
            part = out[at : at + BATCH]
            for byte, p in self.positions(windows[at : at + BATCH]):
                p[byte == PAD] = 0
                part += p
        return out

    def train(self, windows: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = TRAIN_BATCH, rate: float = RATE, seed: int = SEED) -> None:
        """Backpropagation through time: cross-entropy of every byte's label, Adam."""
        draw = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = draw.integers(0, len(windows), batch)
            grads = self._gradients(windows[pick], label[pick])
            now = rate * min(1.0, 2 * (steps - step + 1) / steps)
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def _gradients(self, windows: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        by_step, n = np.ascontiguousarray(windows.T), self.hidden
        length, rows = by_step.shape
        kept = {"f": [], "b": []}
        states = {"f": [None] * length, "b": [None] * length}
        for d, steps in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            for t, h in self._pass(d, steps, by_step, kept[d]):
                states[d][t] = h
        both = np.concatenate([np.stack(states["f"]), np.stack(states["b"])], axis=2)
        p = both @ self.w["O"] + self.w["c"]
        p = np.exp(p - p.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(rows), label] -= 1
        real = by_step != PAD
        p *= (real / max(1, real.sum()))[:, :, None]
        grads = {"O": np.einsum("trh,trl->hl", both, p, optimize=True), "c": p.sum((0, 1))}
        to_states = p @ self.w["O"].T
        for d, at in (("f", 0), ("b", n)):
            E, U, V = (np.zeros_like(self.w[k + d]) for k in "EUV")
            own_u, own_v, dh = self.w["U" + d], self.w["V" + d], np.zeros((rows, n), np.float32)
            for t, h, a, rh, c in reversed(kept[d]):
                dh = dh + to_states[t, :, at : at + n]
                r, z = a[:, :n], a[:, n:]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                drh = dc @ own_v.T
                dr = drh * h * r * (1 - r)
                da = np.concatenate([dr, dz], axis=1)
                V += rh.T @ dc
                U += h.T @ da
                np.add.at(E, by_step[t], np.concatenate([da, dc], axis=1))
                dh = dh * z + drh * r + da @ own_u.T
            grads |= {"E" + d: E, "U" + d: U, "V" + d: V}
        return grads


def sample(docs: DataFrame, may_learn: Column, key: str, text: str, lang: str) -> list[tuple[str, bytes]]:
    """(lang, window) pairs of the training sample, in hash order."""
    rows = docs.filter(may_learn & F.col(f"`{lang}`").isNotNull() & (F.length(f"`{text}`") > 0))
    rows = rows.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.lit(SEED), F.col(f"`{key}`")).alias("draw"))
    counts = rows.groupBy("lang").count()
    # draw is even over the longs: this lets about the same number of each language through
    share = F.lit(1.0 * SAMPLE_DOCS) / F.count("*").over(_everything()) / F.col("count")
    counts = stored(counts.withColumn("least", F.lit(2.0**63) - share * F.lit(2.0**64)).drop("count"), "language-counts")
    rows = rows.join(small(counts), "lang").filter(F.col("draw").cast("double") >= F.col("least"))
    at = [F.pmod(F.xxhash64(F.lit(j), F.col("draw")), F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int") + 1 for j in range(SAMPLE_WINDOWS)]
    rows = rows.select("lang", "draw", F.array(*[F.substr("text", x, F.lit(WINDOW)) for x in at]).alias("parts"))
    rows = rows.orderBy("draw", "lang", "parts").limit(2 * SAMPLE_DOCS).collect()
    return [(r["lang"], x.encode()[:WINDOW]) for r in rows for x in r["parts"]]


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def train(docs: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """The network learned from the rows that ``may_learn`` allows; None if there are none."""
    found = sample(docs, may_learn, key, text, lang)
    if not found:
        return None
    labels = sorted({x for x, _ in found})
    network = Network(labels)
    windows = np.concatenate([windows_of(raw) for _, raw in found])
    network.train(windows, np.array([labels.index(x) for x, _ in found]))
    return network


def has_letter(text: Column) -> Column:
    """Whether a text is not null and holds a letter, without which it has no language."""
    return F.coalesce(F.rlike(text, F.lit(_LETTER.pattern)), F.lit(False))


def identify(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """One row for each row of ``docs``: key, lang_pred, score and the columns in ``keep``.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if nothing could be learned.  Whole texts are read, however long.
    Repeated rows and keys stay rows of their own, each judged alike; an empty table
    gives none; columns not in ``keep`` are left out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)])

    def label(batches):
        for batch in batches:
            for part in pieces_of(batch):
                texts = part.column(1).to_pylist()
                lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                known = [i for i, x in enumerate(texts) if x and network and _LETTER.search(x)]
                if known:
                    found = [windows_of(texts[i].encode()) for i in known]
                    sums = network.pooled(np.concatenate(found))
                    starts = np.cumsum([0] + [len(x) for x in found[:-1]])
                    means = np.add.reduceat(sums, starts)
                    means /= means.sum(axis=1, keepdims=True)
                    for i, p in zip(known, means):
                        lang[i], score[i] = network.labels[int(p.argmax())], min(1.0, float(p.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *part.columns[2:]], names=["key", "lang_pred", "score", *part.schema.names[2:]])

    kinds = dict(rows.dtypes)
    schema = ", ".join([OUT, *[f"keep_{i} {kinds[f'keep_{i}']}" for i in range(len(keep))]])
    out = rows.mapInArrow(freeing(label), schema)
    return out.select("key", "lang_pred", "score", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])
