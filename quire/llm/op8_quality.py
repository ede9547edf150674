"""Quality by a byte-level convolutional network in numpy.

Learned byte embeddings, filters of ``WIDTH`` bytes every ``STRIDE`` bytes over overlapping chunks that cover the whole text, a rectifier, and two poolings of
every filter: its greatest value anywhere (over all chunks) and, of the same responses, the mean of the chunks' greatest values, so that one odd passage and
a text that is odd throughout can be told apart. A logistic unit combines them into one probability.

The network is fitted with Adam on at most ``per_class`` texts of each class (see common.label_sample) of LONGEST bytes at most, weighted by the classes' shares, in one
task; an epoch takes every so-many-th chunk of a training text longer than TRAIN_BYTES, other ones each epoch, so that the epochs together meet all of
them. Scoring reads every byte of every text, however long, and is a map over rows.

Defined results: a null text counts as empty; an empty text is one chunk of padding; without labels of both classes every score is the share of label 1 (0.5
without labels); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import crc_mod, joined_texts, label_sample, table

PER_CLASS = 1500
CHUNK, STRIDE, WIDTH, EMBED, FILTERS = 512, 4, 8, 6, 24
#: Bytes of a text's chunks that one training step uses, or more where the epochs could not meet all chunks otherwise; and of a training text.
TRAIN_BYTES, LONGEST = 8192, 1 << 18
EPOCHS, BATCH, RATE, SEED = 6, 32, 4e-3, 7
_BYTES = 1 << 18


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of a text of n bytes begin: each overlaps the next by WIDTH - STRIDE bytes at least, the last one ends with the text."""
    step = CHUNK - (WIDTH - STRIDE)
    return np.arange(0, max(n - (WIDTH - STRIDE), 1), step)


def training_chunks(starts: np.ndarray, epoch: int, epochs: int = EPOCHS) -> np.ndarray:
    """Those of a text's chunks that one epoch uses; all of them over the epochs."""
    parts = min(-(-len(starts) // max(TRAIN_BYTES // CHUNK, 1)), epochs)
    return starts[epoch % parts :: parts]


def chunk_matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of CHUNK bytes for each chunk, zeros after its text's end."""
    at = starts[:, None] + np.arange(CHUNK)
    return np.where(at < ends[:, None], data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)


class ByteNet:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "w": r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "v": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }

    def respond(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk and filter: the greatest response and its position."""
        x = self.p["e"][chunks].reshape(len(chunks), CHUNK * EMBED)
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        z = windows.reshape(-1, WIDTH * EMBED) @ self.p["w"]
        z = z.reshape(len(chunks), -1, FILTERS)
        at = z.argmax(axis=1)
        return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p["b"], 0), at

    def pooled(self, best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both poolings of each text, whose chunks begin at ``first``; and how many chunks it has."""
        n = np.diff(first, append=len(best))
        return np.hstack([np.maximum.reduceat(best, first), np.add.reduceat(best, first) / n[:, None]]), n

    def probability(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each text, from all of its bytes; a text's chunks are met in blocks of bounded size."""
        top, total, count = np.zeros((len(ends), FILTERS), np.float32), np.zeros((len(ends), FILTERS)), np.zeros(len(ends))
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        starts = [chunk_starts(int(n)) for n in ends - begin]
        owner = np.repeat(np.arange(len(ends)), [len(s) for s in starts])
        where = np.concatenate(starts) + begin[owner] if len(starts) else np.zeros(0, np.int64)
        for i in range(0, len(where), _BYTES // CHUNK):
            o = owner[i : i + _BYTES // CHUNK]
            best, _ = self.respond(chunk_matrix(data, where[i : i + len(o)], ends[o]))
            np.maximum.at(top, o, best)
            np.add.at(total, o, best)
            np.add.at(count, o, 1)
        h = np.hstack([top, total / np.maximum(count, 1)[:, None]])
        return 1 / (1 + np.exp(-np.clip(h @ self.p["v"] + self.p["c"], -40, 40))).astype(np.float64)

    def step(self, chunks: np.ndarray, first: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the weighted log loss."""
        best, at = self.respond(chunks)
        h, n = self.pooled(best, first)
        p = 1 / (1 + np.exp(-np.clip(h @ self.p["v"] + self.p["c"], -40, 40)))
        d = (w * (p - y)).astype(np.float32)
        owner = np.repeat(np.arange(len(first)), n)
        gh = d[:, None] * self.p["v"][None]
        gbest = gh[owner, FILTERS:] / n[owner, None]
        top = best == h[owner, :FILTERS]
        ties = np.add.reduceat(top.astype(np.float32), first)
        gbest = (gbest + np.where(top, gh[owner, :FILTERS] / ties[owner], 0)) * (best > 0)
        bytes_at = np.take_along_axis(chunks[:, None, :], at[:, :, None] * STRIDE + np.arange(WIDTH), 2)  # chunk, filter, width
        x = self.p["e"][bytes_at].reshape(len(chunks), FILTERS, WIDTH * EMBED)
        gx = (gbest[:, :, None] * self.p["w"].T[None]).reshape(-1, EMBED)
        ge = np.stack([np.bincount(bytes_at.ravel(), gx[:, k], 256) for k in range(EMBED)], axis=1)
        return {"e": ge.astype(np.float32), "w": np.einsum("cf,cfk->kf", gbest, x), "b": gbest.sum(0), "v": h.T.astype(np.float32) @ d, "c": d.sum(keepdims=True)}

    def fit(self, texts: list[bytes], y: np.ndarray, w: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        r, m, s, t = np.random.default_rng(seed), {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        w = w / w.mean()
        steps = epochs * -(-len(texts) // BATCH)
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                ix, rows, first = order[i : i + BATCH], [], []
                for k in ix:
                    data = np.frombuffer(texts[k], np.uint8)
                    st = training_chunks(chunk_starts(len(data)), epoch, epochs)
                    first.append(sum(map(len, rows)))
                    rows.append(chunk_matrix(data, st, np.full(len(st), len(data))))
                g = self.step(np.concatenate(rows), np.array(first), y[ix], w[ix])
                t += 1
                rate = RATE * min(1, 2 * (1 - t / (steps + 1)))
                for k in self.p:
                    x = g[k] / len(ix) + 1e-5 * self.p[k]
                    m[k] += 0.1 * (x - m[k])
                    s[k] += 0.01 * (x * x - s[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> ByteNet | float:
    """The network; or the share of label 1, where one class has no labels. The sample's texts are fitted in one task, of bounded rows."""
    sample = label_sample(labels, label, per_class)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").filter(F.octet_length("text") <= LONGEST)

    def train(batches):
        texts, y, w = [], [], []
        for b in batches:
            for t, v, p in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                texts.append(t.encode())
                y.append(v)
                w.append(p)
        y, w = np.array(y, np.float64), np.array(w)
        if 0 < y.sum() < len(y):
            net = ByteNet()
            net.fit(texts, y, w / np.where(y == 1, y.sum(), (1 - y).sum()))
            for k, v in net.p.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.astype(np.float32).tobytes()])], names=["name", "value"])
        elif len(y):
            yield pa.RecordBatch.from_arrays([pa.array(["share"]), pa.array([np.float32(y[0]).tobytes()])], names=["name", "value"])

    bounded = text.select("text", "y", "share", "doc_id").repartition(1).sortWithinPartitions("doc_id", "text").select("text", "y", "share")
    got = {r["name"]: np.frombuffer(bytes(r["value"]), np.float32) for r in bounded.mapInArrow(train, "name string, value binary").collect()}
    if "e" not in got:
        return float(got["share"][0]) if "share" in got else 0.5
    net = ByteNet()
    net.p = {k: got[k].reshape(v.shape).copy() for k, v in net.p.items()}
    return net


def score(docs: DataFrame, net: ByteNet | float, threshold: float = 0.3, modulus: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", modulus) == 0).alias("held_out"), F.col("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for b in batches:
            p = np.full(b.num_rows, net) if isinstance(net, float) else net.probability(*joined_texts(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op8_quality_bytenet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
