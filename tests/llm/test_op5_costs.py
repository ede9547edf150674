"""op5: cheaper steps that give the same numbers."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from quire.llm import op5_attention as op5
from quire.llm.common import joined_texts


def fresh_memory(call) -> int:
    """Bytes that a repeated call takes at its peak."""
    call()
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_steps_fill_the_same_arrays_again():
    r = np.random.default_rng(1)
    net, prior = op5.Attention(), op5.priors(r.integers(0, 3, (op5.VOCAB, op5.VOCAB)))
    ids, target, inside = r.integers(0, op5.VOCAB, (96, 24)), r.integers(0, op5.VOCAB, (96, 24)), r.random((96, 24)) < 0.95
    assert fresh_memory(lambda: net.gradient(ids, target, prior, inside)) < 1_000_000
    g, adam = net.gradient(ids, target, prior, inside)[1], op5.Adam(net)
    assert fresh_memory(lambda: adam.step(g)) < 100_000
    place, text = np.arange(op5.VOCAB), r.integers(0, op5.VOCAB, 40_000).astype(np.uint16)
    assert fresh_memory(lambda: op5.score_texts(net, prior, place, [text])) < 5_000_000


def test_gradient_agrees_with_differences():
    r = np.random.default_rng(2)
    net, prior = op5.Attention(), op5.priors(r.integers(0, 3, (op5.VOCAB, op5.VOCAB)))
    net.p["w"] = r.normal(0, 0.3, net.p["w"].shape).astype(np.float32)
    ids, target, inside = r.integers(0, 40, (9, 24)), r.integers(0, op5.VOCAB, (9, 24)), r.random((9, 24)) < 0.9
    g = net.gradient(ids, target, prior, inside)[1]
    for k in net.p:
        way = np.where(g[k] != 0, r.normal(size=g[k].shape), 0).astype(np.float32)
        kept, at = net.p[k], []
        for step in (-3e-3, 3e-3):
            net.p[k] = kept + np.float32(step) * way
            at.append(net.gradient(ids, target, prior, inside)[0])
        net.p[k] = kept
        want = -(at[1] - at[0]) / 6e-3
        assert abs((g[k] * way).sum() - want) < 2e-2 * max(1, abs(want)), k


def test_texts_are_looked_up_once(spark, capsys):
    docs = spark.createDataFrame([(i, f"the of {i} zq{i % 7}") for i in range(50)], "doc_id long, text string")
    rows = docs.selectExpr("doc_id", "doc_id id", "text").withColumn("key", op5.row_key()).withColumn("train", op5.crc_mod("doc_id", 10) != 0)
    op5.base_scores(rows, 3)[0].explain()
    assert "MapInArrow" not in capsys.readouterr().out


def test_windows_of_many_texts_are_those_of_each():
    r = np.random.default_rng(3)
    texts = [r.integers(0, 256, n) for n in (1, 23, 24, 25, 48, 500, 1, 71, 72, 73)]
    first = np.arange(len(texts)) % op5.ROUNDS
    got = op5.batch_windows(np.concatenate(texts), np.array([len(t) for t in texts]), op5.END, first, op5.ROUNDS)
    for k, part in enumerate(zip(*(op5.training_windows(t, op5.END, int(f), op5.ROUNDS) for t, f in zip(texts, first)))):
        assert np.array_equal(got[k], np.concatenate(part))
    seen = [np.append(t, op5.END)[: len(t)].tolist() for t in texts]
    for t in seen:
        parts = [op5.training_windows(np.array(t), op5.END, f, op5.ROUNDS) for f in range(op5.ROUNDS)]
        assert sorted(x for _, target, inside in parts for x in target[inside].tolist()) == sorted(t)


def test_a_small_memory_of_words_changes_no_ids():
    words = [f"wörd{i} {i * i}" for i in range(300)]
    texts = [" ".join(words[i : i + 30]) for i in range(0, 300, 7)] + ["", "the The", words[0]]
    big, small = op5.Subwords(op5.pieces()), op5.Subwords(op5.pieces(), 40)
    for i in range(0, len(texts), 5):
        part = joined_texts(pa.array(texts[i : i + 5]))
        for a, b in zip(big.texts(*part), small.texts(*part), strict=True):
            assert np.array_equal(a, b)
