"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models of order two, one of toxic and one of ordinary texts, over the same symbols: a word that enough training texts hold is a symbol, a
rarer one is its stem (its first bytes) if enough texts hold that, and anything rarer is one unknown symbol; how a symbol is spelt is alike in both classes and
cancels out. A class's probability of a symbol after another backs off from its own pairs to its own single symbols and from there to the continuation counts
(the distinct predecessors of a symbol) that both classes share, so an expression that a class has hardly met is judged by shared counts. Every level has an absolute
discount from its counts of counts, n1 / (n1 + 2 * n2), and what it takes goes to the level below, so each distribution sums to one.

An expression counts once a text, in training and in scoring: counts are numbers of texts, and near copies among the training texts (same three least word
hashes) count once. ``cut``, the number of texts from which words, stems and pairs are told apart, is the least at which it would be a chance of CHANCE that all of
an expression's texts are toxic.

A text is compared by its distinct pairs of symbols: the mean difference of the two log-likelihoods, times the root of their number, and how far expressions stand out
by more than STANDS above the text's own median, as a sum and by the root of the length; that median takes out what a language or a kind of text has more
of in one class. A logistic curve, fitted on training texts that the counts have not seen and weighted by the classes' shares, turns these into a probability.

The counts come from at most ``per_class`` texts of each class (see common.label_sample); they are summed on the executors, and ``cut`` grows so that at most
KINDS words, stems or pairs each reach the driver and the broadcast, however long the texts are. Scoring is a map over rows.

Defined results: a null text counts as empty; an empty text gets the score of no evidence; without labels of both classes every score is the share of label 1
(0 without labels); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import HashTable, byte_words, crc_mod, fit_logistic, joined_texts, label_sample, mix64, slices, table, word_hashes, written

#: Texts of each class that the models are counted on and calibrated with, at most.
PER_CLASS = 4000
#: Bytes of a word that make its stem.
STEM = 5
CHANCE = 1e-6
#: Difference above a text's median from which an expression stands out.
STANDS = 2.0
#: Words, stems and pairs that the models tell apart at most, each.
KINDS = 400_000
_CHUNK = 1 << 18
#: Words here are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z lower-cased.
_BETWEEN = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


def words_and_stems(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of their stems, and the number of words of each text."""
    start, stop, count = byte_words(data, ends, _BETWEEN)
    return word_hashes(data, start, stop, fold=True), word_hashes(data, start, np.minimum(stop, start + STEM), fold=True), count


def parts(column):
    """First row, bytes and ends of the texts of an Arrow column in slices of bounded size."""
    data, ends = joined_texts(column)
    for a, b in slices(ends, _CHUNK):
        base = ends[a - 1] if a else 0
        yield a, data[base : ends[b - 1]], ends[a:b] - base


def least_count(share: float, total: int, chance: float = CHANCE, kinds: int = KINDS) -> int:
    """Texts that an expression needs: ``share`` to this power is below ``chance``; and so many that no more than ``kinds`` of ``total`` can have them."""
    share = min(max(share, 1e-6), 0.99)
    return max(2, math.ceil(math.log(chance) / math.log(share)), -(-total // kinds))


def distinct(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each owner (owners ascending)."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], key[new]


class Symbols:
    """Numbers of words: of those told apart, of the stems of others, and one for the rest."""

    def __init__(self, words: np.ndarray, stems: np.ndarray):
        if len(words) + len(stems) >= 1 << 24:
            raise ValueError("too many symbols")
        self.size = len(words) + len(stems) + 1
        self.words, self.stems = HashTable(words, np.arange(len(words))), HashTable(stems, np.arange(len(stems)) + len(words))

    def pairs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and number (symbol before * size + symbol) of each distinct pair; before a text's first word stands the number ``size``."""
        word, stem, n = words_and_stems(data, ends)
        owner = np.repeat(np.arange(len(n)), n)
        v, hit = self.words.get(word)
        s, found = self.stems.get(stem)
        x = np.where(hit, v, np.where(found, s, self.size - 1)).astype(np.int64)
        before = np.full(len(x), self.size, np.int64)
        same = owner[1:] == owner[:-1]
        before[1:][same] = x[:-1][same]
        return distinct(owner, before * self.size + x)


def discount(once: float, twice: float) -> float:
    """The absolute discount from how many kinds occur once and twice."""
    return once / (once + 2 * twice) if once else 0.5


def interpolated(count: np.ndarray, d: float, below: np.ndarray) -> np.ndarray:
    """Discounted shares, and the rest by the level below."""
    p = np.maximum(count - d, 0) / max(count.sum(), 1)
    return p + (1 - p.sum()) * below


class KneserNey:
    """Probabilities of a symbol after another in either class (0 ordinary, 1 toxic).

    ``single``: by class, texts that hold each symbol; ``shared``: distinct predecessors of each, in either class; ``after``: by class, pairs that begin with each symbol
    (and with a text's start, last); ``pair`` and ``pair_count``: the pairs told apart and, by class, their texts; ``discounts``: of single symbols and of pairs, by class.
    """

    def __init__(self, symbols: Symbols, single: np.ndarray, shared: np.ndarray, after: np.ndarray, pair: np.ndarray, pair_count: np.ndarray, discounts: np.ndarray):
        self.symbols, k = symbols, symbols.size
        base = interpolated(shared, discount((shared == 1).sum(), (shared == 2).sum()), np.full(k, 1 / k))
        self.pairs = HashTable(mix64(pair.astype(np.uint64)), np.arange(len(pair)))
        self.one, self.rest, self.two = [], [], []
        for c in (0, 1):
            self.one.append(interpolated(single[c], discounts[0][c], base))
            p = np.maximum(pair_count[c] - discounts[1][c], 0) / np.maximum(after[c][pair // k], 1)
            self.rest.append(1 - np.bincount(pair // k, p, k + 1))
            self.two.append(np.append(p, 0.0))

    def probability(self, pair: np.ndarray, c: int) -> np.ndarray:
        """Of the second symbol of each pair after the first."""
        k = self.symbols.size
        at, hit = self.pairs.get(mix64(pair.astype(np.uint64)))
        return self.two[c][np.where(hit, at, len(self.two[c]) - 1).astype(np.int64)] + self.rest[c][pair // k] * self.one[c][pair % k]

    def evidence(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each text: mean difference of the log-likelihoods of its distinct pairs, their number, and what stands out above its median difference."""
        out = np.zeros((len(ends), 3))
        for a, b in slices(ends, _CHUNK):
            base = ends[a - 1] if a else 0
            owner, pair = self.symbols.pairs(data[base : ends[b - 1]], ends[a:b] - base)
            r = np.log(self.probability(pair, 1)) - np.log(self.probability(pair, 0))
            n = np.bincount(owner, minlength=b - a)
            some = np.flatnonzero(n)
            order = np.lexsort((r, owner))
            middle = np.zeros(b - a)
            first = np.cumsum(n) - n
            middle[some] = (r[order[first[some] + (n[some] - 1) // 2]] + r[order[first[some] + n[some] // 2]]) / 2
            out[a:b, 0] = np.bincount(owner, r, b - a) / np.maximum(n, 1)
            out[a:b, 1] = n
            out[a:b, 2] = np.bincount(owner, np.maximum(r - middle[owner] - STANDS, 0), b - a)
        return out


def features(e: np.ndarray, centre: float) -> np.ndarray:
    root = np.sqrt(np.maximum(e[:, 1], 1))
    return np.stack([(e[:, 0] - centre) * (e[:, 1] > 0) * root, e[:, 2] / root, np.log1p(e[:, 2])], axis=1)


class Curve:
    """A probability from a text's evidence."""

    def __init__(self, centre: float, weights: np.ndarray):
        self.centre, self.weights = centre, weights

    def __call__(self, e: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(e, self.centre) @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _counted(keys: list[np.ndarray], ys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with how many of either class they have."""
    key, y = np.concatenate(keys), np.concatenate(ys)
    u, inv = np.unique(key, return_inverse=True)
    return u, np.bincount(inv, y == 0, len(u)).astype(np.int64), np.bincount(inv, y == 1, len(u)).astype(np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """word, stem and the numbers of ordinary and toxic texts that hold it, of rows (y, text)."""

    def run(batches):
        for b in batches:
            y = b.column(0).to_numpy()
            for first, *texts_ in parts(b.column(1)):
                word, stem, n = words_and_stems(*texts_)
                owner, key = distinct(np.repeat(np.arange(len(n)), n), word)
                u, c0, c1 = _counted([key], [y[first + owner]])
                _, at = np.unique(word, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(stem[at].view(np.int64)), pa.array(c0), pa.array(c1)], names=["word", "stem", "c0", "c1"])

    return texts.select("y", "text").mapInArrow(run, "word long, stem long, c0 long, c1 long").groupBy("word").agg(F.min("stem").alias("stem"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def count_pairs(texts: DataFrame, symbols: Symbols) -> DataFrame:
    """pair (-1 - symbol: a single one) and the numbers of ordinary and toxic texts that hold it, of rows (y, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(symbols)

    def run(batches):
        sym = shared.value
        for b in batches:
            y = b.column(0).to_numpy()
            for first, *texts_ in parts(b.column(1)):
                owner, pair = sym.pairs(*texts_)
                alone, single = distinct(owner, pair % sym.size)
                u, c0, c1 = _counted([pair, -1 - single], [y[first + owner], y[first + alone]])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c0), pa.array(c1)], names=["pair", "c0", "c1"])

    return texts.select("y", "text").mapInArrow(run, "pair long, c0 long, c1 long").groupBy("pair").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _totals(counts: DataFrame) -> list[int]:
    """By class: the sum of the counts, and how many are one and two."""
    return [int(x or 0) for x in counts.agg(*[x for c in ("c0", "c1") for x in (F.sum(c), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2))]).first()]


def count_models(texts: DataFrame, chance: float = CHANCE) -> KneserNey | None:
    """The models of training texts (y, text); None where a class has no word."""
    words = written(count_words(texts), "toxic-words")
    n0, once0, twice0, n1, once1, twice1 = _totals(words)
    if not n0 or not n1:
        return None
    cut = least_count(n1 / (n0 + n1), n0 + n1, chance)
    known = F.col("c0") + F.col("c1") >= cut
    frequent = words.filter(known).select("word").toArrow().column(0).to_numpy()
    stems = words.filter(~known).groupBy("stem").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).filter(known).select("stem").toArrow().column(0).to_numpy()
    symbols = Symbols(np.sort(frequent.view(np.uint64)), np.sort(stems.view(np.uint64)))
    k = symbols.size
    pairs = written(count_pairs(texts, symbols), "toxic-pairs")
    alone, two = pairs.filter("pair < 0"), pairs.filter("pair >= 0")
    total = _totals(two)
    single, shared, after = np.zeros((2, k)), np.zeros(k), np.zeros((2, k + 1))
    got = alone.toArrow()
    single[:, -1 - got.column(0).to_numpy()] = np.stack([got.column(1).to_numpy(), got.column(2).to_numpy()])
    got = two.groupBy((F.col("pair") % k).alias("x")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    shared[got.column(0).to_numpy()] = got.column(1).to_numpy()
    got = two.groupBy(F.expr(f"pair div {k}").alias("v")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow()
    after[:, got.column(0).to_numpy()] = np.stack([got.column(1).to_numpy(), got.column(2).to_numpy()])
    got = two.filter(F.col("c0") + F.col("c1") >= least_count(n1 / (n0 + n1), total[0] + total[3], chance)).toArrow()
    discounts = np.array([[discount(once0, twice0), discount(once1, twice1)], [discount(*total[1:3]), discount(*total[4:6])]])
    order = np.argsort(got.column(0).to_numpy())
    pair, *counts = (got.column(i).to_numpy()[order] for i in range(3))
    return KneserNey(symbols, single, shared, after, pair, np.stack(counts), discounts)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, chance: float = CHANCE) -> tuple[KneserNey | None, Curve | float]:
    """The models and the curve; (None, share of label 1) where one class has no labels."""
    sample = label_sample(labels, label, per_class)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")

    def sketched(batches):
        for b in batches:
            sketch = []
            for _, *texts_ in parts(b.column(3)):
                word, _, n = words_and_stems(*texts_)
                sketch += [hash(tuple(np.unique(word[z - m : z])[:3].tolist())) for z, m in zip(np.cumsum(n), n, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sketch, pa.int64())], names=["y", "share", "check", "text", "sketch"])

    rows = text.select(F.col("y").cast("int").alias("y"), "share", "check", "text")
    ready = written(rows.mapInArrow(sketched, "y int, share double, check boolean, text string, sketch long"), "toxic-sample")
    once = written(ready.filter("NOT check").groupBy("y", "sketch").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("y", "text"), "toxic-texts")
    model = count_models(once, chance)
    if model is None:
        one = sample.agg(F.max(F.when(F.col("y") == 1, F.col("share")))).first()[0]
        return None, float(one or 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for b in batches:
            e = shared.value.evidence(*joined_texts(b.column(0)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *(pa.array(np.ascontiguousarray(x)) for x in e.T)], names=["y", "share", "d", "n", "out"])

    seen = ready.filter("check").select("text", "y", "share").mapInArrow(measure, "y int, share double, d double, n double, out double").toArrow()
    rows = np.array([c.to_numpy() for c in seen.columns], float).reshape(5, -1)
    y, share, *e = rows[:, np.lexsort(np.round(rows, 9))]  # in an order of their own
    e = np.stack(e, axis=1)
    centre = float(np.median(e[y == 0, 0])) if (y == 0).any() else 0.0
    w = share / np.maximum(np.where(y == 1, y.sum(), (1 - y).sum()), 1)
    return model, Curve(centre, fit_logistic(features(e, centre), y, w, 1e-6))


def score(docs: DataFrame, model: KneserNey | None, curve: Curve | float, threshold: float = 0.5, modulus: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", modulus) == 0).alias("held_out"), F.col("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model, curve))

    def run(batches):
        for b in batches:
            p = probabilities(*shared.value, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def probabilities(model: KneserNey | None, curve: Curve | float, texts) -> np.ndarray:
    """The probability of label 1 of each text of an Arrow column."""
    return np.full(len(texts), float(curve)) if model is None else curve(model.evidence(*joined_texts(texts)))


def keep_ordinary(docs: DataFrame, model: KneserNey | None, curve: Curve | float, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast((model, curve)), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(probabilities(*shared.value, b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, table(spark, sf_dir, "labels")))
