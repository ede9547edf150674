"""Benchmark decontamination by template canonicalisation.

A text becomes a template: runs of ASCII letters, digits and characters beyond ASCII are its tokens; numbers, names (capitalised words inside a sentence, a run
of them counting as one) and units (after a number) become typed slots, everything else is literal and lower-cased. Windows of ``WINDOW`` template tokens of
the benchmark items are hash-joined with those of the documents; an item shorter than a window is one window of its own length. What a capital letter means at the
start of a sentence is open, so both readings are tried: items have their windows with such words as literals, with their first word as inside a sentence, and with
all such words as names but for STARTERS; documents have theirs with such words as literals and, around them, as names.

Matching windows on one diagonal are checked for slots: one item value stands for one document value throughout (and one document name for one item name). Of the pairs
of values the most frequent are taken; a window with any other pair is void and covers nothing. What the consistent windows cover of an item decides: a
re-parameterised question covers it as well as a verbatim one.

Beside the template stands an exact path: windows of the plain tokens, whatever slots they would be, or the whole item if it is shorter. Either path leaks
with COVERAGE of the item's tokens or with RUN consecutive ones.

The benchmark side is broadcast only if its texts hold BROADCAST_CHARS characters at most; beyond that the same windows are joined by a shuffle, before which a filter of
fixed size (BLOOM bits) drops document windows that no item has.

Defined results: one row for each document and item it leaks (doc_id, item_id); null and empty texts and items leak nothing; an item that is a slot pattern
only (fewer than LITERALS literal tokens in every window) matches exact copies only; repeated rows give one row; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import HashTable, byte_words, gram_hashes, joined_texts, slices, table, word_hashes

WINDOW = 8
#: Literal tokens that a window needs to say anything.
LITERALS = 4
#: Of an item's tokens, the part that a document must cover.
COVERAGE = 0.5
#: Consecutive tokens of an item that are a leak, however long the item.
RUN = 13
BROADCAST_CHARS = 16_000_000
_BYTES = 1 << 18
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: How a window was made: a template, one whose item's first word is no start of a sentence, one with names at the start of sentences, or plain tokens.
TEMPLATE, INSIDE, NAMES, EXACT = 0, 1, 2, 3
#: Bits of the filter before a shuffle.
BLOOM = 1 << 25
#: Words that are no name at the start of a sentence.
STARTERS = "a all an and any are as at but by can compute could did do does each every find for from give given had has have he her his how if in is it its let many most no not of on one or our she should show since so some solve suppose that the their there these they this those to two was we were what when where which while who whose why will with would you your".split()
_BETWEEN = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_STOP = np.isin(np.arange(256), list(b".!?:;\n"))
_MARK = np.array([0, 0x6E756D, 0x6E616D65, 0x756E6974], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Words that are a unit after a number.
UNITS = "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg t lb lbs oz pound pounds ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh hz khz mhz ghz w kw mw v a j kj cal kcal k c f pa kpa bar percent dollar dollars euro euros cent cents usd eur gbp degree degrees meter meters metre metres kilometer kilometers kilogram kilograms gram grams".split()


def _hashes(words: list[str]) -> np.ndarray:
    data = "".join(words).encode()
    ends = np.cumsum([len(u) for u in words])
    return np.sort(word_hashes(np.frombuffer(data, np.uint8), ends - [len(u) for u in words], ends, fold=True))


_UNIT_HASHES, _STARTER_HASHES = _hashes(UNITS), _hashes(STARTERS)


class Template:
    """Template tokens of many texts: kind, canonical hash, literal hash, first and last byte, and where each text's tokens begin; and the same of plain tokens.
    ``begins``: a text begins a sentence. ``names``: capitalised words at the start of sentences are names, too.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, begins: bool = True, names: bool = False):
        start, stop, count = byte_words(data, ends, _BETWEEN)
        n = len(start)
        owner = np.repeat(np.arange(len(ends)), count)
        new = np.ones(n, bool)
        new[1:] = owner[1:] != owner[:-1]
        raw = word_hashes(data, start, stop, fold=True)
        lead, second = data[start] if n else np.zeros(0, np.uint8), data[np.minimum(start + 1, len(data) - 1)] if n else np.zeros(0, np.uint8)
        number = (lead >= 48) & (lead < 58)
        upper = (lead >= 65) & (lead < 91) | (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])
        previous = np.concatenate([[0], stop[:-1]])[:n]
        opens = np.where(new, True, stops[start] > stops[np.minimum(previous, start)])
        fresh = np.where(new, begins, opens)
        if names:
            fresh = opens & upper
            fresh[fresh] = np.isin(raw[fresh], _STARTER_HASHES)
        after_number = np.zeros(n, bool)
        after_number[1:] = number[:-1]
        unit = after_number & ~new & ~number
        unit[unit] = np.isin(raw[unit], _UNIT_HASHES)
        kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(upper & ~fresh, NAME, LITERAL)))
        join = np.zeros(n, bool)  # 3.14 is one number, Ada Lovelace one name
        if n > 1:
            gap = start[1:] - stop[:-1]
            between = data[np.minimum(stop[:-1], len(data) - 1)]
            join[1:] = ~new[1:] & ((kind[1:] == NUMBER) & (kind[:-1] == NUMBER) & (gap == 1) & np.isin(between, list(b".,:/-")) | (kind[1:] == NAME) & (kind[:-1] == NAME) & ~opens[1:])
        keep = np.flatnonzero(~join)
        self.kind, self.raw, self.start = kind[keep], raw[keep], start[keep]
        self.stop = stop[np.append(keep[1:], n)[: len(keep)] - 1] if n else stop
        self.canon = np.where(self.kind == LITERAL, self.raw, _MARK[self.kind])
        self.count = np.bincount(owner[keep], minlength=len(ends)) if n else np.zeros(len(ends), np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.owner = owner[keep] if n else owner
        self.opens = (opens & upper)[keep] if n else np.zeros(0, bool)
        self.words, self.word_owner, self.word_count = raw, owner, count
        self.word_first = np.cumsum(count) - count

    def exact_windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First plain token and hash of each window of plain tokens inside one text."""
        g = gram_hashes(self.words, size)
        s = np.flatnonzero(self.word_owner[: len(g)] == self.word_owner[size - 1 :]) if len(g) else np.zeros(0, np.int64)
        return s, g[s]

    def places(self, size: int, opening: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first token in it and hash of each window: of template tokens, or of plain ones where ``size`` is negative. ``opening``: only those with a
        capitalised word at the start of a sentence, or right after one, where names may be joined otherwise."""
        s, g = self.windows(size) if size > 0 else self.exact_windows(-size)
        if opening:
            upto = np.concatenate([[0], np.cumsum(self.opens)])
            some = upto[s + size] > upto[s]
            s, g = s[some], g[some]
        owner, first = (self.owner, self.first) if size > 0 else (self.word_owner, self.word_first)
        return owner[s], s - first[owner[s]], g

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of each window inside one text."""
        g = gram_hashes(self.canon, size)
        s = np.flatnonzero(self.owner[: len(g)] == self.owner[size - 1 :]) if len(g) else np.zeros(0, np.int64)
        return s, g[s]


def item_templates(texts: list[str]) -> tuple[np.ndarray, tuple[Template, ...]]:
    """The items' bytes and their templates: with the first word at the start of a sentence, inside one, and with names at the start of sentences."""
    data, ends = joined_texts(pa.array(texts, pa.string()))
    return data, (Template(data, ends), Template(data, ends, begins=False), Template(data, ends, names=True))


def doc_templates(data: np.ndarray, ends: np.ndarray) -> tuple[Template, Template]:
    """The documents' templates, without and with names at the start of sentences."""
    return Template(data, ends), Template(data, ends, names=True)


def doc_windows(forms: tuple[Template, Template], size: int):
    """(whether names stand at the start of sentences, text, first token, hash) of the windows of one size."""
    yield False, *forms[0].places(size)
    if size > 0:
        yield True, *forms[1].places(size, opening=True)


def item_windows(ids: list, texts: list[str], window: int = WINDOW, literals: int = LITERALS) -> list[tuple[int, int, int, int, int]]:
    """(window length, negative for plain tokens; hash, item number, first token, how it was made) of every window that says something."""
    out = []
    for mode, t in enumerate(item_templates(texts)[1]):
        lit = np.concatenate([[0], np.cumsum(t.kind == LITERAL)])
        for size in sorted({int(min(c, window)) for c in t.count if c}):
            s, g = t.windows(size)
            ok = (np.minimum(t.count[t.owner[s]], window) == size) & (lit[s + size] - lit[s] >= min(literals, size))
            out += [(size, int(h), int(t.owner[i]), int(i - t.first[t.owner[i]]), mode) for i, h in zip(s[ok], g[ok], strict=True)]
    for size in sorted({int(min(c, window)) for c in t.word_count if c}):
        s, g = t.exact_windows(size)
        ok = np.minimum(t.word_count[t.word_owner[s]], window) == size
        out += [(-size, int(h), int(t.word_owner[i]), int(i - t.word_first[t.word_owner[i]]), EXACT) for i, h in zip(s[ok], g[ok], strict=True)]
    return out


def longest_run(places: list[int]) -> int:
    """The most consecutive numbers in an ascending list."""
    if not places:
        return 0
    cuts = np.flatnonzero(np.diff(places) != 1)
    return int(np.diff(np.concatenate([[-1], cuts, [len(places) - 1]])).max())


class Judge:
    """Decides what one document leaks of one item, given matching windows."""

    def __init__(self, coverage: float = COVERAGE, run: int = RUN):
        self.coverage, self.run = coverage, run

    def __call__(self, docs: tuple[Template, Template], text: int, data: np.ndarray, items: tuple[Template, ...], number: int, item_data: np.ndarray, hits: list[tuple[int, int, int, int]]) -> tuple[int, float, str] | None:
        """hits: (first token in the document, in the item, length, how made). Returns tokens covered, their part of the item, and verbatim or reparameterised."""
        said = [self.template(docs[m == NAMES], text, data, items[m], number, item_data, [h for h in hits if h[3] == m]) for m in (TEMPLATE, INSIDE, NAMES)]
        said = [x for x in said if x]
        return max(said, key=lambda x: (x[2], x[1])) if said else self.exact(docs[0], text, items[0], number, [h for h in hits if h[3] == EXACT])

    def exact(self, doc: Template, text: int, item: Template, number: int, hits: list) -> tuple[int, float, str] | None:
        d0, i0, n = doc.word_first[text], item.word_first[number], int(item.word_count[number])
        covered, by, most = np.zeros(n, bool), defaultdict(set), 0
        for a, b, size, _ in hits:
            by[a - b].update(range(b, b + abs(size)))
        for diagonal, tokens in by.items():
            found = [k for k in sorted(tokens) if item.words[i0 + k] == doc.words[d0 + k + diagonal]]
            covered[found] = True
            most = max(most, longest_run(found))
        return self.verdict(covered, most, True)

    def verdict(self, covered: np.ndarray, most: int, same: bool) -> tuple[int, float, str] | None:
        part = covered.mean() if len(covered) else 0.0
        return (int(covered.sum()), float(part), "verbatim" if same else "reparameterised") if covered.any() and (part >= self.coverage or most >= self.run) else None

    def template(self, doc: Template, text: int, data: np.ndarray, item: Template, number: int, item_data: np.ndarray, hits: list) -> tuple[int, float, str] | None:
        d0, i0, n = doc.first[text], item.first[number], int(item.count[number])
        covered, values, back, same, most = np.zeros(n, bool), {}, {}, True, 0
        by = defaultdict(set)
        for a, b, size, _ in hits:
            by[a - b].add((b, size))
        for diagonal, windows in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
            pairs, void = defaultdict(list), set()
            for k in sorted({k for b, size in windows for k in range(b, b + size)}):
                i, j = i0 + k, d0 + k + diagonal
                if item.canon[i] != doc.canon[j]:
                    void.add(k)
                elif item.kind[i] != LITERAL:
                    v = (int(item.kind[i]), item_data[item.start[i] : item.stop[i]].tobytes().lower())
                    pairs[v, (int(item.kind[i]), data[doc.start[j] : doc.stop[j]].tobytes().lower())].append(k)
            for (v, w), at in sorted(pairs.items(), key=lambda x: (-len(x[1]), x[1])):
                if values.setdefault(v, w) != w or v[0] == NAME and back.setdefault(w, v) != v:
                    void.update(at)  # another value for the same slot
            found = sorted({k for b, size in windows if void.isdisjoint(range(b, b + size)) for k in range(b, b + size)})
            same &= all(v == w for (v, w), at in pairs.items() if not void.issuperset(at))
            covered[found] = True
            most = max(most, longest_run(found))
        return self.verdict(covered, most, same)


_OUT = "doc_id long, item_id long, n_tokens long, coverage double, kind string"
_NAMES = ["doc_id", "item_id", "n_tokens", "coverage", "kind"]


def _leaks(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) if found else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)], names=_NAMES)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``doc_id, item_id, n_tokens, coverage, kind`` of every document (doc_id, text) and benchmark item (item_id, text) that it leaks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).filter("item IS NOT NULL AND item_id IS NOT NULL").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("item")), F.lit(0))).first()
    if chars + 64 * n <= broadcast_chars:
        return _by_broadcast(rows, items, window, literals, coverage).distinct()
    return _by_shuffle(rows, items, window, literals, coverage).distinct()


def _by_broadcast(rows: DataFrame, items: DataFrame, window: int, literals: int, coverage: float) -> DataFrame:
    listed = items.orderBy("item_id", "item").collect()
    ids, texts = [r[0] for r in listed], [r[1] for r in listed]
    wins = item_windows(ids, texts, window, literals)
    tables = {}
    for size in sorted({w[0] for w in wins}):
        h = np.unique(np.array([w[1] for w in wins if w[0] == size], np.uint64))
        tables[size] = HashTable(h, np.arange(len(h), dtype=np.float32) if len(h) < 1 << 24 else np.zeros(len(h), np.float32))
    at = defaultdict(list)
    for size, h, i, k, mode in wins:
        at[size, h].append((i, k, mode))
    shared = rows.sparkSession.sparkContext.broadcast((ids, texts, tables, dict(at)))

    def run(batches):
        ids, texts, tables, at = shared.value
        item_data, forms = item_templates(texts)
        judge = Judge(coverage)
        for b in batches:
            data, ends = joined_texts(b.column(1))
            doc_ids = b.column(0).to_pylist()
            found = []
            for a, z in slices(ends, _BYTES):
                base = ends[a - 1] if a else 0
                part = data[base : ends[z - 1]]
                t = doc_templates(part, ends[a:z] - base)
                hits = defaultdict(list)
                for size, tab in tables.items():
                    for named, o, s, g in doc_windows(t, size):
                        _, hit = tab.get(g)
                        for x, i, h in zip(o[hit].tolist(), s[hit].tolist(), g[hit].tolist(), strict=True):
                            for number, k, mode in at[size, h]:
                                if named == (mode == NAMES):
                                    hits[x, number].append((i, k, size, mode))
                for (o, number), h in hits.items():
                    if said := judge(t, o, part, forms, number, item_data, h):
                        found.append((doc_ids[a + o], ids[number], *said))
            yield _leaks(found)

    return rows.mapInArrow(run, _OUT)


def _bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set."""
    at = (h % np.uint64(BLOOM)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1


def _bloom(windows: DataFrame) -> np.ndarray:
    """A bit for each window hash (column h): BLOOM bits, however many windows there are; the tasks' bits are joined in a few groups before they reach the driver."""

    def bits_of(batches):
        bits = np.zeros(BLOOM >> 3, np.uint8)
        for b in batches:
            at = (b.column(0).to_numpy().view(np.uint64) % np.uint64(BLOOM)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    def either(column) -> np.ndarray:
        out = np.zeros(BLOOM >> 3, np.uint8)
        for x in column.to_pylist():
            out |= np.frombuffer(x, np.uint8)
        return out

    parts = windows.select("h").mapInArrow(bits_of, "bits binary").groupBy(F.pmod(F.spark_partition_id(), F.lit(8)).alias("g"))
    return either(parts.applyInArrow(lambda t: pa.table({"bits": pa.array([either(t.column("bits")).tobytes()], pa.binary())}), "bits binary").toArrow().column(0))


def _by_shuffle(rows: DataFrame, items: DataFrame, window: int, literals: int, coverage: float) -> DataFrame:
    """The same for a benchmark of any size: windows of both sides meet by hash; what an item's windows hit in a document is judged with both texts at hand."""
    from quire.llm.common import written

    rows, items = rows.withColumn("tk", F.xxhash64("text")), items.withColumn("ik", F.xxhash64("item"))

    def of_items(batches):
        for b in batches:
            ids, keys, texts = (c.to_pylist() for c in b.columns)
            w = item_windows(ids, texts, window, literals)
            yield pa.RecordBatch.from_arrays([pa.array([ids[x[2]] for x in w], pa.int64()), pa.array([keys[x[2]] for x in w], pa.int64()), pa.array([x[0] for x in w], pa.int32()), pa.array(np.array([x[1] for x in w], np.uint64).view(np.int64)), pa.array([x[3] for x in w], pa.int32()), pa.array([x[4] for x in w], pa.int32())], names=["item_id", "ik", "size", "h", "k", "mode"])

    def of_docs(batches):
        for b in batches:
            data, ends = joined_texts(b.column(2))
            ids, keys = b.column(0), b.column(1)
            for a, z in slices(ends, _BYTES):
                base = ends[a - 1] if a else 0
                t = doc_templates(data[base : ends[z - 1]], ends[a:z] - base)
                sizes, bits = shared.value
                for size in sizes:
                    for named, o, s, g in doc_windows(t, size):
                        there = np.flatnonzero(_bit(bits, g))
                        o, s, g = o[there], s[there], g[there]
                        take = pa.array(o + a)
                        yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(np.full(len(s), size, np.int32)), pa.array(g.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(np.full(len(s), named))], names=["doc_id", "tk", "size", "h", "at", "named"])

    iw = items.select("item_id", "ik", "item").mapInArrow(of_items, "item_id long, ik long, size int, h long, k int, mode int").distinct()
    iw = written(iw.withColumn("named", F.col("mode") == NAMES), "item-windows")
    shared = rows.sparkSession.sparkContext.broadcast((sorted(r[0] for r in iw.select("size").distinct().collect()), _bloom(iw)))
    dw = rows.select("doc_id", "tk", "text").mapInArrow(of_docs, "doc_id long, tk long, size int, h long, at int, named boolean").distinct()
    met = dw.join(iw, ["size", "h", "named"]).groupBy("doc_id", "tk", "item_id", "ik").agg(F.collect_list(F.struct("at", "k", "size", "mode")).alias("hits"))
    both = met.join(rows.select(F.col("doc_id").alias("d2"), "tk", "text").distinct(), (F.col("d2").eqNullSafe(F.col("doc_id"))) & (met.tk == rows.tk)).join(items.select(F.col("item_id"), "ik", "item"), ["item_id", "ik"])

    def run(batches):
        judge = Judge(coverage)
        for b in batches:
            found = []
            for d, i, text, item, hits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, (item_data, forms) = joined_texts(pa.array([text])), item_templates([item])
                if said := judge(doc_templates(*x), 0, x[0], forms, 0, item_data, [(h["at"], h["k"], h["size"], h["mode"]) for h in hits]):
                    found.append((d, i, *said))
            yield _leaks(found)

    return both.select("doc_id", "item_id", "text", "item", "hits").mapInArrow(run, _OUT)


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaks of benchmark items: doc_id, item_id, n_tokens, coverage, kind."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
