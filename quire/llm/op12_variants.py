"""Spelling variants: words one edit apart, and the commoner spelling each may stand for.

One edit leaves one half of a word whole: the first at the start of the other word, or the second at its end. Automaton shards (Aho-Corasick) hold the halves of all
words; every word is scanned by the shards whose halves begin or end as it does, and a half that is met counts if it lies at the start or the end and if the lengths
differ by one at most. What is left is verified: a few words with one half by comparison, many through an index of their remainders with one code point left
out, which finds those one edit away without meeting the others.

Words are counted where texts are read, and summed by word. A shard of more than SHARD words is split by a hash of the word; scanned words then visit all its parts.
Every visit answers with one row a word (how many near words, the best of them), so pairs are never written out.

Defined results: a null text has no words; a null doc_id counts as the empty string in the hash; repeated rows count again; a table without frequent words gives no
rows; other columns are ignored. Among near words of equal count the first in code-point order is the form.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import partitions, table, written

RUN = re.compile("[a-zÀ-ÿ]+")
#: Code points and occurrences that a word needs at least.
LEAST, OFTEN = 5, 3
#: One in NOISE occurrences loses a code point.
NOISE = 97
#: Words of a shard; words that a task counts before it hands them on.
SHARD, HELD = 100_000, 300_000
#: Code points of a half that the automaton holds; the rest of it is verified.
DEPTH = 64
#: Code points of a half by which it is dealt to a shard.
KEY = 4
#: Words with one half that are compared one by one; code points of a remainder that is indexed.
FEW, SHORT = 8, 64


# --- words -----------------------------------------------------------------------------------------------------------------------------


def counted_words(docs: DataFrame, least: int = LEAST, noise: int = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words of ``least`` code points. Texts are met one at a time; a task hands on its sums."""

    def run(batches):
        total: Counter[str] = Counter()
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                if not t.is_valid:
                    continue
                i = i.as_py()
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, c in Counter(RUN.findall(t.as_buffer().to_pybytes().lower().decode())).items():
                    if len(w) < least:
                        continue
                    h = zlib.crc32(w.encode(), seed)
                    if h % noise == 0:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                        if len(w) < least:
                            continue
                    total[w] += c
                if len(total) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- halves ----------------------------------------------------------------------------------------------------------------------------


def first_difference(a: str, b: str) -> int:
    """The length of the common beginning."""
    n = min(len(a), len(b))
    if n > 32:
        low, high = 0, n  # a[:low] == b[:low]
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
        return low
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def one_edit(a: str, b: str) -> bool:
    """Whether one code point is inserted, deleted or replaced."""
    d = len(a) - len(b)
    if not -1 <= d <= 1 or a == b:
        return False
    i = first_difference(a, b)
    return a[i + 1 :] == b[i + 1 :] if d == 0 else a[i + 1 :] == b[i:] if d == 1 else a[i:] == b[i + 1 :]


def left_out(s: str) -> set[str]:
    """A remainder, and all that is left of it without one code point."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


class Halves:
    """One shard: an automaton over the first or the second halves of its words."""

    def __init__(self, words: list[str], counts: list[int], first: bool):
        import ahocorasick

        self.words, self.counts, self.first = words, counts, first
        ids: dict[str, int] = {}
        self.groups: list[list[int]] = []
        for i, w in enumerate(words):
            s = self.half(w)
            at = ids.setdefault(s, len(ids))
            if at == len(self.groups):
                self.groups.append([])
            self.groups[at].append(i)
        self.sizes = list(map(len, ids))
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.indexes: dict[int, tuple[dict[str, list[int]], list[int]]] = {}

    def half(self, word: str) -> str:
        return word[: min(len(word) // 2, DEPTH)] if self.first else word[len(word) // 2 :][-DEPTH:]

    def _rest(self, word: str, size: int) -> str:
        return word[size:] if self.first else word[: len(word) - size]

    def _index(self, group: int) -> tuple[dict[str, list[int]], list[int]]:
        """Words with one half by what is left of their remainders; those with long remainders apart."""
        found = self.indexes.get(group)
        if found is None:
            by, long = defaultdict(list), []
            for i in self.groups[group]:
                rest = self._rest(self.words[i], self.sizes[group])
                if len(rest) > SHORT:
                    long.append(i)
                else:
                    for s in left_out(rest):
                        by[s].append(i)
            found = self.indexes[group] = dict(by), long
        return found

    def near(self, word: str) -> Iterator[int]:
        """The shard's words one edit away that share this half with ``word`` (for second halves: and not the first)."""
        n, words = len(word), self.words
        for end, group in self.automaton.iter(word) if words else ():
            size = self.sizes[group]
            if (end + 1 != size) if self.first else (end + 1 != n):
                continue
            members = self.groups[group]
            if len(members) > FEW:
                by, long = self._index(group)
                rest = self._rest(word, size)
                some = set(long)
                if len(rest) <= SHORT + 1:
                    for s in left_out(rest):
                        some.update(by.get(s, ()))
                members = some
            for i in members:
                w = words[i]
                if -1 <= len(w) - n <= 1 and one_edit(word, w) and (self.first or not word.startswith(w[: min(len(w) // 2, DEPTH)])):
                    yield i

    def best(self, word: str) -> tuple[int, int, str] | None:
        """How many near words, and the commonest of them."""
        found = list(self.near(word))
        if not found:
            return None
        n, w = min((-self.counts[i], self.words[i]) for i in found)
        return len(found), -n, w


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("m", pa.int64()), ("form", pa.string())])


def near_words(vocabulary: DataFrame, shard: int = SHARD) -> DataFrame:
    """``word, n_near, m, form`` of every word of ``vocabulary`` (word, n; distinct words) that has near words: their number, the largest count, and the first such word."""
    spark = vocabulary.sparkSession
    n = max(1, math.ceil(2 * vocabulary.count() / shard), partitions(spark))
    size = F.length("word")

    def shards(first: bool, longer: int):
        """Where the halves of a word of ``longer`` more code points lie that begins (ends) like this one."""
        half = F.floor((size + longer) / 2) if first else size + longer - F.floor((size + longer) / 2)
        start = F.least(half, F.lit(KEY)).cast("int")
        return F.pmod(F.xxhash64(F.lit(first), F.substring("word", F.lit(1), start) if first else F.substring("word", size - start + 1, start)), F.lit(n))

    sides = vocabulary.select("word", "n", F.explode(F.array(*(F.struct(F.lit(first).alias("first"), shards(first, 0).alias("home"), F.array_distinct(F.array(*(shards(first, d) for d in (0, -1, 1)))).alias("shards")) for first in (True, False)))).alias("s"))
    sides = sides.select("word", "n", "s.first", "s.home", F.explode("s.shards").alias("shard"))
    heavy = written(sides.filter("shard = home").groupBy("first", "shard").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > shard).select("first", "shard", F.ceil(F.col("c") / shard).cast("int").alias("parts")), "heavy")
    dealt = (
        sides.join(heavy, ["first", "shard"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("first", "shard", "part", "word", "n", ((F.col("shard") == F.col("home")) & (F.col("part") == F.col("own"))).alias("held"))
    )

    def answers(rows: list[str], halves: Halves):
        found = [(w, *a) for w in rows if (a := halves.best(w))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _NEAR, strict=True)], schema=_NEAR)

    def run(batches):
        at, words, counts, halves = None, [], [], None
        for b in batches:
            passing: list[str] = []
            for first, number, part, word, k, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (first, number, part) != at:
                    if at is not None:
                        halves = halves or Halves(words, counts, at[0])
                        yield from answers(passing, halves)
                        yield from answers(words, halves)
                    at, words, counts, halves, passing = (first, number, part), [], [], None, []
                if held:
                    words.append(word)
                    counts.append(k)
                else:
                    halves = halves or Halves(words, counts, first)
                    passing.append(word)
            if passing:
                yield from answers(passing, halves)
        if at is not None:
            yield from answers(words, halves or Halves(words, counts, at[0]))

    sharded = dealt.repartition(n, "first", "shard", "part").sortWithinPartitions("first", "shard", "part", F.col("held").desc())
    parts = sharded.mapInArrow(run, "word string, n_near long, m long, form string")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "form")).alias("b")).select("word", "n_near", (-F.col("b.m")).alias("m"), F.col("b.form").alias("form"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """``word, root`` of every row of ``forms`` (word, form), by doubling: counts at least double from word to form, so a chain up to a count of ``most`` is short."""
    t = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(1, math.ceil(math.log2(max(2, math.log2(max(2, most)))))) + 1):
        a, b = t.select("word", "root"), t.select(F.col("word").alias("root"), F.col("root").alias("further"))
        t = written(a.join(b, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if t.filter("moved").isEmpty():
            break
    return t.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, noise: int = NOISE, shard: int = SHARD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``least`` code points and ``often`` occurrences."""
    vocabulary = written(counted_words(docs, least, noise).filter(F.col("n") >= often), "vocabulary")
    near = near_words(vocabulary, shard)
    formed = F.col("m") >= 2 * F.col("n")
    rows = written(
        vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("m")).alias("form_n")), "variants"
    )
    most = rows.agg(F.max("n")).first()[0] or 1
    found = roots(rows.filter("form IS NOT NULL"), most)
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its near words: word, form, root, n, n_near, form_n."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _crc_table() -> list[int]:
    out = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


_UPPER = "".join(map(chr, range(65, 91)))
ORACLE = f"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
r AS (SELECT doc_id, translate(w, '{_UPPER}', '{_UPPER.lower()}') AS w, count(*) AS c FROM o WHERE length(w) >= {LEAST} GROUP BY ALL),
b AS (SELECT w, c, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END))) AS bytes FROM r),
h AS (SELECT w, c, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, ({_crc_table()}::BIGINT[])[1 + (xor(a, x) & 255)])), 4294967295) AS h FROM b),
d AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(c) >= {OFTEN}),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
s AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS k FROM i),
e AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS k FROM i),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM s a JOIN s b ON a.k = b.k AND a.word <> b.word UNION SELECT e.word, v.word, v.n FROM e JOIN v ON v.word = e.k UNION SELECT v.word, e.word, e.n FROM e JOIN v ON v.word = e.k),
q AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
f AS (SELECT q.word, q.n_near, q.m, min(p.near) AS form FROM q JOIN p ON p.word = q.word AND p.m = q.m GROUP BY ALL),
g AS (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.m >= 2 * v.n THEN f.form END AS form, CASE WHEN f.m >= 2 * v.n THEN f.m END AS form_n FROM v LEFT JOIN f ON f.word = v.word),
t AS (SELECT word, word AS root FROM g WHERE form IS NULL UNION ALL SELECT g.word, t.root FROM g JOIN t ON g.form = t.word)
SELECT g.word, g.form, t.root, g.n, CAST(g.n_near AS BIGINT) AS n_near, g.form_n FROM g JOIN t ON t.word = g.word
"""
