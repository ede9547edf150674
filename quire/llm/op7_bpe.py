"""BPE encoding and decoding by tree concatenation.

A text is cut at white space, where no token of the vocabulary can cross; a piece that the pre-tokeniser leaves unsplit and that is longer than
``leaf`` symbols is halved again and again, its fragments are encoded independently (as rows of their own when the piece is longer than ``segment``), and
neighbouring results are joined by re-encoding a window around the join. The window grows until its first token is the left side's and its last token is
the right side's. Adjacent tokens of a valid BPE encoding are a valid encoding of their own text, and a sequence all of whose adjacent pairs are valid is
the encoding; so agreement on both sides proves the join exact.

Defined results: a null text counts as empty; an empty text has no token and the hash of the empty string; repeated rows give repeated results; a null
doc_id stays null; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table

#: Characters of a text from which its parts become rows of their own, so that a task holds parts of it only.
SEGMENT = 1 << 15
#: Symbols of an unsplit piece that are encoded at once; longer ones are halved.
LEAF = 64
#: Entries of a worker's memory of encoded pieces; beyond it, the memory starts anew.
MEMORY = 250_000

_PLAIN = re.compile(r"[A-Za-z]+").fullmatch
_ODD = re.compile("[\x1c-\x1f]").search
_ASCII = re.compile(r"[ \t\n\x0b\x0c\r]+")


def pieces_of(text: str) -> list[str]:
    """The parts of a text between white space. str.split() also splits at U+001C to U+001F, which are no white space to the tokeniser."""
    return [p for p in _ASCII.split(text) if p] if _ODD(text) else text.split()


class TreeEncoder:
    """Encodes pieces with the tokenizers library's normaliser, pre-tokeniser and BPE model, joining long unsplit ones as a tree."""

    def __init__(self, source: str, leaf: int = LEAF, memory: int = MEMORY):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        import json

        self.tokenizer, spec = Tokenizer.from_str(source), json.loads(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = spec["model"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.whole, self.part = self.tokenizer.model, BPE(vocab=model["vocab"], merges=pairs)
        self.names = {i: s for s, i in model["vocab"].items()}
        added = spec.get("added_tokens") or []
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) for a in added):
            raise ValueError("added tokens must be plain strings without white space, matched before normalisation")
        self.special = {a["content"]: a["id"] for a in added}
        self.names |= {i: s for s, i in self.special.items()}
        self.find = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.lower = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        self.leaf, self.limit, self.memory = leaf, memory, {}

    def symbols(self, piece: str) -> list[str]:
        """The pre-tokens of a piece, in the byte-level alphabet."""
        return [s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece))]

    def fragment(self, s: str, last: bool) -> list[int]:
        """One fragment at once; only the last one of a pre-token carries the end-of-word suffix."""
        return [t.id for t in (self.whole if last else self.part).tokenize(s)] if s else []

    def text_of(self, ids: list[int]) -> str:
        s = "".join(map(self.names.__getitem__, ids))
        return s.removesuffix(self.suffix) if self.suffix else s

    def join(self, a: list[int], b: list[int], last: bool) -> list[int]:
        """Two adjacent encodings as one: a window around the join grows until both sides agree."""
        k = 1
        while a and b:
            left, right = a[-k:], b[:k]
            w = self.fragment(self.text_of(left) + self.text_of(right), last and k >= len(b))
            if (k >= len(a) or w[0] == left[0]) and (k >= len(b) or w[-1] == right[-1]):
                return a[:-k] + w + b[k:]
            k *= 2
        return a + b

    def tree(self, parts: list[list[int]], last: bool) -> list[int]:
        """Neighbouring parts of one pre-token joined pairwise, level by level."""
        while len(parts) > 1:
            n = len(parts)
            parts = [self.join(parts[i], parts[i + 1], last and i + 2 >= n) if i + 1 < n else parts[i] for i in range(0, n, 2)]
        return parts[0] if parts else []

    def halves(self, s: str) -> list[str]:
        if len(s) <= self.leaf:
            return [s]
        return self.halves(s[: len(s) // 2]) + self.halves(s[len(s) // 2 :])

    def pretoken(self, s: str, last: bool = True) -> list[int]:
        if len(s) <= self.leaf:
            return self.fragment(s, last)
        f = self.halves(s)
        return self.tree([self.fragment(x, last and i + 1 == len(f)) for i, x in enumerate(f)], last)

    def plain(self, piece: str) -> list[int]:
        """A piece without added tokens."""
        if self.lower and _PLAIN(piece):  # ASCII letters: one pre-token, itself in the byte-level alphabet
            return self.pretoken(piece.lower())
        out: list[int] = []
        for s in self.symbols(piece):
            out += self.pretoken(s)
        return out

    def encode_piece(self, piece: str) -> list[int]:
        if self.find is None or "<" not in piece and not self.find.search(piece):
            return self.plain(piece)
        out, at = [], 0
        for m in self.find.finditer(piece):
            out += self.plain(piece[at : m.start()]) if m.start() > at else []
            out.append(self.special[m[0]])
            at = m.end()
        return out + (self.plain(piece[at:]) if at < len(piece) else [])

    def encode(self, text: str) -> list[int]:
        """All ids of a text, in this process."""
        out: list[int] = []
        for p in pieces_of(text):
            out += self.encode_piece(p)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def known(self, piece: str) -> tuple[list[int], str, str]:
        """Ids of a piece, also as text and as token names, kept in memory."""
        if len(self.memory) >= self.limit:
            self.memory.clear()
        ids = self.encode_piece(piece)
        out = self.memory[piece] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return out


_ENCODERS: dict[tuple, TreeEncoder] = {}


def encoder(source: str, leaf: int) -> TreeEncoder:
    """One encoder a worker, kept between tasks."""
    key = (hash(source), leaf)
    if key not in _ENCODERS:
        _ENCODERS[key] = TreeEncoder(source, leaf)
    return _ENCODERS[key]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _digest(enc: TreeEncoder, text: str, spaced: bool) -> tuple[int, str, str]:
    """Token count and the two hashes of a short text from remembered pieces. ``spaced``: the library decodes by joining token names with spaces."""
    parts = pieces_of(text)
    if not spaced:
        ids = enc.encode(text)
        return len(ids), _sha(" ".join(map(str, ids))), _sha(enc.decode(ids))
    got, know = enc.memory.get, enc.known
    found = [got(p) or know(p) for p in parts]
    found = [f for f in found if f[0]]
    return sum([f[0] for f in found]), _sha(" ".join([f[1] for f in found])), _sha(" ".join([f[2] for f in found]))


def _longest(text: str) -> int:
    return max(map(len, pieces_of(text)), default=0)


def segments(enc: TreeEncoder, text: str, size: int) -> Iterator[tuple[int, str]]:
    """A long text as parts of about ``size``: 0 a run of pieces; 1 and 2 a fragment, 2 the last, of an unsplit pre-token; 3 an added token's id; 4 short pre-tokens."""
    run, n = [], 0
    for piece in pieces_of(text):
        if len(piece) <= size:
            run.append(piece)
            n += len(piece) + 1
            if n < size:
                continue
        if run:
            yield 0, " ".join(run)
            run, n = [], 0
        if len(piece) > size:
            at, spans = 0, []
            for m in enc.find.finditer(piece) if enc.find else ():
                spans += [(False, piece[at : m.start()]), (True, m[0])]
                at = m.end()
            few, k = [], 0
            for special, s in [*spans, (False, piece[at:])]:
                for t in [s] if special else enc.symbols(s) if s else []:
                    if not special and len(t) <= size:
                        few.append(t)
                        k += len(t)
                        if k < size:
                            continue
                    if few:
                        yield 4, " ".join(few)
                        few, k = [], 0
                    if special:
                        yield 3, str(enc.special[t])
                    elif len(t) > size:
                        cut = [t[i : i + size] for i in range(0, len(t), size)]
                        yield from ((2 if i + 1 == len(cut) else 1, c) for i, c in enumerate(cut))
            if few:
                yield 4, " ".join(few)
    if run:
        yield 0, " ".join(run)


def encode_documents(docs: DataFrame, source: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, leaf: int = LEAF, digests: bool = False) -> DataFrame:
    """Ids of every text: ``doc_id, n_tokens, ids array<int>, decoded string``; with ``digests`` the hashes of the last two instead.

    ``source`` is the tokeniser's JSON text (bounded by the vocabulary). Texts of up to ``segment`` characters are encoded where they are read. Longer ones
    become rows of their parts, dealt evenly, encoded in parallel and joined again by document.
    """
    spark = docs.sparkSession
    if len(source) > 64 << 20:
        raise ValueError("a vocabulary file of more than 64 MB is not broadcast")
    vocab = spark.sparkContext.broadcast(source)
    import json

    spaced = json.loads(source).get("decoder") is None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tail = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.list_(pa.int32()), pa.string()]
    schema = pa.schema([("doc_id", pa.int64()), *zip(re.findall(r"(\w+) (?:long|string|array<int>)", tail), types, strict=True)])

    def answer(enc: TreeEncoder, ids: list[int]) -> tuple:
        text = enc.decode(ids)
        return (len(ids), _sha(" ".join(map(str, ids))), _sha(text)) if digests else (len(ids), ids, text)

    def short(batches):
        enc = encoder(vocab.value, leaf)
        for b in batches:
            out = [_digest(enc, t, spaced) if digests else answer(enc, enc.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], schema.types[i + 1]) for i in range(3))], schema=schema)

    part_schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("seg", pa.int64()), ("kind", pa.int32()), ("part", pa.string())])

    def cut(batches):
        enc = encoder(vocab.value, leaf)
        for b in batches:
            for i, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = list(segments(enc, t, segment)) or [(0, "")]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array([k] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found])], schema=part_schema)

    ids_schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("seg", pa.int64()), ("kind", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def encode_parts(batches):
        enc = encoder(vocab.value, leaf)
        do: dict[int, Callable] = {0: enc.encode, 1: lambda s: enc.pretoken(s, False), 2: enc.pretoken, 3: lambda s: [int(s)], 4: lambda s: [i for t in s.split(" ") if t for i in enc.pretoken(t)]}
        for b in batches:
            ids = [do[k](s) for k, s in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.list_(pa.int32()))], schema=ids_schema)

    def put_together(t: pa.Table) -> pa.Table:
        enc = encoder(vocab.value, leaf)
        rows = sorted(zip(t.column("seg").to_pylist(), t.column("kind").to_pylist(), t.column("ids").to_pylist(), strict=True), key=lambda r: r[0])
        times = sum(r[0] == 0 for r in rows)  # repeated rows
        out, open_ = [], []
        for _, kind, ids in rows[::times]:
            if kind in (1, 2):
                open_.append(ids)
                if kind == 2:
                    out += enc.tree(open_, True)
                    open_ = []
            else:
                out += ids
        a = answer(enc, out)
        return pa.Table.from_arrays([pa.array([t.column("doc_id")[0].as_py()] * times, pa.int64()), *(pa.array([a[i]] * times, schema.types[i + 1]) for i in range(3))], schema=schema)

    few = rows.filter(F.length("text") <= segment).mapInArrow(short, f"doc_id long, {tail}")
    parts = rows.filter(F.length("text") > segment).select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(cut, "doc_id long, text_key long, seg long, kind int, part string")
    many = (
        parts.repartition("doc_id", "text_key", "seg")
        .mapInArrow(encode_parts, "doc_id long, text_key long, seg long, kind int, ids array<int>")
        .groupBy("doc_id", "text_key")
        .applyInArrow(put_together, f"doc_id long, {tail}")
    )
    return few.unionByName(many)


def tokenizer_source(path: str | None = None) -> str:
    """The JSON text of a tokeniser file; by default that of the public word-level BPE vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_source(), digests=True)
