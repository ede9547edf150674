"""Token ids as binary files of patched frame-of-reference blocks.

Every text is encoded by the tokenizers library, an end id is appended, and the ids of all documents follow one another in ascending doc_id order. A file holds
blocks of BLOCK ids. A block keeps its minimum; the differences are packed at the bit width that PERCENTILE of them fit; the others are exceptions, whose
positions and high bits follow in a list. An index at the end of the file has the place of every block and the first id of every document, so that a range of
ids is read from its own blocks alone.

Documents are dealt to files by ranges of doc_id; a file is written as a stream, one block at a time, and named anew by every attempt of a task. The manifest, a
Parquet table that Spark commits, lists the files that count, so a lost executor leaves unlisted files and nothing else. Offsets across files come from the manifest,
which has one row a file of up to FILE_IDS ids.

A text is cut where the pre-tokeniser always cuts (around runs of letters or digits, before white space), so that a worker encodes a frequent piece once.

Defined results: a null text counts as empty; an empty text is the end id alone; a null doc_id comes first and stays null; rows with one doc_id are ordered by a hash
of their text, then by the text, and repeated rows follow one another; an empty table gives an empty manifest and no file; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import partitions, shared_dir, table, written

BLOCK = 8192
PERCENTILE = 0.95
#: Ids and documents of a file from which the next document begins a new one.
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 22
#: Words that a worker remembers in each of two generations, of up to LONG characters.
MEMORY, LONG = 500_000, 48
#: Characters of a text that are cut into pieces at once, bytes of texts that are met at once.
STRETCH, BYTES = 1 << 20, 1 << 22

MAGIC = b"QPF1"
_HEAD = struct.Struct("<IHHBB")  # minimum, ids less one, exceptions, width, width of the exceptions' high bits
_TAIL = struct.Struct("<QQQQ4s")  # blocks, documents, ids, place of the index, magic


# --- blocks ----------------------------------------------------------------------------------------------------------------------------


def _packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of unsigned 32-bit values, one after another."""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(len(values), 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def _unpacked(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    """``n`` values from ``at``, and where they end."""
    size = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32), at + size


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of 1 to 65,536 unsigned 32-bit ids."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n, low = len(ids), ids.min()
    rest = ids - low
    k = min(n - 1, int(n * percentile))
    width = int(np.partition(rest, k)[k]).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros(n, np.uint32)
    odd = np.flatnonzero(high)
    if len(odd) > 65535:
        width, odd = int(rest.max()).bit_length(), odd[:0]
    above = int(high[odd].max()).bit_length() if len(odd) else 0
    return b"".join([_HEAD.pack(int(low), n - 1, len(odd), width, above), _packed(rest, width), odd.astype("<u2").tobytes(), _packed(high[odd], above)])


def unpack_block(data: bytes) -> np.ndarray:
    """The ids of a block."""
    low, n, odd, width, above = _HEAD.unpack_from(data)
    rest, at = _unpacked(data, _HEAD.size, n + 1, width)
    if odd:
        where = np.frombuffer(data, "<u2", odd, at)
        rest[where] |= _unpacked(data, at + 2 * odd, odd, above)[0] << np.uint32(width)
    return rest + np.uint32(low)


# --- files -----------------------------------------------------------------------------------------------------------------------------


def _opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


class FileWriter:
    """Writes one file as a stream; it holds a block of ids and the index."""

    def __init__(self, path: str, block: int = BLOCK, percentile: float = PERCENTILE):
        system, where = _opened(path)
        self.path, self.out, self.block, self.percentile = path, system.open_output_stream(where), block, percentile
        self.out.write(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.at, self.blocks, self.docs, self.missing, self.starts = len(MAGIC), [], [], [], []

    def add(self, doc_id: int | None, parts: Iterator[np.ndarray]) -> None:
        """One document's ids, in parts."""
        self.docs.append(doc_id or 0)
        self.missing.append(doc_id is None)
        self.starts.append(self.n_ids)
        for ids in parts:
            self.n_ids += len(ids)
            self.held.append(ids)
            self.n_held += len(ids)
            if self.n_held >= self.block:
                self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            data = pack_block(ids[i : min(i + self.block, whole)], self.percentile)
            self.out.write(data)
            self.blocks.append(self.at)
            self.at += len(data)
        self.held = [ids[whole:]]
        self.n_held = len(ids) - whole

    def close(self) -> tuple[str, int, int, int]:
        """Path, documents, ids and bytes."""
        self._blocks(True)
        body = b"".join(
            [np.array([*self.blocks, self.at], "<u8").tobytes(), np.array(self.docs, "<i8").tobytes(), np.array(self.missing, np.uint8).tobytes(), np.array([*self.starts, self.n_ids], "<u8").tobytes()]
        )
        self.out.write(body + _TAIL.pack(len(self.blocks), len(self.docs), self.n_ids, self.at, MAGIC))
        self.out.close()
        return self.path, len(self.docs), self.n_ids, self.at + len(body) + _TAIL.size


class FileReader:
    """Reads a file's index at once and its blocks on demand."""

    def __init__(self, path: str):
        system, where = _opened(path)
        self.file = system.open_input_file(where)
        size = self.file.size()
        tail = self.file.read_at(_TAIL.size, size - _TAIL.size) if size >= _TAIL.size + len(MAGIC) else b"\0" * _TAIL.size
        n_blocks, n_docs, self.n_ids, at, magic = _TAIL.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        body = self.file.read_at(size - _TAIL.size - at, at)
        self.blocks = np.frombuffer(body, "<u8", n_blocks + 1)
        self.docs = np.frombuffer(body, "<i8", n_docs, 8 * (n_blocks + 1))
        self.missing = np.frombuffer(body, np.uint8, n_docs, 8 * (n_blocks + 1 + n_docs)).astype(bool)
        self.starts = np.frombuffer(body, "<u8", n_docs + 1, 8 * (n_blocks + 1 + n_docs) + n_docs)
        self.block = _HEAD.unpack(self.file.read_at(_HEAD.size, int(self.blocks[0])))[1] + 1 if n_blocks else 0

    def _block(self, i: int) -> np.ndarray:
        a, z = int(self.blocks[i]), int(self.blocks[i + 1])
        return unpack_block(self.file.read_at(z - a, a))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """A range of ids; only its blocks are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = start // self.block
        got = np.concatenate([self._block(i) for i in range(first, (stop - 1) // self.block + 1)])
        return got[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, first id, ids and their crc32 of each document, in one pass over the blocks; memory holds one block."""
        starts, doc, crc = self.starts.astype(np.int64), 0, 0
        name = lambda i: None if self.missing[i] else int(self.docs[i])
        for i in range(len(self.blocks) - 1):
            ids = self._block(i).astype("<u4", copy=False)
            low = i * self.block
            while doc < len(self.docs) and starts[doc] < low + len(ids):
                a, z = max(int(starts[doc]) - low, 0), int(starts[doc + 1]) - low
                crc = zlib.crc32(ids[a : min(z, len(ids))].tobytes(), crc)
                if z > len(ids):
                    break
                yield name(doc), int(starts[doc]), z + low - int(starts[doc]), crc
                doc, crc = doc + 1, 0

    def close(self) -> None:
        self.file.close()


# --- encoding --------------------------------------------------------------------------------------------------------------------------

# Letters and digits of the first alternative are so for every version of Unicode; what follows them is neither, so the pre-tokeniser cuts there. Marks before white
# space end their run, a lone line feed before a letter is a piece of its own. All else runs up to such a place.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_IDEOGRAMS = "一-鿿ぁ-ゖァ-ヺ"
PIECE = re.compile(
    rf" ?(?:[{_LETTERS}]+(?![^\W\d_])|[0-9]+(?!\w))|[.,;:!?]+(?=[ \n])|\n(?=[{_LETTERS}])|.+?(?:(?<=[^\W_])(?=[ \n])|(?<=[.,;:!?)\]}}\"'-])(?=[ \n])|(?<=[{_IDEOGRAMS}])(?=[。，、！？]))|.+", re.DOTALL
)
_WORD = re.compile(rf" ?(?:[{_LETTERS}]+|[0-9]+)").fullmatch
_STOP = re.compile(r"(?<=[A-Za-z0-9])(?= )")
#: White space before a space; elsewhere the pre-tokeniser cuts before every space.
_DOUBLE = re.compile(r"[\s\x1c-\x1f\x85] ").search


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PieceEncoder:
    """The tokenizers library's ids of texts, by words and pieces of words; what was seen is remembered in two generations, so that a full memory never forgets all."""

    def __init__(self, source: str, memory: int = MEMORY):
        from tokenizers import Tokenizer
        import json

        spec = json.loads(source)
        before = spec.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError("the tokeniser must split by the byte-level pattern, without a prefix space, a normaliser or a post-processor")
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) or a["content"].isalnum() for a in spec.get("added_tokens") or []):
            raise ValueError("added tokens must be plain strings with marks and without white space, matched before all else")
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.alphabet = self.tokenizer.model, dict(enumerate(_byte_alphabet()))
        self.space = self.alphabet[32]
        self.limit, self.new, self.old, self.bare = memory, {}, {}, {}

    def _encoded(self, piece: str) -> bytes:
        if _WORD(piece):  # one pre-token
            ids = [t.id for t in self.model.tokenize(piece.replace(" ", self.space) if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet))]
        else:
            ids = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        """One piece of a text. Those with a leading space are remembered without it."""
        if piece[0] == " ":
            word = piece[1:]
            got = self.new.get(word)
            if got is None:
                got = self.old.get(word)
                if got is None:
                    got = self._encoded(piece)
                self._keep(word, got)
            return got
        got = self.bare.get(piece)
        if got is None:
            got = self._encoded(piece)
            if len(piece) <= LONG:
                if len(self.bare) >= self.limit // 4:
                    self.bare.clear()
                self.bare[piece] = got
        return got

    def _keep(self, word: str, got: bytes) -> None:
        if len(word) <= LONG:
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[word] = got

    def _word(self, word: str) -> bytes:
        """A space and what follows up to the next one, if the new generation lacks it."""
        got = self.old.get(word)
        if got is None:
            pieces = PIECE.findall(" " + word)
            got = self._encoded(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece, pieces))
        self._keep(word, got)
        return got

    def _stretch(self, text: str) -> bytes:
        if _DOUBLE(text):
            return b"".join(map(self._piece, PIECE.findall(text)))
        first, *words = text.split(" ")
        missing = self._word
        head = b"".join(map(self._piece, PIECE.findall(first))) if first else b""
        # Memory may be renewed on the way, so that it is looked up anew for every word.
        return head + b"".join([self.new.get(w) or missing(w) for w in words])

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, a stretch at a time."""
        at, n = 0, len(text)
        while at < n:
            z = n
            if n - at > STRETCH and (m := _STOP.search(text, at + STRETCH)):
                z = m.start()
            yield np.frombuffer(self._stretch(text[at:z] if at or z < n else text), "<u4")
            at = z


_ENCODERS: dict[int, PieceEncoder] = {}


def encoder(source: str) -> PieceEncoder:
    """One encoder a worker, kept between tasks."""
    key = hash(source)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(source)
    return _ENCODERS[key]


# --- jobs ------------------------------------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, source: str, path: str, end_id: int = 0, files: int | None = None, block: int = BLOCK, percentile: float = PERCENTILE, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes all documents in ascending doc_id order into files under ``path`` (a folder that driver and executors share).

    Returns the manifest, in no particular order of its rows: part, seq (the files' order), path, n_docs, n_ids, n_bytes. Texts are shuffled once, by ranges of
    doc_id; ``files`` is the number of ranges (by default Spark's number of shuffle partitions).
    """
    spark = docs.sparkSession
    if len(source) > 64 << 20:
        raise ValueError("a vocabulary file of more than 64 MB is not broadcast")
    vocab = spark.sparkContext.broadcast(source)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    dealt = rows.repartitionByRange(files or partitions(spark), "doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    end = np.array([end_id], "<u4")

    def run(batches):
        enc, part, seq, out, done = encoder(vocab.value), TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                if out is None:
                    out = FileWriter(f"{path}/ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.qpf", block, percentile)
                out.add(i.as_py(), (*enc.parts(text.as_py()), end) if len(text.as_py()) <= STRETCH else _chained(enc.parts(text.as_py()), end))
                if out.n_ids >= file_ids or len(out.docs) >= FILE_DOCS:
                    done.append((part, seq, *out.close()))
                    out, seq = None, seq + 1
        if out is not None:
            done.append((part, seq, *out.close()))
        yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, d, strict=True)) for d in done], schema=_MANIFEST)

    system, where = _opened(path)
    system.create_dir(where, recursive=True)
    return written(dealt.select("doc_id", "text").mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"), "token-files")


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _chained(parts: Iterator[np.ndarray], end: np.ndarray) -> Iterator[np.ndarray]:
    yield from parts
    yield end


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone; ``start`` counts the ids of all files before.

    The driver sees one short row a file. Each file is read by one task, a block at a time.
    """
    files, before, listed = manifest.select("part", "seq", "path", "n_ids").collect(), 0, []
    for f in sorted(files):
        listed.append((f.path, before))
        before += f.n_ids

    def run(batches):
        for b in batches:
            for path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                reader, held = FileReader(path), []
                for i, start, n, crc in reader.documents():
                    held.append((i, start + base, n, crc))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=_ROWS)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=_ROWS)
                reader.close()

    tasks = spark.createDataFrame(listed, "path string, base long").repartition(max(1, min(len(listed), 4 * partitions(spark))))
    return tasks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_source(path: str | None = None) -> str:
    """The JSON text of a tokeniser file; by default that of the public byte-level BPE vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files and read back: doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_source(), path))
