"""Greedy longest-match token counts with a linear automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces that continue it. A node that no longer matches follows its
failure link; the pieces that this pops are not built, their number is precomputed per link. Every character costs one step plus the links followed, each of
which drops at least one character of what was matched, so the work is linear in the text.

The words of a batch that a worker does not remember run through the automaton side by side, as numpy arrays; words of more than LONG characters run alone, and are not
remembered.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a word that the vocabulary cannot spell counts as one unknown token; null and empty texts have no
tokens; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD, table

#: Words that a worker remembers, of up to LONG characters; beyond it, the memory starts anew.
MEMORY = 400_000
LONG = 256
_BITS = 21  # of a code point


class Automaton:
    """The trie, its failure links and popped-token counts as arrays; small (some bytes a character of the vocabulary) and picklable."""

    def __init__(self, initial: list[str], continuing: list[str]):
        edges: dict[int, int] = {}
        parent, char, depth, final = [-1, -1], [0, 0], [0, 0], [False, False]
        for root, words in ((0, initial), (1, continuing)):
            for w in words:
                at = root
                for c in map(ord, w):
                    nxt = edges.get(at << _BITS | c)
                    if nxt is None:
                        nxt = edges[at << _BITS | c] = len(parent)
                        parent.append(at)
                        char.append(c)
                        depth.append(depth[at] + 1)
                        final.append(False)
                    at = nxt
                if at > 1:
                    final[at] = True
        n = len(parent)
        fail, pops = [-1] * n, [0] * n
        for v in sorted(range(2, n), key=depth.__getitem__):
            if final[v]:
                fail[v], pops[v] = 1, 1
                continue
            u, c = parent[v], char[v]
            z, popped = fail[u], pops[u]
            while z >= 0 and (z << _BITS | c) not in edges:
                popped += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = edges[z << _BITS | c], popped
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.fromiter(edges.values(), np.int32, len(edges))[order]
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)

    def step(self, state: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node after one more character, or -1."""
        if not len(self.keys):
            return np.full(len(state), -1, np.int32)
        want = state.astype(np.int64) << _BITS | chars
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.next[at], -1)

    def count(self, word: str) -> int:
        """Tokens of one word; -1 where the vocabulary cannot spell it."""
        if not hasattr(self, "plain"):
            self.plain = dict(zip(self.keys.tolist(), self.next.tolist(), strict=True)), self.fail.tolist(), self.pops.tolist()
        edges, fail, pops = self.plain
        step, state, total = edges.get, 0, 0
        for c in word:
            c = ord(c)
            while (nxt := step(state << _BITS | c)) is None:
                total += pops[state]
                state = fail[state]
                if state < 0:
                    return -1
            state = nxt
        while state > 1:
            total += pops[state]
            state = fail[state]
        return -1 if state < 0 else total

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "plain"}

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; -1 where the vocabulary cannot spell it."""
        n = len(words)
        out = np.zeros(n, np.int64)
        if not n:
            return out
        lengths = np.fromiter(map(len, words), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        text = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.cumsum(lengths) - lengths
        state, total = np.zeros(n, np.int32), np.zeros(n, np.int64)
        live = n
        for i in range(int(lengths[0]) if n else 0):
            while live and lengths[live - 1] <= i:
                live -= 1
            idx = np.flatnonzero(state[:live] >= 0)
            chars = text[start[idx] + i]
            while len(idx):
                nxt = self.step(state[idx], chars)
                stuck = nxt < 0
                state[idx[~stuck]] = nxt[~stuck]
                idx, chars = idx[stuck], chars[stuck]
                total[idx] += self.pops[state[idx]]
                state[idx] = self.fail[state[idx]]
                go = state[idx] >= 0
                idx, chars = idx[go], chars[go]
        idx = np.flatnonzero(state > 1)
        while len(idx):
            total[idx] += self.pops[state[idx]]
            state[idx] = self.fail[state[idx]]
            idx = idx[state[idx] > 1]
        total[state < 0] = -1
        total[lengths == 0] = 0
        out[order] = total
        return out


def split_vocabulary(pieces: list[str], mark: str = "▁") -> tuple[list[str], list[str]]:
    """Pieces with the word mark begin words, the others continue them."""
    return [p[len(mark) :] for p in pieces if p.startswith(mark) and len(p) > len(mark)], [p for p in pieces if not p.startswith(mark) and p]


def vocabulary(path: str | None = None) -> list[str]:
    """The ordinary pieces of a sentencepiece model file; by default the public one of 32,000 pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


_WORDS: dict[int, dict[str, int]] = {}


def count_tokens(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every text. A map over rows: nothing is shuffled; the automaton (bounded by the vocabulary) is broadcast."""
    if len(pieces) > 2_000_000:
        raise ValueError("a vocabulary of more than 2 million pieces is not broadcast")
    auto = docs.sparkSession.sparkContext.broadcast(Automaton(*split_vocabulary(pieces)))
    key = hash(tuple(pieces))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        known = _WORDS.setdefault(key, {})
        for b in batches:
            words = [WORD.findall(t) if t else [] for t in b.column(1).to_pylist()]
            every = set().union(*words)
            long = {w: auto.value.count(w) for w in every if len(w) > LONG}
            every.difference_update(long)
            new = list(every.difference(known))
            if len(known) + len(new) > memory:
                known.clear()
                new = list(every)
            known.update(zip(new, auto.value.counts(new).tolist(), strict=True))
            got = known.__getitem__ if not long else lambda w: long[w] if len(w) > LONG else known[w]
            found = [list(map(got, w)) for w in words]
            unknown = [f.count(-1) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([sum(f) + 2 * u for f, u in zip(found, unknown, strict=True)], pa.int64()), pa.array(unknown, pa.int64())],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece lengths of every document: doc_id, n_words, n_tokens, n_unknown."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())
