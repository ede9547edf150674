"""Language-model scoring with causal self-attention over subword ids, beside a word-unigram base.

Tokens: a text's words become subword ids by greedy longest match in the first VOCAB entries of a public vocabulary file (bytes for the rest), each word with its
leading space, then one end. The model is a softmax over a tree of LEVELS levels with BRANCH branches each. Its logits are the log of corpus transition counts,
gathered over all training documents, plus what one head of causal self-attention over the window adds. The tree's order comes from a recursive spectral
split of the transition counts, so tokens of one language and role share a branch.

Attention is trained in numpy where the data lies: in each of ROUNDS rounds every task takes windows of each of its training documents, a new share of them
each round so that the rounds together meet every window once (a text's last one, with its end, is padded), runs Adam from the common parameters, and the tasks' parameters are averaged, weighted by tokens. So counts and training follow the input.
Each task meets its rows in the order they lie in, so the parameters, and by some parts in a thousand the scores, depend on how the input is partitioned.

Scoring covers each text by windows of WINDOW ids that overlap by WINDOW - STRIDE; a window scores the ids that the one before did not, so each is scored once,
with masked attention over batches of windows.

The base score needs the training count of every word of every document. Counts are pre-aggregated in each batch. The counts of the most frequent words, COMMON of them at
most, are broadcast (a histogram of counts gives the least count); only rarer words, of which no single one is hot, are joined with their counts by a shuffle. One pass over
the texts looks the frequent words up, writes the hashes of the others and the subword ids.

Defined results: a null text counts as empty; an empty text is one end token; without training documents all counts are 0 and the model is near uniform; repeated
rows give repeated results; a null doc_id counts as the empty text for the split; other columns are ignored.
"""

from __future__ import annotations

import base64
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import _FOLD, HashTable, byte_words, crc_mod, joined_texts, lower_ascii, release, slices, table, word_hashes, written
from quire.llm.op9_substring import ROW, row_key

BRANCH, LEVELS = 13, 3
VOCAB, WIDTH, WINDOW, STRIDE = BRANCH**LEVELS, 16, 24, 20
END = 256
COMMON = 1 << 18
ROUNDS, BATCH, RATE, SEED = 3, 96, 8e-3, 11
#: Words that a worker remembers the ids of.
MEMORY = 600_000
_BLOCK, _SLICE = 192, 1 << 19
LOG10 = float(np.log(10.0))


def pieces(path: str | None = None, size: int = VOCAB) -> list[str]:
    """The first entries of a vocabulary of ranks that are lower-case text of two characters or more; with the bytes and the end they make ``size`` ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out: list[str] = []
    with open(path, "rb") as f:
        for line in f:
            if len(out) == size - END - 1:
                break
            raw = base64.b64decode(line.split()[0])
            try:
                s = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(s) > 1 and s == lower_ascii(s) and not any(c.isspace() for c in s[1:]) and s[0] not in "\t\n\x0b\x0c\r":
                out.append(s)
    return out


class Subwords:
    """Greedy longest match; ids 0 to 255 are bytes, END the end of a text, the pieces follow. Ids of words met before are kept in flat arrays by hash."""

    def __init__(self, vocabulary: list[str], memory: int = MEMORY):
        self.ids = {p: END + 1 + i for i, p in enumerate(vocabulary)} | {chr(i): i for i in range(128)}
        sizes: dict[str, set[int]] = {}
        for p in vocabulary:
            sizes.setdefault(p[:3], set()).add(len(p))
        self.sizes = {k: sorted(x, reverse=True) for k, x in sizes.items()}  # of the pieces that begin with the same three characters
        self.limit = memory
        self.forget()

    def forget(self, room: int = 0) -> None:
        """Empty the memory, and make room for so many words at least."""
        room = max(room, self.limit)
        self.known, self.count = HashTable(np.zeros(0, np.uint64), np.zeros(0, np.float32), room), 0
        self.number = np.zeros(len(self.known.keys), np.int64)  # of the word in each slot
        self.first, self.flat = np.zeros(room + 1, np.int64), np.zeros(1 << 16, np.uint16)  # where the ids of each word begin, and the next one's

    def learn(self, h: np.ndarray, words: list[bytes]) -> None:
        """Remember words by their hashes."""
        found = [self.word(w.decode("utf-8", "surrogatepass")) for w in words]
        ends = self.first[self.count] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(int(ends[-1]) - len(self.flat), len(self.flat)), np.uint16)])
        self.flat[self.first[self.count] : ends[-1]] = np.fromiter(itertools.chain.from_iterable(found), np.uint16)
        self.first[self.count + 1 : self.count + 1 + len(h)] = ends
        self.known.add(h, np.zeros(len(h), np.float32))
        self.number[self.known.slots(h)] = np.arange(self.count, self.count + len(h))
        self.count += len(h)

    def word(self, w: str) -> list[int]:
        s, i, out, get, sizes = " " + w, 0, [], self.ids.get, self.sizes.get
        n = len(s)
        while i < n:
            for j in sizes(s[i : i + 3], ()):
                k = get(s[i : i + j]) if i + j <= n else None
                if k is not None:
                    break
            else:
                j = 2
                k = get(s[i : i + 2]) if i + 2 <= n else None
                if k is None:
                    j, k = 1, get(s[i])
            if k is None:
                out += s[i].encode("utf-8", "surrogatepass")
            else:
                out.append(k)
            i += j
        return out

    def texts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after another, and how many each has (its end included)."""
        low = _FOLD[data]
        start, stop, count = byte_words(low, ends)
        return self.words(low, start, stop, count, word_hashes(low, start, stop))

    def words(self, low: np.ndarray, start: np.ndarray, stop: np.ndarray, count: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from lower-case bytes, the places of their words, how many of these each text has, and their hashes."""
        slot = self.known.slots(h)
        if (slot < 0).any():
            new, at = np.unique(h[slot < 0], return_index=True)
            if self.count + len(new) >= len(self.first):
                new, at = np.unique(h, return_index=True)
                self.forget(len(new))
                slot[:] = -1
            at, raw = np.flatnonzero(slot < 0)[at], low.tobytes()
            self.learn(new, [raw[x:y] for x, y in zip(start[at].tolist(), stop[at].tolist(), strict=True)])
            slot = self.known.slots(h)
        number = self.number[slot]
        first, size = self.first[number], self.first[number + 1] - self.first[number]
        owner = np.repeat(np.arange(len(count)), count)
        lengths = np.bincount(owner, size, len(count)).astype(np.int64) + 1
        out = np.full(int(lengths.sum()), END, np.uint16)
        place = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(place, size)
        out[np.repeat(place + owner, size) + inside] = self.flat[np.repeat(first, size) + inside]
        return out, lengths


def arrange(counts: np.ndarray) -> np.ndarray:
    """A position for each id, whose digits lead through the tree: recursive halving by the leading singular vector of the transitions."""
    m = np.log1p(np.hstack([counts, counts.T]).astype(np.float32))
    m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-9

    def split(ids: np.ndarray) -> list[np.ndarray]:
        if len(ids) <= BRANCH:
            return [ids]
        x = m[ids] - m[ids].mean(0)
        u = np.random.default_rng(1).normal(size=len(ids)).astype(np.float32)
        g = x @ x.T
        for _ in range(30):
            u = g @ u
            u /= np.linalg.norm(u) + 1e-12
        order = np.argsort(u, kind="stable")
        h = len(ids) // 2
        return split(ids[order[:h]]) + split(ids[order[h:]])

    place = np.empty(len(counts), np.int64)
    place[np.concatenate(split(np.arange(len(counts))))] = np.arange(len(counts))
    return place


def priors(counts: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """Log probabilities of the next branch by the token before, the node reached (level by level, from the root) and the branch. ``counts`` by position."""
    v, out = len(counts), []
    for level in range(LEVELS):
        up, rest = BRANCH**level, v // BRANCH ** (level + 1)
        c = counts.reshape(v, up, BRANCH, rest).sum(3).astype(np.float32)
        uni = c.sum(0) + 0.05 * rest
        out.append(np.log((c + weight * (uni / uni.sum(1, keepdims=True))) / (c.sum(2, keepdims=True) + weight)).astype(np.float32))
    return np.concatenate(out, axis=1)


_LEVEL = np.repeat(np.eye(LEVELS, dtype=np.float32), BRANCH, axis=0)  # sums the branches of each level
_UP = BRANCH ** np.arange(LEVELS)  # nodes of each level
# By position: the node that it passes on each level, among all nodes, and the branch that it takes there, among the logits of all levels.
_NODE = np.arange(VOCAB)[:, None] // (VOCAB // _UP) + np.cumsum(_UP) - _UP
_CHOICE = np.arange(VOCAB)[:, None] // (VOCAB // _UP // BRANCH) % BRANCH + BRANCH * np.arange(LEVELS)


class Room:
    """Arrays by name that are filled again and again, as fresh memory costs more than the work in it. A copy starts empty."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, dtype=np.float32) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self.kept or self.kept[name].size < n:
            self.kept[name] = np.empty(n, dtype)
        return self.kept[name][:n].reshape(shape)

    def __reduce__(self):
        return Room, ()


class Attention:
    """One head of causal self-attention beside the embeddings of the last two ids, and a linear map to the logits of each level."""

    def __init__(self, vocab: int = VOCAB, width: int = WIDTH, window: int = WINDOW, seed: int = SEED):
        r = np.random.default_rng(seed)
        n = lambda *s, k=1.0: r.normal(0, k, s).astype(np.float32)
        self.width = width
        self.p = {"e": n(vocab, width, k=0.5), "o": n(window, width, k=0.1), "qkv": n(width, 3 * width, k=width**-0.5), "w": np.zeros((3 * width, LEVELS * BRANCH), np.float32)}
        self.p["qkv"][:, :width] *= width**-0.5
        self.past, self.room = np.tril(np.ones((window, window), np.float32)), Room()

    def hidden(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of windows of ids (rows): the state at each place, and what the gradient needs. All of it lies in arrays that the next call fills again."""
        p, (m, n), d, room = self.p, ids.shape, self.width, self.room
        x = np.take(p["e"], ids, axis=0, out=room("x", m, n, d), mode="clip")
        x += p["o"][:n]
        z = room("z", m * n, 3 * d + 1)
        np.matmul(x.reshape(-1, d), p["qkv"], out=z[:, : 3 * d])
        z[:, 3 * d] = 1  # beside the values, so that their weighted sums come with the sum of the weights
        z = z.reshape(m, n, 3 * d + 1)
        q, k, v = z[..., :d], z[..., d : 2 * d], z[..., 2 * d :]
        s = np.matmul(q, k.transpose(0, 2, 1), out=room("s", m, n, n))
        np.clip(s, -60, 60, out=s)
        np.exp(s, out=s)
        s *= self.past[:n, :n]
        h = room("h", m, n, 3 * d)
        h[..., :d], h[:, 1:, d : 2 * d], h[:, 0, d : 2 * d] = x, x[:, :-1], 0
        sums = np.matmul(s, v, out=room("sums", m, n, d + 1))
        total = 1 / sums[..., d:]
        np.multiply(sums[..., :d], total, out=h[..., 2 * d :])
        return h, x, q, k, v, s, total

    def log_probs(self, h: np.ndarray, before: np.ndarray, target: np.ndarray, prior: np.ndarray, grad: bool = False):
        """Natural log probability of each target (rows of h); with ``grad`` also its gradient by the logits, negated."""
        room, t, b = self.room, len(target), LEVELS * BRANCH
        node = np.take(_NODE, target, axis=0, out=room("node", t, LEVELS, dtype=np.int64), mode="clip")
        node += (before * prior.shape[1])[:, None]
        z = np.take(prior.reshape(-1, BRANCH), node, axis=0, out=room("logits", t, LEVELS, BRANCH), mode="clip").reshape(t, b)
        z += np.matmul(h, self.p["w"], out=room("drive", t, b))
        np.clip(z, -80, 80, out=z)
        chosen = np.take(_CHOICE, target, axis=0, out=node, mode="clip")
        chosen += np.arange(0, t * b, b)[:, None]
        out = z.ravel().take(chosen)
        np.exp(z, out=z)
        total = z @ _LEVEL
        out -= np.log(total)
        out = out @ np.ones(LEVELS, np.float32)
        if not grad:
            return out
        z *= np.matmul(1 / total, _LEVEL.T, out=room("drive", t, b))
        z.reshape(-1)[chosen.ravel()] -= 1
        return out, z

    def gradient(self, ids: np.ndarray, target: np.ndarray, prior: np.ndarray, inside: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log probability and its loss's gradient over the places ``inside``; the others only pad windows."""
        p, (m, n), d, room, flat = self.p, ids.shape, self.width, self.room, ids.ravel()
        h, x, q, k, v, s, total = self.hidden(ids)
        lp, gz = self.log_probs(h.reshape(-1, 3 * d), flat, target.ravel(), prior, True)
        outside = np.flatnonzero(~inside)
        lp[outside], gz[outside] = 0, 0
        size = len(lp) - len(outside)
        g = {"w": h.reshape(-1, 3 * d).T @ gz}
        gh = np.matmul(gz, p["w"].T, out=room("gh", m * n, 3 * d)).reshape(m, n, 3 * d)
        gx = gh[..., :d]
        gx[:, :-1] += gh[:, 1:, d : 2 * d]
        go = room("go", m, n, d + 1)  # the last column meets the ones beside the values
        np.multiply(gh[..., 2 * d :], total, out=go[..., :d])
        np.negative(np.einsum("ijk,ijk->ij", go[..., :d], h[..., 2 * d :]), out=go[..., d])
        gs = np.matmul(go, v.transpose(0, 2, 1), out=room("gs", m, n, n))
        gs *= s
        gz = room("gz", m, n, 3 * d)
        np.matmul(gs, k, out=gz[..., :d])
        np.matmul(gs.transpose(0, 2, 1), q, out=gz[..., d : 2 * d])
        np.matmul(s.transpose(0, 2, 1), go[..., :d], out=gz[..., 2 * d :])
        gz = gz.reshape(-1, 3 * d)
        g["qkv"] = x.reshape(-1, d).T @ gz
        back = np.matmul(gz, p["qkv"].T, out=room("back", m * n, d)).reshape(m, n, d)
        back += gx
        g["o"] = np.zeros(p["o"].shape, np.float32)
        g["o"][:n] = back.sum(0)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        met = flat.take(order)
        first = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
        g["e"] = np.zeros(p["e"].shape, np.float32)
        g["e"][met[first]] = np.add.reduceat(back.reshape(-1, d).take(order, 0), first, axis=0)
        return float(lp.sum()) / size, {name: y / size for name, y in g.items()}

    def pack(self) -> bytes:
        return b"".join(self.p[k].astype(np.float32).tobytes() for k in sorted(self.p))

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].astype(np.float32).reshape(self.p[k].shape)
            at += n


class Adam:
    """Adam over all parameters as one array, of which the net's become views."""

    def __init__(self, net: Attention, rate: float = RATE):
        self.net, self.rate, self.t, self.names = net, rate, 0, sorted(net.p)
        self.flat = np.concatenate([net.p[k].ravel() for k in self.names])
        self.m, self.s, self.g, self.d = (np.zeros_like(self.flat) for _ in range(4))
        at = 0
        for k in self.names:
            net.p[k] = self.flat[at : at + net.p[k].size].reshape(net.p[k].shape)
            at += net.p[k].size

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        x, d = np.concatenate([g[k].ravel() for k in self.names], out=self.g), self.d
        np.subtract(x, self.m, out=d)
        d *= 0.1
        self.m += d
        x *= x
        x -= self.s
        x *= 0.02
        self.s += x
        np.multiply(self.s, 1 / (1 - 0.98**self.t), out=d)
        np.sqrt(d, out=d)
        d += 1e-8
        np.divide(self.m, d, out=d)
        d *= self.rate / (1 - 0.9**self.t)
        self.flat -= d


def window_plan(n: int) -> np.ndarray:
    """First places of the windows over n targets."""
    return np.arange(0, 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // STRIDE)) * STRIDE


def score_texts(net: Attention, prior, place: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text's ids; every id is scored once."""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = np.zeros(len(texts))
    if not len(texts):
        return total
    end = place[END]
    flat = np.append(place[np.concatenate(texts)], end)
    begin = np.cumsum(lengths) - lengths
    last = np.concatenate([[end], flat[:-1]])
    last[begin] = end
    plans = [window_plan(int(n)) for n in lengths]
    owner, start = np.repeat(np.arange(len(texts)), [len(p) for p in plans]), np.concatenate(plans)
    first, left, offset = start + begin[owner], lengths[owner] - start, np.arange(WINDOW)
    # Windows in order own each id once and in order, so what they own are runs of ``flat``. Places beyond a text only come after those that it owns.
    lp, done = np.empty(len(flat) - 1, np.float32), 0
    for i in range(0, len(start), _BLOCK):
        b = slice(i, i + _BLOCK)
        own = np.flatnonzero((offset < left[b, None]) & ((start[b, None] == 0) | (offset >= WINDOW - STRIDE)))
        h = net.hidden(last.take(first[b, None] + offset, mode="clip"))[0].reshape(-1, 3 * net.width)
        h = np.take(h, own, axis=0, out=net.room("own", len(own), 3 * net.width), mode="clip")
        run = slice(done, done + len(own))
        lp[run] = net.log_probs(h, last[run], flat[run], prior)
        done = run.stop
    return np.bincount(np.repeat(np.arange(len(texts)), lengths), lp, len(texts))


def _ids(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def transitions(tokens: DataFrame, vocab: int = VOCAB) -> np.ndarray:
    """Counts of each id after each id in the training texts (an end before the first); vocab**2 numbers, however large the input."""

    def run(batches):
        total = np.zeros(vocab * vocab, np.int64)
        for b in batches:
            ids = _ids(b.column(0))
            for i in range(0, len(ids), 512):
                t = np.concatenate(ids[i : i + 512]).astype(np.int64)  # each text ends with END, which also comes before the next one's first
                total += np.bincount(np.concatenate([[END], t[:-1]]) * vocab + t, minlength=vocab * vocab)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    got = tokens.filter("train").select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocab * vocab, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(vocab, vocab)


def batch_windows(ids: np.ndarray, lengths: np.ndarray, end: int, first: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's consecutive windows (texts one after another in ``ids``), each ``every``-th from the one numbered ``first``: ids before, target ids, and
    which places lie inside the text."""
    some = np.maximum(-(-(-(-lengths // WINDOW) - first) // every), 0)
    owner = np.repeat(np.arange(len(lengths)), some)
    at = ((first - every * (np.cumsum(some) - some))[owner] + every * np.arange(len(owner)))[:, None] * WINDOW + np.arange(WINDOW)
    size, where = lengths[owner, None], at + (np.cumsum(lengths) - lengths)[owner, None]
    inside = at < size
    target = np.where(inside, ids.take(where, mode="clip"), end)
    return np.where((at > 0) & (at <= size), ids.take(where - 1, mode="clip"), end), target, inside


def training_windows(ids: np.ndarray, end: int, first: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of one text."""
    return batch_windows(ids, np.array([len(ids)]), end, np.array([first]), every)


def train(tokens: DataFrame, place: np.ndarray, prior, rounds: int = ROUNDS, seed: int = SEED) -> Attention:
    """The attention's parameters after averaging rounds over all training texts; each round meets one window in ``rounds`` of each text, other ones each
    round, beginning at a place that the text's key chooses, so that every window is met once."""
    net, spark = Attention(seed=seed), tokens.sparkSession
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((net.pack(), place, prior, r))

        def run(batches):
            packed, place, prior, r = shared.value
            net = Attention(seed=seed)
            net.unpack(np.frombuffer(packed, np.float32))
            adam, seen, held = Adam(net, RATE / (r + 1)), 0, None

            def learn(before, target, inside):
                adam.step(net.gradient(before, target, prior, inside)[1])
                return int(inside.sum())

            for b in batches:
                ids, begin = _ids(b.column(1)), (r - b.column(0).to_numpy() % rounds) % rounds
                for i in range(0, len(ids), 128):
                    part = ids[i : i + 128]
                    got = batch_windows(place[np.concatenate(part)], np.array([len(x) for x in part]), place[END], begin[i : i + 128], rounds)
                    held = got if held is None else tuple(np.concatenate(x) for x in zip(held, got, strict=True))
                    whole = len(held[0]) - len(held[0]) % BATCH
                    for k in range(0, whole, BATCH):
                        seen += learn(*(x[k : k + BATCH] for x in held))
                    held = tuple(x[whole:] for x in held)
            if held is not None and len(held[0]):
                seen += learn(*held)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([net.pack()], pa.binary())], names=["weight", "params"])

        def average(t: pa.Table) -> pa.Table:
            w = t.column("weight").to_numpy()
            x = sum(a * np.frombuffer(p, np.float32) for a, p in zip(w / w.sum(), t.column("params").to_pylist(), strict=True))
            return pa.table({"weight": pa.array([float(w.sum())]), "params": pa.array([x.astype(np.float32).tobytes()], pa.binary())})

        locals_ = tokens.filter("train").select("key", "ids").mapInArrow(run, "weight double, params binary")
        few = locals_.groupBy(F.pmod(F.spark_partition_id(), F.lit(16)).alias("g")).applyInArrow(average, "weight double, params binary").toArrow()
        if few.num_rows:
            net.unpack(np.frombuffer(average(few).column("params")[0].as_py(), np.float32))
    return net


def _word_counts(rows: DataFrame) -> DataFrame:
    """h, c: how often each word occurs in the training texts; summed in each batch before it is shuffled."""

    def run(batches):
        for b in batches:
            data, ends = joined_texts(b.column(0))
            found = []
            for a, z in slices(ends, _SLICE):
                base = ends[a - 1] if a else 0
                part = data[base : ends[z - 1]]
                start, stop, _ = byte_words(part, ends[a:z] - base)
                found.append(np.unique(word_hashes(part, start, stop, fold=True), return_counts=True))
            if found:
                u, inv = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                c = np.bincount(inv, np.concatenate([f[1] for f in found]), len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "c"])

    return rows.filter("train").select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


_SUBWORDS: dict[int, Subwords] = {}


def met_words(rows: DataFrame, common: int = COMMON, vocabulary: list[str] | None = None) -> tuple[DataFrame, DataFrame, int, float, bool]:
    """What one pass finds in the texts of (doc_id, id, key, train, text), written once: doc_id, id, key, train, n_tokens, of frequent words and the end their number m and
    score s, the hashes of all other words, and the ids by ``vocabulary`` as 16-bit numbers (none without one). Also: the counts of the words that are not frequent, the number of
    training tokens, the divisor of counts, and whether anything is trained on."""
    spark = rows.sparkSession
    counts = written(_word_counts(rows), "counts")
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = rows.filter("train").count()
    n, v = int(words + ends), int(kinds) + (ends > 0)
    floor = n + 0.1 * (v + 1)
    step = F.floor(F.log2("c") * 16).cast("int")
    least, have = 0, 0  # counts from this step on belong to ``common`` words at most
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        have += r["count"]
        if have > common:
            least = r["step"] + 1
            break
    top = counts.filter(step >= least).toArrow()
    known = HashTable(top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy().astype(np.float32))
    exact = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)) if n >= 1 << 24 else {}
    big = {h: c for h, c in exact.items() if c >= 1 << 24}  # beyond float32's whole numbers
    values = np.log10((known.values.astype(np.float64) + 0.1) / floor)
    for h, c in big.items():
        hit = known.used & (known.keys == np.uint64(h & (1 << 64) - 1))
        values[hit] = np.log10((c + 0.1) / floor)
    shared = spark.sparkContext.broadcast((known, values, float(np.log10((ends + 0.1) / floor)), vocabulary))
    name = hash(tuple(vocabulary or ()))

    def run(batches):
        known, values, end, vocabulary = shared.value
        if vocabulary is not None and name not in _SUBWORDS:
            _SUBWORDS[name] = Subwords(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                c = b.slice(i, 2048)
                data, stops = joined_texts(c.column(4))
                for a, z in slices(stops, _SLICE):
                    base = stops[a - 1] if a else 0
                    low = _FOLD[data[base : stops[z - 1]]]
                    start, stop, count = byte_words(low, stops[a:z] - base)
                    h = word_hashes(low, start, stop)
                    slot, owner = known.slots(h), np.repeat(np.arange(z - a), count)
                    hit = slot >= 0
                    m, s = np.bincount(owner[hit], minlength=z - a), np.bincount(owner[hit], values[slot[hit]], z - a) + end
                    flat, size = (np.zeros(0, np.uint16), np.zeros(z - a, np.int64)) if vocabulary is None else _SUBWORDS[name].words(low, start, stop, count, h)
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer(np.append(0, 2 * np.cumsum(size))), pa.py_buffer(flat)]).cast(pa.binary())
                    rest = pa.ListArray.from_arrays(np.append(0, np.cumsum(count - m)).astype(np.int32), pa.array(h[~hit].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*(c.column(k).slice(a, z - a) for k in range(4)), pa.array(count + 1), pa.array(m), pa.array(s), rest, ids], names=["doc_id", *ROW, "train", "n_tokens", "m", "s", "rest", "ids"])

    met = rows.select("doc_id", *ROW, "train", "text").mapInArrow(run, "doc_id long, id long, key long, train boolean, n_tokens long, m long, s double, rest array<long>, ids binary")
    return written(met, "met"), counts.filter(step < least), n, float(floor), ends > 0


def word_scores(met: DataFrame, less: DataFrame, floor: float, seen: bool) -> DataFrame:
    """For each row of ``met``: n_tokens, n_known, base_score, times (rows that share id and text)."""
    main = met.groupBy(*ROW).agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times"), F.first("n_tokens").alias("n_tokens"), F.first("m").alias("m"), F.first("s").alias("s"))
    low = met.select(*ROW, F.explode("rest").alias("h")).join(less, "h", "left").groupBy(*ROW).agg(F.count("c").alias("rm"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(floor))).alias("rs"))
    return main.join(low, ROW, "left").select("doc_id", *ROW, "times", "n_tokens", (F.col("m") + int(seen) + F.coalesce(F.col("rm") / F.col("times"), F.lit(0))).cast("long").alias("n_known"), (F.col("s") + F.coalesce(F.col("rs") / F.col("times"), F.lit(0.0))).alias("base_score"))


def base_scores(rows: DataFrame, common: int = COMMON) -> tuple[DataFrame, int]:
    """For each row (doc_id, id, key, train, text): n_tokens, n_known, base_score, times (rows that share id and text); and the number of training tokens."""
    met, less, n, floor, seen = met_words(rows, common)
    return word_scores(met, less, floor, seen), n


def score_documents(docs: DataFrame, vocabulary: list[str], modulus: int = 10) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("key", row_key()).withColumn("train", crc_mod("doc_id", modulus) != 0)
    spark = docs.sparkSession
    tokens, less, n, floor, seen = met_words(rows, vocabulary=vocabulary)
    base = written(word_scores(tokens, less, floor, seen), "base")
    release(spark)
    counts = transitions(tokens)
    place = arrange(counts)
    moved = np.zeros_like(counts)
    moved[np.ix_(place, place)] = counts
    prior = priors(moved)
    net = train(tokens, place, prior)
    shared = spark.sparkContext.broadcast((net, prior, place))

    def run(batches):
        net, prior, place = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(score_texts(net, prior, place, _ids(c.column(2))) / LOG10)], names=[*ROW, "score"])

    scored = tokens.select(*ROW, "ids").mapInArrow(run, "id long, key long, score double").groupBy(*ROW).agg(F.first("score").alias("score"))
    each = base.join(scored, ROW).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select("doc_id", (crc_mod("doc_id", modulus) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op5_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probabilities: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score_documents(table(spark, sf_dir, "documents"), pieces())
