"""Token files, spelling variants and fill-in-middle against brute-force versions on small tables with nulls, long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import op11_token_files as op11
from quire.llm import op12_variants as op12
from quire.llm import op13_middle as op13
from quire.llm.common import shared_dir

SCHEMA = "doc_id long, text string, word string, n int, part string, key long"


def make(spark, rows):
    """A documents table with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 3, "y", 9) for i, t in rows], SCHEMA).repartition(3)


ODD = ["", None, "a", " ", "\n\n x", "<|endoftext|>", "it's<|endoftext|> we'll", "tab\t space  two three　four", "中文。和，字", "x" * 5000, "Ünï cödé ² ⅷ ā_b 12ab3 ...?!  ", "\x1c \x85 z"]


# --- 11 ------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(op11.tokenizer_source())


def test_op11_files_hold_every_id_in_order(spark, tokenizer):
    r = random.Random(3)
    words = ["the", "Over", "naïve", "rain.", "hill,\nthen", "don't", "12", "3.5", "<|endoftext|>", " "]
    rows = [(None, "null id"), (7, "same"), (7, "same"), (7, "other"), (-4, "first?"), *((100 + i, t) for i, t in enumerate(ODD))]
    rows += [(1000 + i, " ".join(r.choice(words) for _ in range(r.randint(0, 400)))) for i in range(60)] + [(5, " ".join(r.choice(words) for _ in range(40_000)))]
    docs = make(spark, rows)
    manifest = op11.write_token_files(docs, op11.tokenizer_source(), shared_dir(spark) + "/op11-test", files=3, block=64, file_ids=5000)
    files = sorted(manifest.collect())
    assert len(files) > 3 and sum(f.n_docs for f in files) == len(rows)
    stream = np.concatenate([(f := op11.FileReader(m.path)).ids(0, f.n_ids) for m in files])
    got = op11.read_token_files(spark, manifest).collect()
    assert len(got) == len(rows) and sum(g.n_tokens for g in got) == len(stream)
    got.sort(key=lambda g: g.start)
    order = [g.doc_id for g in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    want = collections.defaultdict(collections.Counter)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i][len(ids), zlib.crc32(ids.tobytes())] += 1
    at, have = 0, collections.defaultdict(collections.Counter)
    for g in got:
        assert g.start == at and zlib.crc32(stream[at : at + g.n_tokens].astype("<u4").tobytes()) == g.ids_crc32 and stream[at + g.n_tokens - 1] == 0
        at += g.n_tokens
        have[g.doc_id][g.n_tokens, g.ids_crc32] += 1
    assert have == want
    reader = op11.FileReader(files[1].path)
    whole = reader.ids(0, reader.n_ids)
    for a, z in ((0, 1), (63, 65), (64, 64), (100, reader.n_ids), (reader.n_ids - 1, reader.n_ids)):
        assert (reader.ids(a, z) == whole[a:z]).all()


def test_op11_empty_table_and_broken_file(spark, tmp_path):
    docs = make(spark, [(1, "x")]).limit(0)
    manifest = op11.write_token_files(docs, op11.tokenizer_source(), shared_dir(spark) + "/op11-empty")
    assert manifest.count() == 0 and op11.read_token_files(spark, manifest).count() == 0
    (tmp_path / "f").write_bytes(b"QPF1 nothing of the kind, but long enough for a tail")
    with pytest.raises(ValueError):
        op11.FileReader(str(tmp_path / "f"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=400), st.sampled_from([0.0, 0.5, 0.95, 1.0]))
def test_op11_blocks_round_trip(ids, percentile):
    x = np.array(ids, np.uint32)
    assert (op11.unpack_block(op11.pack_block(x, percentile)) == x).all()


def test_op11_exceptions_are_few_bits():
    """One great id in a block of small ones costs an exception and leaves the width alone."""
    x = np.full(1000, 3, np.uint32)
    x[:900] = np.arange(900) % 8
    y = x.copy()
    y[500] = 2**31
    assert len(op11.pack_block(x)) == 10 + 375 and len(op11.pack_block(y)) <= 10 + 375 + 2 + 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab cé \n\t'stre.,;!?1²ā中。、_-\"()<|>\x1c ́　", "<|endoftext|>", "'s", "'re", " the", "  "]), max_size=30).map("".join))
def test_op11_pieces_encode_like_the_library(text):
    encoder = op11.encoder(op11.tokenizer_source())
    assert "".join(op11.PIECE.findall(text)) == text
    assert [int(x) for p in encoder.parts(text) for x in p] == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_op11_small_memory_and_stretches(monkeypatch, tokenizer):
    monkeypatch.setattr(op11, "STRETCH", 50)
    r = random.Random(5)
    encoder = op11.PieceEncoder(op11.tokenizer_source(), memory=8)
    text = " ".join(r.choice(["alpha", "Beta.", "it's", "x,\ny", "naïve", "  gap", "dolor", "sit"]) + str(r.randint(0, 9)) for _ in range(2000))
    assert [int(x) for p in encoder.parts(text) for x in p] == tokenizer.encode(text, add_special_tokens=False).ids


# --- 12 ------------------------------------------------------------------------------------------------------------------------------


def plain_variants(rows):
    """word: (form, root, n, n_near, form_n), by comparing all pairs."""
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = "".join(c for k, c in enumerate(w) if k != h % len(w))
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    mates = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: best for w in n if mates[w] and n[best := min(mates[w], key=lambda v: (-n[v], v))] >= 2 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = form.get(w), root, n[w], len(mates[w]), n[form[w]] if w in form else None
    return out


@pytest.mark.parametrize("shard", [7, 10**6])
def test_op12_against_all_pairs(spark, shard):
    r = random.Random(11)
    base = ["winter", "colour", "straße", "élève", "abcde", "aaaaa", "aaaaaa", "aaaaaaa", "reading", "leading", "loading", "b" * 200, "b" * 199, "b" * 100 + "c" + "b" * 99]
    words = list(base)
    for w in base:
        for _ in range(14):
            k, c = r.randrange(len(w)), r.choice("abceéß")
            words.append(r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]]))
    rows = [(i, " ".join(r.choice(words) if r.random() < 0.7 else r.choice(base).upper() for _ in range(60)) + ". The × of x÷y…") for i in range(60)]
    rows += [(None, "winter winter"), (5, None), (6, ""), (7, "12 ! 34"), (8, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (9, "WINTERS " * 3 + "winteré winteré winteré ")]
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in op12.spelling_variants(make(spark, rows), shard=shard).collect()}
    want = plain_variants(rows)
    assert got == want and len(got) > 100 and any(v[0] for v in want.values())


def test_op12_chains_ties_and_empty_tables(spark):
    chain = [("abcdefgh", 40), ("abcdefgx", 20), ("abcdefyx", 10), ("abcdzzyx", 5), ("abcdezyx", 5), ("qqqqq", 3), ("qqqqa", 6), ("qqqqb", 6)]
    rows = [(1, " ".join(w for w, c in chain for _ in range(c)))]
    got = {x.word: x for x in op12.spelling_variants(make(spark, rows)).collect()}
    want = plain_variants(rows)
    assert {w: (x.form, x.root, x.n, x.n_near, x.form_n) for w, x in got.items()} == want
    if "qqqqq" in got and got["qqqqq"].n == 3 and got["qqqqa"].n == got["qqqqb"].n == 6:
        assert got["qqqqq"].form == "qqqqa"
    assert op12.spelling_variants(make(spark, [(1, "few words here")])).count() == 0
    assert op12.spelling_variants(make(spark, rows).limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=8), st.text("abé", max_size=8))
def test_op12_one_edit(a, b):
    want = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or any(b[:k] + b[k + 1 :] == a for k in range(len(b))) or any(a[:k] + a[k + 1 :] == b for k in range(len(a)))
    assert op12.one_edit(a, b) == want
    long = "a" * 40
    assert op12.one_edit(long + a, long + b) == want and op12.one_edit(a + long, b + long) == want


# --- 13 ------------------------------------------------------------------------------------------------------------------------------


def plain_middle(i, t):
    t = t or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, t
    a, z = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:z]), "".join(u[z:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_op13_against_lists_of_units(spark):
    r = random.Random(2)
    parts = ["word", " ", "é", "\n", "😀", "<", "<P", "S>", "M>", ".", "12", "<<", ">"]
    rows = [(None, "null id"), (3, "same text"), (3, "same text"), *((200 + i, t) for i, t in enumerate(ODD)), (400, "has <P> inside"), (401, "<M>"), (402, "<S>x"), (403, "y" * 100_000 + " z" * 100_000)]
    rows += [(1000 + i, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(400)]
    docs = make(spark, rows)
    out = op13.fill_in_middle(docs)
    got = collections.Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in out.collect())
    assert got == collections.Counter((i, *plain_middle(i, t)) for i, t in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    back = out.select("doc_id", op13.restore(out.output, out.form).alias("t")).collect()
    assert collections.Counter((x.doc_id, x.t) for x in back) == collections.Counter((i, t or "") for i, t in rows)
    assert op13.fill_in_middle(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("ab é\n<PSM>", max_size=30), st.integers(0, 10**6))
def test_op13_ranks(text, i):
    assert op13.transformed(i, text) == plain_middle(i, text)


# --- repeated rows and long texts of the scoring and counting operators ----------------------------------------------------------------


def test_scores_and_counts_of_repeated_rows_and_long_texts(spark):
    """A row that comes again gets the same answer, and a text of a million characters one of its own; neither changes the others' answers once a model is fitted."""
    from test_llm_operators import labelled, prose

    from quire.llm import op4_toxicity as op4
    from quire.llm import op8_quality as op8
    from quire.llm import op10_wordpiece as op10

    texts, labels = labelled(spark, 120)
    docs = make(spark, list(enumerate(texts)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    r = random.Random(41)
    long = prose(r, 170_000)
    more = make(spark, [*enumerate(texts), (3, texts[3]), (3, texts[3]), (3, texts[4]), (None, texts[3]), (900, long), (900, long), (901, None)])
    model, net, pieces = op4.fit(docs, lab), op8.fit(docs, lab), op10.vocabulary()
    for answer in (lambda d: op4.score(d, *model), lambda d: op8.score(d, net), lambda d: op10.count_tokens(d, pieces)):
        once, again = answer(docs).collect(), answer(more).collect()
        plain = lambda x: tuple(round(v, 9) if isinstance(v, float) else v for v in x[1:])
        known = {x.doc_id: plain(x) for x in once}
        by = collections.defaultdict(list)
        for x in again:
            by[x.doc_id].append(plain(x))
        assert len(again) == len(texts) + 7 and all(by[i] == [known[i]] for i in range(len(texts)) if i != 3)
        assert len(by[3]) == 4 and by[3].count(known[3]) == 3
        assert len(by[900]) == 2 and by[900][0] == by[900][1] and len(by[None]) == len(by[901]) == 1
