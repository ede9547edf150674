"""The corpus operators against brute-force versions on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import op1_decontamination as op1
from quire.llm import op2_html as op2
from quire.llm import op3_minmax as op3
from quire.llm import op4_toxicity as op4
from quire.llm import op5_attention as op5
from quire.llm import op6_topk as op6
from quire.llm import op7_bpe as op7
from quire.llm import op8_quality as op8
from quire.llm import op9_substring as op9
from quire.llm import op10_wordpiece as op10
from quire.llm.common import WORD, joined_texts

SCHEMA = "doc_id long, text string, lang string, key long, at string, n int"


def make(spark, texts, ids=None):
    """A documents table with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 7, "x", 3) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA).repartition(3)


def prose(r, n, words="the of and to in that was for with his her they this from have not".split()):
    return " ".join(r.choice(words) + (str(r.randint(0, 40)) if r.random() < 0.5 else "") for _ in range(n))


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- 1 -------------------------------------------------------------------------------------------------------------------------------


def test_op1_verbatim_and_reparameterised(spark):
    item = "A train leaves Paris at 10 km per hour and Anna Smith walks 3 miles toward the station before the train from Paris arrives."
    same = "Foo bar. " + item + " Bar foo."
    other = item.replace("Paris", "Berlin").replace("10", "45").replace("Anna Smith", "Bob").replace("3 miles", "7 feet")
    mixed = item.replace("at 10", "at 45").replace("from Paris", "from Rome").replace("Anna Smith", "Bob")
    docs = make(spark, [same, other, "nothing of the kind here at all in this text", None, "", same, mixed, "12 34 56 78 90 12 34 56 78 90 12 34"], [1, 2, 3, 4, 5, 1, 6, 7])
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (5, "1 2 3 4 5 6 7 8 9 10 11 12"), (1, item)], "item_id long, text string")
    want = {(1, 1, "verbatim"), (2, 1, "reparameterised"), (6, 1, "reparameterised")}
    for chars in (10**9, 0):
        got = op1.find_leaks(docs, bench, broadcast_chars=chars).collect()
        assert {(r.doc_id, r.item_id, r.kind) for r in got} == want and len(got) == 3
        by = {r.doc_id: r.coverage for r in got}
        assert by[1] > 0.95 and by[2] > 0.8 and by[6] < by[2]
    assert op1.find_leaks(docs.limit(0), bench).count() == 0 and op1.find_leaks(docs, bench.limit(0)).count() == 0


def test_op1_exact_copies_names_and_long_runs(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(59))
    bench = spark.createDataFrame([(1, "What is 12 * 7?"), (2, "What is the capital of France?"), (3, long)], "item_id long, text string")
    docs = make(spark, ["They asked: What is 12 * 7? Nobody knew", "then she asked, What is the capital of France? of him", "then she asked, What is the capital of Spain? of him", "so " + " ".join(long.split()[20:45]) + " it ended", "so " + " ".join(long.split()[20:30]) + " it ended", "What is 13 * 7?"])
    for chars in (10**9, 0):
        got = {(r.doc_id, r.item_id, r.kind) for r in op1.find_leaks(docs, bench, broadcast_chars=chars).collect()}
        assert got == {(0, 1, "verbatim"), (1, 2, "verbatim"), (2, 2, "reparameterised"), (3, 3, "verbatim")}


def test_op1_slots_decide(spark):
    """Sentence-initial names are slots; values that don't hold throughout void their windows."""
    short, item = "Alice has 3 apples and buys 5 pears", "Bob drives from Paris to Rome at 40 km per hour and then from Paris to Oslo in 7 hours with Paris asleep"
    bench = spark.createDataFrame([(1, short), (2, item)], "item_id long, text string")
    texts = [
        "Robert has 7 apples and buys 9 pears",
        "It rained. Robert has 7 apples and buys 7 pears. So what",
        item.replace("Paris", "Bonn").replace("40", "50"),
        "Carl drives from Bonn to Kiel at 50 km an hour and then from Ulm to Mainz in 9 hours with Essen asleep",
        item.replace("to Oslo", "to Rome"),
        "The cat has many apples and buys a few pears",
    ]
    for chars in (10**9, 0):
        got = {(r.doc_id, r.item_id): (r.kind, r.coverage) for r in op1.find_leaks(make(spark, texts), bench, broadcast_chars=chars).collect()}
        assert {k: v[0] for k, v in got.items()} == {(0, 1): "reparameterised", (1, 1): "reparameterised", (2, 2): "reparameterised", (4, 2): "verbatim"}
        assert got[0, 1][1] == got[2, 2][1] == 1.0 and got[4, 2][1] < 1
    consistent = texts[3].replace("Ulm", "Bonn").replace("Essen", "Bonn")
    assert [(r.doc_id, r.kind) for r in op1.find_leaks(make(spark, [texts[3], consistent]), bench).collect()] == [(1, "reparameterised")]


# --- 2 -------------------------------------------------------------------------------------------------------------------------------


def test_op2_pages(spark):
    para = "Some words of the article that go on for a while, as paragraphs do, and on."
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header class=top><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies.</div><div id=main><h1>Head &amp; line</h1><p>{para}<p>Second  <b>bold</b> <a href=x>link</a>
    {para}<ul><li>one<li>two</ul><script>if (a < b) "</p>"</script></div><aside>{para}</aside><form>Name <input></form><div id=comments><p>{para} {para} {para}</p></div><footer>end</footer>"""
    got = op2.extract(page).split("\n\n")
    assert got == ["Head & line", para, "Second bold link " + para, "one", "two"]
    assert op2.extract(None) == op2.extract("") == op2.extract("<div></div>") == "" and op2.extract("plain  text") == "plain text"
    assert op2.extract("<!-- open") == "" and op2.extract("<p>a<!-- x --> b</p>") == "a b"
    assert op2.extract("<div class=menu>only this</div>") == "only this"
    assert len(op2.extract("<div>" * 3000 + "deep text" + "</div>" * 3000)) == 9
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "y"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    rows = {(r.page_id, r.url, r.n_chars) for r in op2.extract_text(df, ["page_id", "url"]).collect()}
    assert rows == {(1, "u", len("\n\n".join(got))), (2, None, 0)}


def test_op2_keeps_the_whole_article_without_landmarks():
    words = "words of a paragraph that goes on "
    long, short = (words * 9).strip(), (words * 3).strip()
    three, items = [f"{i} {long}" for i in range(3)], [f"{i} {short}" for i in range(20)]
    tags = lambda tag, texts: "".join(f"<{tag}>{x}</{tag}>" for x in texts)
    menu = "<ul><li><a href=/a>First</a></li><li><a href=/b>Second</a></li></ul><div class=sidebar><p>" + long + "</p></div>"
    page = lambda inner: f"<body>{menu}{inner}<footer>end</footer></body>"
    assert op2.extract(page(f"<div>{tags('p', three)}<ul>{tags('li', items)}</ul></div>")).split("\n\n") == three + items
    assert op2.extract(page(f"<h1>Title</h1><div>{tags('p', three)}</div>")).split("\n\n") == ["Title", *three]
    sections = "".join(f"<section><h2>Part {i}</h2>{tags('p', x)}</section>" for i, x in enumerate((three, ["Short."], three * 4)))
    assert op2.extract(page(f"<div>{sections}</div>")).split("\n\n") == ["Part 0", *three, "Part 1", "Short.", "Part 2", *three * 4]
    table = "<table><tr><th>A</th><th>B</th></tr>" + "".join(f"<tr><td>{i}</td><td>{short}</td></tr>" for i in range(30)) + "</table>"
    assert op2.extract(page(f"<div>{tags('p', three)}{table}<p>Last.</p></div>")).split("\n\n") == [*three, "A B", *(f"{i} {short}" for i in range(30)), "Last."]
    assert op2.extract(page(f"<article>{tags('p', three)}</article><article><p>Short.</p></article>")).split("\n\n") == [*three, "Short."]


def test_op2_forms_weak_names_and_title_headers():
    para = ["Some words of the article that go on for a while, as paragraphs do, and on.", "More of them in a second paragraph, which is about as long as the first one was."]
    body = "".join(f"<p>{p}</p>" for p in para)
    menu = "<div class=nav><a href=/>Home</a> <a href=/a>About</a></div>"
    # A form around the whole page, as some servers write it, with a form of fields inside.
    page = f"<html><body><form id=aspnet>{menu}<div id=x><h1>Title</h1>{body}<div class=search-form>Find <input></div></div><div class=footer>end</div></form></body></html>"
    assert op2.extract(page).split("\n\n") == ["Title", *para]
    assert op2.extract(f"<body><article><h1>T</h1>{body}</article><form>Your name <input> Your mail <input></form></body>").split("\n\n") == ["T", *para]
    # Sections whose names hold words of boilerplate.
    for name in ('class="results-and-discussion"', 'id="discussion"', 'class="notification-settings"'):
        got = op2.extract(f"<body>{menu}<article><h1>T</h1><p>{para[0]}</p><section {name}><h2>Part</h2><p>{para[1]}</p></section></article></body>")
        assert got.split("\n\n") == ["T", para[0], "Part", para[1]], name
    for name in ('class="comments"', 'class="social-sharing"', 'id="sidebar-left"', 'class="cookie-consent"', 'class="login-form"'):
        assert op2.extract(f"<body>{menu}<article><h1>T</h1>{body}</article><div {name}><p>{para[0]} {para[1]}</p></div></body>").split("\n\n") == ["T", *para], name
    # A header by name that holds the title of the article, and one of the site.
    assert op2.extract(f'<body>{menu}<article><div class="page-header"><h1>Title</h1></div>{body}</article></body>').split("\n\n") == ["Title", *para]
    assert op2.extract(f'<body><div class="page-header"><h1>Site</h1></div><article><h1>Title</h1>{body}</article></body>').split("\n\n") == ["Title", *para]


def test_op2_names_and_links_inside_an_article():
    para = "Some words of the article that go on for a while, as paragraphs do, and on."
    names = "share-price form-factor legal-news follow-up related-work search-history skip-lists rail-transport top-story notice-period".split()
    kept = "".join(f'<div class="{x}"><p>{i} {para}</p></div>' for i, x in enumerate(names))
    gone = "".join(f'<div class="{x}"><p>{para}</p></div>' for x in "share-buttons related-posts search-box follow-us comments menu site-header sidebar-left legal ad-slot".split())
    two = '<p><a href="/a">One link</a> and <a href="/b">another</a>.</p>'
    got = op2.extract(f"<body><article><h1>T</h1>{kept}{gone}{two}<p><a href=/>Prev</a> | <a href=/>Next</a></p></article></body>").split("\n\n")
    assert got == ["T", *(f"{i} {para}" for i in range(len(names))), "One link and another."]
    assert op2.extract("<p>" + "word " * 400_000 + "</p>").count("word") == 400_000


# --- 3 -------------------------------------------------------------------------------------------------------------------------------


def brute_links(rows, k=4):
    sets = []
    for _, t in rows:
        w = low(t).encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(i)), default=None)
        out.append((d, len(sets[i]), c, d is None or c == d))
    return sorted(map(str, out))


def test_op3_links(spark):
    r = random.Random(5)
    texts = []
    for _ in range(14):
        base = prose(r, 60).split(" ")
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = prose(r, 1)
            texts.append(" ".join(copy))
    texts += [None, "", " \n", "two words", "TWO\twords", "a b c d", "a b c d", texts[0], texts[0].upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[0])]
    got = op3.link_documents(make(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
    assert sorted(str((x.doc_id, x.n_shingles, x.component_id, x.kept)) for x in got) == brute_links(rows)
    assert op3.link_documents(make(spark, ["x"]).limit(0)).count() == 0


def test_op3_one_id_with_different_texts(spark):
    r = random.Random(15)
    a, b = prose(r, 50), prose(r, 50)
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (5, prose(r, 50)), (5, b), (7, a), (1, b), (9, " ".join(prose(r, 1) + str(i) for i in range(30_000)))]
    got = op3.link_documents(make(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
    want = {1: {1}, 2: {1}, 3: {1}, 5: {1, 5}, 7: {1}, 9: {9}}
    assert {d: {x.component_id for x in got if x.doc_id == d} for d in want} == want and len(got) == len(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_op3_large_group_and_blocks(spark, monkeypatch):
    r = random.Random(9)
    base, rows = [prose(r, 1) + str(i) for i in range(40)], []
    for i in range(120):
        copy = list(base)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(40)] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(op3, "BLOCK_U", 7)
    monkeypatch.setattr(op3, "BLOCK_M", 11)
    got = op3.link_documents(make(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
    assert sorted(str((x.doc_id, x.n_shingles, x.component_id, x.kept)) for x in got) == brute_links(rows)


def test_op3_band_recall():
    r = np.random.default_rng(1)
    found = 0
    for _ in range(200):
        a = r.integers(0, 2**63, 90, dtype=np.uint64)
        b = np.concatenate([a[:80], r.integers(0, 2**63, 10, dtype=np.uint64)])
        v = op3.bands(*op3.signatures(np.concatenate([a, b]), np.array([90, 90])))
        found += bool((v[0] == v[1]).any())
    assert found == 200


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 100)] + [(200, 201)]
    got = dict(map(tuple, op3.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 101: 0, 103: 0, 200: 200, 201: 200}


# --- 4 and 8 -------------------------------------------------------------------------------------------------------------------------


def labelled(spark, n=600):
    r = random.Random(2)
    texts, labels = [], []
    for i in range(n):
        t = prose(r, r.randint(30, 120))
        bad = i % 4 == 0
        if bad:
            w = t.split(" ")
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["scumbag", "moronic", "vileling" + str(r.randint(0, 99))])
            t = " ".join(w)
        texts.append(t)
        labels.append((i, int(not bad), int(bad)))
    return texts, labels


def test_op4_finds_toxic_texts(spark):
    texts, labels = labelled(spark)
    docs = make(spark, [*texts, None, ""], [*range(len(texts)), 9001, 9002])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = op4.fit(docs, lab)
    got = {r.doc_id: r for r in op4.score(docs, *model).collect()}
    assert len(got) == len(texts) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert got[9001].score == got[9002].score < 0.5
    kept = op4.keep_ordinary(docs, *model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}
    none = op4.score(docs, *op4.fit(docs, lab.limit(0)))
    assert {r.score for r in none.collect()} == {0.0}


def test_op4_is_two_kneser_ney_models(spark):
    """Probabilities sum to one, and evidence equals a plain dictionary version with the same symbols, discounts and backoff."""
    r = random.Random(14)
    vocab = "alpha beta gamma delta rarely rarest stemming stemmed stemmer".split()
    texts = [(i % 2, " ".join(r.choice(vocab + (["nasty", "vile"] if i % 2 else [])) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(1, "onlyonce nasty"), (0, "")]
    model = op4.count_models(spark.createDataFrame(texts, "y int, text string").repartition(3), chance=1e-3)
    k = model.symbols.size
    for c in (0, 1):
        for v in range(k + 1):
            assert abs(model.probability(v * k + np.arange(k), c).sum() - 1) < 1e-9
    words = [t.split() for _, t in texts]
    df = collections.Counter((w, y) for (y, _), ws in zip(texts, words) for w in set(ws))
    total = [sum(n for (_, y), n in df.items() if y == c) for c in (0, 1)]
    cut = op4.least_count(total[1] / sum(total), sum(total), 1e-3)
    both = lambda w: df[w, 0] + df[w, 1]
    stems = collections.Counter()
    for w in {w for w, _ in df}:
        if both(w) < cut:
            stems[w[:5]] += both(w)
    name = lambda w: w if both(w) >= cut else w[:5] + "*" if stems[w[:5]] >= cut else "?"
    names = {w for w, _ in df if both(w) >= cut} | {x + "*" for x, n in stems.items() if n >= cut} | {"?"}
    pairs_of = lambda ws: {(a, b) for a, b in zip(["^", *map(name, ws)], map(name, ws))}
    pairs = [collections.Counter(p for (y, _), ws in zip(texts, words) if y == c for p in pairs_of(ws)) for c in (0, 1)]
    single = [collections.Counter(x for (y, _), ws in zip(texts, words) if y == c for x in set(map(name, ws))) for c in (0, 1)]
    shared = collections.Counter(b for _, b in set(pairs[0]) | set(pairs[1]))
    d = lambda counts: op4.discount(sum(n == 1 for n in counts), sum(n == 2 for n in counts))

    def mixed(counts, dis, n, below):
        p = {x: max(counts[x] - dis, 0) / n for x in names}
        return {x: p[x] + (1 - sum(p.values())) * below[x] for x in names}

    base = mixed(shared, d(shared.values()), sum(shared.values()), dict.fromkeys(names, 1 / len(names)))
    dw = [d([n for (_, y), n in df.items() if y == c]) for c in (0, 1)]
    one = [mixed(single[c], dw[c], sum(single[c].values()), base) for c in (0, 1)]
    cut2 = op4.least_count(total[1] / sum(total), sum(map(lambda p: sum(p.values()), pairs)), 1e-3)
    assert k == len(names) and cut == cut2 > 2

    def prob(a, b, c):
        dis, n = d(pairs[c].values()), max(sum(m for (x, _), m in pairs[c].items() if x == a), 1)
        kept = {y: max(pairs[c][a, y] - dis, 0) / n for y in names if pairs[0][a, y] + pairs[1][a, y] >= cut2}
        return kept.get(b, 0) + (1 - sum(kept.values())) * one[c][b]

    new = ["alpha nasty beta", "unseen words", "", "vile vile vile stemmed stemming nasty", "onlyonce"]
    got = model.evidence(*joined_texts(pa.array(new)))
    for t, e in zip(new, got):
        lr = [np.log(prob(a, b, 1) / prob(a, b, 0)) for a, b in pairs_of(t.split())]
        want = (np.mean(lr), len(lr), sum(max(x - np.median(lr) - op4.STANDS, 0) for x in lr)) if lr else (0, 0, 0)
        assert np.allclose(e, want)


def test_op8_finds_junk(spark):
    r = random.Random(3)
    texts, labels = [], []
    for i in range(500):
        t = prose(r, r.randint(20, 300))
        texts.append(t if i % 5 else "!! ".join(t.upper().split(" ")))
        labels.append((i, int(i % 5 > 0), 0))
    docs = make(spark, [*texts, None, ""], [*range(500), 9001, 9002])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in op8.score(docs, op8.fit(docs, lab)).collect()}
    held = [(got[i].predicted, y) for i, y, _ in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95 and got[9001].score == got[9002].score
    assert {x.score for x in op8.score(docs, op8.fit(docs, lab.filter("quality = 1"))).collect()} == {1.0}


def test_op8_gradient_and_cover():
    net = op8.ByteNet()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    chunks, first, y, w = r.integers(0, 256, (5, op8.CHUNK)).astype(np.uint8), np.array([0, 3]), np.array([1.0, 0.0]), np.ones(2)

    def loss():
        best, _ = net.respond(chunks)
        h, _ = net.pooled(best, first)
        z = h @ net.p["v"] + net.p["c"]
        return float((np.logaddexp(0, z) - y * z).sum())

    g = net.step(chunks, first, y, w)
    for k in ("w", "v", "b", "c"):
        i = tuple(x // 2 for x in net.p[k].shape)
        net.p[k][i] += 1e-5
        up = loss()
        net.p[k][i] -= 2e-5
        down = loss()
        net.p[k][i] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-3
    for n in (0, 1, 511, 512, 513, 5000):
        st = op8.chunk_starts(n)
        assert st[0] == 0 and st[-1] + op8.CHUNK >= n and (np.diff(st) <= op8.CHUNK - 4).all()
    for n in (1, 16, 17, 95, 500):
        assert set(np.concatenate([op8.training_chunks(np.arange(n), e) for e in range(op8.EPOCHS)])) == set(range(n))


def test_op8_scores_as_a_plain_version():
    """The probability from all bytes, chunk by chunk, response by response."""
    net, r = op8.ByteNet(), np.random.default_rng(2)
    texts = ["", "abc", "some words of a text, " * 60, "".join(map(chr, r.integers(32, 300, 1500)))]
    got = net.probability(*joined_texts(pa.array(texts)))
    for t, p in zip(texts, got):
        data, best = t.encode(), []
        for s in op8.chunk_starts(len(data)):
            chunk = data[s : s + op8.CHUNK].ljust(op8.CHUNK, b"\0")
            z = [np.concatenate([net.p["e"][c] for c in chunk[i : i + op8.WIDTH]]) @ net.p["w"] + net.p["b"] for i in range(0, op8.CHUNK - op8.WIDTH + 1, op8.STRIDE)]
            best.append(np.maximum(np.max(z, axis=0), 0))
        h = np.concatenate([np.max(best, axis=0), np.mean(best, axis=0)])
        assert abs(1 / (1 + np.exp(-(h @ net.p["v"] + net.p["c"][0]))) - p) < 1e-4


def test_learned_scores_ignore_order_and_repeats(spark):
    texts, labels = labelled(spark, 200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = op4.score(make(spark, texts), *op4.fit(make(spark, texts), lab))
    b = op4.score(make(spark, texts).repartition(5), *op4.fit(make(spark, texts).repartition(5), lab))
    assert {r.doc_id: round(r.score, 9) for r in a.collect()} == {r.doc_id: round(r.score, 9) for r in b.collect()}


# --- 5 -------------------------------------------------------------------------------------------------------------------------------


def test_op5_base_and_model(spark):
    r = random.Random(4)
    texts = [prose(r, r.randint(1, 150)) for _ in range(120)] + [None, "", " \t", "É ǅ 漢字 emoji 😀", prose(r, 2000)]
    rows = [*enumerate(texts), (3, texts[3]), (None, "the of")]
    docs = make(spark, [t for _, t in rows], [i for i, _ in rows])
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts, ends = collections.Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update(low(t).encode().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for common in (op5.COMMON, 5):
        base, total = op5.base_scores(docs.selectExpr("doc_id", "coalesce(doc_id, 0) id", "coalesce(text, '') text").withColumn("key", op5.row_key()).withColumn("train", op5.crc_mod("doc_id", 10) != 0), common)
        assert total == n
        got = {(x.doc_id, round(x.base_score, 6)): (x.n_tokens, x.n_known, x.times) for x in base.collect()}
        for i, t in rows:
            w = low(t).encode().split()
            s = sum(np.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[x] for x in w), ends])
            assert got[i, round(s, 6)][:2] == (len(w) + 1, 1 + sum(counts[x] > 0 for x in w))
    out = op5.score_documents(docs, op5.pieces()).collect()
    assert len(out) == len(rows) and all(x.score < 0 and x.held_out == held(x.doc_id) and x.train_tokens == n for x in out)
    assert len({x.score for x in out if x.doc_id == 3}) == 1


def test_op5_scores_each_id_once_and_sums_to_one():
    r = np.random.default_rng(0)
    prior = op5.priors(r.integers(0, 3, (op5.VOCAB, op5.VOCAB)))
    net, place = op5.Attention(), np.arange(op5.VOCAB)
    net.p["w"] = r.normal(0, 0.3, net.p["w"].shape).astype(np.float32)
    h = net.hidden(r.integers(0, op5.VOCAB, (1, 5)))[0][0, 4:5]
    p = np.exp(net.log_probs(np.repeat(h, op5.VOCAB, 0), np.full(op5.VOCAB, 7), np.arange(op5.VOCAB), prior).astype(float))
    assert abs(p.sum() - 1) < 1e-4
    for n in (1, op5.WINDOW, op5.WINDOW + 1, 100):
        ids = r.integers(0, op5.VOCAB, n).astype(np.uint16)
        want = 0.0
        for i in range(n):  # the window that scores place i, alone
            s = next(int(s) for s in op5.window_plan(n) if i < s + op5.WINDOW)
            before = np.array([op5.END if j == 0 else int(ids[j - 1]) for j in range(s, i + 1)])[None]
            want += float(net.log_probs(net.hidden(before)[0][0, -1:], before[0, -1:], ids[i : i + 1].astype(np.int64), prior)[0])
        assert abs(op5.score_texts(net, prior, place, [ids])[0] - want) < 1e-3 * max(1, abs(want))


def test_op5_trains_on_every_window_once():
    r = np.random.default_rng(3)
    texts = [np.append(r.integers(0, 256, n), op5.END).astype(np.uint16) for n in (0, 1, 22, 23, 24, 70, 700)]
    seen = []
    for r_ in range(op5.ROUNDS):
        for i, t in enumerate(texts):
            before, target, inside = op5.training_windows(t.astype(np.int64), op5.END, (r_ - (i * 31 - 5)) % op5.ROUNDS, op5.ROUNDS)
            seen += zip(before[inside].tolist(), target[inside].tolist())
    want = sorted((a, b) for t in texts for a, b in zip([op5.END, *t[:-1].tolist()], t.tolist()))
    assert sorted(seen) == want


def test_op5_padding_has_no_gradient():
    r = np.random.default_rng(5)
    net, prior = op5.Attention(), op5.priors(r.integers(0, 3, (op5.VOCAB, op5.VOCAB)))
    before, target, inside = op5.training_windows(r.integers(0, op5.VOCAB, 10), op5.END, 0, 1)
    lp, g = net.gradient(before, target, prior, inside)
    lp10, g10 = net.gradient(before[:, :10], target[:, :10], prior, inside[:, :10])
    assert abs(lp - lp10) < 1e-5 and all(np.allclose(g[k], g10[k], atol=1e-6) for k in g)


def test_op5_subwords():
    sub = op5.Subwords(op5.pieces())
    texts = ["The cat", "", "é漢 x  y", "the the THE"]
    flat, size = sub.texts(*joined_texts(pa.array(texts)))
    for t, ids in zip(texts, np.split(flat, np.cumsum(size)[:-1])):
        assert ids.tolist() == [i for w in low(t).split() for i in sub.word(w)] + [op5.END]


# --- 6 -------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [1, 8])
def test_op6_exact(spark, monkeypatch, few):
    monkeypatch.setattr(op6, "SHARD", 130)
    monkeypatch.setattr(op6, "FEW", few)
    r = np.random.default_rng(6)
    x = r.normal(0, 0.2, (700, 8))
    x[50:90] = x[50]  # ties
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)] + [(701, None, 1), (702, [None] * 8, 1), (703, [float("nan")] * 8, 1), (None, x[0].tolist(), 1), (704, [0.1, 0.2], 1), (100, x[100].tolist(), 1), (705, x[50].tolist(), 1), (705, x[50].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(4)
    ok = [(i, np.array([*np.floor(1024 * np.array(v)), *[0] * (8 - len(v))])) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = set()
    for i, q in {i: q for i, q in ok if i % 100 == 0}.items():
        best = sorted((-int(q @ v), j) for j, v in ok if j != i)[:10]
        want |= {(i, k, j, -s) for k, (s, j) in enumerate(best, 1)}
    assert {tuple(t) for t in op6.top_k(df).collect()} == want
    assert op6.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 8])
def test_op6_large_components_and_two_vectors_of_one_id(spark, monkeypatch, few):
    """Against Python's integers, without any bound on components; the index serves them all."""
    from fractions import Fraction

    monkeypatch.setattr(op6, "FEW", few)
    r = np.random.default_rng(8)
    rows = [(0, [1e9, 2e9]), (0, [1.0, -1.0]), (0, [1.0, -1.0]), (0, [1 / 1024, 0.0]), (0, [-3e200, 7.0]), (1, [3e9, 1e9]), (2, [2e9, 2e9]), (3, [1e300, -1.0]), (4, [0.5, 0.25]), (5, [2e9, 2e9]), (6, []), (7, [2.0**50, 0.0]), (8, [2.0**49, 0.0]), (9, [-0.0, -1e-9]), (10, [2.0**53 - 1, 0.0]), (11, [-(2.0**53), 1.0]), (12, [-1e300, 2.0])]
    rows += [(20 + i, (r.normal(0, 1, 2) * 10.0 ** r.integers(-3, 18, 2)).tolist()) for i in range(75)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ints = [(i, [int(Fraction(x) * 1024 // 1) for x in v] + [0] * (2 - len(v))) for i, v in rows]
    want = []
    for q in {tuple(v) for i, v in ints if i == 0}:
        best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ints if i != 0)[:10]
        want += [(0, k, i, max(min(-s, 2**63 - 1), -(2**63))) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, op6.top_k(df).collect())) == sorted(want)
    two = spark.createDataFrame([(0, [1 / 1024, 0.0]), (1, [2.0**50, 0.0]), (2, [2.0**49, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((x.vec_id, x.score) for x in op6.top_k(two).collect()) == [(1, 2**60), (2, 2**59)]


# --- 7 -------------------------------------------------------------------------------------------------------------------------------


def test_op7_matches_the_library(spark):
    from tokenizers import Tokenizer

    src = op7.tokenizer_source()
    lib, r = Tokenizer.from_str(src), random.Random(8)
    al = "abcdethinoraußüéñ''sdm12.,-|<>  \n\t\x1c ́漢"
    texts = ["".join(r.choice(al) for _ in range(r.randint(0, 200))) for _ in range(80)]
    texts += [None, "", " ", "x<|endoftext|>y", "it" * 900, "".join(r.choice("inthaero") for _ in range(2000)), "a" * 500 + " b " + "ß1" * 400, "<|endoftext|>" * 30 + "z" * 99]
    docs = make(spark, [*texts, texts[-1]], [*range(len(texts)), len(texts) - 1])
    for segment, leaf in ((1 << 15, 64), (100, 16)):
        want = []
        for i, t in [*enumerate(texts), (len(texts) - 1, texts[-1])]:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = op7.encode_documents(docs, src, segment=segment, leaf=leaf, digests=True)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    full = op7.encode_documents(docs, src).filter("doc_id = 0").first()
    assert full.ids == lib.encode(texts[0], add_special_tokens=False).ids and full.decoded == lib.decode(full.ids, skip_special_tokens=False)


# --- 9 -------------------------------------------------------------------------------------------------------------------------------


def brute_windows(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_op9_exact(spark):
    r = random.Random(10)
    shared = prose(r, 50)
    texts = [prose(r, r.randint(0, 90)) for _ in range(25)]
    texts += [prose(r, 5) + " " + shared + "\n" + prose(r, 9) for _ in range(4)] + [shared + " " + prose(r, 20) + " " + shared, "go " * 120, "go " * 34, None, "", texts[0], texts[0] + " x", prose(r, 60), "a b " * 40]
    texts += [texts[-3]]
    docs = make(spark, texts)
    for window, gram, batches in ((35, 12, 2), (8, 3, 4)):
        want = brute_windows(texts, window)
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in op9.dedup_substrings(docs, window, gram, batches).collect()}
        assert got == {i: w[:3] for i, w in enumerate(want)}
        cut = op9.without_repeats(docs, window, gram, batches)
        assert cut.columns == docs.columns
        assert {x.doc_id: x.text for x in cut.collect()} == {i: w[3] if w[1] else t for i, (w, t) in enumerate(zip(want, texts))}
    assert op9.dedup_substrings(docs.limit(0)).count() == 0


def test_op9_index_is_incremental(spark):
    index = op9.FingerprintIndex(spark, buckets=3, fan_in=2)
    frame = lambda x: spark.createDataFrame([(h,) for h in x], "h long")
    hits = lambda x: sorted(r.h for r in index.add(frame(x)).collect())
    assert hits([1, 2, 2, 3]) == [2] and hits([3, 4]) == [3] and hits([5, 1, 4]) == [1, 4] and hits([6]) == []
    assert [level for level, _ in index.runs] == [2]
    index.save()
    again = op9.FingerprintIndex.open(spark, index.path)
    assert dict(map(tuple, again.history().collect())) == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1}
    index.drop()


def test_op9_sessions_share_an_index(spark):
    """A passage once in an earlier session and once in a later one goes from the later one; a reopened, compacted index says what brute force says of all."""
    r = random.Random(21)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    shared, twice = words(40), words(36)
    sessions = [
        [words(80), words(9) + " " + shared + " " + words(7), twice + " " + words(50)],
        [words(5) + " " + shared, words(60), None, "", words(3) + " " + twice + " " + words(44) + " " + twice],
        [shared + " " + words(2), words(30)],
    ]
    sessions[2].append(sessions[0][0])
    path, seen, sizes = None, [], []
    for texts in sessions:
        index = op9.FingerprintIndex(spark, buckets=2) if path is None else op9.FingerprintIndex.open(spark, path)
        path = index.path
        ids = list(range(len(seen), len(seen) + len(texts)))
        seen += texts
        want = {i: w[:3] for i, w in enumerate(brute_windows(seen, 35))}
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in op9.dedup_substrings(make(spark, texts, ids), batches=2, index=index).collect()}
        assert got == {i: want[i] for i in ids}
        sizes.append(len(index.runs))
    assert sizes == [2, 2, 2] and max(level for level, _ in index.runs) == 1  # six runs, of which three and then two more were compacted
    again = op9.FingerprintIndex.open(spark, path)
    assert again.runs == index.runs and len(again.sessions) == 3
    index.drop()


def test_op9_compacts_in_the_query(spark, monkeypatch):
    merged = []
    compact = op9.FingerprintIndex.compact

    def counted(self):
        before = len(self.runs)
        compact(self)
        merged.append(before - len(self.runs))

    monkeypatch.setattr(op9.FingerprintIndex, "compact", counted)
    assert op9.dedup_substrings(make(spark, ["a b c " * 40, "x y z", "q " * 60])).count() == 3
    assert merged == [0, 0, 2, 0]


# --- 10 ------------------------------------------------------------------------------------------------------------------------------


def test_op10_counts(spark):
    pieces = op10.vocabulary()
    first, more = map(set, op10.split_vocabulary(pieces))

    def brute(w):
        i = n = 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in (more if i else first)), 0)
            if not j:
                return None
            i, n = j, n + 1
        return n

    r = random.Random(12)
    texts = [prose(r, 30), None, "", "☃☃ snow", "unbelievable tokenization of\tZusammenhänge", "x" * 5000, "\x1cfoo bar", "x" * 200 + " " + "token" * 2000 + " y", "ab☃" * 300 + " ab"]
    got = {x.doc_id: (x.n_words, x.n_tokens, x.n_unknown) for x in op10.count_tokens(make(spark, texts), pieces).collect()}
    for i, t in enumerate(texts):
        c = [brute(w) for w in WORD.findall(t or "")]
        assert got[i] == (len(c), sum(1 if x is None else x for x in c), c.count(None))
    assert op10.count_tokens(make(spark, texts).limit(0), pieces).count() == 0
    auto, some = op10.Automaton(*op10.split_vocabulary(pieces)), [w for t in texts for w in WORD.findall(t or "")]
    assert [auto.count(w) for w in some] == auto.counts(some).tolist()
    assert auto.count("e" * 3_000_000) > 0  # linear in the word, not a step of an array each character


# --- pipeline ------------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = op9.written(stage(spark, docs, SF), "test")
        if name != "bpe_encoding":
            assert out.columns == docs.columns
        seen.append({r.doc_id for r in out.select("doc_id").collect()})
        assert seen[-1] <= seen[-2] and (seen[-1] == seen[-2] or name in ("toxicity", "minhash_near_dedup", "benchmark_decontamination"))
        docs = out
    whole = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(seen[-1]) > 0.7 * len(whole) and re.fullmatch("[0-9a-f]{64}", docs.first().ids_sha256)


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() against plain versions of the five stages on documents with nulls, empty texts, repeated rows and clashing columns."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    r = random.Random(31)
    bench = ["A farmer has 12 cows and sells 5 of them on Monday for 300 dollars each, how many remain", "Which river flows through the old town of Weimar before it reaches the sea in spring"]
    shared = prose(r, 60)
    texts, labels = labelled(spark, 200)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(300, None), (301, ""), (302, rows[1][1]), (303, rows[2][1] + " end"), (1, rows[1][1]), (304, prose(r, 30) + " " + bench[0] + " " + prose(r, 30)), (305, prose(r, 20) + " " + bench[1].replace("Weimar", "Gotha"))]
    rows += [(310 + i, prose(r, 20) + " " + shared + " " + prose(r, 20)) for i in range(3)] + [(None, prose(r, 40))]
    # Rows of one id with different texts, copies among them, rows without an id, repeated rows; leaks whose id is another row's too.
    a, b, c, d = prose(r, 40), prose(r, 40), prose(r, 40), prose(r, 40)
    rows += [(400, a), (405, b), (405, a + " end"), (407, b), (407, b), (None, c), (None, c), (408, d), (408, d), (None, d), (409, ""), (409, "")]
    rows += [(410, prose(r, 30)), (410, prose(r, 20) + " " + bench[0]), (None, prose(r, 25) + " " + bench[1].replace("Weimar", "Jena"))]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key long, at string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([*enumerate(bench), (9, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256").collect()))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model, curve = op4.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    p = op4.probabilities(model, curve, pa.array([t for _, t in rows], pa.string()))
    kept = [x for x, q in zip(rows, p) if q < 0.5]
    assert {i for i, _ in rows} - {i for i, _ in kept} >= {i for i, _, y in labels if y} - {1}
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0))
    links = sorted((eval(x) for x in brute_links([(n, t) for n, (_, t) in enumerate(kept)], 5)))  # noqa: S307
    assert [x[0] for x in links] == list(range(len(kept)))
    kept = [x for x, link in zip(kept, links) if link[3]]
    assert [t for _, t in kept].count(b) == [t for _, t in kept].count(c) == [t for _, t in kept].count(d) == 1 and (408, d) in kept and kept.count((409, "")) == 2
    cut = brute_windows([t for _, t in kept], 35)
    kept = [(i, w[3] if w[1] else t) for (i, t), w in zip(kept, cut)]
    assert sum(w[1] > 0 for w in cut) >= 3
    before = len(kept)
    asked = re.compile("|".join(re.escape(b).replace("Weimar", r"\w+") for b in bench))
    kept = [(i, t) for i, t in kept if not asked.search(t or "")]
    assert len(kept) == before - 4 and 410 in [i for i, _ in kept]
    lib = Tokenizer.from_str(op7.tokenizer_source())
    want = []
    for i, t in kept:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append(str((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())))
    as_tuple = [re.sub(r"^Row\(doc_id=(.*), n_tokens=(.*), ids_sha256=(.*)\)$", r"(\1, \2, \3)", x) for x in got]
    assert sorted(as_tuple) == sorted(want)


def test_empty_tables(spark, tmp_path):
    """No operator fails on tables without rows, and none makes rows of nothing."""
    import corpus_pipeline
    from conftest import SF
    from quire.llm.queries import QUERIES

    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, q in {**QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert q(spark, str(tmp_path)).count() == 0, name


def test_long_texts(spark):
    """A text of a million characters among short ones, through the operators that meet texts whole."""
    r = random.Random(33)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(180_000))
    docs = make(spark, [long, "short text of five words", long + " end"])
    assert {x.component_id for x in op3.link_documents(docs).collect()} == {0, 1}
    assert sum(x.n_removed for x in op9.dedup_substrings(docs).collect()) == 2 * 180_000
    item = " ".join(long.split()[500:560])
    assert {x.doc_id for x in op1.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {0, 2}
    assert [x.n_words for x in op10.count_tokens(docs, op10.vocabulary()).collect() if x.doc_id == 0] == [180_000]
