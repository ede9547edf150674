"""Trees of wrong and right mark-up, edits on the source of pages, and running totals of a stream with keyed state."""

import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import html_edits
from quire.sources.html import html_blocks
from quire.sources.tree import Builder, Text, decoded, nodes, outline

STANDARD = "<!doctype html>"
#: Mark-up and the tree that the HTML standard gives it.
TREES = [
    ("<b>1<p>2</b>3</p>", "b('1') p(b('2') '3')"),
    ("<p>1<b>2<i>3</b>4</i>5</p>", "p('1' b('2' i('3')) i('4') '5')"),
    ("<a>1<div>2<a>3</a>4</div>5</a>", "a('1') div(a('2') a('3') '4') '5'"),
    ("<p><em>a<div>b</em>c</div>", "p(em('a')) div(em('b') 'c')"),
    ("<p>x<b>y</p><p>z", "p('x' b('y')) p(b('z'))"),
    ("<b><b><b><b>x</b></b></b></b>y", "b(b(b(b('x')))) 'y'"),
    ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "b b('bbb') table(tbody(tr(td('aaa')))) b('ccc')"),
    ("<em><table><tr><td>a</em>b</table>c", "em(table(tbody(tr(td('ab')))) 'c')"),
    ("<table><input type=hidden><input></table>", "input table(input)"),
    ("<table>x<tr>y<td>z</table>", "'xy' table(tbody(tr(td('z'))))"),
    ("<table><tr><tr><td>x<td>y</table>", "table(tbody(tr tr(td('x') td('y'))))"),
    ("<table><caption>k<td>x</table>", "table(caption('k') tbody(tr(td('x'))))"),
    ("<table><col><tr><td>x</table>", "table(colgroup(col) tbody(tr(td('x'))))"),
    ("<table><tr><td><table><tr><td>i</table>o</table>p", "table(tbody(tr(td(table(tbody(tr(td('i')))) 'o')))) 'p'"),
    (STANDARD + "<p>a<table>b<tr><td>c</table>d", "p('a') 'b' table(tbody(tr(td('c')))) 'd'"),
    ("<p>a<table><tr><td>c</table>d", "p('a' table(tbody(tr(td('c')))) 'd')"),
    ("<ul><li>1<li>2<ul><li>3</ul>4</ul>5", "ul(li('1') li('2' ul(li('3')) '4')) '5'"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt('a') dd('b') dt('c'))"),
    ("<h1>a<h2>b</h1>c", "h1('a') h2('b') 'c'"),
    ("a</p>b", "'a' p 'b'"),
    ("<div><p>a<div>b</div>c</p>d</div>", "div(p('a') div('b') 'c' p 'd')"),
    ("<button>a<button>b", "button('a') button('b')"),
    ("<select><option>a<option>b<p>c</select>d", "select(option('a') option('bc')) 'd'"),
    ("<svg><p>x</svg>y", "svg p('xy')"),
    ("<svg><g><title>t</title></g></svg>y", "svg(g(title('t'))) 'y'"),
    ("<pre>\n\nx</pre>", "pre('\\nx')"),
    ("a<br/>b</br>c", "'a' br 'b' br 'c'"),
    ("1 < 2 & 3 &lt 4 &amp;lt; &notit; &#65;&#x42", "'1 < 2 & 3 < 4 &lt; ¬it; AB'"),
    ("<a href='x>y'>t</a><i b=\">\">u</i>", "a('t') i('u')"),
    ("<!-->a<!--b--!>c<!x>d</>e<?f>g", "'acdeg'"),
    ("<body><p>a</body>b", "p('ab')"),
    ("x<script>if (a < b) '</p>'</script>y", "'x' script(\"if (a < b) '</p>'\") 'y'"),
    ("<textarea>\n<b>&amp;</textarea>z", "textarea('<b>&') 'z'"),
]


@pytest.mark.parametrize("source,tree", TREES)
def test_trees(source, tree):
    b = Builder(source)
    assert outline(b.body, source) == f"body({tree})"


def test_head_and_blocks():
    page = '<!DOCTYPE html><html><head><meta charset=utf-8><title>A &amp; B</title><style>p{}</style></head>\n<body><p>one<b>two<p>three</b>four<table><td>cell<div>x</table></body></html>'
    assert [(k, lv, t) for _, k, lv, t in html_blocks(page)] == [("title", 0, "A & B"), ("paragraph", None, "onetwo"), ("paragraph", None, "threefour"), ("table-cell", None, "cell"), ("paragraph", None, "x")]
    assert html_blocks("") == [] and html_blocks("<p> </p><span>no block</span>") == []
    assert [t for *_, t in html_blocks("<body>" + "<div>" * 3000 + "deep" + "</div>" * 3000)] == ["deep"]


_SOUP = st.lists(st.sampled_from(["<b>", "</b>", "<i>", "</i>", "<a>", "</a>", "<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "</td>", "</tr>", "<tbody>", "<caption>", "<col>", "<li>", "<ul>", "</ul>", "<div>", "</div>", "<h1>", "</h2>", "<select>", "<option>", "</select>", "<svg>", "</svg>", "<form>", "</form>", "<button>", "<nobr>", "<object>", "</object>", "<template>", "</template>", "<title>", "</title>", "<br>", "<!-- c -->", "x", "y z", " ", "&amp;", "&lt", "\r\n", "é", "<", "<input>", "<font color=1>", "<dd>", "<rt>", "<ruby>"]), max_size=40).map("".join)


@settings(max_examples=600, deadline=None)
@given(_SOUP)
def test_any_mark_up_makes_a_tree(source):
    b = Builder(source)
    seen, texts = set(), 0
    for e in nodes(b.root):
        assert id(e) not in seen
        seen.add(id(e))
        for k in e.kids:
            assert k.parent is e
            if isinstance(k, Text):
                for p in k.pieces:
                    text, places = decoded(source, *p)
                    assert len(places) == len(text) + 1 and places == sorted(places) and p[0] <= places[0] and places[-1] == p[1]
                    texts += text.count("x")
    if "<svg>" not in source and "<title>" not in source:
        assert texts == len(re.findall("x", re.sub(r"<[^>]*>|<!--.*?-->", "", source))) or "<" in re.sub(r"<[^>]*>", "", source)


@settings(max_examples=300, deadline=None)
@given(st.text("ab&lt;#6x\r\n", max_size=20))
def test_decoded_like_the_library(raw):
    text, places = decoded(raw, 0, len(raw), True)
    assert text == html.unescape(raw.replace("\r\n", "\n").replace("\r", "\n")) and len(places) == len(text) + 1


def test_replacement_touches_only_the_hits():
    page = "<p class='old'>The <b>old</b>&nbsp;&amp; o<i>l</i>d\r\n man, old&lt;</p><!-- old --><script>old</script><p>gold</p>"
    status, places, blocks, out = html_edits.replace_text(page, "old", "new & <b>", True)
    assert (status, places, blocks) == ("ok", 4, [1, 2])
    new = "new &amp; &lt;b&gt;"
    assert out == f"<p class='old'>The <b>{new}</b>&nbsp;&amp; {new}<i></i>\r\n man, {new}&lt;</p><!-- old --><script>old</script><p>g{new}</p>"
    assert html_edits.replace_text(page, "old", "x", False)[:2] == ("ambiguous", 4) and html_edits.replace_text(page, "none", "x", True)[0] == "not_found"
    assert html_edits.replace_text(page, "", "x", True)[0] == "invalid" and html_edits.replace_text("", "a", "b", True)[3] == ""
    assert html_edits.replace_text("<p>a &amp; b &copy; c</p>", "& b ©", "&", True)[3] == "<p>a &amp; c</p>"
    assert html_edits.replace_text("<p>one two three</p>", "one two three", "one 2 three", True)[3] == "<p>one 2 three</p>"


def test_block_edits(spark):
    page = '<body>\n  <h1 id="t">Head</h1>\n  <p id="q" class=c>one</p>\n  <p>two\n  <ul><li>i</ul>\n</body>'
    edits = [(1, 1, "retag", "h2", None), (1, 2, "insert", "a < b", None), (1, 2, "comment", "x -- y", "me"), (1, 3, "retag", "li", None), (1, 4, "delete", None, None), (1, 9, "delete", None, None), (1, 1, "delete", None, None), (2, 1, "delete", None, None), (3, None, "delete", None, None)]
    pages = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, page, "x")], "page_id long, html string, kind string")
    got = {r.page_id: r for r in html_edits.edited_pages(pages, spark.createDataFrame(edits, "page_id long, ordinal int, kind string, value string, author string")).collect()}
    assert set(got) == {1, 2} and got[2].html == "" and got[2].statuses == ["1 delete not_found"]
    assert sorted(got[1].statuses) == sorted(["1 delete ok", "1 retag protected", "2 comment ok", "2 insert ok", "3 retag unsupported", "4 delete ok", "9 delete not_found"])
    assert got[1].html == '<body>\n  <!-- 批注（me）：x — y --><p id="q" class=c>one</p>\n  <p class=c>a &lt; b</p>\n  <p>two\n  <ul></ul>\n</body>'
    again = html_edits.edited_pages(pages, spark.createDataFrame([(1, 1, "retag", "h2", None)], "page_id long, ordinal int, kind string, value string, author string")).first()
    assert again.html == page.replace('<h1 id="t">', '<h2 id="t">').replace("</h1>", "</h2>")
    empty = html_edits.edited_pages(pages.limit(0), spark.createDataFrame(edits, "page_id long, ordinal int, kind string, value string, author string"))
    assert empty.count() == 0 and html_edits.replaced_in_pages(pages.limit(0), "a", "b").count() == 0


def test_keyed_state_over_restarts(spark, tmp_path):
    """Requests out of order in three arrivals, one later than the watermark allows; every call starts the stream anew from its checkpoint."""
    from datetime import datetime, timedelta

    from quire.streaming import costs

    t0 = datetime(2026, 1, 5)
    row = lambda i, user, minutes: (i, user, t0 + timedelta(minutes=minutes, microseconds=i), "x-pro" if i % 3 else "x-flash", 1000 + i, 10 * i, i)
    arrivals = [[row(1, 1, 10), row(2, 1, 5), row(3, 2, 50), row(4, 1, 5)], [row(5, 1, 200), row(6, 2, 40), row(7, 2, 210)], [row(8, 1, 3), row(9, 1, 400), row(10, 3, 300), row(11, 1, 190)], [row(12, -1, 9000)]]
    schema = "event_id long, user_id long, ts timestamp, model string, prompt long, cached long, completion long"
    paths = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    seen = []
    for a in arrivals:
        spark.createDataFrame(a, schema).coalesce(1).write.mode("append").parquet(paths[0])
        costs.advance(spark, paths[0], spark.createDataFrame(a, schema).schema, paths[1], paths[2], late="1 hour")
        seen.append(spark.read.parquet(paths[1]).count())
    costs.advance(spark, paths[0], spark.createDataFrame(arrivals[0], schema).schema, paths[1], paths[2], late="1 hour")
    got = spark.read.parquet(paths[1]).collect()
    assert seen == sorted(seen) and len(set(seen)) > 2 and len(got) == seen[-1]
    kept = [r for a in arrivals[:3] for r in a if r[0] != 8]  # 8 comes 187 minutes after the watermark passed it
    assert {r.event_id for r in got} == {r[0] for r in kept}
    from quire.operators.control import running_totals, usage_costs

    batch = {r.event_id: r.total for r in running_totals(usage_costs(spark.createDataFrame(kept, schema)), "user_id", "ts", "event_id", "cost").collect()}
    order = {}
    for i, user, ts, *_ in sorted(kept, key=lambda r: (r[1], r[2], r[0])):
        order.setdefault(user, []).append(i)
    for r in got:
        upto = order[r.user_id][: order[r.user_id].index(r.event_id) + 1]
        assert r.total == pytest.approx(batch[r.event_id]) and r.requests == len(upto) and r.prompt == sum(1000 + i for i in upto) and r.completion == sum(upto) and r.cached == sum(10 * i for i in upto)
