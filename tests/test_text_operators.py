import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import compare, layout
from quire.operators.blocks import markdown_blocks
from quire.operators.search import find_all
from quire.sources.documents import docx_blocks
from quire.sources.html import html_blocks

CHARS = st.text(alphabet="ab '-—“ \nAé中", max_size=30)


def kinds(text):
    return [(k, lv) for _, k, lv, _ in markdown_blocks(text)]


def test_markdown_grammar():
    text = "---\ntitle: x\n---\n# One\n\npara\nmore\n- a\n- b\n| c |\n|---|\n> q\n```js\n~~~\n# no\n```\n~~~\nopen"
    assert kinds(text) == [("other", None), ("heading", 1), ("paragraph", None), ("list", None), ("list", None), ("table-cell", None), ("table-cell", None), ("quote", None), ("code", None), ("code", None)]
    assert kinds("") == [] and kinds("\r\n \r\n") == []
    assert [b[3] for b in markdown_blocks("a\r\nb\r\n\r\nc")] == ["a\nb", "c"]
    assert kinds("---\nno end") == [("paragraph", None)]


def test_find_all():
    assert find_all("aaaa", "aa") == [(0, 2, False), (2, 4, False)]
    assert find_all("x “q” y", '"q"') == [(2, 5, True)]
    assert find_all("a  \n b", "a b") == [(0, 6, True)]
    assert find_all("abc", "") == [] and find_all("abc", "  ") == []
    assert find_all("ABC abc", "abc", False) == [(0, 3, False), (4, 7, False)]


@settings(max_examples=200, deadline=None)
@given(CHARS, CHARS)
def test_hunks_rebuild_the_new_text(old, new):
    out = old
    for s, e, t in reversed(compare.hunks(old, new)):
        out = out[:s] + t + out[e:]
    fold = lambda x: "".join(" " if t.isspace() else t.translate(compare._FOLD) for t in compare._TOKEN.findall(x))
    assert fold(out) == fold(new)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_longest_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert compare._lcs(a, b) == t[-1][-1]


def test_similarity_and_core():
    assert compare.similarity("", "a") == 0 and compare.similarity("A b", "a B") == 1
    assert compare.core("Crème-brûlée  1!") == "creme brulee 1"
    assert [(i, j) for i, j, _ in compare.align(["a b c", "x y z"], ["q", "a b c", "x y w"], 0.5)] == [(0, 1), (1, 2)]


def test_html_and_docx_blocks():
    got = html_blocks("<title>T</title><h1>A &amp; B</h1><p>one<p>two <b>x</b><ul><li>i<li>j</ul><div>direct</div><script>p</script>")
    assert [(k, lv, t) for _, k, lv, t in got] == [("title", 0, "T"), ("heading", 1, "A & B"), ("paragraph", None, "one"), ("paragraph", None, "two x"), ("list", None, "i"), ("list", None, "j"), ("paragraph", None, "direct")]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    assert docx_blocks(buf.getvalue()) == [(1, "正文", "H1", "Hi"), (2, "表格1 第1行第1列", None, "c")]
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(buf, "a") as z:
        for n in (10, 2):
            z.writestr(f"word/header{n}.xml", f"<w:hdr {w}>{para(f'head {n}')}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {w}>{para('foot')}</w:ftr>")
        z.writestr("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:type="separator" w:id="0">{para("-")}</w:footnote><w:footnote w:id="1">{para("note")}</w:footnote></w:footnotes>')
    assert [b[1:] for b in docx_blocks(buf.getvalue())[2:]] == [("页眉2", None, "head 2"), ("页眉10", None, "head 10"), ("页脚1", None, "foot"), ("脚注1", None, "note")]
    nested = html_blocks("<body><ul>loose<li>one<li>two</ul>after<table><tr><td>c</table><details><summary>sum</summary>body text</details></body>")
    assert [(k, t) for _, k, _, t in nested] == [("paragraph", "looseafterbody text"), ("list", "one"), ("list", "two"), ("table-cell", "c"), ("paragraph", "sum")]
    with pytest.raises(zipfile.BadZipFile):
        docx_blocks(b"no")


def test_components_and_levels_follow_long_paths(spark):
    steps = []  # a staircase of 26 segments, 25 touches long
    for i in range(13):
        steps += [(1, 1, 2 * i, 10.0 * i, 10.0 * i, 10.0 * i + 10, 10.0 * i, True), (1, 1, 2 * i + 1, 10.0 * i + 10, 10.0 * i, 10.0 * i + 10, 10.0 * i + 10, False)]
    far = [(1, 1, 90, 900.0, 900.0, 910.0, 900.0, True), (1, 2, 5, 0.0, 0.0, 9.0, 0.0, True)]
    df = spark.createDataFrame(steps + far, "doc_id long, page int, seg int, x0 double, y0 double, x1 double, y1 double, horizontal boolean")
    got = {(r.page, r.seg): r.root for r in layout.segment_components(spark, df).collect()}
    assert got == {**{(1, s): 0 for s in range(26)}, (1, 90): 90, (2, 5): 5}
    edges = [(g, i, f"n{i}", f"n{i + 1}") for g, n in ((1, 10), (2, 25)) for i in range(n)] + [(2, 99, "n25", "n3"), (3, 0, "a", "b"), (3, 1, "b", "a"), (3, 2, "b", "c"), (3, 3, "a", "c")]
    levels = {(r.graph, r.node): r.level for r in layout.diagram_levels(spark, spark.createDataFrame(edges, "graph int, pos int, src string, dst string")).collect()}
    assert levels == {**{(g, f"n{i}"): i for g, n in ((1, 10), (2, 25)) for i in range(n + 1)}, (3, "a"): 0, (3, "b"): 1, (3, "c"): 2}


def test_sessions_and_files_are_written_and_read(spark, tmp_path):
    from quire.sources import documents as sources

    v = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "session_id string, v int, text string")
    sources.write_session(v, str(tmp_path / "s"))
    sources.write_session(spark.createDataFrame([("a", 2, "z")], v.schema), str(tmp_path / "s"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).select("session_id", "v", "text").collect()) == [("a", 1, "x"), ("a", 2, "z"), ("b", 1, "y")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.md").write_text("# T")
    (tmp_path / "f" / "two.xyz").write_text("?")
    assert sorted((r.name, r.format, bytes(r.content)) for r in sources.read_files(spark, f"file://{tmp_path}/f").collect()) == [("one.md", "markdown", b"# T"), ("two.xyz", "unsupported", b"?")]
    bad = sources.with_docx_blocks(spark.createDataFrame([(1, bytearray(b"no zip"))], "file_id long, content binary")).collect()
    assert [(r.file_id, r.status) for r in bad] == [(1, "invalid")]
