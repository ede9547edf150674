"""Registered queries of the document operators and the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import beside, blocks, charts, compare, control, edits, figures, fractions, html_edits, layout, markup, pages, search, spacing, tabs
from quire.plans.tables import table
from quire.sources.derived import STYLES, TABLES as DERIVED, Corpus, derived
from quire.sources.fixtures import TABLES as INLINE, fixture, values_sql
from quire.sources import documents as sources
from quire.sources.html import with_html_blocks
from quire.sources.shared import shared_path
from quire.streaming import costs, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    """An operator's input: inline rows, or the table derived from the driver's tables."""
    return derived(spark, str(d), name) if isinstance(d, Corpus) and name in DERIVED else fixture(spark, name)


def query(sql: str | None = None, corpus: bool = True):
    """Register a query; ``sql`` may name input tables as {name}. With ``corpus`` a query over such tables is registered a second time as <name>_corpus, over inputs derived
    from the driver's tables."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            named = [n for n in INLINE if "{" + n + "}" in sql]
            ORACLE_SQL[f.__name__] = _filled(sql, {n: values_sql(n) for n in named})
            if corpus and any(n in DERIVED for n in named):
                QUERIES[f.__name__ + "_corpus"] = lambda spark, d: f(spark, Corpus(d))
                ORACLE_SQL[f.__name__ + "_corpus"] = _filled(sql, {n: DERIVED[n][1] if n in DERIVED else values_sql(n) for n in named})
        return f

    return put


def _filled(sql: str, tables: dict[str, str]) -> str:
    for n, t in tables.items():
        sql = sql.replace("{" + n + "}", t)
    return sql


_SP = r"[\t\n\x{0b}\x{0c}\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Blocks of texts without fences and front matter, which the tables don't have.
_BLOCKS = rf"""
WITH l AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS n FROM documents),
k AS (SELECT *, CASE WHEN trim(regexp_replace(line, '{_SP}+', ' ', 'g')) = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,6}}\s') THEN 'heading' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s') THEN 'list' WHEN regexp_matches(line, '^\s*\|') THEN 'table-cell' ELSE 'text' END AS c FROM l),
s AS (SELECT *, CASE WHEN c = 'blank' THEN 0 WHEN c <> 'text' THEN 1 WHEN coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY n), 'blank') <> 'text' THEN 1 ELSE 0 END AS new FROM k),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS ordinal FROM s WHERE c <> 'blank'),
b AS (SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN min(c) <> 'text' THEN min(c) WHEN regexp_matches(arg_min(line, n), '^\s*>') THEN 'quote' ELSE 'paragraph' END AS kind,
      CASE WHEN min(c) = 'heading' THEN CAST(length(regexp_extract(arg_min(line, n), '^(#+)', 1)) AS INTEGER) END AS level, string_agg(line, chr(10) ORDER BY n) AS text FROM g GROUP BY doc_id, ordinal)
"""


@query(_BLOCKS + rf"""SELECT doc_id, count(*) AS block_count, CAST(sum(length(regexp_replace(text, '{_SP}+', '', 'g'))) AS BIGINT) AS char_count, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'list') AS list_items,
CAST(max(CASE WHEN kind = 'table-cell' THEN 1 ELSE 0 END) AS BIGINT) AS tables, count(*) FILTER (kind = 'quote') AS quotes, CAST(0 AS BIGINT) AS code_blocks FROM b GROUP BY doc_id""")
def doc_summary(spark, d):
    return blocks.summaries(table(spark, d, "documents"))


@query(_BLOCKS + "SELECT doc_id, ordinal, 'B' || ordinal || '@v0' AS ref, kind, level, text FROM b")
def block_list(spark, d):
    return blocks.with_blocks(table(spark, d, "documents"))


@query(_BLOCKS + "SELECT doc_id, ordinal, '[B' || ordinal || '@v0] (' || kind || ') ' || CASE WHEN length(text) > 1500 THEN left(replace(text, chr(10), '⏎'), 1500) || '…' ELSE replace(text, chr(10), '⏎') END AS line FROM b WHERE ordinal <= 40")
def block_read_page(spark, d):
    return blocks.read_page(blocks.with_blocks(table(spark, d, "documents")))


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4 AS BIGINT) AS hits FROM documents WHERE contains(lower(text), 'tion')")
def search_literal_counts(spark, d):
    return search.hit_counts(table(spark, d, "documents"), "tion")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+[.,]')) AS hits FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+[.,]')")
def search_regex_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[A-Z][a-z]+[.,]")).cast("long").alias("hits")).filter("hits > 0")


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS hits FROM documents WHERE contains(lower(text), 'the') ORDER BY hits DESC, doc_id LIMIT 30")
def search_top_k(spark, d):
    return search.hit_counts(table(spark, d, "documents"), "the").orderBy(F.col("hits").desc(), "doc_id").limit(30)


@query("SELECT count(*) AS blocks, CAST(sum((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4) AS BIGINT) AS hits, lang FROM documents WHERE contains(lower(text), 'tion') GROUP BY lang")
def search_totals(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("lang", tx.literal_hits(F.col("text"), "tion").alias("hits")).filter("hits > 0").groupBy("lang").agg(F.count(F.lit(1)).alias("blocks"), F.sum("hits").alias("hits"))


@query("""WITH p AS (SELECT doc_id, text, string_split(lower(text), 'tion') AS ps FROM documents WHERE contains(lower(text), 'tion')), h AS (SELECT doc_id, text, ps, unnest(range(1, least(len(ps) - 1, 30) + 1)) AS hit FROM p),
a AS (SELECT doc_id, text, hit, len(ps) - 1 AS total, CAST(list_sum(list_transform(ps[1:hit], lambda x: length(x))) + (hit - 1) * 4 AS BIGINT) AS p FROM h)
SELECT doc_id, CAST(hit AS INTEGER) AS hit, p AS index, replace(CASE WHEN p > 60 THEN '…' ELSE '' END || substring(text, greatest(p - 60, 0) + 1, p - greatest(p - 60, 0)) || '【' || substring(text, p + 1, 4) || '】' || substring(text, p + 5, 60) || CASE WHEN length(text) > p + 64 THEN '…' ELSE '' END, chr(10), '⏎') AS snippet, CAST(total AS INTEGER) AS total FROM a""")
def search_snippets(spark, d):
    return search.snippets(table(spark, d, "documents"), "tion")


@query()
def search_fuzzy(spark, d):
    return search.fuzzy_matches(rows(spark, d, "odd_texts").select(F.col("id").cast("long").alias("doc_id"), "text"), "'s' - x y")


@query(rf"SELECT doc_id, length(n) AS n_chars, md5(n) AS digest FROM (SELECT doc_id, regexp_replace(translate(text, '{tx.TYPOGRAPHIC.replace(chr(39), chr(39) * 2)}', '{tx.PLAIN.replace(chr(39), chr(39) * 2)}'), '[ \n\r]+', ' ', 'g') AS n FROM documents)")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalized(F.col("text")).alias("n")).select("doc_id", F.length("n").cast("long").alias("n_chars"), F.md5("n").alias("digest"))


_REST = "regexp_replace(text, '⟨[^⟩]*⟩', '', 'g')"
_KINDS = {"wide": "[㐀-鿿豈-﫿぀-ヿ가-힯]", "words": "[A-Za-z0-9À-ɏͰ-ϿЀ-ӿ]+", "spaces": r"[\t\n\x0c\r ]+"}


@query("SELECT doc_id, len(regexp_extract_all(text, '⟨[^⟩]*⟩')) AS placeholders, " + ", ".join(f"len(regexp_extract_all({_REST}, '{p}')) AS {k}" for k, p in _KINDS.items()) + f", length(regexp_replace({_REST}, '{'|'.join(_KINDS.values())}', '', 'g')) AS others FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in tx.token_kinds(F.col("text")).items()))


@query("SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY 1")
def word_counts(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(tx.WORD), F.lit(0))).alias("w"))
    return words.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]+(?:-[A-Za-z]+)*'), lambda x: lower(x)))) AS words FROM documents")
def vocabulary(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+(?:-[A-Za-z]+)*"), F.lit(0)), F.lower))).cast("long").alias("words"))


@query(f"SELECT lower(w) AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{tx.HYPHENATED}')) AS w FROM documents) GROUP BY 1")
def hyphenated_terms(spark, d):
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(tx.HYPHENATED), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("term")).agg(F.count(F.lit(1)).alias("n"))


#: First parts of compounds that keep their hyphen.
KEEP_PREFIX = "multi cross self non pre post co sub semi anti inter intra over under well low high two three four single double full half state deep end real long short large small fine coarse patch pixel slice noise edge data task domain channel spatial frequency image feature level scale window time user open closed top bottom left right first second third zero one dual quasi pseudo".split()


_KEPT = ", ".join(f"'{x}'" for x in KEEP_PREFIX)


@query(rf"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{tx.WORD}'), lambda x: lower(x)) AS w, list_transform(regexp_extract_all(text, '[A-Za-z]+(?:-[A-Za-z]+)*'), lambda x: lower(x)) AS h FROM {{hyphen_text}}),
s AS (SELECT doc_id, w, list_distinct(list_concat(h, list_transform(h, lambda x: replace(x, '-', '')))) AS s FROM t), k AS (SELECT doc_id, unnest(w) AS w FROM t), n AS (SELECT doc_id, w, count(*) AS n FROM k GROUP BY 1, 2),
p AS (SELECT doc_id, id, rtrim(regexp_replace(a, '-$', '')) AS base, regexp_extract(b, '^([A-Za-z]+)', 1) AS rb FROM {{hyphens}}), q AS (SELECT *, regexp_extract(base, '([A-Za-z]+)$', 1) AS ra FROM p), r AS (SELECT *, lower(ra) AS a, lower(rb) AS b FROM q)
SELECT r.id, CASE WHEN ra = '' OR rb = '' THEN false WHEN regexp_matches(base, '-[A-Za-z]+$') THEN false WHEN regexp_matches(rb, '^[A-Z]') AND NOT regexp_matches(rb, '^[A-Z]+$') THEN false WHEN list_contains(s, a || '-' || b) THEN false WHEN list_contains(s, a || b) THEN true
WHEN a IN ({_KEPT}) THEN false WHEN length(ra) >= 2 AND ra = upper(ra) THEN false WHEN length(a) >= 3 AND coalesce(x.n, 0) >= 2 AND coalesce(y.n, 0) >= 2 THEN false ELSE length(a) >= 2 AND length(b) >= 2 END AS soft
FROM r JOIN s ON s.doc_id = r.doc_id LEFT JOIN n x ON x.doc_id = r.doc_id AND x.w = r.a LEFT JOIN n y ON y.doc_id = r.doc_id AND y.w = r.b""")
def soft_hyphen_decisions(spark, d):
    """Each document's hyphens are judged by its own words."""
    return compare.soft_hyphens(rows(spark, d, "hyphen_text"), rows(spark, d, "hyphens"), KEEP_PREFIX)


_CLEAN = rf"regexp_replace(%s, '[\x{{00}}-\x{{1f}}\x{{7f}}-\x{{9f}}]|{_SP}', '', 'g')"


@query(f"SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split({_CLEAN % 'text'}, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1, 2")
def char_multiset(spark, d):
    docs = table(spark, d, "documents")
    each = docs.select("lang", F.explode(F.split(F.regexp_replace("text", f"[\\x00-\\x1f\\x7f-\\x9f]|{tx.SPACE}", ""), "")).alias("ch")).filter("ch <> ''")
    return each.groupBy("lang", "ch").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS (SELECT doc_id, {_CLEAN % "coalesce(text, '')"} AS a, {_CLEAN % "left(coalesce(text, ''), length(text) // 2)"} AS b FROM documents),
c AS (SELECT doc_id, a, b, length(a) AS total, list_filter(string_split(a, ''), lambda x: x <> '') AS cs FROM d), u AS (SELECT doc_id, total, a, b, unnest(list_distinct(cs)) AS ch FROM c), l AS (SELECT doc_id, ch, strpos(a, ch) AS p, greatest(length(b) - length(replace(b, ch, '')), 0) AS got, length(a) - length(replace(a, ch, '')) AS n FROM u),
g AS (SELECT doc_id, sum(greatest(n - got, 0)) AS lost, string_agg(ch, '' ORDER BY p) FILTER (n > got) AS miss FROM l GROUP BY 1)
SELECT c.doc_id, CAST(total AS BIGINT) AS total, CAST(coalesce(lost, 0) AS BIGINT) AS lost, round(CASE WHEN total = 0 THEN 1.0 ELSE 1 - coalesce(lost, 0) / total END, 6) AS coverage, left(coalesce(miss, ''), 30) AS missing FROM c LEFT JOIN g ON g.doc_id = c.doc_id""")
def char_coverage(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return compare.coverage(docs, F.col("text"), F.left("text", F.floor(F.length("text") / 2).cast("int")))


@query(f"""WITH d AS (SELECT doc_id, length({_CLEAN % "coalesce(text, '')"}) + doc_id % 5 + doc_id % 3 AS total, greatest(doc_id % 5 - doc_id % 4, 0) AS acute, greatest(doc_id % 3 - doc_id % 2, 0) AS hat FROM documents)
SELECT doc_id, CAST(total AS BIGINT) AS total, CAST(acute + hat AS BIGINT) AS lost, round(CASE WHEN total = 0 THEN 1.0 ELSE 1 - (acute + hat) / total END, 6) AS coverage, CASE WHEN acute > 0 THEN '´' ELSE '' END || CASE WHEN hat > 0 THEN 'ˆ' ELSE '' END AS missing FROM d""")
def accent_coverage(spark, d):
    """Texts with spacing accents before them against ones with fewer combining accents instead."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    put = lambda c, n: F.repeat(F.lit(c), (F.col("doc_id") % n).cast("int"))
    return compare.coverage(docs, F.concat(put("´", 5), put("ˆ", 3), "text"), F.concat(put("\u0301", 4), put("\u0302", 2), "text"))


@query("""WITH a AS (SELECT doc_id, version, part, body FROM {parts})
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.part, n.part) AS part, CASE WHEN o.part IS NULL THEN 'added' WHEN n.part IS NULL THEN 'lost' WHEN o.body = n.body THEN 'identical' ELSE 'modified' END AS status
FROM (SELECT * FROM a WHERE version = 0) o FULL JOIN (SELECT * FROM a WHERE version = 1) n ON o.doc_id = n.doc_id AND o.part = n.part""")
def fidelity_parts(spark, d):
    p = rows(spark, d, "parts")
    return compare.fidelity(p.filter("version = 0"), p.filter("version = 1"), ["doc_id", "part"], "body")


@query("SELECT lang, CASE WHEN contains(text, 'tion') THEN 'modified' ELSE 'identical' END AS status, count(*) AS n FROM documents GROUP BY 1, 2")
def fidelity_by_document(spark, d):
    docs = table(spark, d, "documents")
    new = docs.select("doc_id", F.replace("text", F.lit("tion"), F.lit("sion")).alias("text"))
    return compare.fidelity(docs, new, ["doc_id"], "text").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH v AS (SELECT doc_id, string_split_regex(text, '\r?\n') AS a, string_split_regex(replace(text, 'tion', 'sion'), '\r?\n') AS b FROM documents),
c AS (SELECT doc_id, len(a) AS n, list_transform(list_zip(a, b), lambda x: x[1] <> x[2]) AS diff FROM v),
p AS (SELECT doc_id, n, coalesce(list_position(diff, true) - 1, n) AS pre, coalesce(list_position(list_reverse(diff), true) - 1, n) AS post FROM c)
SELECT doc_id, CAST(pre AS BIGINT) AS prefix, CAST(least(post, n - pre) AS BIGINT) AS suffix, CAST(n - pre - least(post, n - pre) AS BIGINT) AS removed, CAST(n - pre - least(post, n - pre) AS BIGINT) AS added FROM p""")
def common_prefix_suffix_change(spark, d):
    return compare.common_affixes(table(spark, d, "documents").select("doc_id", F.col("text").alias("old"), F.replace("text", F.lit("tion"), F.lit("sion")).alias("new")))


@query(r"""SELECT line, count(DISTINCT doc_id) AS holders, count(*) AS n FROM (SELECT doc_id, regexp_replace(trim(unnest(string_split_regex(text, '\r?\n'))), '[0-9]+', '#', 'g') AS line FROM documents) WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 2""")
def repeated_lines(spark, d):
    return layout.repeated_lines(table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\r?\n")).alias("line")))


_TRI = "SELECT {id} AS id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT {id}, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z]+') AS w FROM {tab}))"


@query("WITH d AS (" + _TRI.replace("{id}", "doc_id").replace("{tab}", "documents") + "), b AS (" + _TRI.replace("{id}", "item_id").replace("{tab}", "benchmark") + ") SELECT d.id AS doc_id, b.id AS item_id, count(DISTINCT d.t) AS shared FROM d JOIN b ON d.t = b.t GROUP BY 1, 2")
def trigram_overlap(spark, d):
    """A text's trigrams are made distinct in its row; only those that an item has are shuffled."""

    def tri(df, i):
        w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
        each = F.expr("array_distinct(transform(sequence(0, size(w) - 3), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2])))")
        return df.select(i, w.alias("w")).filter(F.size("w") > 2).select(i, F.explode(each).alias("t"))

    items = tri(table(spark, d, "benchmark"), "item_id").distinct()
    return tri(table(spark, d, "documents"), "doc_id").join(items, "t").groupBy("doc_id", "item_id").agg(F.countDistinct("t").alias("shared"))


def _turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).filter("before IS NOT NULL")


@query()
def word_similarity(spark, d):
    return compare.with_similarity(_turns(spark, d), "before", "text").select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


def _both(spark, d, *more):
    """Every document's lines before and after a change of words."""
    cut = lambda c: F.split(c, "\r?\n")
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", cut(text).alias("old"), cut(F.replace(text, F.lit("tion"), F.lit("sion"))).alias("new"), *more)


@query()
def carry_over_edits(spark, d):
    return compare.aligned(_both(spark, d)).select("doc_id", "old_ordinal", "new_ordinal", F.round("similarity", 6).alias("similarity"))


@query()
def carry_over_rules(spark, d):
    fresh = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit(" the "), F.lit(" a ")), "\r?\n")
    return compare.carried(_both(spark, d, fresh.alias("fresh")).select("doc_id", F.col("old").alias("base"), F.col("new").alias("edited"), "fresh")).select("doc_id", "place", "decision", F.md5("text").alias("digest"))


@query()
def inline_diffs(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("old"), F.replace("text", F.lit("the"), F.lit("a")).alias("new"))
    return compare.with_inline_diff(b)


@query()
def word_map(spark, d):
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "")
    docs = table(spark, d, "documents").select("doc_id", w.alias("doc"))
    return compare.word_map(docs.select("doc_id", "doc", F.filter("doc", lambda x, i: i % 50 != 7).alias("page")))


@query()
def min_hunks(spark, d):
    docs = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("old"), F.replace("text", F.lit("the"), F.lit("a")).alias("new"))
    return compare.with_hunks(docs)


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'tion', ''))) / 4 AS BIGINT) AS places, CASE WHEN NOT contains(text, 'tion') THEN 'not_found' WHEN (length(text) - length(replace(text, 'tion', ''))) / 4 > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM documents")
def replace_status(spark, d):
    return search.replace_status(table(spark, d, "documents"), "tion", "sion")


@query("SELECT doc_id, 1 AS version, md5(replace(text, 'tion', 'sion')) AS digest FROM documents WHERE contains(text, 'tion')")
def replace_all_versions(spark, d):
    return search.replaced(table(spark, d, "documents"), "tion", "sion").select("doc_id", "version", F.md5("text").alias("digest"))


@query("SELECT user_id, count(*) AS v, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type FROM events GROUP BY 1")
def version_latest(spark, d):
    return control.latest(table(spark, d, "events"), "user_id", "event_type", F.struct("ts", "event_id"))


@query("SELECT user_id, CAST(row_number() OVER w AS INTEGER) AS v, event_id, lag(event_id) OVER w AS undo_to FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def version_undo(spark, d):
    return control.undone(control.versions(table(spark, d, "events"), "user_id", "ts", "event_id"), "user_id", "event_id")


_REVIEW = "SELECT doc_id, string_agg(text, '' ORDER BY ordinal) FILTER (kind = 'keep' OR (kind = 'ins') = %s) AS text FROM {revisions} GROUP BY doc_id"


@query(_REVIEW % "true")
def review_accept(spark, d):
    return control.reviewed(rows(spark, d, "revisions"), True)


@query(_REVIEW % "false")
def review_reject(spark, d):
    return control.reviewed(rows(spark, d, "revisions"), False)


@query("SELECT doc_id, string_agg(text, '' ORDER BY ordinal) FILTER (kind = 'keep' OR NOT coalesce(author = 'ann' AND rev_id IN ('r1', 'r2'), false) OR kind = 'ins') AS text FROM {revisions} GROUP BY doc_id")
def review_by_author(spark, d):
    return control.reviewed(rows(spark, d, "revisions"), True, "ann", ["r1", "r2"])


@query("SELECT doc_id, rev_id, count(*) AS n FROM {revisions} WHERE rev_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_revisions(spark, d):
    return rows(spark, d, "revisions").filter("rev_id IS NOT NULL").groupBy("doc_id", "rev_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query()
def html_blocks(spark, d):
    return with_html_blocks(table(spark, d, "pages"))


@query()
def html_outline(spark, d):
    return with_html_blocks(table(spark, d, "pages")).filter("level IS NOT NULL").select("page_id", "ordinal", "level", "text")


# A <b> that stays open goes on inside the footer, whose text then lies in no block.
_FOOTER = "CASE WHEN len(string_split(html, '<b>')) > len(string_split(html, '</b>')) AND contains(html, '<footer') THEN position('<footer' IN html) - 1 ELSE length(html) END"
_PIECES = rf"regexp_extract_all(left(html, {_FOOTER}), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|[^<]+')"


@query(f"""WITH h AS (SELECT page_id, coalesce(html, '') AS html FROM pages), p AS (SELECT page_id, {_PIECES} AS p, substr(html, 1 + {_FOOTER}) AS rest FROM h),
n AS (SELECT *, coalesce(list_sum(list_transform(p, lambda x: CASE WHEN x[1] = '<' THEN 0 ELSE len(string_split(x, 'que')) - 1 END)), 0) AS n FROM p)
SELECT page_id, CASE WHEN n = 0 THEN 'not_found' ELSE 'ok' END AS status, CAST(n AS BIGINT) AS places, md5(array_to_string(list_transform(p, lambda x: CASE WHEN x[1] = '<' THEN x ELSE replace(x, 'que', 'q&lt;&amp;&gt;') END), '') || rest) AS digest FROM n""")
def html_replace(spark, d):
    """A text replaced in all blocks of all pages, on their source: tags, scripts, comments, references and spacing stay byte for byte."""
    return html_edits.replaced_in_pages(table(spark, d, "pages"), "que", "q<&>").select("page_id", "status", "places", F.md5("html").alias("digest"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(replace(html, '<title', '<!-- 批注（QA）：see — below --><title'), '<h1\b', '<h2', 'g'), '</h1>', '</h2>', 'g')) AS digest FROM pages WHERE html IS NOT NULL AND contains(html, '<h1')")
def html_block_edits(spark, d):
    """Every first-level heading made a second-level one and a note set before every title, by block."""
    pages = table(spark, d, "pages")
    b = with_html_blocks(pages)
    edits = b.filter("level IN (0, 1)").select("page_id", "ordinal", F.when(F.col("level") == 1, "retag").otherwise("comment").alias("kind"), F.when(F.col("level") == 1, "h2").otherwise("see -- below").alias("value"), F.lit("QA").alias("author"))
    return html_edits.edited_pages(pages, edits).select("page_id", F.md5("html").alias("digest"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?i)<p\b')) AS paragraphs, len(regexp_extract_all(html, '(?i)<h[1-6]\b')) AS headings, len(regexp_extract_all(html, '(?i)<table\b')) AS tables, len(regexp_extract_all(html, '(?i)<img\b')) AS images FROM pages")
def html_tag_counts(spark, d):
    n = lambda t: F.regexp_count("html", F.lit(rf"(?i)<{t}\b")).cast("long")
    return table(spark, d, "pages").select("page_id", n("p").alias("paragraphs"), n("h[1-6]").alias("headings"), n("table").alias("tables"), n("img").alias("images"))


@query(r"SELECT doc_id, ordinal, repeat(' ', greatest(2 * (level - 1), 0)) || text AS line, regexp_replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}\s-]', '', 'g'), '\s+', '-', 'g') AS slug FROM {headings}")
def toc_slugs(spark, d):
    return blocks.outline(rows(spark, d, "headings"))


@query("SELECT conv_id, CAST(ceil(sum(length(coalesce(text, ''))) / 2.5) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def conversation_tokens(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(tx.estimated_tokens(F.sum(F.length(F.coalesce("text", F.lit(""))))).alias("tokens"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY session, role = 'tool' ORDER BY idx DESC) AS k FROM {tool_results}), f AS (SELECT *, role = 'tool' AND k > 6 AND length(content) >= 1500 AS folded FROM r)
SELECT session, idx, role, folded, CASE WHEN folded THEN '[旧的工具输出已折叠以节省上下文（原 ' || length(content) || ' 字，开头：' || left(string_split(content, chr(10))[1], 120) || '）。如需其中内容，请重新调用相应工具读取。]' ELSE content END AS content FROM f""")
def conversation_fold(spark, d):
    return control.folded_results(rows(spark, d, "tool_results"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '【用户】' WHEN 'assistant' THEN '【助手】' ELSE '【系统】' END || trim(text), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def conversation_transcript(spark, d):
    name = F.when(F.col("role") == "user", "【用户】").when(F.col("role") == "assistant", "【助手】").otherwise("【系统】")
    line = F.struct("turn", F.concat(name, F.trim("text")).alias("s"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["s"]), "\n").alias("transcript"))


@query("""WITH m AS (SELECT *, sum(CASE WHEN role <> 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY idx) AS turn FROM {messages}), c AS (SELECT session, turn, unnest(string_split(call_ids, ',')) AS id, generate_subscripts(string_split(call_ids, ','), 1) - 1 AS pos FROM m WHERE role = 'assistant' AND call_ids IS NOT NULL),
r AS (SELECT session, turn, tool_call_id AS id, min(idx) AS idx, arg_min(content, idx) AS content FROM m WHERE role = 'tool' GROUP BY 1, 2, 3), t AS (SELECT c.session, c.turn, CASE WHEN r.idx IS NULL THEN 2 ELSE 1 END AS part, coalesce(r.idx, c.pos) AS p, 'tool' AS role, coalesce(r.content, '（该工具调用被中断，未执行）') AS content, c.id AS tool_call_id FROM c LEFT JOIN r ON r.session = c.session AND r.turn = c.turn AND r.id = c.id),
u AS (SELECT session, turn, 0 AS part, idx AS p, role, coalesce(content, '') AS content, CAST(NULL AS VARCHAR) AS tool_call_id FROM m WHERE role <> 'tool' UNION ALL SELECT * FROM t) SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY turn, part, p) AS INTEGER) AS pos, role, content, tool_call_id FROM u""")
def message_pairing(spark, d):
    return control.paired_messages(rows(spark, d, "messages"))


def _usage(spark, d):
    n = F.floor(F.abs("value")).cast("long")
    return table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", "x-pro").otherwise("x-flash").alias("model"), n.alias("prompt"), F.floor(n / 3).alias("cached"), F.floor(n / 2).alias("completion"))


_COST = """WITH u AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS pro, CAST(floor(abs(value)) AS BIGINT) AS n FROM events),
c AS (SELECT *, isodow(ts) <= 5 AND ((hour(ts) >= 1 AND hour(ts) < 4) OR (hour(ts) >= 6 AND hour(ts) < 10)) AS peak, n // 3 AS cached, n // 2 AS completion FROM u),
k AS (SELECT *, (cached * CASE WHEN pro = 1 THEN 0.022 ELSE 0.003 END + greatest(n - cached, 0) * CASE WHEN pro = 1 THEN 0.66 ELSE 0.15 END + completion * CASE WHEN pro = 1 THEN 1.98 ELSE 0.6 END) / 1e6 * CASE WHEN peak THEN 2 ELSE 1 END AS cost FROM c) """


@query(_COST + "SELECT user_id, peak, count(*) AS requests, CAST(sum(n) AS BIGINT) AS prompt, CAST(sum(cached) AS BIGINT) AS cached, round(sum(cost), 9) AS cost FROM k GROUP BY 1, 2")
def usage_cost_peak(spark, d):
    return control.usage_costs(_usage(spark, d)).groupBy("user_id", "peak").agg(F.count(F.lit(1)).alias("requests"), F.sum("prompt").alias("prompt"), F.sum("cached").alias("cached"), F.round(F.sum("cost"), 9).alias("cost"))


@query(_COST + "SELECT user_id, event_id, round(sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS total FROM k")
def running_cost(spark, d):
    return control.running_totals(control.usage_costs(_usage(spark, d)), "user_id", "ts", "event_id", "cost").select("user_id", "event_id", F.round("total", 9).alias("total"))


@query(_COST + """SELECT user_id, event_id, count(*) OVER w AS requests, CAST(sum(n) OVER w AS BIGINT) AS prompt, CAST(sum(cached) OVER w AS BIGINT) AS cached, CAST(sum(completion) OVER w AS BIGINT) AS completion, round(sum(cost) OVER w, 9) AS total
FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_cost_stream(spark, d):
    """The events as they may come: up to an hour late, in three arrivals, each taken up by a stream that starts anew from its checkpoint; a mark far ahead closes them."""
    usage = _usage(spark, d)
    came = usage.withColumn("came", F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(3600)))
    low, high, last = came.agg(F.min("came"), F.max("came"), F.max("ts")).first()
    source, out, checkpoint = (shared_path(spark, n) for n in ("usage", "totals", "usage-state"))
    step = ((high or 0) - (low or 0)) // 3 + 1
    for k in range(3):
        came.filter((F.col("came") - (low or 0)).between(k * step, (k + 1) * step - 1)).drop("came").write.mode("append").parquet(source)
        costs.advance(spark, source, usage.schema, out, checkpoint, late="2 hours")
    if last is not None:
        usage.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.expr("CAST(ts AS TIMESTAMP)").alias("ts"), "model", "prompt", "cached", "completion").withColumn(
            "ts", (F.lit(last) + F.expr("INTERVAL 1 DAY")).cast(usage.schema["ts"].dataType)
        ).write.mode("append").parquet(source)
        costs.advance(spark, source, usage.schema, out, checkpoint, late="2 hours")
    names = "user_id long, event_id long, requests long, prompt long, cached long, completion long, total double"
    return spark.read.schema(names).parquet(out).withColumn("total", F.round("total", 9))


@query(r"""WITH c AS (SELECT * FROM {calls}), k AS (SELECT list, idx, rule, regexp_extract(rule, '^([A-Za-z0-9_]+)(?:\((.*)\))?$', 1) AS name, regexp_extract(rule, '^([A-Za-z0-9_]+)(?:\((.*)\))?$', 2) AS body, contains(rule, '(') AS narrow FROM {rules} WHERE regexp_matches(rule, '^([A-Za-z0-9_]+)(?:\((.*)\))?$')),
h AS (SELECT call_id, list FROM c JOIN k ON k.name = c.tool AND (NOT narrow OR body = '*' OR regexp_full_match(content, replace(regexp_replace(body, '([.+?^${}()|\[\]\\])', '\\\1', 'g'), '*', '.*')))), f AS (SELECT call_id, bool_or(list = 'deny') AS deny, bool_or(list = 'ask') AS ask, bool_or(list = 'allow') AS allow FROM h GROUP BY 1),
m AS (SELECT c.*, unnest(['default', 'plan', 'acceptEdits', 'bypassPermissions']) AS mode FROM c)
SELECT m.call_id, mode, CASE WHEN deny THEN 'deny:rule' WHEN ask THEN 'ask:rule' WHEN own IS NOT NULL THEN own || ':tool' WHEN mode = 'bypassPermissions' THEN 'allow:bypass' WHEN readonly THEN 'allow:readonly' WHEN mode = 'plan' THEN 'deny:plan' WHEN allow THEN 'allow:rule' WHEN mode = 'acceptEdits' AND category = 'edit' AND NOT destructive THEN 'allow:edits' ELSE 'ask:default' END AS decision FROM m LEFT JOIN f ON f.call_id = m.call_id""")
def permission_decisions(spark, d):
    c, r = rows(spark, d, "calls"), rows(spark, d, "rules")
    out = None
    for mode in ("default", "plan", "acceptEdits", "bypassPermissions"):
        x = control.decisions(c, r, mode)
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT key, arg_max(value, prio) AS value, arg_max(layer, prio) AS layer FROM {settings} GROUP BY key")
def settings_layers(spark, d):
    return control.layered(rows(spark, d, "settings"))


@query("SELECT CAST(row_number() OVER (ORDER BY prio, pos) AS INTEGER) AS ordinal, layer, rule FROM {setting_rules}")
def settings_rules(spark, d):
    return control.numbered_rules(rows(spark, d, "setting_rules"))


@query("WITH c AS (SELECT * FROM {capabilities}), t AS (SELECT * FROM {tools}) SELECT format, tool, agent_ok AND tool <> 'agent' AS sub_agent FROM t JOIN c ON t.needs = c.capability UNION ALL SELECT f.format, tool, agent_ok AND tool <> 'agent' FROM t, (SELECT DISTINCT format FROM c) f WHERE needs IS NULL")
def tool_pool_by_format(spark, d):
    return control.tool_pools(rows(spark, d, "tools"), rows(spark, d, "capabilities"))


@query("WITH s AS (SELECT * FROM {styles}), p AS (SELECT * FROM {paras}), u AS (SELECT coalesce(style, (SELECT style_id FROM s WHERE is_default AND type = 'paragraph')) AS style_id FROM p UNION ALL SELECT run_style FROM p WHERE run_style IS NOT NULL) SELECT s.style_id, s.name, s.type, count(u.style_id) AS in_use FROM s LEFT JOIN u ON u.style_id = s.style_id GROUP BY 1, 2, 3")
def style_usage(spark, d):
    return control.style_usage(rows(spark, d, "styles"), rows(spark, d, "paras"))


@query("WITH s AS (SELECT * FROM {styles}), p AS (SELECT * FROM {paras}), u AS (SELECT coalesce(style, (SELECT style_id FROM s WHERE is_default AND type = 'paragraph')) AS style_id FROM p UNION ALL SELECT run_style FROM p WHERE run_style IS NOT NULL), g AS (SELECT s.style_id, s.name, s.type, count(u.style_id) AS n FROM s LEFT JOIN u ON u.style_id = s.style_id GROUP BY 1, 2, 3) SELECT type, coalesce(string_agg(name || ' ｜ ' || style_id || ' ｜ ' || n, chr(10) ORDER BY n DESC, name) FILTER (n > 0), '') AS used, count(*) FILTER (n = 0) AS unused, coalesce(string_agg(name, '、' ORDER BY name) FILTER (n = 0), '') AS unused_names FROM g GROUP BY 1")
def style_lists(spark, d):
    return control.style_lists(control.style_usage(rows(spark, d, "styles"), rows(spark, d, "paras")))


@query("""WITH RECURSIVE s AS (SELECT * FROM {styles}), up AS (SELECT style_id, based_on AS at, outline_lvl AS lvl, name, 0 AS hop, [style_id] AS seen FROM s UNION ALL SELECT u.style_id, p.based_on, p.outline_lvl, p.name, u.hop + 1, list_append(u.seen, p.style_id) FROM up u JOIN s p ON p.style_id = u.at AND NOT list_contains(u.seen, p.style_id)),
lv AS (SELECT style_id, arg_min(lvl + 1, hop) AS l FROM up WHERE lvl < 9 GROUP BY 1),
nm AS (SELECT style_id, arg_min(CAST(regexp_extract(lower(name), '^(?:heading |标题 ?|h)([1-9])', 1) AS INTEGER), hop) AS l FROM up WHERE regexp_matches(lower(name), '^(heading |标题 ?|h)[1-9]') GROUP BY 1)
SELECT s.style_id, coalesce(lv.l, nm.l) AS level FROM s LEFT JOIN lv ON lv.style_id = s.style_id LEFT JOIN nm ON nm.style_id = s.style_id""")
def style_heading_level(spark, d):
    return control.heading_levels(spark, rows(spark, d, "styles"))


def style_heading_level_corpus(spark, d):
    """Chains of styles set from the customers."""
    return control.heading_levels(spark, STYLES[0](spark, d))


QUERIES["style_heading_level_corpus"], ORACLE_SQL["style_heading_level_corpus"] = style_heading_level_corpus, ORACLE_SQL["style_heading_level"].replace(values_sql("styles"), STYLES[1])


@query("SELECT c.doc_id, c.comment_id, c.author, c.text, a.ref FROM (SELECT * FROM {comments}) c LEFT JOIN (SELECT doc_id, comment_id, arg_min(ref, ordinal) AS ref FROM {anchors} GROUP BY 1, 2) a ON a.doc_id = c.doc_id AND a.comment_id = c.comment_id")
def comment_anchors(spark, d):
    return control.first_anchor(rows(spark, d, "comments"), rows(spark, d, "anchors"))


@query("WITH p AS (SELECT * FROM {paras}) SELECT p.doc_id, p.ordinal, coalesce((SELECT max(q.ordinal) FROM p q WHERE q.doc_id = p.doc_id AND q.part = p.part AND coalesce(q.style, '') = coalesce(p.style, '') AND q.text <> '' AND q.ordinal < p.ordinal), (SELECT min(q.ordinal) FROM p q WHERE q.doc_id = p.doc_id AND q.part = p.part AND coalesce(q.style, '') = coalesce(p.style, '') AND q.text <> '' AND q.ordinal > p.ordinal)) AS template FROM p")
def style_templates(spark, d):
    return control.style_templates(rows(spark, d, "paras"))


@query("""WITH b AS (SELECT l_returnflag AS k, l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL), n AS (SELECT k, floor(v * 2 + 0.5) / 2 AS bin, count(*) AS n, max(v) AS hi FROM b GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY bin RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS score, sum(n) OVER (PARTITION BY k) AS total FROM n)
SELECT k AS l_returnflag, coalesce(max(bin) FILTER (score >= greatest(3, ceil(total * 0.15))), max(hi)) AS edge FROM s GROUP BY 1""")
def dominant_edge(spark, d):
    return layout.dominant_edge(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query("""WITH b AS (SELECT doc_id AS k, x1 AS v FROM {spans}), n AS (SELECT k, floor(v * 2 + 0.5) / 2 AS bin, count(*) AS n, max(v) AS hi FROM b GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY bin RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS score, sum(n) OVER (PARTITION BY k) AS total FROM n)
SELECT k AS doc_id, coalesce(max(bin) FILTER (score >= greatest(3, ceil(total * 0.15))), max(hi)) AS edge FROM s GROUP BY 1""")
def page_right_edge(spark, d):
    return layout.dominant_edge(rows(spark, d, "spans"), "doc_id", "x1")


@query("SELECT l_linestatus, list_sort(list(l_extendedprice))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1")
def upper_median(spark, d):
    return layout.upper_median(table(spark, d, "lineitem"), "l_linestatus", "l_extendedprice")


@query("SELECT l_returnflag, mode, weight FROM (SELECT l_returnflag, l_quantity AS mode, CAST(count(*) AS BIGINT) AS weight, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber)) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def weighted_mode(spark, d):
    return layout.weighted_mode(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", F.lit(1), F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query("WITH r AS (SELECT DISTINCT conv_id AS doc_id, CAST(turn AS BIGINT) AS page FROM conversations WHERE role <> 'assistant'), g AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS run FROM r), e AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM g GROUP BY doc_id, run) SELECT doc_id, string_agg(CASE WHEN a = b THEN '' || a ELSE a || '–' || b END, '、' ORDER BY a) AS ranges FROM e GROUP BY 1")
def page_ranges(spark, d):
    return layout.page_ranges(table(spark, d, "conversations").filter("role <> 'assistant'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page")))


@query(r"""WITH f AS (SELECT doc_id, total, list_filter(string_split(regexp_replace(regexp_replace(translate(spec, '０１２３４５６７８９–—－~～至到，、;；', '0123456789-------,,,,'), '[第页頁\s]', '', 'g'), '前(\d+)', '1-\1', 'g'), ','), lambda x: x <> '') AS ps FROM {page_specs}),
v AS (SELECT doc_id, total, unnest(ps) AS p FROM f WHERE len(list_filter(ps, lambda x: NOT regexp_matches(x, '^(\d+|\d+-\d*|-\d+)$'))) = 0),
r AS (SELECT doc_id, CAST(total AS BIGINT) AS total, CAST(least(coalesce(TRY_CAST(regexp_extract(p, '^(\d+)', 1) AS DOUBLE), 1), 2147483647) AS BIGINT) AS a, CASE WHEN p LIKE '%-' THEN total ELSE CAST(least(TRY_CAST(regexp_extract(p, '(\d+)$', 1) AS DOUBLE), 2147483647) AS BIGINT) END AS b FROM v)
SELECT DISTINCT doc_id, CAST(unnest(range(greatest(least(a, b), 1), least(greatest(a, b), total) + 1)) AS INTEGER) AS page FROM r""")
def parse_page_ranges(spark, d):
    return layout.parsed_ranges(rows(spark, d, "page_specs"))


@query("""WITH i AS (SELECT *, max(x1) OVER (PARTITION BY line ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {intervals}), n AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY x0, x1) AS run FROM i)
SELECT line, min(x0) AS x0, max(x1) AS x1 FROM n GROUP BY line, run""")
def merge_intervals(spark, d):
    return layout.merged_intervals(rows(spark, d, "intervals"))


@query("""WITH g AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY axis ORDER BY v) > 2 THEN 1 ELSE 0 END AS gap FROM {positions}), r AS (SELECT *, sum(gap) OVER (PARTITION BY axis ORDER BY v) AS run FROM g) SELECT axis, round(avg(v), 6) AS centre, count(*) AS n FROM r GROUP BY axis, run""")
def cluster_centroids(spark, d):
    return layout.centroids(rows(spark, d, "positions"))


@query("SELECT s.doc_id, s.page, s.elem, c.cell FROM (SELECT *, (x0 + x1) / 2 AS cx, (top + bottom) / 2 AS cy FROM {spans}) s LEFT JOIN (SELECT * FROM {cells}) c ON s.doc_id = c.doc_id AND s.page = c.page AND cx >= c.x0 AND cx < c.x1 AND cy >= c.y0 AND cy < c.y1")
def cell_assignment(spark, d):
    return layout.cell_texts(rows(spark, d, "spans"), rows(spark, d, "cells"))


_RULES = """m AS (SELECT doc_id, page, horizontal, round((CASE WHEN horizontal THEN y0 ELSE x0 END) * 2) / 2 AS pl, CASE WHEN horizontal THEN least(x0, x1) ELSE least(y0, y1) END AS a, CASE WHEN horizontal THEN greatest(x0, x1) ELSE greatest(y0, y1) END AS b FROM {segments}),
mr AS (SELECT *, max(b) OVER (PARTITION BY doc_id, page, horizontal, pl ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m), mn AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, horizontal, pl ORDER BY a, b) AS run FROM mr),
rules AS (SELECT doc_id, page, horizontal, pl, min(a) AS a, max(b) AS b FROM mn GROUP BY doc_id, page, horizontal, pl, run)"""


@query("WITH " + _RULES + """, c AS (SELECT * FROM {cells}), e AS (SELECT doc_id, page, cell, 'top' AS edge, true AS horizontal, y0 AS level, x0 AS lo, x1 AS hi FROM c UNION ALL SELECT doc_id, page, cell, 'bottom', true, y1, x0, x1 FROM c UNION ALL SELECT doc_id, page, cell, 'left', false, x0, y0, y1 FROM c UNION ALL SELECT doc_id, page, cell, 'right', false, x1, y0, y1 FROM c),
g AS (SELECT e.doc_id, e.page, cell, edge, sum(coalesce(CASE WHEN abs(pl - level) <= 2 THEN greatest(least(hi, b) - greatest(lo, a), 0.0) ELSE 0.0 END, 0.0)) AS len, max(hi - lo) AS w FROM e LEFT JOIN rules r ON r.doc_id = e.doc_id AND r.page = e.page AND r.horizontal = e.horizontal GROUP BY 1, 2, 3, 4)
SELECT doc_id, page, cell, edge, round(least(len / w, 1.0), 6) AS share, least(len / w, 1.0) >= 0.6 AS border FROM g""")
def edge_coverage(spark, d):
    return layout.edge_coverage(rows(spark, d, "cells"), rows(spark, d, "segments"))


_GUTTER = """s AS (SELECT * FROM {spans}), pg AS (SELECT doc_id, page, min(x0) AS lo, max(x1) AS hi FROM s GROUP BY 1, 2), gx AS (SELECT doc_id, page, unnest(range(CAST(ceil(lo + 0.3 * (hi - lo)) AS INTEGER), CAST(floor(lo + 0.7 * (hi - lo)) AS INTEGER) + 1)) AS x FROM pg),
gk AS (SELECT gx.doc_id, gx.page, gx.x, least(count(*) FILTER (s.x1 <= gx.x), count(*) FILTER (s.x0 >= gx.x)) - count(*) FILTER (s.x0 < gx.x AND s.x1 > gx.x) AS score FROM gx JOIN s ON s.doc_id = gx.doc_id AND s.page = gx.page GROUP BY 1, 2, 3),
gutter AS (SELECT doc_id, page, CAST(x AS INTEGER) AS x, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, x) AS r FROM gk) WHERE r = 1)"""


@query("WITH " + _GUTTER + " SELECT * FROM gutter")
def gutter_score(spark, d):
    return layout.gutters(rows(spark, d, "spans"))


@query("""WITH RECURSIVE s AS (SELECT * FROM {segments}), e AS (SELECT h.doc_id, h.page, h.seg AS a, v.seg AS b FROM s h JOIN s v ON h.horizontal AND NOT v.horizontal AND h.doc_id = v.doc_id AND h.page = v.page AND v.x0 >= h.x0 - 2.5 AND v.x0 <= h.x1 + 2.5 AND h.y0 >= v.y0 - 2.5 AND h.y0 <= v.y1 + 2.5),
l AS (SELECT * FROM e UNION ALL SELECT doc_id, page, b, a FROM e), r AS (SELECT doc_id, page, seg, seg AS root FROM s UNION SELECT r.doc_id, r.page, l.b, r.root FROM r JOIN l ON l.doc_id = r.doc_id AND l.page = r.page AND l.a = r.seg)
SELECT doc_id, page, seg, min(root) AS root FROM r GROUP BY 1, 2, 3""")
def table_components(spark, d):
    return layout.segment_components(spark, rows(spark, d, "segments"))


@query("""WITH RECURSIVE e AS (SELECT * FROM {edges}), n AS (SELECT graph, src AS node FROM e UNION SELECT graph, dst FROM e), w AS (SELECT graph, node, 0 AS level FROM n UNION SELECT w.graph, e.dst, w.level + 1 FROM w JOIN e ON e.graph = w.graph AND e.src = w.node)
SELECT graph, node, max(level) AS level FROM w GROUP BY 1, 2""")
def diagram_levels(spark, d):
    return layout.diagram_levels(spark, rows(spark, d, "edges"))


@query(r"""WITH s AS (SELECT doc_id, page, regexp_replace(text, '[0-9]+', '#', 'g') AS norm, regexp_extract_all(text, '[0-9]+') AS a FROM {spans}), n AS (SELECT doc_id, page, norm, unnest(range(0, len(a))) AS pos, unnest(a) AS n FROM s),
b AS (SELECT doc_id, norm, pos, TRY_CAST(n AS BIGINT) - page AS shift, count(DISTINCT page) AS pages, count(DISTINCT n) AS numbers FROM n GROUP BY 1, 2, 3, 4), t AS (SELECT doc_id, count(DISTINCT page) AS total FROM s GROUP BY 1)
SELECT b.doc_id, norm, CAST(pos AS INTEGER) AS pos, shift, pages FROM b JOIN t ON t.doc_id = b.doc_id WHERE pages >= greatest(2, ceil(total * 0.8)) AND numbers >= 2""")
def line_counters(spark, d):
    return layout.page_counters(rows(spark, d, "spans"))


@query("""WITH d AS (SELECT doc_id, size, lead(top) OVER (PARTITION BY doc_id, page, size, floor(x0) ORDER BY top) - top AS d FROM {spans}), f AS (SELECT * FROM d WHERE d > 0 AND d >= 0.9 * size AND d <= 3.5 * size), b AS (SELECT doc_id, size, floor(d * 2 + 0.5) / 2 AS bin, count(*) AS n FROM f GROUP BY 1, 2, 3),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, size ORDER BY bin RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS near, sum(n) OVER (PARTITION BY doc_id, size) AS pairs FROM b), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, size ORDER BY near DESC, bin) AS r FROM s) WHERE r = 1 AND pairs >= 8 AND near >= 0.4 * pairs)
SELECT doc_id, size, list_sort(list(d))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS pitch, CAST(max(pairs) AS BIGINT) AS pairs FROM f JOIN t USING (doc_id, size) WHERE abs(d - bin) <= 0.75 GROUP BY 1, 2""")
def line_pitch(spark, d):
    return pages.pitches(rows(spark, d, "spans"))


@query("SELECT doc_id, page, fill, color FROM {fills} WHERE x1 - x0 >= 0.85 * width AND bottom - top >= 0.85 * height AND (x1 - x0) * (bottom - top) >= 0.7 * width * height")
def page_backgrounds(spark, d):
    return layout.page_backgrounds(rows(spark, d, "fills"))


@query("""WITH f AS (SELECT doc_id, page, x0 AS a, x1 AS b, top AS t, bottom AS u, color FROM {fills} WHERE bottom - top <= 40 AND x1 - x0 <= 0.9 * width), s AS (SELECT * FROM {spans}), m AS (SELECT s.doc_id, s.page, elem, color, greatest(least(x1, b) - greatest(x0, a), 0.0) AS o, x1 - x0 AS w FROM s JOIN f ON f.doc_id = s.doc_id AND f.page = s.page AND (s.top + s.bottom) / 2 BETWEEN t AND u AND (u - t) / size BETWEEN 0.6 AND 2.6),
g AS (SELECT doc_id, page, elem, color, sum(o) AS o, max(w) AS w FROM m GROUP BY 1, 2, 3, 4) SELECT doc_id, page, elem, arg_max(color, {'o': o, 'c': color}) AS color FROM g WHERE o >= 0.5 * w GROUP BY 1, 2, 3""")
def text_highlights(spark, d):
    return layout.highlights(rows(spark, d, "spans"), rows(spark, d, "fills"))


@query("SELECT doc_id, ordinal AS was, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN moved THEN (SELECT max(ordinal) FROM {moves} WHERE anchor) ELSE ordinal END, moved, ordinal) AS INTEGER) AS ordinal, text FROM {moves}".replace("FROM {moves} WHERE anchor", "FROM (SELECT ordinal, anchor FROM {moves}) WHERE anchor"))
def move_blocks(spark, d):
    return blocks.moved(rows(spark, d, "moves"))


@query("SELECT turn, CAST(batch AS BIGINT) AS batch, count(*) AS calls, bool_and(safe) AS parallel FROM (SELECT *, sum(new) OVER (PARTITION BY turn ORDER BY pos) AS batch FROM (SELECT *, CASE WHEN safe AND coalesce(lag(safe) OVER (PARTITION BY turn ORDER BY pos), false) THEN 0 ELSE 1 END AS new FROM {batch_calls})) GROUP BY 1, 2")
def tool_batches(spark, d):
    return control.call_batches(rows(spark, d, "batch_calls"))


@query("SELECT session, count(*) FILTER (status = 'done') AS done, count(*) AS total FROM {todos} GROUP BY 1")
def todo_progress(spark, d):
    return rows(spark, d, "todos").groupBy("session").agg(F.count_if(F.col("status") == "done").alias("done"), F.count(F.lit(1)).alias("total"))


@query("SELECT name, arg_min(source, prio * 100 + pos) AS source FROM {names} GROUP BY 1")
def first_name_wins(spark, d):
    return control.first_wins(rows(spark, d, "names"))


@query(r"SELECT file_id, name, CASE WHEN regexp_matches(lower(name), '\.(docx|dotx|docm)$') THEN 'docx' WHEN regexp_matches(lower(name), '\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(name), '\.(html|htm|xhtml)$') THEN 'html' WHEN regexp_matches(lower(name), '\.(md|markdown|txt)$') THEN 'markdown' ELSE 'unsupported' END AS format FROM {files}")
def detect_format(spark, d):
    return control.detected_formats(rows(spark, d, "files"))


@query(r"""SELECT file_id, CASE WHEN k = 0 THEN c ELSE regexp_replace(c, '\.[^.]+$', '') || '-' || k || regexp_extract(c, '(\.[^.]+)$', 1) END AS stored FROM (SELECT file_id, c, row_number() OVER (PARTITION BY c ORDER BY file_id) - 1 AS k FROM (SELECT file_id, regexp_replace(name, '[\\/:*?"<>|]', '_', 'g') AS c FROM {files}))""")
def stored_names(spark, d):
    return control.stored_names(rows(spark, d, "files"))


@query(r"SELECT doc_id, part, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY regexp_replace(part, '[0-9]+.*$', ''), CAST(coalesce(nullif(regexp_extract(part, '([0-9]+)', 1), ''), '0') AS INTEGER), part) AS INTEGER) AS ordinal FROM {parts} WHERE version = 0")
def natural_part_order(spark, d):
    w = Window.partitionBy("doc_id").orderBy(F.regexp_replace("part", "[0-9]+.*$", ""), F.coalesce(F.regexp_extract("part", "([0-9]+)", 1).try_cast("int"), F.lit(0)), "part")
    return rows(spark, d, "parts").filter("version = 0").select("doc_id", "part", F.row_number().over(w).alias("ordinal"))


@query(r"SELECT id, regexp_matches(text, '^(?i:fig(ure)?)\.?\s*\d') AS figure, regexp_matches(text, '^(?:TABLE|Table)\s+([IVX]+|\d+)') AS tabular, regexp_matches(text, '^[图表]\s*\d') AS chinese FROM {captions}")
def caption_kinds(spark, d):
    t = F.col("text")
    return rows(spark, d, "captions").select("id", t.rlike(r"^(?i:fig(ure)?)\.?\s*\d").alias("figure"), t.rlike(r"^(?:TABLE|Table)\s+([IVX]+|\d+)").alias("tabular"), t.rlike(r"^[图表]\s*\d").alias("chinese"))


@query(r"SELECT id, replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), chr(173), '') AS expanded, regexp_matches(text, '^(?:\S ){3,}\S$') AS spaced, trim(regexp_replace(text, '(?s)<system-reminder>.*?</system-reminder>', '', 'g')) AS shown FROM {odd_texts}")
def text_cleanups(spark, d):
    t = F.col("text")
    return rows(spark, d, "odd_texts").select("id", tx.ligatures_expanded(t).alias("expanded"), t.rlike(r"^(?:\S ){3,}\S$").alias("spaced"), F.trim(F.regexp_replace(t, "(?s)<system-reminder>.*?</system-reminder>", "")).alias("shown"))


@query("SELECT id, round(w + (length(text) - w) * CAST(0.55 AS DOUBLE), 2) AS width FROM (SELECT id, text, len(regexp_extract_all(text, '[⺀-鿿가-힯豈-﫿＀-｠]')) AS w FROM {odd_texts})")
def display_widths(spark, d):
    return rows(spark, d, "odd_texts").select("id", tx.display_width(F.col("text")).alias("width"))


@query("SELECT doc_id, CASE WHEN length(text) > 30000 THEN left(text, 30000) || '…' ELSE text END AS shown FROM (SELECT doc_id, text FROM documents)".replace("AS shown", "AS t").replace("SELECT doc_id, CASE", "SELECT doc_id, md5(CASE").replace("ELSE text END AS t", "ELSE text END) AS digest"))
def result_truncation(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(F.when(F.length(t) > 30000, F.concat(F.left(t, F.lit(30000)), F.lit("…"))).otherwise(t)).alias("digest"))


_SEG = "WITH r AS (SELECT c_mktsegment, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) "


def _segments(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("c_mktsegment", F.year("o_orderdate").alias("y"), "o_totalprice")


@query(_SEG + "SELECT c_mktsegment, '| y | v |' || chr(10) || '| --- | --- |' || string_agg(chr(10) || '| ' || y || ' | ' || n || ' |', '' ORDER BY y) AS markdown FROM (SELECT c_mktsegment, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1")
def table_markdown(spark, d):
    n = _segments(spark, d).groupBy("c_mktsegment", "y").agg(F.count(F.lit(1)).alias("n"))
    rows = n.select("c_mktsegment", F.col("y").alias("pos"), F.array(F.col("y").cast("string"), F.col("n").cast("string")).alias("cells"))
    head = n.select("c_mktsegment").distinct().select("c_mktsegment", F.lit(0).alias("pos"), F.array(F.lit("y"), F.lit("v")).alias("cells"))
    return markup.markdown_rows(rows.unionByName(head), "c_mktsegment", "cells")


@query("SELECT o_orderpriority, " + ", ".join(f"coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 2), 0.0) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1")
def chart_matrix(spark, d):
    return markup.chart_matrix(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", list("FOP"))


@query("SELECT l_linestatus, CAST(i AS INTEGER) AS tick, round(lo + (hi - lo) * i / 4, 4) AS at FROM (SELECT l_linestatus, least(min(l_extendedprice), 0.0) AS lo, greatest(max(l_extendedprice), 0.0) AS hi, unnest(range(0, 5)) AS i FROM lineitem GROUP BY 1)")
def chart_ticks(spark, d):
    return markup.chart_ticks(table(spark, d, "lineitem"), "l_linestatus", "l_extendedprice")


@query(r"""WITH s AS (SELECT doc_id, size, bold, font, count(*) AS n, count(*) FILTER (size > 10 OR bold) AS c FROM {spans} GROUP BY 1, 2, 3, 4), t AS (SELECT doc_id, sum(n) AS total FROM s GROUP BY 1),
v AS (SELECT s.* FROM s JOIN t ON t.doc_id = s.doc_id WHERE c > 0 AND n <= greatest(3, total * 0.15)) SELECT doc_id, size, bold, font, n, CAST(least(3, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, bold DESC, font)) AS INTEGER) AS level FROM v""")
def heading_signatures(spark, d):
    return layout.heading_levels(rows(spark, d, "spans"))


@query(r"""WITH s AS (SELECT * FROM {spans}), n AS (SELECT doc_id, page, TRY_CAST(unnest(regexp_extract_all(text, '[0-9]+')) AS BIGINT) - page AS shift FROM s), b AS (SELECT doc_id, shift, count(DISTINCT page) AS pages FROM n GROUP BY 1, 2), t AS (SELECT doc_id, count(DISTINCT page) AS total FROM s GROUP BY 1)
SELECT doc_id, shift, pages FROM (SELECT b.*, total, row_number() OVER (PARTITION BY b.doc_id ORDER BY pages DESC, shift) AS r FROM b JOIN t ON t.doc_id = b.doc_id) WHERE r = 1 AND pages >= greatest(2, ceil(total / 2))""")
def page_number_offset(spark, d):
    return layout.page_offset(rows(spark, d, "spans"))


@query("SELECT doc_id, odd, line, n FROM (SELECT doc_id, page % 2 AS odd, regexp_replace(text, '[0-9]+', '#', 'g') AS line, count(*) AS n, row_number() OVER (PARTITION BY doc_id, page % 2 ORDER BY count(*) DESC, regexp_replace(text, '[0-9]+', '#', 'g')) AS r FROM {spans} WHERE top <= 80 GROUP BY 1, 2, 3) WHERE r = 1")
def header_signatures(spark, d):
    return layout.header_signatures(rows(spark, d, "spans"))


@query("WITH " + _GUTTER + """, f AS (SELECT s.*, coalesce(s.x0 < g.x AND s.x1 > g.x, true) AS full_ FROM s LEFT JOIN gutter g ON g.doc_id = s.doc_id AND g.page = s.page AND g.score > 0), n AS (SELECT *, CASE WHEN full_ = lag(full_) OVER (PARTITION BY doc_id, page ORDER BY top, x0) THEN 0 ELSE 1 END AS new FROM f), z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY top, x0) AS zone FROM n)
SELECT doc_id, page, CAST(zone AS BIGINT) AS zone, bool_or(full_) AS "full", count(*) AS lines, min(top) AS top, max(bottom) AS bottom FROM z GROUP BY 1, 2, 3""")
def column_zones(spark, d):
    spans = rows(spark, d, "spans")
    return layout.zones(spans, layout.gutters(spans).filter("score > 0"))


@query("SELECT doc_id, page, elem, CASE WHEN len(list_filter(e, lambda x: x >= m - 1.5)) >= 3 THEN m END AS edge FROM (SELECT *, list_max(e) AS m FROM (SELECT doc_id, page, elem, list(x1) OVER (PARTITION BY doc_id, page, floor(x0) ORDER BY top ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS e FROM {spans}))")
def local_right_edges(spark, d):
    return layout.local_right_edges(rows(spark, d, "spans"))


@query("""WITH l AS (SELECT doc_id, text, n, CASE WHEN n % 40 = 0 THEN 1 ELSE 0 END AS cut FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)), p AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM l),
i AS (SELECT doc_id, n, part, floor(coalesce(sum(length(text)) OVER (PARTITION BY doc_id, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 3000) AS p FROM p), f AS (SELECT doc_id, part, coalesce(sum(max(p) + 1) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM i GROUP BY 1, 2)
SELECT i.doc_id, CAST(n AS INTEGER) AS ordinal, CAST(first + p + 1 AS INTEGER) AS page FROM i JOIN f ON f.doc_id = i.doc_id AND f.part = i.part WHERE first + p + 1 <= 50""")
def estimated_pages(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("doc_id", (F.col("n") + 1).alias("ordinal"), "text")
    return layout.estimated_pages(lines, breaks=F.col("ordinal") % 40 == 0)


@query("WITH m AS (SELECT l_returnflag, count(*) AS n, list_sort(list(l_discount - 0.1))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS m FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1) SELECT l_returnflag, round(floor(m * 20 + 0.5) / 20, 2) AS spacing, n FROM m WHERE n >= 2 AND abs(m) >= 0.03")
def char_spacing(spark, d):
    return layout.char_spacing(table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") - 0.1).alias("extra")), "l_returnflag", "extra")


_FAMILY = r"regexp_replace(b, '(?:PS)?[-,]?(?:BoldItalic|BoldOblique|Bold|Italic|Oblique)?(?:MT)?$', '')"
_COMMON = "CASE " + " ".join(f"WHEN regexp_matches(regexp_replace(lower(family), '[\\s_]', '', 'g'), '^({k})') THEN '{v}'" for k, v in reversed(layout.FAMILIES.items())) + " ELSE family END"


@query("SELECT id, family, " + _COMMON + " AS common, bold, italic FROM (SELECT id, " + _FAMILY + r" AS family, contains(b, 'Bold') AS bold, contains(b, 'Italic') OR contains(b, 'Oblique') AS italic FROM (SELECT id, regexp_replace(font, '^[A-Z]{6}\+', '') AS b FROM {fonts}))")
def font_parts(spark, d):
    return layout.font_parts(rows(spark, d, "fonts"))


@query("SELECT doc_id, page, round((780 - max(bottom)) / 720.0, 6) AS blank, (780 - max(bottom)) / 720.0 > 0.15 AS too_blank FROM {spans} WHERE bottom <= 740 GROUP BY 1, 2")
def blank_pages(spark, d):
    return layout.blank_pages(rows(spark, d, "spans"))


@query("SELECT c.doc_id, c.page, c.cell, arg_max(f.color, f.fill) AS color FROM (SELECT * FROM {cells}) c LEFT JOIN (SELECT * FROM {fills}) f ON f.doc_id = c.doc_id AND f.page = c.page AND (c.x0 + c.x1) / 2 BETWEEN f.x0 AND f.x1 AND (c.y0 + c.y1) / 2 BETWEEN f.top AND f.bottom GROUP BY 1, 2, 3")
def cell_shading(spark, d):
    return layout.fill_cells(rows(spark, d, "cells"), rows(spark, d, "fills"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, pos) AS INTEGER) AS ordinal, text FROM (SELECT doc_id, ordinal AS place, 0 AS pos, text FROM {blocks} UNION ALL SELECT doc_id, after, pos, text FROM {inserts})")
def insert_blocks(spark, d):
    return blocks.inserted(rows(spark, d, "blocks"), rows(spark, d, "inserts"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS INTEGER) AS ordinal, text, CASE WHEN gone THEN 'protected' ELSE 'ok' END AS status FROM (SELECT b.*, g.doc_id IS NOT NULL AS gone, count(*) OVER (PARTITION BY b.doc_id) AS n FROM (SELECT * FROM {blocks}) b LEFT JOIN (SELECT * FROM {deletes}) g ON g.doc_id = b.doc_id AND g.ordinal = b.ordinal) WHERE NOT gone OR n = 1")
def delete_blocks(spark, d):
    return blocks.deleted(rows(spark, d, "blocks"), rows(spark, d, "deletes"))


@query(r"SELECT doc_id, 'modified' AS change, CAST(n AS INTEGER) AS old_block, CAST(n AS INTEGER) AS new_block FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS text, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS n FROM documents) WHERE contains(text, 'tion')")
def changed_blocks(spark, d):
    return compare.changed_blocks(_both(spark, d))


@query("SELECT id, kind, again, CASE WHEN again THEN least(30.0, pow(2.0, attempt - 1)) END AS delay FROM (SELECT *, kind IN ('rate_limit', 'server', 'network') AND attempt < 5 AS again FROM (SELECT *, CASE WHEN aborted THEN 'aborted' WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status = 401 THEN 'auth' WHEN status = 402 THEN 'balance' WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'server' WHEN status = 0 THEN 'network' ELSE 'invalid' END AS kind FROM {attempts}))")
def retry_plan(spark, d):
    return control.retries(rows(spark, d, "attempts"))


@query("SELECT id, coalesce(matcher = '*' OR regexp_full_match(tool, nullif(matcher, '*')), true) AS match FROM {hooks}")
def hook_matches(spark, d):
    return control.hook_matches(rows(spark, d, "hooks"))


@query("SELECT lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (contains(text, chr(10))) AS multiline FROM documents GROUP BY 1")
def corpus_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"), F.count_if(F.contains("text", F.lit("\n"))).alias("multiline"))


@query("SELECT id, regexp_matches(w, '" + pages.BULLET + "') AS bullet, regexp_matches(w, '" + pages.CLAUSE + "') AS clause, regexp_matches(text, '" + pages.HEADING_NUMBER + "') AS numbered FROM (SELECT id, text, string_split_regex(trim(text), '\\s+')[1] AS w FROM {odd_texts})")
def label_kinds(spark, d):
    return pages.label_kinds(rows(spark, d, "odd_texts"))


@query("SELECT doc_id, page, mark, arg_min(elem, {'o': off, 'e': elem}) AS host, CASE WHEN arg_min(u < bottom, {'o': off, 'e': elem}) THEN 'superscript' ELSE 'subscript' END AS script FROM (SELECT h.*, m.elem AS mark, m.bottom AS u, abs(h.bottom - m.bottom) AS off FROM (SELECT * FROM {scripts}) h JOIN (SELECT * FROM {scripts}) m ON m.doc_id = h.doc_id AND m.page = h.page AND m.size <= 0.85 * h.size AND length(regexp_replace(m.text, '\\s', '', 'g')) BETWEEN 1 AND 30 AND m.x0 >= h.x0 - 2 AND m.x1 <= h.x1 + 2.5 * h.size AND abs(h.bottom - m.bottom) <= 0.75 * h.size) GROUP BY 1, 2, 3")
def attached_marks(spark, d):
    return pages.attached_marks(rows(spark, d, "scripts"))


@query("SELECT id, CASE WHEN x0 - 0.5 <= cx AND x1 + 0.5 >= cx THEN left(text, k + 1) || translate(trim(accent), '" + pages.ACCENTS + "', '" + pages.COMBINING + "') || substring(text, k + 2) ELSE text END AS text FROM (SELECT *, CAST(least(length(text) - 1, greatest(0, floor((cx - x0) / greatest(0.1, x1 - x0) * length(text)))) AS INTEGER) AS k FROM {accents})")
def folded_accents(spark, d):
    return pages.folded_accents(rows(spark, d, "accents"))


@query("SELECT doc_id, page, CAST(line AS INTEGER) AS line, string_agg(text, ' ' ORDER BY x0, elem) AS text, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom, count(*) AS spans, max(size) AS size FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY bottom) AS line FROM " + DERIVED["spans"][1] + ") GROUP BY 1, 2, 3")
def line_assembly(spark, d):
    s = rows(spark, Corpus(d), "spans")
    return pages.line_table(s, pages.assembled_lines(s))


@query()
def column_gutters(spark, d):
    s = rows(spark, Corpus(d), "spans")
    return pages.column_gutters(s, pages.assembled_lines(s))


# Front pages set from documents' words: ten a line, two of them left of the corridor; thirty lines a page and a line across below.
@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n\r\t]+'), lambda x: x <> '') AS w FROM documents), k AS (SELECT doc_id, w, unnest(range(0, (len(w) + 9) // 10)) AS k FROM w),
t AS (SELECT doc_id, CAST(k // 30 + 1 AS INTEGER) AS page, k % 30 AS i, array_to_string(w[k * 10 + 1 : k * 10 + 2], ' ') AS a, array_to_string(w[k * 10 + 3 : k * 10 + 10], ' ') AS b FROM k),
l AS (SELECT doc_id, page, count(*) AS n, count(*) AS nl, count(*) FILTER (b <> '') AS nr, sum(length(a)) AS cl, sum(length(b)) AS cr, max(72.0 + least(length(a) * 4, 100)) AS e, string_agg(a, chr(10) ORDER BY i) AS lt, string_agg(b, chr(10) ORDER BY i) FILTER (b <> '') AS rt FROM t GROUP BY 1, 2)
SELECT doc_id, page, CAST(1 AS INTEGER) AS block, CAST(69 AS DOUBLE) AS x0, CAST((e + 200) / 2 AS DOUBLE) AS border, CAST(543 AS DOUBLE) AS x1, CAST(99 AS DOUBLE) AS y0, CAST(111 + 12 * (n - 1) AS DOUBLE) AS y1, CASE WHEN doc_id % 3 < 2 THEN CAST(110.5 AS DOUBLE) END AS rule, CAST(n AS INTEGER) AS lines, lt AS left, rt AS right
FROM l WHERE n >= 6 AND nr >= 3 AND cl >= 40 AND cr >= 40 AND (doc_id % 3 = 0 OR page = 1 AND n >= 8 AND nr >= 4)""")
def side_by_side(spark, d):
    """Rules under both heads (every third document), under the left one or none, by which a block needs to be on the first page."""
    w = table(spark, d, "documents").select("doc_id", F.expr(r"filter(split(text, '[ \\n\\r\\t]+'), x -> x <> '')").alias("w")).filter("size(w) > 0")
    k = w.select("doc_id", "w", F.explode(F.expr("sequence(0, (size(w) + 9) div 10 - 1)")).alias("k"))
    k = k.selectExpr("doc_id", "CAST(k div 30 + 1 AS INT) AS page", "CAST(k % 30 AS INT) AS i", "array_join(slice(w, k * 10 + 1, 2), ' ') AS a", "array_join(slice(w, k * 10 + 3, 8), ' ') AS b", "k % 30 = 29 OR k = (size(w) + 9) div 10 - 1 AS last")
    at = "{0} + 12.0D * i AS top, {1} + 12.0D * i AS bottom, 10.0D AS size, 792.0D AS height"
    spans = _stacked(
        k, ("doc_id, page, 2 * i AS elem, a AS text, 72.0D AS x0, 72.0D + least(length(a) * 4.0D, 100.0D) AS x1, " + at.format("100.0D", "110.0D"), "true"),
        ("doc_id, page, 2 * i + 1 AS elem, b AS text, 200.0D AS x0, 540.0D AS x1, " + at.format("100.0D", "110.0D"), "b <> ''"), ("doc_id, page, 1000 AS elem, 'across' AS text, 72.0D AS x0, 540.0D AS x1, " + at.format("112.0D", "122.0D"), "last"),
    )
    under = lambda where, y, x0, x1: (f"doc_id, page, {y}D AS y, {x0}D AS x0, {x1}D AS x1", f"i = 0 AND {where}")
    rules = _stacked(k, under("doc_id % 3 < 2", 110.5, 72.0, 120.0), under("doc_id % 3 = 0", 111.0, 200.0, 260.0))
    return beside.side_by_side(spans, None, rules)


@query()
def gutter_consensus(spark, d):
    return pages.agreed_gutters(pages.page_columns(rows(spark, Corpus(d), "spans")))


def _side_lines(spark, d):
    return rows(spark, Corpus(d), "spans").filter("font = 'Serif'").withColumn("side", F.when(F.col("x0") < 300, 0).otherwise(1))


@query()
def page_paragraphs(spark, d):
    return pages.paragraphs(_side_lines(spark, d))


@query()
def paragraph_shapes(spark, d):
    lines = _side_lines(spark, d)
    return pages.paragraph_shapes(lines, pages.paragraphs(lines), F.when(F.col("side") == 0, 72.0).otherwise(320.0), F.when(F.col("side") == 0, 300.0).otherwise(548.0))


@query(r"""WITH l AS (SELECT doc_id, n, trim(text) AS t, trim(lag(text) OVER (PARTITION BY doc_id ORDER BY n)) AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
k AS (SELECT *, CASE WHEN t <> '' AND b <> '' AND NOT regexp_matches(string_split_regex(t, '\s')[1], '{BULLET}') AND NOT regexp_matches(string_split_regex(t, '\s')[1], '{CLAUSE}') AND NOT regexp_matches(t, '{CAPTION}') AND (NOT regexp_matches(b, '[.!?。！？:：]["''”’)\]]?$') OR regexp_matches(t, '^[a-z]')) THEN 0 ELSE 1 END AS new FROM l), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM k)
SELECT doc_id, CAST(min(n) AS INTEGER) AS first, CAST(max(n) AS INTEGER) AS last, count(*) AS pieces FROM r GROUP BY doc_id, run""".replace("{BULLET}", pages.BULLET).replace("{CLAUSE}", pages.CLAUSE).replace("{CAPTION}", pages.CAPTION))
def merged_paragraphs(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).select("doc_id", (F.col("ordinal") + 1).alias("ordinal"), F.trim("text").alias("text"))
    shaped = lines.select("*", F.lit(10.0).alias("size"), F.lit("left").alias("align"), F.lit(0.0).alias("first_line"), F.lit(True).alias("last_full"), F.lit(False).alias("heading"))
    return pages.merged_paragraphs(shaped).select("doc_id", "first", "last", (F.col("last") - F.col("first") + 1).cast("long").alias("pieces"))


_RULED = """WITH RECURSIVE s AS (SELECT * FROM {segments}), e AS (SELECT h.doc_id, h.page, h.seg AS a, v.seg AS b FROM s h JOIN s v ON h.horizontal AND NOT v.horizontal AND h.doc_id = v.doc_id AND h.page = v.page AND v.x0 >= h.x0 - 2.5 AND v.x0 <= h.x1 + 2.5 AND h.y0 >= v.y0 - 2.5 AND h.y0 <= v.y1 + 2.5),
l AS (SELECT * FROM e UNION ALL SELECT doc_id, page, b, a FROM e), r AS (SELECT doc_id, page, seg, seg AS root FROM s UNION SELECT r.doc_id, r.page, l.b, r.root FROM r JOIN l ON l.doc_id = r.doc_id AND l.page = r.page AND l.a = r.seg), c AS (SELECT doc_id, page, seg, min(root) AS tab FROM r GROUP BY 1, 2, 3),
v AS (SELECT c.*, horizontal, CASE WHEN horizontal THEN y0 ELSE x0 END AS v FROM c JOIN s USING (doc_id, page, seg)), g AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY doc_id, page, tab, horizontal ORDER BY v) > 2 THEN 1 ELSE 0 END AS gap FROM v), u AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, page, tab, horizontal ORDER BY v ROWS UNBOUNDED PRECEDING) AS run FROM g),
k AS (SELECT doc_id, page, tab, horizontal, run, avg(v) AS v, count(*) AS k FROM u GROUP BY 1, 2, 3, 4, 5), t AS (SELECT doc_id, page, tab, min(v) FILTER (NOT horizontal) AS x0, max(v) FILTER (NOT horizontal) AS x1, min(v) FILTER (horizontal) AS y0, max(v) FILTER (horizontal) AS y1, count(*) FILTER (horizontal) AS ys, count(*) FILTER (NOT horizontal) AS xs, sum(k) FILTER (horizontal) AS hs, sum(k) FILTER (NOT horizontal) AS vs FROM k GROUP BY 1, 2, 3)
SELECT doc_id, page, tab, x0, x1, y0, y1, CAST(ys - 1 AS INTEGER) AS n_rows, CAST(xs - 1 AS INTEGER) AS n_cols FROM t WHERE hs >= 2 AND vs >= 2 AND xs >= 2 AND ys >= 2 AND x1 - x0 >= 20 AND y1 - y0 >= 8"""


@query(_RULED)
def ruled_tables(spark, d):
    return pages.ruled_tables(layout.with_components(rows(spark, d, "segments")))


# What lies in the orders' grids: slanting lines, coloured and grey fills, texts about as long as a grid without words allows.
_IN_GRIDS = {
    "paths": "doc_id, 1 AS page, 72e0 AS x0, CASE WHEN doc_id % 8 = 4 THEN -300e0 ELSE 91e0 END AS y0, 500e0 AS x1, CASE WHEN doc_id % 8 = 4 THEN -100e0 ELSE 89e0 + 20e0 * k END AS y1, false AS curved, doc_id % 4 = 0 AS diagonal",
    "fills": "doc_id, 1 AS page, 80e0 + 30e0 * i AS x0, 100e0 + 30e0 * i AS x1, 90e0 AS top, 95e0 AS bottom, CASE WHEN i = 2 AND doc_id % 8 = 5 THEN '808284' WHEN i = 1 THEN '00Ff00' ELSE 'c01020' END AS color",
    "spans": "doc_id, 1 AS page, concat(repeat('a ', CAST(4 * k AS INTEGER)), CASE WHEN doc_id % 2 = 1 THEN 'b' ELSE ' ' END) AS text, 100e0 AS x0, 300e0 AS x1, 92e0 AS top, 102e0 AS bottom",
}


@query("WITH t AS (SELECT * FROM (" + _RULED.replace("{segments}", DERIVED["segments"][1]) + f""")), o AS (SELECT l_orderkey AS doc_id, CAST(count(*) AS INTEGER) AS k FROM lineitem GROUP BY 1), p AS (SELECT {_IN_GRIDS['paths']} FROM o WHERE doc_id % 4 = 0), f AS (SELECT {_IN_GRIDS['fills']} FROM (SELECT *, unnest([0, 1, 2]) AS i FROM o WHERE doc_id % 4 = 1)), s AS (SELECT {_IN_GRIDS['spans']} FROM o WHERE doc_id % 3 = 0),
a AS (SELECT DISTINCT t.doc_id, t.tab FROM t JOIN p ON p.doc_id = t.doc_id AND p.y0 >= t.y0 - 4 AND p.y1 <= t.y1 + 4 AND p.x0 >= t.x0 - 4 AND p.x1 <= t.x1 + 4 AND greatest(p.x1 - p.x0, p.y1 - p.y0) > 0.15 * least(t.x1 - t.x0, t.y1 - t.y0)
  UNION SELECT t.doc_id, t.tab FROM t JOIN f ON f.doc_id = t.doc_id AND f.color <> '808284' AND f.x0 >= t.x0 - 4 AND f.x1 <= t.x1 + 4 AND f.top >= t.y0 - 4 AND f.bottom <= t.y1 + 4 GROUP BY 1, 2 HAVING count(*) >= 3),
c AS (SELECT t.doc_id, t.tab, sum(length(replace(s.text, ' ', ''))) AS n FROM t JOIN s ON s.doc_id = t.doc_id AND 200 > t.x0 AND 200 < t.x1 AND 97 > t.y0 AND 97 < t.y1 GROUP BY 1, 2)
SELECT t.* FROM t LEFT JOIN a ON a.doc_id = t.doc_id AND a.tab = t.tab LEFT JOIN c ON c.doc_id = t.doc_id AND c.tab = t.tab WHERE a.doc_id IS NULL OR coalesce(c.n, 0) > greatest(6, 2 * t.n_rows * t.n_cols)""", corpus=False)
def tables_without_charts(spark, d):
    """Ruled tables of the orders' grids, without those that hold a drawing and hardly any text."""
    tables = pages.ruled_tables(layout.with_components(rows(spark, Corpus(d), "segments")))
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("k"))
    put = lambda name, df: spark.sql(f"SELECT {_IN_GRIDS[name]} FROM {{o}}", o=df)
    return charts.without_chart_grids(tables, put("paths", o.filter("doc_id % 4 = 0")), put("fills", o.filter("doc_id % 4 = 1").withColumn("i", F.explode(F.array(*map(F.lit, (0, 1, 2)))))), put("spans", o.filter("doc_id % 3 = 0")))


def _grid(spark, d):
    w = Window.partitionBy("doc_id", "page")
    return rows(spark, d, "cells").withColumn("r", F.dense_rank().over(w.orderBy("y0"))).withColumn("c", F.dense_rank().over(w.orderBy("x0")))


@query("WITH " + _RULES + """, c AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y0) AS r, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY x0) AS c FROM {cells}), e AS (SELECT doc_id, page, cell, 'top' AS edge, true AS horizontal, y0 AS level, x0 AS lo, x1 AS hi FROM c UNION ALL SELECT doc_id, page, cell, 'left', false, x0, y0, y1 FROM c),
q AS (SELECT e.doc_id, e.page, cell, edge, least(sum(coalesce(CASE WHEN abs(pl - level) <= 2 THEN greatest(least(hi, b) - greatest(lo, a), 0.0) ELSE 0.0 END, 0.0)) / max(hi - lo), 1.0) >= 0.6 AS border FROM e LEFT JOIN rules r ON r.doc_id = e.doc_id AND r.page = e.page AND r.horizontal = e.horizontal GROUP BY 1, 2, 3, 4),
h AS (SELECT doc_id, page, cell, bool_or(edge = 'left' AND border) AS lft, bool_or(edge = 'top' AND border) AS tp FROM q GROUP BY 1, 2, 3), o AS (SELECT c.*, tp, CASE WHEN lft OR row_number() OVER (PARTITION BY c.doc_id, c.page, c.r ORDER BY c.c) = 1 THEN 1 ELSE 0 END AS new FROM c JOIN h ON h.doc_id = c.doc_id AND h.page = c.page AND h.cell = c.cell),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, r ORDER BY c ROWS UNBOUNDED PRECEDING) AS g FROM o), w AS (SELECT doc_id, page, r, min(c) AS c0, max(c) AS c1, bool_or(tp) AS tp FROM g GROUP BY doc_id, page, r, g), y AS (SELECT *, CASE WHEN NOT tp AND coalesce(lag(r) OVER (PARTITION BY doc_id, page, c0, c1 ORDER BY r) = r - 1, false) THEN 0 ELSE 1 END AS new FROM w),
z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, c0, c1 ORDER BY r ROWS UNBOUNDED PRECEDING) AS run FROM y) SELECT doc_id, page, CAST(min(r) AS INTEGER) AS r, CAST(c0 AS INTEGER) AS c, CAST(count(*) AS INTEGER) AS row_span, CAST(c1 - c0 + 1 AS INTEGER) AS col_span FROM z GROUP BY doc_id, page, c0, c1, run""")
def cell_grid(spark, d):
    g = _grid(spark, d)
    return pages.cell_grid(g, layout.edge_coverage(g, rows(spark, d, "segments")))


@query("WITH " + _RULES + """, s AS (SELECT *, doc_id AS d FROM {spans}), m2 AS (SELECT s.*, r.pl, r.a, r.b, CASE WHEN r.pl >= bottom - 0.5 AND r.pl <= bottom + 0.3 * size THEN 'underline' WHEN r.pl < bottom - 0.15 * size AND r.pl > bottom - 0.45 * size THEN 'strike' END AS kind FROM s JOIN rules r ON r.horizontal AND r.doc_id = s.doc_id AND r.page = s.page WHERE least(r.b, s.x1) - greatest(r.a, s.x0) >= 0.5 * (s.x1 - s.x0)),
k AS (SELECT *, greatest(min(x0) OVER w - a, b - max(x1) OVER w) AS out_, max(size) OVER w AS most FROM m2 WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page, pl, a, b)) SELECT DISTINCT doc_id, page, elem, kind FROM k WHERE out_ <= greatest(2.0, 0.6 * most)""")
def text_decorations(spark, d):
    return pages.decorations(rows(spark, d, "spans"), rows(spark, d, "segments"))


_EQ = r"""WITH l AS (SELECT *, 72.0 AS rx0, 540.0 AS rx1, len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: regexp_full_match(w, '[a-z]{4,}'))) AS words FROM {spans}), f AS (SELECT *, x0 - rx0 > 0.06 * (rx1 - rx0) AS ind, regexp_matches(text, '{NUM}') AS num, regexp_matches(text, '{REL}') AS rel FROM l),
g AS (SELECT *, rel AND words = 0 AND (ind OR num) AS strong, (rel AND words = 0 AND (ind OR num)) OR (length(regexp_replace(text, '\s', '', 'g')) <= 12 AND words = 0 AND ind) AS cand FROM f), r AS (SELECT *, CASE WHEN cand AND coalesce(lag(cand) OVER (PARTITION BY doc_id, page ORDER BY top, x0, elem), false) THEN 0 ELSE 1 END AS new FROM g),
z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY top, x0, elem ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT doc_id, page, min(elem) AS first, max(elem) AS last, bool_or(num) AS numbered FROM z WHERE cand GROUP BY doc_id, page, run HAVING bool_or(strong)""".replace("{NUM}", pages.EQUATION_NUMBER).replace("{REL}", pages.RELATION)


@query(_EQ)
def display_equations(spark, d):
    return pages.equations(rows(spark, d, "spans").withColumn("rx0", F.lit(72.0)).withColumn("rx1", F.lit(540.0)))


@query(r"""WITH s AS (SELECT * FROM {spans}), n AS (SELECT doc_id, page, TRY_CAST(unnest(regexp_extract_all(text, '[0-9]+')) AS BIGINT) - page AS shift FROM s), b AS (SELECT doc_id, shift, count(DISTINCT page) AS pages FROM n GROUP BY 1, 2), t AS (SELECT doc_id, count(DISTINCT page) AS total FROM s GROUP BY 1),
o AS (SELECT doc_id, shift FROM (SELECT b.*, total, row_number() OVER (PARTITION BY b.doc_id ORDER BY pages DESC, shift) AS r FROM b JOIN t ON t.doc_id = b.doc_id) WHERE r = 1 AND pages >= greatest(2, ceil(total / 2))),
h AS (SELECT s.doc_id, page, top, x0, CASE WHEN shift IS NULL THEN text ELSE regexp_replace(text, '\b' || (page + shift) || '\b', '{PAGE}', 'g') END AS line FROM s LEFT JOIN o ON o.doc_id = s.doc_id WHERE top <= 80),
e AS (SELECT doc_id, page, CASE WHEN page = 1 THEN 'first' WHEN page % 2 = 1 THEN 'odd' ELSE 'even' END AS kind, string_agg(line, chr(10) ORDER BY top, x0, line) AS header FROM h GROUP BY 1, 2), g AS (SELECT doc_id, kind, header, count(*) AS n, min(page) AS p FROM e GROUP BY 1, 2, 3)
SELECT doc_id, kind, arg_min(header, {'n': -n, 'p': p}) AS header, max(n) AS pages FROM g GROUP BY 1, 2""")
def header_set(spark, d):
    s = rows(spark, d, "spans")
    return pages.header_set(s, layout.page_offset(s))


@query("""WITH k AS (SELECT *, before + after AS total, floor((before + after) / pitch + 0.5) AS k, abs(line_height - pitch) < 0.3 AS grid, floor((before + content + after) / pitch + 0.5) * pitch AS h FROM {grid_paras}), m AS (SELECT *, grid AND abs(total - k * pitch) < 0.05 AS keep, least(after, k * pitch) AS a1, CASE WHEN h < content THEN ceil(content / pitch) * pitch ELSE h END - content - after AS b0 FROM k)
SELECT id, round(CASE WHEN keep THEN before WHEN grid THEN k * pitch - a1 ELSE greatest(b0, 0.0) END, 4) AS before, round(CASE WHEN keep THEN after WHEN grid THEN a1 ELSE greatest(CASE WHEN b0 < 0 THEN after + b0 ELSE after END, 0.0) END, 4) AS after FROM m""")
def grid_spacing(spark, d):
    return pages.grid_spacing(rows(spark, d, "grid_paras"))


@query("""WITH w AS (SELECT doc_id, page, CAST(elem AS INTEGER) AS line FROM {spans}), p AS (SELECT doc_id, max(page) AS pages FROM w GROUP BY 1), h AS (SELECT w.doc_id, r.line AS ref, r.page AS p, count(*) FILTER (w.line < r.line) / count(*) AS share FROM w JOIN (SELECT * FROM w WHERE line % 17 = 3) r ON r.doc_id = w.doc_id AND r.page = w.page GROUP BY 1, 2, 3),
x AS (SELECT h.*, pages, greatest(CASE WHEN p > 1 AND share < 0.35 THEN p ELSE p + 1 END, 2) AS want FROM h JOIN p ON p.doc_id = h.doc_id) SELECT doc_id, ref, CAST(CASE WHEN want > pages THEN greatest(2, p) ELSE want END AS INTEGER) AS page FROM x""")
def float_pages(spark, d):
    w = rows(spark, d, "spans").select("doc_id", "page", F.col("elem").alias("line"))
    return pages.float_pages(w, w.filter("line % 17 = 3").select("doc_id", "page", "line", F.col("line").alias("ref")))


@query()
def running_lines(spark, d):
    return pages.running_lines(rows(spark, Corpus(d), "spans"))


@query("WITH " + _GUTTER + """, l AS (SELECT doc_id, max(page) AS last FROM s GROUP BY 1), k AS (SELECT s.doc_id, s.page, s.bottom, CASE WHEN s.x0 < g.x - 2 AND s.x1 > g.x + 2 THEN 'F' WHEN (s.x0 + s.x1) / 2 < g.x THEN 'L' ELSE 'R' END AS side FROM s JOIN gutter g ON g.doc_id = s.doc_id AND g.page = s.page WHERE s.bottom <= 740),
e AS (SELECT k.doc_id, k.page, max(bottom) FILTER (side = 'L') AS l, max(bottom) FILTER (side = 'R') AS r FROM k JOIN l ON l.doc_id = k.doc_id AND k.page < l.last GROUP BY 1, 2) SELECT doc_id, page, l AS left_end, r AS right_end, coalesce(abs(l - r) > 7.2 AND greatest(l, r) > 716, false) AS uneven FROM e""")
def uneven_pages(spark, d):
    s = rows(spark, d, "spans")
    return pages.uneven_pages(s, layout.gutters(s))


@query()
def page_texts(spark, d):
    s = rows(spark, Corpus(d), "spans")
    return pages.page_texts(s.select("doc_id", "page", F.col("elem").alias("pos"), "text", (792 - F.col("bottom")).alias("y"), (F.col("bottom") - F.col("top")).alias("h"), F.lit(True).alias("eol")))


@query()
def page_booktabs(spark, d):
    b = rows(spark, Corpus(d), "segments").filter("horizontal")
    c = rows(spark, Corpus(d), "cells")
    texts = c.select("doc_id", "page", F.col("cell").alias("elem"), F.concat(F.lit("c"), "cell").alias("text"), (F.col("x0") + 5).alias("x0"), (F.col("x0") + 60).alias("x1"), (F.col("y0") + 4).alias("top"), (F.col("y1") - 4).alias("bottom"))
    return pages.booktabs(texts, b)


@query("SELECT doc_id, page, 1 AS figure, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) + 15 AS y1, CAST(count(*) AS INTEGER) AS paths FROM " + DERIVED["fills"][1] + " WHERE fill > 0 GROUP BY 1, 2 HAVING count(*) >= 2")
def page_figures(spark, d):
    f = rows(spark, Corpus(d), "fills").filter("fill > 0")
    return pages.figures(f.select("doc_id", "page", "x0", F.col("top").alias("y0"), "x1", (F.col("bottom") + 15).alias("y1"), F.lit(0).alias("curvy"), F.lit(1).alias("coloured"), F.lit(0).alias("image"), (F.col("width") * F.col("height")).alias("area")))


_PART = "SELECT doc_id, CAST(pos AS INTEGER) AS pos, '[P' || ordinal || '@v0] (' || part || ') ' || CASE WHEN text = '' THEN '（空段落）' WHEN length(text) > 1500 THEN left(text, 1500) || '…' ELSE text END AS line, total, CASE WHEN total > 12 THEN 13 END AS read_on FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS pos, count(*) OVER (PARTITION BY doc_id) AS total FROM {paras} WHERE {}) WHERE pos BETWEEN 2 AND 12"


def _located(spark, d):
    return rows(spark, d, "paras").select("doc_id", "ordinal", F.concat(F.lit("P"), "ordinal", F.lit("@v0")).alias("ref"), F.col("part").alias("location"), "text")


@query(_PART.replace("{}", "contains(part, 'od')"))
def block_read_part(spark, d):
    return blocks.read_part(_located(spark, d), "od", 2, 11)


@query(_PART.replace("{}", "starts_with(part, 'bo')"))
def block_list_part(spark, d):
    return blocks.read_part(_located(spark, d), "bo", 2, 11, prefix=True)


@query("SELECT doc_id, ordinal, '[P' || ordinal || '] (' || concat_ws(' · ', part, style, CASE WHEN style = 'H1' THEN '标题1' END, run_style) || ') ' || CASE WHEN text = '' THEN '（空段落）' WHEN length(text) > 1500 THEN left(text, 1500) || '…' ELSE text END AS line FROM {paras}")
def paragraph_lines(spark, d):
    p = rows(spark, d, "paras").select("doc_id", "ordinal", F.concat(F.lit("P"), "ordinal").alias("ref"), F.col("part").alias("location"), "style", F.when(F.col("style") == "H1", 1).alias("level"), F.when(F.col("run_style").isNotNull(), F.array("run_style")).alias("flags"), "text")
    return blocks.detailed(p)


_EDITED = "(SELECT *, CASE WHEN ordinal % 2 = 0 THEN 'e' WHEN ordinal % 7 = 0 THEN '' END AS target, ordinal % 3 = 0 AS bold, ordinal % 2 = 1 AS italic, ordinal % 5 = 0 AS strike FROM {blocks})"


@query("SELECT doc_id, ordinal, status, CASE WHEN status <> 'ok' THEN text WHEN target IS NULL THEN o || text || c ELSE replace(text, target, o || target || c) END AS text FROM (SELECT *, CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN o = '' THEN 'unsupported' ELSE 'ok' END AS status FROM (SELECT *, CASE WHEN target IS NULL THEN 1 WHEN target = '' THEN 0 ELSE (length(text) - length(replace(text, target, ''))) // length(target) END AS n, CASE WHEN bold THEN '**' ELSE '' END || CASE WHEN italic THEN '*' ELSE '' END || CASE WHEN strike THEN '~~' ELSE '' END AS o, CASE WHEN strike THEN '~~' ELSE '' END || CASE WHEN italic THEN '*' ELSE '' END || CASE WHEN bold THEN '**' ELSE '' END AS c FROM " + _EDITED + "))")
def format_text(spark, d):
    b = rows(spark, d, "blocks").select("doc_id", "ordinal", "text")
    o = F.col("ordinal")
    return edits.formatted(b, b.select("doc_id", "ordinal", F.when(o % 2 == 0, "e").when(o % 7 == 0, "").alias("target"), (o % 3 == 0).alias("bold"), (o % 2 == 1).alias("italic"), (o % 5 == 0).alias("strike")))


@query(r"SELECT doc_id, ordinal, CASE WHEN k < 3 THEN 'ok' ELSE 'unsupported' END AS status, CASE k WHEN 0 THEN '## ' || b WHEN 1 THEN '### ' || b WHEN 2 THEN b ELSE text END AS text FROM (SELECT *, ordinal % 4 AS k, regexp_replace(text, '^#{1,6}\s+', '') AS b FROM {blocks})")
def set_paragraph(spark, d):
    b = rows(spark, d, "blocks").select("doc_id", "ordinal", "text")
    k = F.col("ordinal") % 4
    return edits.relevelled(b, b.select("doc_id", "ordinal", F.when(k == 0, "Heading 2").when(k == 1, "h3").when(k == 2, "正文").otherwise("Fancy").alias("style")))


@query("SELECT doc_id, ordinal, CASE ordinal % 3 WHEN 0 THEN '## ' || text WHEN 1 THEN '- ' || text ELSE text END AS text FROM {blocks}")
def styled_blocks(spark, d):
    k = F.col("ordinal") % 3
    return rows(spark, d, "blocks").select("doc_id", "ordinal", edits.styled(F.col("text"), F.when(k == 0, "Heading 2").when(k == 1, "列表").otherwise("Body")).alias("text"))


_NOTED = "n AS (SELECT doc_id, ordinal AS p, 0 AS k, '<!-- 批注（ann）：' || replace(left(text, 12) || '--x', '--', '—') || ' -->' AS text FROM {blocks} WHERE ordinal % 3 = 1), u AS (SELECT doc_id, ordinal AS p, 1 AS k, text FROM {blocks} UNION ALL SELECT * FROM n)"


def _noted(spark, d):
    b = rows(spark, d, "blocks").select("doc_id", "ordinal", "text")
    return edits.commented(b, b.filter("ordinal % 3 = 1").select("doc_id", "ordinal", F.lit("ann").alias("author"), F.concat(F.left("text", F.lit(12)), F.lit("--x")).alias("comment")))


@query("WITH " + _NOTED + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, k, text) AS INTEGER) AS ordinal, text FROM u")
def add_comments(spark, d):
    return _noted(spark, d)


@query("WITH " + _NOTED + ", r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, k, text) AS INTEGER) AS ordinal, k, text FROM u) SELECT doc_id, ordinal, 'ann' AS author, substring(text, 14, length(text) - 17) AS comment FROM r WHERE k = 0")
def list_comments(spark, d):
    return edits.listed_comments(_noted(spark, d))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS INTEGER) AS ordinal, text FROM {blocks} WHERE text <> ''")
def remove_comments(spark, d):
    return edits.without_comments(_noted(spark, d), "ann")


_TABLE = "t AS (SELECT doc_id, 1 AS tab, ordinal AS r, list_resize(string_split(text, ' ')[1:3], 3, '') AS cells FROM {blocks})"


def _table_rows(spark, d):
    three = F.slice(F.concat(F.slice(F.split("text", " "), 1, 3), F.array_repeat(F.lit(""), 3)), 1, 3)
    return rows(spark, d, "blocks").select("doc_id", F.lit(1).alias("tab"), F.col("ordinal").alias("r"), three.alias("cells"))


def _new_rows(t):
    return t.filter("r % 3 = 1").select("doc_id", "tab", "r", (F.col("r") % 2 == 0).alias("after"), F.when(F.col("r") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("cells"))


@query("WITH " + _TABLE + ", u AS (SELECT doc_id, tab, r, 0 AS p, cells FROM t UNION ALL SELECT doc_id, tab, r, CASE WHEN r % 2 = 0 THEN 1 ELSE -1 END, ['x', 'y', 'z'] FROM t WHERE r % 3 = 1 AND r % 5 <> 0) SELECT doc_id, tab, CAST(row_number() OVER (PARTITION BY doc_id, tab ORDER BY r, p) AS INTEGER) AS r, array_to_string(cells, '|') AS cells FROM u")
def insert_table_rows(spark, d):
    t = _table_rows(spark, d)
    return edits.with_rows(t, _new_rows(t)).withColumn("cells", F.array_join("cells", "|"))


@query("WITH " + _TABLE + " SELECT doc_id, tab, r, CASE WHEN r % 5 = 0 THEN 'invalid' ELSE 'ok' END AS status FROM t WHERE r % 3 = 1")
def table_row_status(spark, d):
    t = _table_rows(spark, d)
    return edits.row_status(t, _new_rows(t))


@query("WITH " + _TABLE + ", n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, tab) AS n FROM t) SELECT doc_id, tab, CAST(row_number() OVER (PARTITION BY doc_id, tab ORDER BY r) AS INTEGER) AS r, array_to_string(cells, '|') AS cells, CASE WHEN r % 4 = 1 THEN 'invalid' ELSE 'ok' END AS status FROM n WHERE r % 4 <> 1 OR n = 1")
def delete_table_rows(spark, d):
    t = _table_rows(spark, d)
    return edits.without_row(t, t.filter("r % 4 = 1").select("doc_id", "tab", "r")).withColumn("cells", F.array_join("cells", "|"))


@query("WITH " + _TABLE + " SELECT doc_id, tab, r, array_to_string([cells[1], CASE WHEN r % 2 = 0 THEN 'v' || r ELSE '' END, cells[3]], '|') AS cells FROM t")
def replace_table_column(spark, d):
    """The second column goes, another comes in its place."""
    t = _table_rows(spark, d)
    v = t.filter("r % 2 = 0").select("doc_id", "tab", "r", F.concat(F.lit("v"), "r").alias("value"))
    return edits.with_column(edits.without_column(t, F.lit(2)), F.lit(1), v).withColumn("cells", F.array_join("cells", "|"))


@query("WITH " + _TABLE + ", m AS (SELECT doc_id, tab, string_agg(c, chr(10) ORDER BY r, k) AS whole FROM (SELECT doc_id, tab, r, unnest([1, 2]) AS k, unnest(cells[1:2]) AS c FROM t WHERE r BETWEEN 2 AND 3) WHERE c <> '' GROUP BY 1, 2) SELECT t.doc_id, t.tab, r, CASE WHEN r = 2 THEN coalesce(whole, '') || '||' || cells[3] WHEN r = 3 THEN '||' || cells[3] ELSE array_to_string(cells, '|') END AS cells FROM t LEFT JOIN m ON m.doc_id = t.doc_id AND m.tab = t.tab")
def merge_table_cells(spark, d):
    t = _table_rows(spark, d)
    area = t.select("doc_id", "tab").distinct().select("doc_id", "tab", F.lit(2).alias("r1"), F.lit(1).alias("c1"), F.lit(3).alias("r2"), F.lit(2).alias("c2"))
    return edits.merged_cells(t, area).withColumn("cells", F.array_join("cells", "|"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 AND event_id % 10 < 6 AND event_id % 10 + 2 > 2 THEN 'protected' ELSE 'ok' END AS status FROM events")
def atom_guard(spark, d):
    """Edits of two characters against a placeholder at 2 to 6 in every third text."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.lit("ab⟨图片⟩cd⟨x")).otherwise(F.lit("abcdefgh")).alias("text"), (F.col("event_id") % 10).alias("start"), (F.col("event_id") % 10 + 2).alias("end"))
    return edits.atom_guard(e)


@query("SELECT doc_id, ordinal, CASE WHEN ordinal % 13 = 0 OR ordinal % 6 = 1 OR (ordinal % 2 = 0 AND count(*) OVER (PARTITION BY doc_id, CASE WHEN ordinal % 2 = 0 THEN ordinal // 4 ELSE -1 END) = 1) THEN 'protected' ELSE 'ok' END AS status FROM {blocks}")
def delete_guard(spark, d):
    o = F.col("ordinal")
    return edits.delete_guard(rows(spark, d, "blocks").select("doc_id", "ordinal", F.when(o % 2 == 0, F.floor(o / 4)).alias("cell"), (o % 6 == 1).alias("section_break"), (o % 13 == 0).alias("deleted")))


@query("SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'ok' ELSE 'reverted' END AS status, md5(CASE WHEN contains(text, 'tion') THEN replace(text, 'tion', 'sion') || '⟨图片⟩' ELSE text || '⟨图片⟩' END) AS digest FROM documents")
def fidelity_guard(spark, d):
    """An edit that loses a text's picture is reverted."""
    t = F.col("text")
    pairs = table(spark, d, "documents").select("doc_id", F.concat(t, F.lit("⟨图片⟩")).alias("old"), F.when(F.contains(t, F.lit("tion")), F.concat(F.replace(t, F.lit("tion"), F.lit("sion")), F.lit("⟨图片⟩"))).otherwise(t).alias("new"))
    return edits.guarded(pairs).select("doc_id", "status", F.md5("text").alias("digest"))


@query("WITH l AS (SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS v, event_type AS label, '' || event_id AS text FROM events), m AS (SELECT session, max(v) AS last FROM l GROUP BY 1) SELECT * FROM l UNION ALL SELECT l.session, last + 1, '回滚到 v2', text FROM l JOIN m ON m.session = l.session WHERE l.v = 2 AND l.session % 3 = 0")
def version_rollback(spark, d):
    log = control.versions(table(spark, d, "events"), "user_id", "ts", "event_id").select(F.col("user_id").alias("session"), "v", F.col("event_type").alias("label"), F.col("event_id").cast("string").alias("text"))
    return edits.rolled_back(log, log.filter("session % 3 = 0").select("session").distinct().withColumn("to", F.lit(2)))


@query("SELECT user_id AS doc_id, CAST(page AS INTEGER) AS page, n > 5 AS truncated FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE page <= 5")
def page_cap(spark, d):
    return edits.capped_pages(control.versions(table(spark, d, "events"), "user_id", "ts", "event_id").select(F.col("user_id").alias("doc_id"), F.col("v").alias("page")), 5)


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 2 THEN 'invalid' WHEN event_id % 3 = 0 THEN 'identity' ELSE 'unsupported' END AS status, event_id % 3 <> 0 AS lossy FROM events")
def export_status(spark, d):
    k = F.col("event_id") % 3
    return edits.exports(table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("markdown").alias("source"), F.when(k == 0, "markdown").when(k == 1, "docx").otherwise("rtf").alias("target")))


@query("SELECT event_id AS id, CAST(value AS DOUBLE) AS updated_at FROM events WHERE event_id % 5 <> 0 AND value IS NOT NULL")
def session_list(spark, d):
    raw = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("value").alias("updatedAt")))).alias("record"))
    return control.listed_sessions(raw)


@query("SELECT event_id AS id, n AS name, a AS args, CASE WHEN n IN ('mode', 'help') THEN 'builtin' WHEN n = 'polish' THEN 'skill' ELSE 'unknown' END AS source, CASE WHEN n = 'nope' THEN 'not_found' WHEN n = 'mode' AND a NOT IN ('', 'plan') THEN 'invalid' ELSE 'ok' END AS status FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'mode' WHEN 1 THEN 'help' WHEN 2 THEN 'polish' ELSE 'nope' END AS n, CASE event_id % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'other text' ELSE '' END AS a FROM events) WHERE event_id % 7 <> 0")
def slash_commands(spark, d):
    e = F.col("event_id")
    name, args = F.when(e % 4 == 0, "mode").when(e % 4 == 1, "help").when(e % 4 == 2, "polish").otherwise("nope"), F.when(e % 3 == 0, "plan").when(e % 3 == 1, "other text").otherwise("")
    lines = table(spark, d, "events").select(e.alias("id"), F.when(e % 7 == 0, "no command").otherwise(F.concat(F.lit("/"), name, F.lit(" "), args)).alias("text"))
    return control.commands(lines, spark.createDataFrame([("polish", "skill"), ("help", "skill")], "name string, source string"))


@query("SELECT conv_id AS id, a AS after, CASE WHEN a > 75 THEN CASE WHEN f THEN 'micro+auto' ELSE 'auto' END WHEN f THEN 'micro' ELSE 'none' END AS kind FROM (SELECT conv_id, b > 50 AND s > 0 AS f, CASE WHEN b > 50 AND s > 0 THEN b - s ELSE b END AS a FROM (SELECT conv_id, CAST(ceil(sum(length(coalesce(text, ''))) / 2.5) AS BIGINT) AS b, CAST(coalesce(sum(length(text) // 5) FILTER (role = 'assistant'), 0) AS BIGINT) AS s FROM conversations GROUP BY 1))")
def compaction_plan(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(tx.estimated_tokens(F.sum(F.length(F.coalesce("text", F.lit(""))))).alias("before"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.floor(F.length("text") / 5))), F.lit(0)).alias("saved"))
    return control.compactions(c, budget=100)


@query("SELECT conv_id AS session, CAST(ceil(sum(length(text) + CASE WHEN role = 'assistant' THEN length(left(text, 7)) + length(role) ELSE 0 END) / 2.5) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def message_tokens(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "role", F.col("text").alias("content"), F.left("text", F.lit(7)).alias("reasoning"), F.col("role").alias("calls"))
    return control.message_tokens(c)


@query("SELECT session, idx, kind, text, CASE WHEN kind = 'tool' THEN 'doc_read' END AS title, CASE WHEN kind = 'tool' THEN NOT starts_with(text, '错误：') END AS ok FROM (SELECT conv_id AS session, turn AS idx, CASE role WHEN 'system' THEN 'tool' ELSE role END AS kind, CASE WHEN role = 'system' AND turn % 2 = 0 THEN '错误：' || text WHEN role = 'user' THEN trim(text) ELSE text END AS text FROM conversations WHERE trim(text) <> '') UNION ALL SELECT DISTINCT conv_id, -1::BIGINT, 'assistant', 'call', NULL, NULL FROM conversations WHERE role = 'system'")
def transcript_items(spark, d):
    c, system = table(spark, d, "conversations"), F.col("role") == "system"
    none = F.lit(None).cast("string")
    content = F.when(system & (F.col("turn") % 2 == 0), F.concat(F.lit("错误："), "text")).when(F.col("role") == "user", F.concat("text", F.lit("<system-reminder>hidden</system-reminder>"))).otherwise(F.col("text"))
    said = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("idx"), F.when(system, "tool").otherwise(F.col("role")).alias("role"), content.alias("content"), F.when(system, "c").alias("tool_call_id"), none.alias("call_id"), none.alias("tool"))
    call = c.filter(system).select(F.col("conv_id").alias("session")).distinct().select("session", F.lit(-1).cast("long").alias("idx"), F.lit("assistant").alias("role"), F.lit("call").alias("content"), none.alias("tool_call_id"), F.lit("c").alias("call_id"), F.lit("doc_read").alias("tool"))
    return control.transcript(said.unionByName(call))


@query(_COST + "SELECT user_id, round(sum(cached) / sum(n), 6) AS hit_rate, count(*) AS requests FROM k GROUP BY 1 HAVING sum(n) > 0")
def usage_hit_rate(spark, d):
    u = _usage(spark, d).groupBy("user_id").agg(F.sum("cached").alias("c"), F.sum("prompt").alias("p"), F.count(F.lit(1)).alias("requests")).filter("p > 0")
    return u.select("user_id", F.round(F.col("c") / F.col("p"), 6).alias("hit_rate"), "requests")


@query("SELECT doc_id, md5(text) AS digest FROM (SELECT doc_id, regexp_replace(trim(text, ' ' || chr(10)), '\\s+', ' ', 'g') AS text FROM documents)")
def serialized_documents(spark, d):
    """Documents put together again from their blocks hold the same words."""
    again = sources.serialized(blocks.with_blocks(table(spark, d, "documents")))
    return table(spark, d, "documents").select("doc_id").join(again, "doc_id", "left").select("doc_id", F.md5(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " ")).alias("digest"))


@query("SELECT 's' || (doc_id % 40) AS name, trim(arg_max(left(replace(text, chr(10), ' '), 30), doc_id)) AS description FROM documents GROUP BY 1")
def skill_manifests(spark, d):
    """Names and descriptions in front matter; the last loaded of equal names wins."""
    body = F.concat(F.lit("---\nname: s"), F.col("doc_id") % 40, F.lit("\ndescription: "), F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(30)), F.lit("\n---\n"), "text")
    return sources.front_matter(table(spark, d, "documents").select(body.alias("text"), F.col("doc_id").alias("prio"))).select("name", "description").orderBy("name")


@query("SELECT c_mktsegment, '<table><caption>Orders</caption><tr><th>y</th><th>v</th></tr>' || string_agg('<tr><td>' || y || '</td><td>' || n || '</td></tr>', '' ORDER BY y) || '</table>' AS html FROM (SELECT c_mktsegment, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1")
def table_html(spark, d):
    n = _segments(spark, d).groupBy("c_mktsegment", "y").agg(F.count(F.lit(1)).alias("n"))
    body = n.select("c_mktsegment", F.col("y").alias("pos"), F.array(F.col("y").cast("string"), F.col("n").cast("string")).alias("cells"))
    head = n.select("c_mktsegment").distinct().select("c_mktsegment", F.lit(0).alias("pos"), F.array(F.lit("y"), F.lit("v")).alias("cells"))
    return markup.html_rows(body.unionByName(head), "c_mktsegment", "cells", "Orders")


@query("WITH v AS (SELECT o_orderstatus, o_orderpriority, greatest(sum(o_totalprice), 0.0) AS v FROM orders GROUP BY 1, 2), t AS (SELECT *, sum(v) OVER (PARTITION BY o_orderstatus) AS total, sum(v) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority ROWS UNBOUNDED PRECEDING) AS upto FROM v) SELECT o_orderstatus, o_orderpriority, round(360 * (upto - v) / total, 6) AS start, round(360 * upto / total, 6) AS \"end\" FROM t WHERE total > 0")
def pie_angles(spark, d):
    return markup.pie_angles(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'ok' ELSE 'not_found' END AS status, CAST((length(text) - length(replace(text, 'tion', ''))) / 4 AS BIGINT) AS places, md5(replace(text, 'tion', 'sion')) AS digest FROM documents")
def replace_tolerant(spark, d):
    return search.replaced_tolerant(table(spark, d, "documents"), "tion", "sion", True).select("doc_id", "status", "places", F.md5("text").alias("digest"))


@query()
def search_fuzzy_corpus(spark, d):
    return search.fuzzy_matches(table(spark, d, "documents"), "the of")


@query("WITH " + _GUTTER + ", c AS (SELECT doc_id, count(*) AS column_pages FROM gutter WHERE score >= 4 GROUP BY 1), g AS (SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS lines, count(*) FILTER (size > 10 OR bold) AS headings FROM s GROUP BY 1) SELECT g.doc_id, pages, coalesce(column_pages, 0) AS column_pages, lines, headings FROM g LEFT JOIN c ON c.doc_id = g.doc_id")
def page_counts(spark, d):
    s = rows(spark, d, "spans")
    return layout.page_counts(s, layout.gutters(s))


@query("SELECT f.doc_id, f.page, f.fill AS image, arg_min(s.elem, {'d': abs((s.top + s.bottom) / 2 - (f.top + f.bottom) / 2), 'e': s.elem}) AS elem FROM (SELECT * FROM {fills}) f JOIN (SELECT * FROM {spans}) s ON s.doc_id = f.doc_id AND s.page = f.page GROUP BY 1, 2, 3")
def images_by_row(spark, d):
    f = rows(spark, d, "fills").select("doc_id", "page", F.col("fill").alias("image"), F.col("top").alias("y0"), F.col("bottom").alias("y1"))
    return layout.images_by_row(f, rows(spark, d, "spans"))


@query(r"SELECT doc_id, string_agg(repeat('  ', level - 1) || '- [' || trim(text) || '](#' || regexp_replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}\s-]', '', 'g'), '\s+', '-', 'g') || ')', chr(10) ORDER BY ordinal) AS toc FROM {headings} WHERE level BETWEEN 1 AND 3 AND trim(text) <> '' GROUP BY 1")
def table_of_contents(spark, d):
    return blocks.table_of_contents(rows(spark, d, "headings"))


@query(r"SELECT id, CASE WHEN regexp_matches(text, '^(?:\S {1,3}){3,}\S$') THEN replace(replace(regexp_replace(text, ' {2,}', chr(1), 'g'), ' ', ''), chr(1), ' ') ELSE text END AS joined, translate(text, '" + "".join(tx.SYMBOLS) + "', '" + "".join(tx.SYMBOLS.values()) + "') AS symbols FROM {odd_texts}")
def letter_spacing(spark, d):
    return rows(spark, d, "odd_texts").select("id", tx.letters_joined(F.col("text")).alias("joined"), tx.symbols_shown(F.col("text")).alias("symbols"))


# Letters of the lines' first words, one by one: every third line unevenly, every seventh with something between two of them.
_LETTERED = "doc_id, CAST(1 + floor(n / 50) AS INTEGER) AS page, CAST(n * 100 + k AS INTEGER) AS elem, substr(text, k, 1) AS text, CAST(72 + 8 * k + CASE WHEN n % 3 = 0 THEN k % 3 * 2 ELSE 0 END AS DOUBLE) AS x0, CAST(77 + 8 * k + CASE WHEN n % 3 = 0 THEN k % 3 * 2 ELSE 0 END AS DOUBLE) AS x1, CAST(100 + 12 * (n % 50) AS DOUBLE) AS top, CAST(110 + 12 * (n % 50) AS DOUBLE) AS bottom, 1e1 AS size, 'Serif' AS font, n % 2 = 0 AS bold"
_BETWEEN = "doc_id, CAST(1 + floor(n / 50) AS INTEGER) AS page, CAST(n * 100 + 99 AS INTEGER) AS elem, 'ab' AS text, 101e0 AS x0, 104e0 AS x1, CAST(103 + 12 * (n % 50) AS DOUBLE) AS top, CAST(113 + 12 * (n % 50) AS DOUBLE) AS bottom, 5e0 AS size, 'Serif' AS font, false AS bold"
_L = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


@query(f"""WITH sp AS (SELECT * FROM (SELECT {_LETTERED} FROM (SELECT doc_id, n, text, unnest(range(1, 21)) AS k FROM {_L}) WHERE k <= length(text)) WHERE trim(text) <> '' UNION ALL SELECT {_BETWEEN} FROM {_L} WHERE n % 7 = 0),
l AS (SELECT *, x0 - lag(x1) OVER w AS gap, lag(x1) OVER w AS after, lag(elem) OVER w AS other, coalesce(abs(bottom - lag(bottom) OVER w) <= 0.3 AND font = lag(font) OVER w AND size = lag(size) OVER w AND bold = lag(bold) OVER w AND x0 - lag(x1) OVER w BETWEEN 0.08 * size AND 1.2 * size, false) AS alike FROM sp WHERE length(trim(text)) = 1 WINDOW w AS (PARTITION BY doc_id, page ORDER BY bottom, x0, elem)),
b AS (SELECT DISTINCT l.doc_id, l.page, l.elem FROM l JOIN sp o ON o.doc_id = l.doc_id AND o.page = l.page AND alike AND o.x0 >= l.after - 0.3 AND o.x1 <= l.x0 + 0.3 AND abs(o.bottom - l.bottom) <= 0.8 * l.size AND o.elem NOT IN (l.elem, l.other)),
n AS (SELECT l.*, CASE WHEN alike AND b.elem IS NULL THEN 0 ELSE 1 END AS new FROM l LEFT JOIN b ON b.doc_id = l.doc_id AND b.page = l.page AND b.elem = l.elem), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY bottom, x0, elem) AS run FROM n),
g AS (SELECT doc_id, page, run, count(*) AS n, list_sort(list(gap) FILTER (new = 0)) AS gs FROM r GROUP BY ALL HAVING count(*) >= 4), m AS (SELECT *, gs[len(gs) // 2 + 1] AS mid FROM g),
k AS (SELECT doc_id, page, run, mid FROM m WHERE len(list_filter(gs, lambda x: x <= 1.7 * mid + 0.3 AND abs(x - mid) <= 0.35 * greatest(mid, 0.5))) >= 0.6 * len(gs)),
h AS (SELECT r.*, sum(CASE WHEN new = 0 AND gap > 1.7 * mid + 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY r.doc_id, r.page, r.run ORDER BY x0, elem) AS word FROM r JOIN k ON k.doc_id = r.doc_id AND k.page = r.page AND k.run = r.run)
SELECT doc_id, page, elem, text, x0, x1 FROM sp WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = sp.doc_id AND h.page = sp.page AND h.elem = sp.elem) UNION ALL SELECT doc_id, page, arg_min(elem, x0), string_agg(text, '' ORDER BY x0), min(x0), max(x1) FROM h GROUP BY doc_id, page, run, word""")
def letter_spaced_spans(spark, d):
    """Letters set one by one become words again, by page over whole documents."""
    docs = table(spark, d, "documents")
    s = spark.sql(
        f"WITH l AS (SELECT doc_id, n + 1 AS n, text FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (n, text) FROM {{t}})) SELECT * FROM (SELECT {_LETTERED} FROM (SELECT *, explode(sequence(1, 20)) AS k FROM l) WHERE k <= length(text)) WHERE trim(text) <> '' UNION ALL SELECT {_BETWEEN} FROM l WHERE n % 7 = 0",
        t=docs,
    )
    return spacing.merged_letters(s).select("doc_id", "page", "elem", "text", "x0", "x1")


# Pictures of the orders' lines, three in a row: close together, in columns far apart, with captions between rows, with texts in them.
_PICTURES = """SELECT l_orderkey AS doc_id, 1 AS page, CAST(i AS INTEGER) AS image, 60e0 + CASE WHEN l_orderkey % 4 = 1 THEN 200e0 ELSE 130e0 END * (i % 3) AS x0, 100e0 + 100e0 * floor(i / 3) AS y0,
60e0 + CASE WHEN l_orderkey % 4 = 1 THEN 200e0 * (i % 3) + 60e0 ELSE 130e0 * (i % 3) + 110e0 END AS x1, 180e0 + 100e0 * floor(i / 3) AS y1, CAST(q AS INTEGER) AS q
FROM (SELECT l_orderkey, min(l_quantity) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM {t} GROUP BY l_orderkey, l_linenumber)"""
_PICTURE_TEXTS = """SELECT doc_id, page, 3 * image AS elem, concat('(', image, ')') AS text, x0 + 40 AS x0, x0 + 52 AS x1, y1 + 2 AS top, y1 + 10 AS bottom, 8e0 AS size FROM {i}
UNION ALL SELECT doc_id, page, 3 * image + 1, concat(repeat('x', q), '!!!!'), x0 + 2, x1 - 2, y0 + 30, y0 + 40, 1e1 FROM {i} WHERE doc_id % 4 = 3
UNION ALL SELECT doc_id, page, 3 * image + 2, 'Fig. 2 of the order', 60e0, 400e0, y1 + 11, y1 + 19, 8e0 FROM {i} WHERE doc_id % 4 = 2 AND image % 3 = 0"""
_PAGE_SIZE = "612e0 AS width, 792e0 AS height, 1e1 AS body"


@query("WITH i AS (" + _PICTURES.replace("{t}", "lineitem") + "), s AS (" + _PICTURE_TEXTS.replace("{i}", "i") + """), g AS (SELECT *, CAST(CASE doc_id % 4 WHEN 1 THEN image % 3 WHEN 2 THEN floor(image / 3) ELSE 0 END AS INTEGER) AS g FROM i),
b AS (SELECT doc_id, page, g, min(x0) - 1 AS x0, min(y0) - 1 AS y0, max(x1) + 1 AS x1, max(y1) + 11 AS y1, CAST(count(*) AS INTEGER) AS images, CASE WHEN doc_id % 4 = 3 THEN sum(q + 4) ELSE 0 END AS others FROM g GROUP BY 1, 2, 3),
m AS (SELECT g.doc_id, g.g, string_agg(s.text, ' ' ORDER BY s.elem) AS text FROM g JOIN s ON s.doc_id = g.doc_id AND s.elem // 3 = g.image AND s.elem % 3 < 2 GROUP BY 1, 2)
SELECT b.doc_id, page, CAST(b.g + 1 AS INTEGER) AS grid, x0, y0, x1, y1, images, images AS marks, text FROM b JOIN m ON m.doc_id = b.doc_id AND m.g = b.g WHERE images >= 2 AND others <= 80""")
def image_grids(spark, d):
    """Pictures in rows and columns become one figure, with their marks."""
    i = spark.sql(_PICTURES, t=table(spark, d, "lineitem"))
    return figures.image_grids(i, spark.sql(_PICTURE_TEXTS, i=i), spark.sql(f"SELECT DISTINCT doc_id, page, {_PAGE_SIZE} FROM {{i}}", i=i))


def _stacked(source, *parts: tuple[str, str]):
    """The rows of several selections (columns, condition) of one table, by one pass over it."""
    each = ", ".join(f"CASE WHEN {where} THEN struct({columns}) END" for columns, where in parts)
    return source.selectExpr(f"inline(array({each}))").filter("doc_id IS NOT NULL")


# Drawings of the orders: turned titles, panels side by side, lone shapes, tables under them, texts in them and over their edge, by the remainder of the order's number.
_DRAWN = "SELECT l_orderkey AS doc_id, 1 AS page, CAST(sum(l_quantity) AS INTEGER) AS q, min(l_partkey) AS p FROM {t} GROUP BY l_orderkey"
_AT = "CAST({} AS DOUBLE) AS x0, CAST({} AS DOUBLE) AS y0, CAST({} AS DOUBLE) AS x1, CAST({} AS DOUBLE) AS y1"
_LINE = "CAST({} AS DOUBLE) AS x0, CAST({} AS DOUBLE) AS x1, CAST({} AS DOUBLE) AS top, CAST({} AS DOUBLE) AS bottom, CAST({} AS DOUBLE) AS size"
_SHAPES = tuple(
    (f"doc_id, page, {k} AS path, {_AT.format(*at)}, 1 AS curvy, 0 AS coloured", where)
    for k, (at, where) in enumerate((((100, 100, 160, 140), "true"), ((163, 100, 220, 140), "true"), ((260, 101, 320, 141), "doc_id % 6 = 1"), ((323, 101, 380, 141), "doc_id % 6 = 1"), ((240, 110, 260, 130), "doc_id % 6 = 2")))
)
_SHAPE_TEXTS = tuple(
    (f"doc_id, page, {k} AS elem, {text} AS text, {_LINE.format(*at)}", where)
    for k, (text, at, where) in enumerate((
        ("concat('p', p)", (100, 130, 143, 151, 8), "true"), ("concat('q', q)", (100, 130, 156, 164, 8), "true"), ("'too far'", (100, 130, 172, 180, 8), "true"), ("'between the panels'", (230, 250, 115, 125, 10), "doc_id % 12 = 7"),
        ("'and'", (224, 236, 115, 125, 10), "doc_id % 12 = 8"), ("repeat('y', q)", (105, 215, 110, 120, 10), "doc_id % 6 = 4"), ("'across the edge'", (200, "280 + 40 * (doc_id % 12 - 5) / 6", 115, 125, 10), "doc_id % 6 = 5"),
    ))
)


@query("WITH o AS (" + _DRAWN.replace("{t}", "lineitem") + """), f AS (SELECT *, doc_id % 6 AS k, doc_id % 12 AS m, 1 AS figure FROM o UNION ALL SELECT *, doc_id % 6, doc_id % 12, 2 FROM o WHERE doc_id % 12 = 7)
SELECT doc_id, page, CAST(figure AS INTEGER) AS figure, CAST(CASE WHEN figure = 2 THEN 259 WHEN k = 0 THEN 87 ELSE 99 END AS DOUBLE) AS x0, CAST(CASE figure WHEN 1 THEN 99 ELSE 100 END AS DOUBLE) AS y0, CAST(CASE WHEN m = 1 OR figure = 2 THEN 381 WHEN m = 2 THEN 261 ELSE 221 END AS DOUBLE) AS x1,
CAST(CASE figure WHEN 1 THEN 165 ELSE 142 END AS DOUBLE) AS y1, CAST(CASE WHEN figure = 2 THEN 0 WHEN k = 4 THEN 3 ELSE 2 END AS INTEGER) AS labels, CASE WHEN figure = 2 THEN '' ELSE concat('p', p, ' q', q, CASE WHEN k = 4 THEN concat(' ', repeat('y', q)) ELSE '' END) END AS text FROM f WHERE k <> 3 AND NOT (k = 4 AND q > 160) AND m <> 5""")
def labelled_figures(spark, d):
    """Drawings with their panels, lone shapes, labels and turned titles."""
    o = spark.sql(_DRAWN, t=table(spark, d, "lineitem"))
    put = lambda sql: spark.sql(sql, o=o)
    none = put("SELECT doc_id, page, 1 AS image, 0e0 AS x0, 0e0 AS y0, 1e0 AS x1, 1e0 AS y1 FROM {o} WHERE false")
    tables = _stacked(o, (f"doc_id, page, 1 AS tab, {_AT.format(90, 90, 230, 150)}", "doc_id % 6 = 3"))
    turned = _stacked(o, (f"doc_id, page, 90 AS elem, {_AT.format(88, 100, 95, 140)}, 1e1 AS size", "doc_id % 6 = 0"))
    return figures.labelled_figures(_stacked(o, *_SHAPES), none, _stacked(o, *_SHAPE_TEXTS), put(f"SELECT doc_id, page, {_PAGE_SIZE} FROM {{o}}"), tables, turned)


_STORED = "user_id AS session, event_id AS edit_id, ts AS at, event_type AS label, CASE WHEN event_id % 2 = 0 THEN 'md' ELSE 'html' END AS format"


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, event_id % 3 AS a, concat(event_type, ' ', event_id) AS body FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, ts, event_id) - 1 AS n, count(*) FILTER (a < 2) OVER (PARTITION BY user_id) AS before FROM e),
v AS (SELECT user_id AS session, n + CASE WHEN a = 2 AND user_id % 3 = 0 AND before >= 2 THEN 1 ELSE 0 END AS v, event_type AS label, CASE WHEN event_id % 2 = 0 THEN 'md' ELSE 'html' END AS format, body FROM n
UNION ALL SELECT user_id, before, '回滚到 v0', CASE WHEN event_id % 2 = 0 THEN 'md' ELSE 'html' END, body FROM n WHERE n = 0 AND user_id % 3 = 0 AND before >= 2)
SELECT session, CAST(v AS INTEGER) AS v, label, format, sha256(body) AS digest, v = max(v) OVER (PARTITION BY session) AS is_current FROM v""")
def session_store(spark, d):
    """Edits come in three arrivals, some of the first again with the second; before the third, every third session returns to its original. The request for that comes twice."""
    e = spark.sql(f"SELECT {_STORED}, CAST(concat(event_type, ' ', event_id) AS BINARY) AS content, event_id % 3 AS a FROM {{t}}", t=table(spark, d, "events"))
    source, store, checkpoint = (shared_path(spark, n) for n in ("edits", "store", "store-state"))
    for k in range(3):
        e.filter((F.col("a") == k) | (F.lit(k == 1) & (F.col("a") == 0) & (F.col("edit_id") % 5 == 0))).drop("a").write.mode("append").parquet(source)
        sessions.ingest(spark, source, e.drop("a").schema, store, checkpoint)
        for _ in range(2 if k == 1 else 0):
            sessions.roll_back(spark, store, sessions.heads(spark, store).filter("session % 3 = 0").select("session", F.lit(0).alias("to")), "originals")
    last = sessions.heads(spark, store).select("session", F.col("v").alias("last"))
    return sessions.history(spark, store).join(last, "session").select("session", "v", "label", "format", F.sha2("content", 256).alias("digest"), (F.col("v") == F.col("last")).alias("is_current"))


# Rows of the orders' lines as two tables of one extent: a caption between them, a line of prose, or nothing, which makes them one.
_ROWS = "SELECT l_orderkey AS doc_id, 1 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS k, p, CAST(q AS INTEGER) AS q FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_quantity) AS q FROM {t} GROUP BY l_orderkey, l_linenumber)"
_TWICE = tuple(
    (f"doc_id, page, {e} + 2 * i AS elem, concat('{c}', {v}) AS text, {_LINE.format(x0, x1, f'{y} + 12 * i', f'{y + 10} + 12 * i', 10)}", "true") for e, c, v, x0, x1, y in ((0, "a", "p", 74, 120, 101), (1, "b", "q", 300, 350, 101), (1000, "c", "p", 74, 120, 401), (1001, "d", "q", 300, 350, 401))
) + ((f"doc_id, page, 900 AS elem, CASE doc_id % 3 WHEN 0 THEN 'Table 2' ELSE 'the second of the tables of this order' END AS text, {_LINE.format(74, '120 + 300 * (doc_id % 3)', 380, 390, 10)}", "i = 0 AND doc_id % 3 < 2"),)
_RULED_TWICE = tuple((f"doc_id, page, {n} AS seg, {_AT.format(72, y, 540, y)}, true AS horizontal", "i = 0") for n, y in enumerate(("99", "112 + 12 * (k - 1)", "399", "412 + 12 * (k - 1)")))


@query("WITH r AS (" + _ROWS.replace("{t}", "lineitem") + """), c AS (SELECT *, unnest([1, 2]) AS c FROM r), b AS (SELECT *, unnest([0, 1]) AS t FROM c)
SELECT doc_id, page, CAST(CASE WHEN doc_id % 3 = 2 THEN 1 ELSE t + 1 END AS INTEGER) AS tab, CAST(i + 1 + CASE WHEN doc_id % 3 = 2 THEN k * t ELSE 0 END AS INTEGER) AS r, CAST(c AS INTEGER) AS c, concat(CASE c + 2 * t WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' ELSE 'd' END, CASE c WHEN 1 THEN p ELSE q END) AS text FROM b WHERE k >= 2 OR doc_id % 3 = 2""")
def parted_booktabs(spark, d):
    """Tables under rules of one extent, parted at captions and prose."""
    r = spark.sql(_ROWS, t=table(spark, d, "lineitem"))
    return pages.booktabs(_stacked(r, *_TWICE), _stacked(r, *_RULED_TWICE))


# Equations of the orders between two lines of prose: a stacked fraction, its numerator alone, a numbered line, underlined prose.
def _put(where: str, line: int, elem: int, text: str, x0, x1, base, math: str = "false", italic: str = "false") -> str:
    return f"SELECT doc_id, page, {line} AS line, {elem} AS elem, {text} AS text, {_LINE.format(x0, x1, f'{base} - 9', f'{base} + 2', 10)}, CAST({base} AS DOUBLE) AS baseline, {math} AS math, {italic} AS italic, 72e0 AS rx0, 540e0 AS rx1 FROM {{o}} WHERE {where}"


_FORMULAS = " UNION ALL ".join((
    _put("true", 1, 1, "'some words of the text before'", 72, 540, "185 + 3 * (doc_id % 5)"), _put("true", 9, 9, "'some words of the text after'", 72, 540, 240),
    _put("doc_id % 4 < 2", 2, 2, "concat('a + ', p)", 100, "130 + q % 40", 201), _put("doc_id % 4 < 2", 3, 3, "'y'", 72, 78, 208, italic="true"), _put("doc_id % 4 < 2", 3, 4, "'='", 82, 90, 208), _put("doc_id % 4 = 0", 4, 5, "concat('b + ', q)", 100, 150, 215),
    _put("doc_id % 4 = 2", 2, 2, "concat('f = g + ', p)", 100, "160 + q % 40", 208, math="true"), _put("doc_id % 4 = 2", 2, 3, "'(3)'", 525, 539, 208),
    _put("doc_id % 4 = 3", 2, 2, "'words with a line'", 100, 150, 201), _put("doc_id % 4 = 3", 4, 5, "'words under the line'", 100, 150, 215),
))
_BARS = f"SELECT doc_id, page, {_AT.format(98, 204, 172, 204.5)} FROM {{o}} WHERE doc_id % 4 <> 2"


@query("WITH o AS (" + _DRAWN.replace("{t}", "lineitem") + """), e AS (SELECT *, doc_id % 4 = 0 AS fraction, 185 + 3 * (doc_id % 5) AS b FROM o WHERE doc_id % 2 = 0)
SELECT doc_id, page, CAST(2 AS INTEGER) AS first, CAST(CASE WHEN fraction THEN 4 ELSE 2 END AS INTEGER) AS last, NOT fraction AS numbered, fraction, CAST(CASE WHEN fraction THEN 70.5 ELSE 98.5 END AS DOUBLE) AS x0, CAST(CASE WHEN NOT fraction THEN 540.5 WHEN q % 40 = 39 THEN 173.5 ELSE greatest(150, 130 + q % 40) + 1.5 END AS DOUBLE) AS x1,
CAST(greatest(CASE WHEN fraction THEN 190.5 ELSE 197.5 END, b + 2.8) AS DOUBLE) AS y0, CAST(CASE WHEN fraction THEN 218.5 ELSE 211.5 END AS DOUBLE) AS y1 FROM e""")
def stacked_equations(spark, d):
    """Equations with fraction bars, by columns of pages."""
    o = spark.sql(_DRAWN, t=table(spark, d, "lineitem"))
    return fractions.stacked_equations(spark.sql(_FORMULAS, o=o), spark.sql(_BARS, o=o))


# Paragraphs of the orders' lines: a label or nothing, a name, a quantity near one place, and a price at the right edge or before it.
_TABBED = " UNION ALL ".join(
    f"SELECT doc_id, page, 1 AS para, i AS line, {e} AS elem, {text} AS text, CAST({x0} AS DOUBLE) AS x0, CAST({x1} AS DOUBLE) AS x1, 1e1 AS size, 72e0 AS rx0, 540e0 AS rx1 FROM {{r}} WHERE {where}"
    for e, text, x0, x1, where in (
        (0, "concat('(', i + 1, ')')", 72, "86 + 20 * (doc_id % 3)", "doc_id % 2 = 1 AND i = 0"), (1, "concat('part ', p)", "72 + 18 * (doc_id % 2) + 30 * (CASE WHEN i = 0 THEN doc_id % 2 * (doc_id % 3) ELSE 0 END)", 180, "true"),
        (2, "concat('x', q)", "200 + 0.25 * (i % 3)", 220, "true"), (3, "concat('p', p)", "500 - 10 * (q % 3)", "540 - 20 * (doc_id % 3)", "true"),
    )
)
_TABBED_ROWS = _ROWS.replace("{t}", "lineitem")


@query("WITH r AS (" + _TABBED_ROWS + """), p AS (SELECT doc_id, page, count(*) AS lines, CASE WHEN doc_id % 2 = 0 OR count(*) = 1 AND doc_id % 3 = 0 THEN 0 WHEN count(*) = 1 THEN 18 + 30 * (doc_id % 3) ELSE 18 END AS l FROM r GROUP BY doc_id, page)
SELECT doc_id, page, CAST(1 AS INTEGER) AS para, lines, CAST(l AS DOUBLE) AS "left", CAST(-l AS DOUBLE) AS first_line, l > 0 AS hanging FROM p""")
def paragraph_indents(spark, d):
    """Left, first-line and hanging indents."""
    return tabs.paragraph_indents(spark.sql(_TABBED, r=spark.sql(_ROWS, t=table(spark, d, "lineitem"))))


@query("WITH r AS (" + _TABBED_ROWS + """), e AS (SELECT doc_id, page, 128.0 + 0.25 * (i % 3) AS pos, 'left' AS align, 128.0 AS stop FROM r
UNION ALL SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN 468.0 ELSE 428.0 - 10 * (q % 3) END, CASE WHEN doc_id % 3 = 0 THEN 'right' ELSE 'left' END, CASE WHEN doc_id % 3 = 0 THEN 468.0 ELSE 428.0 - 10 * (q % 3) END FROM r
UNION ALL SELECT doc_id, page, 18.0 + 30 * (doc_id % 3), 'left', 18.0 + 30 * (doc_id % 3) FROM r WHERE i = 0 AND k > 1 AND doc_id % 2 = 1 AND doc_id % 3 > 0)
SELECT doc_id, page, CAST(1 AS INTEGER) AS para, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY stop) AS INTEGER) AS stop, CAST(stop AS DOUBLE) AS pos, min(align) AS align, CAST(count(*) AS INTEGER) AS gaps FROM e GROUP BY doc_id, page, e.stop""")
def tab_stops(spark, d):
    """Tab stops of paragraphs, those of hanging labels among them."""
    s = spark.sql(_TABBED, r=spark.sql(_ROWS, t=table(spark, d, "lineitem")))
    return tabs.tab_stops(s, tabs.paragraph_indents(s))


del query
