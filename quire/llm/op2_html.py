"""Main text of HTML pages by composite text density.

A page becomes a tree of its block-level nodes (inline mark-up folds into the block that holds it, so bold or linked words do not split a paragraph).
Each node gets a composite density: its characters per tag, adjusted for the share of its characters and tags that belong to links, against the page's
own ratio. A node's density sum is that of its children's densities, its own text counting as a child of the same unit. The subtree with the greatest sum
lies in the article. If an <article>, <main> or the like holds it, the outermost of these is the article, with others of them elsewhere and every subtree
whose density reaches the least one on the path. Otherwise the article is the lowest node on the path to the body that holds all blocks whose text is not
mostly links; its lists, tables, headings and short sections stay, however their densities compare.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments leave the tree before densities are computed, by element or
by the words of class, id and role; if that leaves no text, the names are disregarded.

Defined results: a null or empty page has the empty text; unclosed and crossing elements are closed as browsers do; white space inside a block becomes one
space; blocks are joined by two line feeds; nothing else is dropped or capped. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table

_TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*+>)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)

BLOCKS = frozenset("html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre article section main figure figcaption address details summary center hgroup fieldset header footer nav aside form menu dialog head".split())
#: Their content is never text of the article.
SKIP = frozenset("script style noscript template svg math iframe object embed canvas audio video select button textarea title option datalist map head".split())
DROP = frozenset("nav footer aside form menu dialog".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
VOID = frozenset("br hr img input meta link area base col embed param source track wbr".split())
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCKS - frozenset("html body head".split()) - frozenset("caption thead tbody tfoot tr td th dt dd li summary figcaption".split()) | frozenset(["hr", "li", "dd", "dt"])
#: A start of the key closes the nearest open one of the first set, unless one of the second set is nearer.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
}
WALLS = frozenset("table td th caption body html".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer foot masthead topbar toolbar pagination pager "
    "comments commentlist disqus respond discussion reactions cookie cookies consent gdpr notification overlay lightbox newsletter subscribe subscription signup login register "
    "sharing social recommended recommendations trending searchbox feedback copyright".split()
)
#: Boilerplate words with everyday meanings: they decide only in names of words that are all listed here, and not inside the article (results-and-discussion, a section's
#: id discussion).
WEAK_WORDS = frozenset("discussion reactions notification consent overlay register login subscription recommended recommendations trending feedback copyright social sharing promotion foot navigation signup subscribe respond toolbar sponsor sponsored".split())
#: Words that mean boilerplate only in a name of such words, boilerplate words and PLAIN_WORDS: share-buttons, but not share-price.
OPEN_WORDS = frozenset("share follow related search form skip legal rail alert notice promo banner popup modal reply replies comment response".split())
PLAIN_WORDS = frozenset("a an and the us me to of in on by bar box button buttons link links top icon icons list item items row rows group section area block widget panel pane wrap wrapper container inner outer left right bottom main site page global post posts article articles story stories text title heading field fields input content module component desktop mobile sticky fixed primary secondary mini small large more this".split())
HEAD_WORDS = frozenset("header head".split())
GOOD_WORDS = frozenset("article content main story entry post body text".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _named(attrs: str) -> int:
    """What the attributes say of an element: 2 boilerplate, 3 boilerplate unless the article holds it, 4 a header unless it holds the title, 1 hidden, -1 the article, 0 nothing."""
    found = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 1
        if key in ("class", "id", "role"):
            for name in value.split():
                words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
                if not words or words[0] in ("with", "has", "no", "without"):
                    continue
                said = BAD_WORDS.intersection(words)
                known = all(w in OPEN_WORDS or w in PLAIN_WORDS or w in BAD_WORDS or w.isdigit() for w in words)
                if said - WEAK_WORDS or OPEN_WORDS.intersection(words) and not said and known or key == "role" and words[0] in ("complementary", "contentinfo", "dialog", "alertdialog", "navigation"):
                    return 2
                if said and known:
                    found = 3
                elif HEAD_WORDS.intersection(words) and not GOOD_WORDS.intersection(words):
                    found = found or 4
                if key == "role" and words[0] == "main":
                    found = -1
        elif key == "itemprop" and value.lower() == "articlebody":
            found = -1
    return found


class _Tree:
    """Block-level nodes as parallel lists; pieces of text in page order, each with the node that holds it."""

    def __init__(self) -> None:
        self.tag, self.parent, self.good, self.bad, self.own = ["#root"], [-1], [False], [False], [0]
        self.text: list[tuple[int, str, bool]] = []  # node, text, in a link
        self.links = [0]

    def add(self, tag: str, parent: int, good: bool, own: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.good.append(good)
        self.own.append(own)  # 1 boilerplate, others only if nothing lifts it: 2 a form, 3 by a weak name, 4 by a header's name
        self.bad.append(self.bad[parent] or own > 0)
        self.links.append(0)
        return len(self.tag) - 1


def parse(page: str, names: bool = True) -> _Tree:
    """The page's blocks. ``names``: class, id and role count."""
    t, stack, link, skip, at, n = _Tree(), [0], -1, 0, 0, len(page)
    skipping = ""  # an element whose content is passed over, with its depth
    scan = _TOKEN.search
    while at < n:
        m = scan(page, at)
        end = m.start() if m else n
        if end > at and not skip:
            t.text.append((stack[-1], page[at:end], link >= 0))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, attrs = m[2].lower(), bool(m[1]), m[3]
        if skip:
            if tag == skipping and tag not in VOID and not attrs.endswith("/>"):
                skip += -1 if closing else 1
            continue
        if not closing and tag in RAW:
            e = RAW[tag].search(page, at)
            close = page.find(">", e.end()) if e else -1
            at = n if close < 0 else close + 1
            continue
        if tag in SKIP and not closing:
            if tag == "head":
                e = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                if e:  # the title and what else the head holds
                    at = e.end() if e[0][1] == "/" else e.start()
                continue
            if tag not in VOID and not attrs.endswith("/>"):
                skipping, skip = tag, 1
            continue
        if tag == "a":
            link = -1 if closing else len(stack)
            if not closing:
                t.links[stack[-1]] += 1
            continue
        if tag == "br" or tag == "hr" or tag == "img":
            t.text.append((stack[-1], " ", False))
            if tag != "hr":
                continue
        if closing:
            if tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if t.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if t.tag[stack[k]] in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
                if link > len(stack):
                    link = -1
            continue
        if tag not in BLOCKS and tag != "hr":
            if names and tag not in VOID and ("class" in attrs or "id=" in attrs or "hidden" in attrs) and tag in ("span", "label", "small", "i", "b") and not attrs.endswith("/>") and _named(attrs) > 0:
                skipping, skip = tag, 1
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if t.tag[stack[k]] == "p":
                    del stack[k:]
                    break
                if t.tag[stack[k]] in WALLS:
                    break
        if tag in IMPLIED:
            ends, walls = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if t.tag[stack[k]] in ends:
                    del stack[k:]
                    if tag == "tr" and t.tag[stack[-1]] == "tr":
                        continue
                    break
                if t.tag[stack[k]] in walls:
                    break
        if tag == "hr" or tag in ("html", "body") and any(t.tag[s] == tag for s in stack):
            continue
        if link > len(stack):
            link = -1
        up = stack[-1]
        said = _named(attrs) if names and attrs != ">" else 0
        fixed = tag in ("html", "body", "main")
        article = any(t.tag[s] in ("article", "main") for s in stack)
        own = 2 if tag == "form" else 1 if tag in DROP or tag == "header" and not article else 0
        if said > 0 and not fixed and (tag != "article" or said == 1) and own in (0, 2):
            own = said if said > 2 else 1
        stack.append(t.add(tag, up, tag in ("article", "main") or said < 0, own))
    _lift(t)
    return t


def _lift(t: _Tree) -> None:
    """What may be boilerplate and isn't: a form around an article or around half of the page's words; what has a weak name inside an article; what has a header's name and
    holds the page's only top heading."""
    n = len(t.tag)
    if not any(own > 1 for own in t.own):
        return
    words = [0] * n
    for node, text, linked in t.text:
        if not linked:
            words[node] += len(text) - text.count(" ")
    article, top = [g or tag in ("article", "main") for g, tag in zip(t.good, t.tag, strict=True)], [tag == "h1" for tag in t.tag]
    hard, within = [own == 1 for own in t.own], [False] * n
    for i in range(1, n):
        p = t.parent[i]
        hard[i] |= hard[p]
        within[i] = within[p] or article[p]
    own_words, heads = [0 if h else w for w, h in zip(words, hard, strict=True)], [int(x and not h) for x, h in zip(top, hard, strict=True)]
    total, all_heads, holds = sum(own_words), sum(heads), list(article)
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        own_words[p] += own_words[i]
        heads[p] += heads[i]
        holds[p] |= holds[i]
    for i in range(1, n):
        if t.own[i] == 2 and (holds[i] or total and 2 * own_words[i] >= total) or t.own[i] == 3 and within[i] or t.own[i] == 4 and heads[i] == all_heads == 1:
            t.own[i] = 0
        t.bad[i] = t.bad[t.parent[i]] or t.own[i] > 0


def _blocks(t: _Tree, inside: list[bool]) -> str:
    """The text of the nodes inside, a block for each run of one block's text; cells of a row make one block."""
    out: list[str] = []
    last, now = None, []
    for node, text, _ in t.text:
        if not inside[node]:
            continue
        while t.tag[node] in ("td", "th") and t.parent[node] > 0:
            node = t.parent[node]
        if node != last:
            out.append("".join(now))
            now, last = [], node
        elif t.tag[node] == "tr":
            now.append(" ")
        now.append(text)
    out.append("".join(now))
    return "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in out) if x)


def densities(t: _Tree) -> tuple[list[float], list[float], list[bool]]:
    """Composite density and density sum of every node, and whether most of the text that it holds itself lies outside links."""
    n = len(t.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text, linked in t.text:
        if not t.bad[node]:
            c = len(text) - text.count(" ") - text.count("\n")
            chars[node] += c
            if linked:
                link_chars[node] += c
    direct = [c - lc for c, lc in zip(chars, link_chars, strict=True)]
    plain_text = [2 * d > c for d, c in zip(direct, chars, strict=True)]
    for i in range(n - 1, 0, -1):
        if t.bad[i]:
            continue
        p = t.parent[i]
        tags[i] += t.links[i]
        link_tags[i] += t.links[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i]
    body = next((i for i in range(n) if t.tag[i] == "body"), 0)
    share = link_chars[body] / max(chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, k = chars[i], max(tags[i], 1)
        if c:
            lc, lt = max(link_chars[i], 1), max(link_tags[i], 1)
            plain = max(c - link_chars[i], 1)
            base = math.log(c / plain * link_chars[i] + share * c + math.e)
            density[i] = c / k * math.log(max(c / lc * (k / lt), 1.0) + 1e-9) / base if c / lc * (k / lt) > 1 else 0.0
        if i and not t.bad[i]:
            total[t.parent[i]] += density[i]
        if direct[i] and t.tag[i] not in ("html", "#root"):  # a node's own text counts as a child of its own
            total[i] += direct[i] * math.log(direct[i]) / math.log(share * direct[i] + math.e)
    return density, total, plain_text


def _choose(t: _Tree) -> list[bool]:
    """The nodes of the article: of the subtree that holds it whole, those that aren't menus."""
    density, total, plain = densities(t)
    n = len(t.tag)
    linked = list(t.links)  # links in each subtree
    parts = [int(p) for p in plain]  # blocks of text in each subtree
    for i in range(n - 1, 0, -1):
        linked[t.parent[i]] += linked[i]
        parts[t.parent[i]] += parts[i]
    said = [False] * n  # has words of its own outside links
    for node, text, link in t.text:
        said[node] |= not link and any(c.isalpha() for c in text)
    best = max(range(n), key=lambda i: -1.0 if t.bad[i] else total[i])
    path, i = [], best
    while i > 0 and t.tag[i] not in ("body", "html"):
        path.append(i)
        i = t.parent[i]
    floor = min((density[i] for i in path), default=0.0)
    top = next((i for i in reversed(path) if t.good[i]), -1)
    marked = top >= 0
    if not marked:
        top = best
        while top > 0 and parts[top] < parts[0]:
            top = t.parent[top]
    on, above = set(path), {t.parent[i] for i in path}
    inside = [False] * n
    inside[top] = True
    for i in range(1, n):
        p = t.parent[i]
        if t.bad[i]:
            continue
        if inside[p]:
            beside = not marked and p in above and i not in on  # not in the densest subtree: there a list of links is a menu
            inside[i] = linked[i] < 2 or (said[i] if t.tag[i] == "p" else parts[i] > 0 if beside else density[i] > 0)  # a block of links only is a menu
        elif marked and i not in on and (density[i] >= max(floor, 1e-9) or t.good[i] and density[i] > 0):
            inside[i] = True
    return inside


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    t = parse(page)
    if not any(text.strip() and not t.bad[node] for node, text, _ in t.text):
        t = parse(page, names=False)
    return _blocks(t, _choose(t))


def extract_text(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """``keys`` and the main text of each page: ``text``, ``n_chars`` (its code points). A map over rows: nothing is shuffled."""
    rows = pages.select(*keys, F.col(html_col).cast("string").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for b in batches:
            found = [extract(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")


def op2_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text: page_id, url, text, n_chars."""
    return extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
