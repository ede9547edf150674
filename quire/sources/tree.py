"""A page's mark-up as the tree that browsers build, every text with its place in the source.

Tokens follow the HTML standard's tokeniser, the tree its tree construction: insertion modes (kept as a stack beside the open elements), implied ends, the list of active
formatting elements with the adoption agency, foster parenting of what stands wrongly in tables, foreign content. Frames are not built, a missing doctype alone makes quirks mode,
and what surrounds <body> goes into it. Texts keep their source pieces apart, so that an edit finds the bytes of each character.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_WORDS = lambda s: frozenset(s.split())
#: Fixed values of the standard: elements by how tree construction treats them.
VOID = _WORDS("area base br col embed hr img input keygen link meta param source track wbr")
RAW = _WORDS("script style xmp iframe noembed noframes noscript")
HEAD = _WORDS("base basefont bgsound link meta noframes script style template title")
FORMATTING = _WORDS("a b big code em font i nobr s small strike strong tt u")
HEADINGS = _WORDS("h1 h2 h3 h4 h5 h6")
BLOCKS = _WORDS("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul")
SPECIAL = BLOCKS | HEADINGS | HEAD | VOID - {"keygen"} | _WORDS("applet body button caption colgroup dd dt form frame frameset head html iframe li listing marquee noembed noscript object plaintext pre select table tbody td textarea tfoot th thead tr xmp")
IMPLIED = _WORDS("dd dt li optgroup option p rb rp rt rtc")
SCOPE = _WORDS("applet caption html table td th marquee object template svg math")
PARTS, TABLE_TAGS = _WORDS("tbody thead tfoot"), _WORDS("caption col colgroup tbody td tfoot th thead tr")
BREAKOUT = BLOCKS | HEADINGS | FORMATTING - {"a"} | _WORDS("body br dd dt embed head hr img li listing meta pre ruby span sub sup table var")
INTEGRATION = _WORDS("foreignobject desc title mi mo mn ms mtext annotation-xml")
MODES = {"table": "table", "tbody": "part", "thead": "part", "tfoot": "part", "tr": "row", "td": "cell", "th": "cell", "caption": "caption", "colgroup": "colgroup", "select": "select", "template": "body"}

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]+|=?[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]+)?)?|=""")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)|\r\n?")
_SPACE = re.compile(r"[ \t\n\f\r]*")


class Element:
    """A start tag stands from ``start`` to ``inner``, the end tag from ``close`` to ``end`` (both where the next token begins, if it is implied); -1: not in the source."""

    __slots__ = ("tag", "attrs", "kids", "parent", "start", "inner", "close", "end", "foreign")

    def __init__(self, tag: str, attrs: str = "", start: int = -1, inner: int = -1, foreign: bool = False):
        self.tag, self.attrs, self.kids, self.parent, self.start, self.inner, self.close, self.end, self.foreign = tag, attrs, [], None, start, inner, -1, -1, foreign


class Text:
    """A text node: its source pieces (start, end, whether references count)."""

    __slots__ = ("pieces", "parent")

    def __init__(self, piece: tuple[int, int, bool]):
        self.pieces, self.parent = [piece], None


def decoded(src: str, start: int, end: int, references: bool) -> tuple[str, list[int]]:
    """A source piece as text, and where each of its characters (and its end) stands."""
    if not references or "&" not in src[start:end] and "\r" not in src[start:end]:
        text = src[start:end]
        return (text.replace("\r\n", "\n"), [i for i in range(start, end) if src[i : i + 2] != "\r\n"] + [end]) if "\r" in text else (text, [*range(start, end + 1)])
    out, at, places = [], start, []
    for m in _REFERENCE.finditer(src, start, end):
        s = "\n" if m[0][0] == "\r" else html.unescape(m[0])
        out += [src[at : m.start()], s]
        places += range(at, m.start())
        # A reference without its semicolon may be a shorter name and plain letters.
        plain = 0
        if m[0][0] == "&" and s[-1:] == m[0][-1]:
            plain = next((k for k in range(len(m[0]) - 1, 0, -1) if (head := html.unescape(m[0][:-k])) != m[0][:-k] and head + m[0][-k:] == s), len(s) if s == m[0] else 0)
        places += [m.start()] * (len(s) - plain) + list(range(m.end() - plain, m.end()))
        at = m.end()
    out.append(src[at:end])
    places += range(at, end)
    return "".join(out), [*places, end]


class Builder:
    """Builds the tree of one page: ``root`` holds head and body."""

    def __init__(self, src: str):
        self.src, self.quirks = src, True
        self.root, self.head, self.body = Element("html"), Element("head"), Element("body")
        self._append(self.root, self.head)
        self._append(self.root, self.body)
        self.stack, self.modes, self.active, self.form = [self.root, self.body], ["body"], [], None
        self.opened = self.foster = self.skip_newline = False
        self.token = (0, 0, "")
        self._run()
        self.token = (len(src), len(src), "")
        while self.stack:
            self._pop()

    # --- tokens ---

    def _run(self) -> None:
        src, at, n = self.src, 0, len(self.src)
        find = src.find
        while at < n:
            lt = find("<", at)
            if lt < 0:
                self._text(at, n)
                return
            m = _NAME.match(src, lt)
            if m is None and not src.startswith(("<!", "<?", "</"), lt) or lt == n - 1:
                nxt = find("<", lt + 1)
                self._text(at, nxt if nxt >= 0 else n)
                at = nxt if nxt >= 0 else n
                continue
            if lt > at:
                self._text(at, lt)
            if m is None:
                at = self._other(lt)
                continue
            p, end = m.end(), -1
            while p < n:
                if src[p] == ">":
                    end = p + 1
                    break
                a = _ATTR.match(src, p)
                if a is None:
                    break
                p = a.end()
            if end < 0:
                return  # the page ends inside a tag
            tag, attrs = m[2].lower(), src[m.end() : end - 1]
            self.skip_newline, self.token = False, (lt, end, tag if m[1] else "")
            if m[1]:
                self._end(tag)
                at = end
            else:
                before = self.stack[-1]
                self._start(tag, attrs, lt, end)
                at = end
                top = self.stack[-1]
                if top is not before and top.start == lt and not top.foreign and (top.tag in RAW or top.tag in ("title", "textarea", "plaintext")):
                    at = self._raw(top, end)

    def _other(self, at: int) -> int:
        """Comments, doctypes and the like; returns where they end."""
        src, n = self.src, len(self.src)
        if src.startswith("<!--", at):
            if src.startswith((">", "->"), at + 4):
                return src.index(">", at) + 1
            m = re.compile("--!?>").search(src, at + 4)
            return m.end() if m else n
        if src.startswith("<![CDATA[", at) and self.stack[-1].foreign:
            z = src.find("]]>", at)
            return z + 3 if z >= 0 else n
        if src[at : at + 9].lower() == "<!doctype" and not self.opened:
            self.quirks = not re.match(r"\s*html\b", src[at + 9 : at + 40], re.I)
        z = src.find(">", at)
        return z + 1 if z >= 0 else n

    def _raw(self, e: Element, at: int) -> int:
        """The text of an element without mark-up, and its end tag; returns where it ends."""
        m = None if e.tag == "plaintext" else re.compile(rf"</{e.tag}(?=[\s/>])", re.I).search(self.src, at)
        z = m.start() if m else len(self.src)
        if e.tag == "textarea" and self.src.startswith("\n", at):
            at += 1
        if z > at:
            self._put(e, Text((at, z, e.tag in ("title", "textarea"))))
        after = self.src.find(">", z) + 1 if m else 0
        after = after or len(self.src)
        self.token = (z, after, e.tag if m else "")
        self._pop()
        return after

    # --- the stack ---

    def _append(self, parent: Element, node: Element | Text, before: Element | None = None) -> None:
        node.parent = parent
        if before is None:
            parent.kids.append(node)
        else:
            parent.kids.insert(parent.kids.index(before), node)

    def _detach(self, node: Element | Text) -> None:
        if node.parent is not None:
            node.parent.kids.remove(node)
            node.parent = None

    def _place(self, target: Element) -> tuple[Element, Element | None]:
        """Where a new node goes: into ``target``, or before the table that it must not stand in."""
        if self.foster and target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            k = max(i for i, e in enumerate(self.stack) if e.tag == "table")
            table = self.stack[k]
            return (table.parent, table) if table.parent is not None else (self.stack[k - 1], None)
        return target, None

    def _put(self, target: Element, node: Element | Text) -> None:
        parent, before = self._place(target)
        if isinstance(node, Text):
            k = parent.kids.index(before) if before is not None else len(parent.kids)
            if k and isinstance(parent.kids[k - 1], Text):
                parent.kids[k - 1].pieces += node.pieces
                return
        self._append(parent, node, before)

    def _push(self, tag: str, attrs: str = "", start: int = -1, inner: int = -1, foreign: bool = False) -> Element:
        e = Element(tag, attrs, start, inner, foreign)
        self._put(self.stack[-1], e)
        self.stack.append(e)
        if tag in MODES and not foreign:
            self.modes.append(MODES[tag])
        return e

    def _pop(self) -> Element:
        e = self.stack.pop()
        e.close, after, closing = self.token
        e.end = after if e.tag == closing else e.close
        if e.tag in MODES and not e.foreign:
            self.modes.pop()
        return e

    def _pop_to(self, *tags: str) -> None:
        """Pop up to and with the topmost of these."""
        while len(self.stack) > 2 and self._pop().tag not in tags:
            pass

    def _clear_to(self, *tags: str) -> None:
        while len(self.stack) > 2 and self.stack[-1].tag not in tags and self.stack[-1].tag != "template":
            self._pop()

    def _within(self, tags, stops=SCOPE) -> bool:
        for e in reversed(self.stack):
            if e.tag in tags and not e.foreign:
                return True
            if e.tag in stops:
                return False
        return False

    _TABLE_SCOPE = _WORDS("html table template")

    def _implied(self, but: str = "") -> None:
        while self.stack[-1].tag in IMPLIED and self.stack[-1].tag != but:
            self._pop()

    def _close_p(self) -> None:
        if self._within(("p",), SCOPE | {"button"}):
            self._implied("p")
            self._pop_to("p")

    # --- formatting elements ---

    def _mark(self) -> None:
        self.active.append(None)

    def _unmark(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _format(self, e: Element) -> None:
        same = []
        for x in reversed(self.active):
            if x is None:
                break
            if x.tag == e.tag and x.attrs == e.attrs:
                same.append(x)
        if len(same) >= 3:
            self.active.remove(same[-1])
        self.active.append(e)

    def _reconstruct(self) -> None:
        a = self.active
        if not a or a[-1] is None or a[-1] in self.stack:
            return
        i = len(a) - 1
        while i > 0 and a[i - 1] is not None and a[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(a)):
            a[k] = self._push(a[k].tag, a[k].attrs, a[k].start, a[k].inner)

    def _last_active(self, tag: str) -> Element | None:
        for e in reversed(self.active):
            if e is None:
                return None
            if e.tag == tag:
                return e
        return None

    def _adopt(self, tag: str) -> None:
        """The adoption agency: a formatting element ends though others opened inside it have not."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            self._pop()
            return
        for _ in range(8):
            fmt = self._last_active(tag)
            if fmt is None:
                self._any_end(tag)
                return
            if fmt not in self.stack:
                self.active.remove(fmt)
                return
            k = self.stack.index(fmt)
            if not self._element_in_scope(fmt):
                return
            far = next((i for i in range(k + 1, len(self.stack)) if self.stack[i].tag in SPECIAL), None)
            if far is None:
                while self._pop() is not fmt:
                    pass
                self.active.remove(fmt)
                return
            block, ancestor, mark = self.stack[far], self.stack[k - 1], self.active.index(fmt)
            node_at, last, inner = far, block, 0
            while True:
                node_at -= 1
                node = self.stack[node_at]
                if node is fmt:
                    break
                inner += 1
                if inner > 3 and node in self.active:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    self.stack.remove(node)
                    continue
                new = Element(node.tag, node.attrs, node.start, node.inner)
                self.active[self.active.index(node)] = self.stack[node_at] = new
                if last is block:
                    mark = self.active.index(new) + 1
                self._detach(last)
                self._append(new, last)
                last = new
            self._detach(last)
            held, self.foster = self.foster, True
            parent, before = self._place(ancestor)
            self.foster = held
            self._append(parent, last, before)
            new = Element(fmt.tag, fmt.attrs, fmt.start, fmt.inner)
            for kid in block.kids:
                kid.parent = new
            new.kids, block.kids = block.kids, []
            self._append(block, new)
            if self.active.index(fmt) < mark:
                mark -= 1
            self.active.remove(fmt)
            self.active.insert(mark, new)
            self.stack.remove(fmt)
            self.stack.insert(self.stack.index(block) + 1, new)

    def _element_in_scope(self, e: Element) -> bool:
        for x in reversed(self.stack):
            if x is e:
                return True
            if x.tag in SCOPE:
                return False
        return False

    def _any_end(self, tag: str) -> None:
        for e in reversed(self.stack[2:]):
            if e.tag == tag:
                self._implied(tag)
                while self._pop() is not e:
                    pass
                return
            if e.tag in SPECIAL:
                return

    # --- text ---

    def _text(self, a: int, z: int) -> None:
        src, mode = self.src, self.modes[-1]
        if self.skip_newline:
            self.skip_newline = False
            a += 2 if src.startswith("\r\n", a) else 1 if src[a] in "\r\n" else 0
            if a >= z:
                return
        blank = _SPACE.fullmatch(src, a, z) is not None
        if not self.opened:
            if blank:
                return
            a = _SPACE.match(src, a).end()
            self.opened = True
        if self.stack[-1].foreign:
            self._put(self.stack[-1], Text((a, z, True)))
            return
        if mode == "colgroup" and not blank:
            self._pop()
            mode = self.modes[-1]
        if mode in ("table", "part", "row") and not blank and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr"):
            self.foster = True
            self._reconstruct()
            self._put(self.stack[-1], Text((a, z, True)))
            self.foster = False
            return
        if mode not in ("table", "part", "row", "colgroup", "select"):
            self._reconstruct()
        self._put(self.stack[-1], Text((a, z, True)))

    # --- start tags ---

    def _start(self, tag: str, attrs: str, start: int, inner: int) -> None:
        new = (tag, attrs, start, inner)
        if tag in ("html", "head", "body", "frameset", "frame"):
            self.opened = self.opened or tag == "body"
            return
        if not self.opened and tag in HEAD:
            self.stack.append(self.head)
            self._insert(*new)
            self.stack.remove(self.head)
            if self.stack[-1].start == start:  # its text or content follows
                return
            return
        self.opened = True
        top = self.stack[-1]
        if top.foreign and top.tag not in INTEGRATION:
            if tag in BREAKOUT or tag == "font" and re.search(r"\b(color|face|size)\b", attrs, re.I):
                while self.stack[-1].foreign and self.stack[-1].tag not in INTEGRATION:
                    self._pop()
            else:
                self._push(*new, foreign=True)
                if attrs.endswith("/"):
                    self._pop()
                return
        getattr(self, f"_in_{self.modes[-1]}")(*new)

    def _insert(self, tag: str, attrs: str, start: int, inner: int) -> Element:
        e = self._push(tag, attrs, start, inner)
        if tag in VOID:
            self._pop()
        return e

    def _in_body(self, *new) -> None:
        tag = new[0]
        if tag == "image":
            tag = "img"
            new = (tag, *new[1:])
        if tag in HEAD:
            self._insert(*new)
        elif tag in BLOCKS or tag in ("pre", "listing", "plaintext", "xmp"):
            self._close_p()
            if tag == "xmp":
                self._reconstruct()
            self._push(*new)
            self.skip_newline = tag in ("pre", "listing")
        elif tag in HEADINGS:
            self._close_p()
            if self.stack[-1].tag in HEADINGS:
                self._pop()
            self._push(*new)
        elif tag == "form":
            if self.form is None:
                self._close_p()
                self.form = self._push(*new)
        elif tag in ("li", "dd", "dt"):
            kin = ("li",) if tag == "li" else ("dd", "dt")
            for e in reversed(self.stack):
                if e.tag in kin:
                    self._implied(e.tag)
                    self._pop_to(e.tag)
                    break
                if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                    break
            self._close_p()
            self._push(*new)
        elif tag == "button":
            if self._within(("button",)):
                self._implied()
                self._pop_to("button")
            self._reconstruct()
            self._push(*new)
        elif tag in FORMATTING:
            if tag == "a" and (old := self._last_active("a")) is not None:
                self._adopt("a")
                if old in self.active:
                    self.active.remove(old)
                if old in self.stack:
                    self.stack.remove(old)
            self._reconstruct()
            if tag == "nobr" and self._within(("nobr",)):
                self._adopt("nobr")
                self._reconstruct()
            self._format(self._push(*new))
        elif tag in ("applet", "marquee", "object"):
            self._reconstruct()
            self._push(*new)
            self._mark()
        elif tag == "table":
            if not self.quirks:
                self._close_p()
            self._push(*new)
        elif tag == "hr":
            self._close_p()
            self._insert(*new)
        elif tag in VOID and tag != "col":
            if tag not in ("param", "source", "track"):
                self._reconstruct()
            self._insert(*new)
        elif tag in ("textarea", "iframe", "noembed", "noscript"):
            self._push(*new)
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self._pop()
            self._reconstruct()
            self._push(*new)
        elif tag in ("rb", "rp", "rt", "rtc"):
            if self._within(("ruby",)):
                self._implied("rtc" if tag in ("rp", "rt") else "")
            self._push(*new)
        elif tag in ("svg", "math"):
            self._reconstruct()
            self._push(*new, foreign=True)
            if new[1].endswith("/"):
                self._pop()
        elif tag not in TABLE_TAGS:
            self._reconstruct()
            self._push(*new)

    def _in_table(self, *new) -> None:
        tag = new[0]
        if tag in TABLE_TAGS:
            self._clear_to("table")
            if tag == "caption":
                self._mark()
                self._push(*new)
            elif tag == "colgroup" or tag in PARTS:
                self._push(*new)
            else:
                self._push("colgroup" if tag == "col" else "tbody")
                self._again(*new)
        elif tag == "table":
            if self._within(("table",), self._TABLE_SCOPE):
                self._pop_to("table")
                self._again(*new)
        elif tag in ("style", "script", "template") or tag == "input" and re.search(r"type\s*=\s*[\"']?hidden\b", new[1], re.I):
            self._insert(*new)
        elif tag == "form":
            if self.form is None:
                self.form = self._push(*new)
                self._pop()
        else:
            self.foster = True
            self._in_body(*new)
            self.foster = False

    def _again(self, *new) -> None:
        getattr(self, f"_in_{self.modes[-1]}")(*new)

    def _in_part(self, *new) -> None:
        tag = new[0]
        if tag in ("tr", "td", "th"):
            self._clear_to(*PARTS)
            if tag == "tr":
                self._push(*new)
            else:
                self._push("tr")
                self._again(*new)
        elif tag in TABLE_TAGS:
            self._clear_to(*PARTS)
            self._pop()
            self._again(*new)
        else:
            self._in_table(*new)

    def _in_row(self, *new) -> None:
        tag = new[0]
        if tag in ("td", "th"):
            self._clear_to("tr")
            self._push(*new)
            self._mark()
        elif tag in TABLE_TAGS:
            self._clear_to("tr")
            self._pop()
            self._again(*new)
        else:
            self._in_table(*new)

    def _close_cell(self) -> None:
        self._implied()
        self._pop_to("td", "th")
        self._unmark()

    def _in_cell(self, *new) -> None:
        if new[0] in TABLE_TAGS:
            self._close_cell()
            self._again(*new)
        else:
            self._in_body(*new)

    def _close_caption(self) -> None:
        self._implied()
        self._pop_to("caption")
        self._unmark()

    def _in_caption(self, *new) -> None:
        if new[0] in TABLE_TAGS:
            self._close_caption()
            self._again(*new)
        else:
            self._in_body(*new)

    def _in_colgroup(self, *new) -> None:
        if new[0] in ("col", "template"):
            self._insert(*new)
        else:
            self._pop()
            self._again(*new)

    def _in_select(self, *new) -> None:
        tag = new[0]
        if tag in ("option", "optgroup", "hr"):
            if self.stack[-1].tag == "option":
                self._pop()
            if tag != "option" and self.stack[-1].tag == "optgroup":
                self._pop()
            self._insert(*new)
        elif tag in ("script", "template"):
            self._insert(*new)
        elif tag in ("select", "input", "keygen", "textarea") or tag in TABLE_TAGS or tag == "table":
            self._pop_to("select")
            if tag != "select":
                self._again(*new)

    # --- end tags ---

    def _end(self, tag: str) -> None:
        if tag == "head":
            return
        top, mode = self.stack[-1], self.modes[-1]
        if top.foreign:
            for e in reversed(self.stack):
                if not e.foreign:
                    break
                if e.tag == tag:
                    while self._pop() is not e:
                        pass
                    return
        if tag == "template":
            if self._within(("template",), _WORDS("html")):
                self._pop_to("template")
                self._unmark()
            return
        if mode == "select":
            if tag == "select":
                self._pop_to("select")
            elif tag == self.stack[-1].tag and tag in ("option", "optgroup"):
                self._pop()
            elif tag == "optgroup" and self.stack[-1].tag == "option" and self.stack[-2].tag == "optgroup":
                self._pop()
                self._pop()
            elif (tag == "table" or tag in TABLE_TAGS) and self._within((tag,), self._TABLE_SCOPE):
                self._pop_to("select")
                self._end(tag)
            return
        if mode != "body" and (tag == "table" or tag in TABLE_TAGS):
            self._table_end(tag, mode)
        elif mode in ("table", "part", "row"):
            self.foster = True
            self._body_end(tag)
            self.foster = False
        elif mode == "colgroup":
            self._pop()
            self._end(tag)
        else:
            self._body_end(tag)

    def _table_end(self, tag: str, mode: str) -> None:
        own = {"cell": ("td", "th"), "caption": ("caption",), "colgroup": ("colgroup",), "row": ("tr",), "part": tuple(PARTS), "table": ("table",)}[mode]
        if tag in own:
            if self._within((tag,), self._TABLE_SCOPE):
                if mode in ("cell", "caption"):
                    self._implied()
                    self._pop_to(tag)
                    self._unmark()
                else:
                    self._clear_to(*own)
                    self._pop()
            return
        outer = {"cell": PARTS | {"table", "tr"}, "caption": {"table"}, "colgroup": {"table"}, "row": PARTS | {"table"}, "part": {"table"}, "table": frozenset()}[mode]
        if tag in outer and self._within((tag,), self._TABLE_SCOPE):
            if mode == "cell":
                self._close_cell()
            elif mode == "caption":
                self._close_caption()
            else:
                self._clear_to(*own)
                self._pop()
            self._end(tag)

    def _body_end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if tag == "p":
            if not self._within(("p",), SCOPE | {"button"}):
                self._push("p")
            self._close_p()
        elif tag in BLOCKS or tag in ("button", "listing", "pre"):
            if self._within((tag,)):
                self._implied()
                self._pop_to(tag)
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and node in self.stack and self._within(("form",)):
                self._implied()
                self.stack.remove(node)
        elif tag in ("li", "dd", "dt"):
            if self._within((tag,), SCOPE | {"ol", "ul"} if tag == "li" else SCOPE):
                self._implied(tag)
                self._pop_to(tag)
        elif tag in HEADINGS:
            if self._within(HEADINGS):
                self._implied()
                self._pop_to(*HEADINGS)
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag in ("applet", "marquee", "object"):
            if self._within((tag,)):
                self._implied()
                self._pop_to(tag)
                self._unmark()
        elif tag == "br":
            self._reconstruct()
            self._insert("br", "", -1, -1)
        else:
            self._any_end(tag)


def outline(node: Element | Text, src: str) -> str:
    """A tree in one line, for tests: tag(child child), texts quoted."""
    if isinstance(node, Text):
        return repr("".join(decoded(src, *p)[0] for p in node.pieces))
    return f"{node.tag}({' '.join(outline(k, src) for k in node.kids)})" if node.kids else node.tag


def nodes(root: Element) -> Iterator[Element]:
    """Elements in document order, without a limit of depth."""
    waiting = [root]
    while waiting:
        e = waiting.pop()
        yield e
        waiting += [k for k in reversed(e.kids) if isinstance(k, Element)]
