"""Comparing texts: character coverage, part fidelity, common affixes, similarity, alignment, minimal hunks."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx

from quire.functions.text import PLAIN, SPACE, TOKEN, TYPOGRAPHIC

_TOKEN = re.compile(TOKEN)
_WORD = re.compile(r"[^\W_]+")
_FOLD = str.maketrans(TYPOGRAPHIC, PLAIN)


def _cleaned(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[\\x00-\\x1f\\x7f-\\x9f]|{SPACE}", "")


#: Combining accents and the spacing accents that they stand for where a letter took them up.
ACCENTS = {"\u0302": "ˆ^", "\u0303": "˜~", "\u0304": "¯", "\u0307": "˙", "\u0308": "¨", "\u0301": "´", "\u0300": "`", "\u030c": "ˇ", "\u20d7": "→\u20d7"}


def coverage(docs: DataFrame, source: Column, result: Column, missing: int = 30) -> DataFrame:
    """How many of the source's characters the result has, as a multiset; 1 where the source has none; and the first ``missing`` characters that are lacking, in the source's order.

    A spacing accent that the result lacks counts as kept for each combining one that it has instead. Both texts stand in one row and are counted there: nothing is shuffled.
    """

    def one(a: str, b: str) -> list[tuple]:
        want, have = Counter(a), Counter(b)
        for mark, alike in ACCENTS.items():
            left = have[mark]
            for c in alike:
                taken = min(left, max(0, want[c] - have[c]))
                have[c] += taken
                left -= taken
        lost = {c: n - have[c] for c, n in want.items() if n > have[c]}
        gone = sum(lost.values())
        return [(len(a), gone, 1 - gone / len(a) if a else 1.0, "".join(list(lost)[:missing]))]

    return _mapped(docs.select("doc_id", _cleaned(source).alias("a"), _cleaned(result).alias("b")), one, "total long, lost long, coverage double, missing string").withColumn("coverage", F.round("coverage", 6))


def fidelity(old: DataFrame, new: DataFrame, keys: list[str], body: str) -> DataFrame:
    """identical, modified, added or lost for every part of either version."""
    a = old.select(*keys, F.sha2(body, 256).alias("a"))
    b = new.select(*keys, F.sha2(body, 256).alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "lost").when(F.col("a") == F.col("b"), "identical").otherwise("modified")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def common_affixes(rows: DataFrame) -> DataFrame:
    """Lines that two versions (columns old, new) share at their start and end, and what changed between."""
    a, b = F.split("old", "\r?\n"), F.split("new", "\r?\n")
    n = F.least(F.size(a), F.size(b))
    same = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    pre = same(a, b)
    post = F.least(same(F.reverse(a), F.reverse(b)), n - pre)
    return rows.select("doc_id", pre.cast("long").alias("prefix"), post.cast("long").alias("suffix"), (F.size(a) - pre - post).cast("long").alias("removed"), (F.size(b) - pre - post).cast("long").alias("added"))


def _lcs(a: list, b: list) -> int:
    at = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    row = (1 << len(b)) - 1
    full = row
    for x in a:  # one bit a word of b; additions carry the matches along
        u = row & at.get(x, 0)
        row = (row + u | row - u) & full
    return len(b) - row.bit_count()


def similarity(a: str, b: str) -> float:
    """Twice the longest common word sequence over both lengths; 0 if either has no word."""
    x, y = _WORD.findall(a.lower()), _WORD.findall(b.lower())
    return 2 * _lcs(x, y) / (len(x) + len(y)) if x and y else 0.0


def core(text: str) -> str:
    """Letters and digits only, without accents, lower-cased."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in plain).lower().split())


def with_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs with a column ``similarity``."""
    keep = pairs.columns

    def run(batches):
        for t in batches:
            s = [similarity(x or "", y or "") for x, y in zip(t.column(t.schema.get_field_index(a)).to_pylist(), t.column(t.schema.get_field_index(b)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(s, pa.float64())], names=[*keep, "similarity"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{schema}, similarity double")


def align(old: list[str], new: list[str], least: float, window: int = 25, sure: float = 0.98) -> list[tuple[int, int, float]]:
    """Order-preserving pairs: each old text takes the most similar of the next ``window`` new ones after the last taken; a near-certain one ends the look."""
    out, at = [], 0
    for i, a in enumerate(old):
        best, where = 0.0, -1
        for j in range(at, min(at + window, len(new))):
            s = similarity(a, new[j])
            if s > best:
                best, where = s, j
            if s > sure:
                break
        if where >= 0 and best >= least:
            out.append((i, where, best))
            at = where + 1
    return out


def _mapped(rows: DataFrame, f, columns: str) -> DataFrame:
    """doc_id and the columns that ``f`` makes of each row's other columns: a map over rows."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    names = [c.split() for c in columns.split(", ")]
    types = [pa.int64(), *(kinds[k] for _, k in names)]

    def run(batches):
        for b in batches:
            out = [(i, *x) for i, *v in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in f(*v)]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", *(n for n, _ in names)])

    return rows.select(F.col("doc_id").cast("long"), *(c for c in rows.columns if c != "doc_id")).mapInArrow(run, f"doc_id long, {columns}")


def aligned(rows: DataFrame, least: float = 0.4) -> DataFrame:
    """Pairs of blocks of two versions (doc_id, old, new: arrays of texts) that belong together, in order."""

    def pairs(old, new):
        return [(i + 1, j + 1, s) for i, j, s in align([x or "" for x in old or []], [x or "" for x in new or []], least)]

    return _mapped(rows.select("doc_id", "old", "new"), pairs, "old_ordinal int, new_ordinal int, similarity double")


def plain(text: str) -> str:
    """Without placeholders, white space collapsed."""
    return " ".join(re.sub("⟨[^⟩]*⟩", "", text).split())


#: Fixed value: what numbers a paragraph: a figure, a table, a section, an item.
_LABEL = re.compile(r"\s*((fig(ure)?\.?|table)\s*[\dIVXLC]+|[A-Z]\.|\d+\)|[IVXLC]+\.)", re.I)


def label(text: str) -> str | None:
    """The number that a paragraph begins with."""
    m = _LABEL.match(text)
    return re.sub(r"\s+", " ", m[0]).upper() if m else None


def notation(token: str) -> bool:
    """Whether a token is mathematical notation rather than a word."""
    return len(token) <= 2 or any(c.isdigit() for c in token) or re.fullmatch("[a-z]{1,2}(th|st|nd|rd)", token) is not None


def carry(base: list[str] | None, edited: list[str], fresh: list[str]) -> list[tuple[int, str, str]]:
    """What becomes of each change between ``base`` and ``edited`` on the texts of a new conversion: (place in fresh, decision, new text).

    Only texts that belong together count. Decisions: same (no change in words), notation (mathematical signs only), other_label (another figure or section), part (already
    in the new text), weak (a short text too little alike), object (a placeholder in the way), unlike (without a base: too different), apply.
    """
    body = lambda texts: [t for t in texts if len(plain(t)) >= 2]
    edited, target = body(edited), [(k, t) for k, t in enumerate(fresh, 1) if len(plain(t)) >= 2]
    if base is None:
        changes = [(t, t) for t in edited]
    else:
        base = body(base)
        changes = [(base[i], edited[j]) for i, j, _ in align(base, edited, 0.4) if plain(base[i]) != plain(edited[j])]
    out = []
    for i, j, alike in align([b for b, _ in changes], [t for _, t in target], 0.55 if base is None else 0.6):
        want, (place, have) = changes[i][1], target[j]
        a, b = core(have).split(), core(want).split()
        if plain(want) == plain(have) or a == b:
            said = "same"
        elif all(notation(t) for p, q, r, s in _script(a, b) for t in (*a[p:q], *b[r:s])):
            said = "notation"
        elif label(want) and label(have) and label(want) != label(have):
            said = "other_label"
        elif core(want) in core(have):
            said = "part"
        elif len(have) < 150 and alike < 0.85:
            said = "weak"
        elif "⟨" in have or "⟨" in want:
            said = "object"
        elif base is None and alike < 0.7 and abs(len(want) - len(have)) > 0.5 * len(have):
            said = "unlike"
        else:
            said = "apply"
        out.append((place, said, want if said == "apply" else have))
    return out


def carried(rows: DataFrame) -> DataFrame:
    """Decisions of carrying edits over, of each row (doc_id, base or NULL, edited, fresh: arrays of texts): place in fresh, decision, text."""
    clean = lambda x: [t or "" for t in x or []]
    return _mapped(rows.select("doc_id", "base", "edited", "fresh"), lambda b, e, f: carry(None if b is None else clean(b), clean(e), clean(f)), "place int, decision string, text string")


def matched_words(doc: list[str], page: list[str], ahead: int = 80, far: int = 1500) -> list[int]:
    """For each word of the page the place of the document's word that it is, -1 for none: equal words go on together; else the next known run of three words sets both anew."""
    at: dict[tuple, list[int]] = {}
    for i in range(len(doc) - 2):
        at.setdefault(tuple(doc[i : i + 3]), []).append(i)
    out, i, j = [-1] * len(page), 0, 0
    while i < len(page) and j < len(doc):
        if page[i] == doc[j]:
            out[i] = j
            i, j = i + 1, j + 1
            continue
        for k in range(i, min(i + ahead, len(page) - 2)):
            hit = next((x for x in at.get(tuple(page[k : k + 3]), ()) if j <= x < j + far), None)
            if hit is not None:
                i, j = k, hit
                break
        else:
            i += 1
    return out


def word_map(rows: DataFrame) -> DataFrame:
    """Of each row (doc_id, doc, page: arrays of words) the words of the page with their place in the document (from 0; -1: none)."""
    return _mapped(rows.select("doc_id", "doc", "page"), lambda a, b: list(enumerate(matched_words(a or [], b or []))), "pos int, at int")


def source_offsets(decoded: str, raw: str) -> list[int] | None:
    """Where each character of a decoded text (and its end) stands in the mark-up it comes from; None if they don't belong together. A reference ends within 32 characters."""
    out, i, j = [], 0, 0
    while j < len(decoded):
        if i >= len(raw):
            return None
        end = raw.find(";", i) if raw[i] == "&" else -1
        if 0 <= end - i <= 32:
            out.append(i)
            i = end + 1
        elif raw[i] == decoded[j]:
            out.append(i)
            i += 1
        elif raw[i] == "\r" and decoded[j] == "\n":
            i += 1
            continue
        else:
            return None
        j += 1
    return [*out, i]


def inline_diff(old: str, new: str, around: int = 40) -> list[tuple[str, str]]:
    """What a preview shows: (same, added, removed or skipped; text), by characters where over a fifth are CJK, else by words; the middle of long unchanged parts is skipped."""
    wide = sum("\u3000" <= c <= "\u9fff" or "\uff00" <= c <= "\uffef" for c in old + new)
    cut = list if wide > 0.2 * (len(old) + len(new)) else lambda t: re.findall(r"\w+|\s+|[^\w\s]", t)
    a, b = cut(old), cut(new)
    parts, at = [], 0
    for p, q, r, s in [*_script(a, b), (len(a), len(a), len(b), len(b))]:
        parts += [(k, "".join(t)) for k, t in (("same", a[at:p]), ("removed", a[p:q]), ("added", b[r:s])) if t]
        at = q
    out = []
    for i, (kind, text) in enumerate(parts):
        if kind != "same" or len(text) <= 2 * around + 10:
            out.append((kind, text))
            continue
        head, tail = text[:around] if i else "", text[-around:] if i + 1 < len(parts) else ""
        out += [x for x in (("same", head), ("skipped", text[len(head) : len(text) - len(tail)]), ("same", tail)) if x[1]]
    return out


def with_inline_diff(pairs: DataFrame) -> DataFrame:
    """The parts of a preview of each row (doc_id, old, new)."""
    return _mapped(pairs.select("doc_id", "old", "new"), lambda o, n: [(k, *x) for k, x in enumerate(inline_diff(o or "", n or ""), 1)], "part int, kind string, text string")


def _middle(a: list, b: list) -> tuple[int, int, int, int]:
    """The stretch of equal elements in the middle of a shortest edit script of two differing sequences: from (x, y) to (u, v). Two frontiers, one from each end, meet there."""
    n, m = len(a), len(b)
    size = n + m + 3
    ahead, back = [0] * size, [0] * size  # furthest x on each diagonal, negative ones at the end
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            if k > n or -k > m:
                continue
            x = ahead[k + 1] if k == -d or k != d and ahead[k - 1] < ahead[k + 1] else ahead[k - 1] + 1
            x = min(x, n, m + k)
            u = x
            while u < n and u - k < m and a[u] == b[u - k]:
                u += 1
            ahead[k] = u
            other = n - m - k
            if (n - m) % 2 and -d < other < d and u + back[other] >= n:
                return x, x - k, u, u - k
        for k in range(-d, d + 1, 2):
            if k > n or -k > m:
                continue
            x = back[k + 1] if k == -d or k != d and back[k - 1] < back[k + 1] else back[k - 1] + 1
            x = min(x, n, m + k)
            u = x
            while u < n and u - k < m and a[n - 1 - u] == b[m - 1 - u + k]:
                u += 1
            back[k] = u
            other = n - m - k
            if (n - m) % 2 == 0 and -d <= other <= d and u + ahead[other] >= n:
                return n - u, m - u + k, n - x, m - x + k
    raise AssertionError("the frontiers always meet")


def _script(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Changed stretches (a from, a to, b from, b to) of a shortest edit script, in memory linear in the texts: halves about the middle stretch are scripts of their own."""
    edits, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        p, q, r, s = todo.pop()
        while p < q and r < s and a[p] == b[r]:
            p, r = p + 1, r + 1
        while p < q and r < s and a[q - 1] == b[s - 1]:
            q, s = q - 1, s - 1
        if p == q or r == s:
            if p < q or r < s:
                edits.append((p, q, r, s))
            continue
        x, y, u, v = _middle(a[p:q], b[r:s])
        if (x, y, u, v) in ((0, 0, 0, 0), (q - p, s - r, q - p, s - r)):
            edits.append((p, q, r, s))  # nothing in common
            continue
        todo += [(p, p + x, r, r + y), (p + u, q, r + v, s)]
    out: list[list[int]] = []
    for e in sorted(edits):
        if out and out[-1][1] == e[0] and out[-1][3] == e[2]:
            out[-1][1], out[-1][3] = e[1], e[3]
        else:
            out.append(list(e))
    return [tuple(e) for e in out]


def hunks(old: str, new: str, many: int = 8, most: float = 0.6) -> list[tuple[int, int, str]]:
    """Half-open spans of the old text and their new text; applied from the right they give the new one, up to typography that folds alike."""
    a, b = _TOKEN.findall(old), _TOKEN.findall(new)
    plain = lambda t: " " if t.isspace() else t.translate(_FOLD)
    edits = _script([plain(t) for t in a], [plain(t) for t in b])
    if not edits:
        return []
    ends_a, ends_b = [0], [0]
    for tokens, ends in ((a, ends_a), (b, ends_b)):
        for t in tokens:
            ends.append(ends[-1] + len(t))
    out = [(ends_a[p], ends_a[q], new[ends_b[r] : ends_b[s]]) for p, q, r, s in edits]
    start, end = edits[0][0], edits[-1][1]
    changed = sum(q - p + s - r for p, q, r, s in edits)
    if len(out) > many or changed / max(2 * max(end - start, 1), 1) > most and len(out) > 1:
        out = [(ends_a[start], ends_a[end], new[ends_b[edits[0][2]] : ends_b[edits[-1][3]]])]
    done = []
    for s, e, t in out:  # trim what both share at either end
        while s < e and t and old[s] == t[0]:
            s, t = s + 1, t[1:]
        while s < e and t and old[e - 1] == t[-1]:
            e, t = e - 1, t[:-1]
        if s < e or t:
            done.append((s, e, t))
    return done


def with_hunks(pairs: DataFrame) -> DataFrame:
    """One row a hunk of each row (doc_id, old, new)."""
    return _mapped(pairs.select("doc_id", "old", "new"), lambda o, n: [(k, *h) for k, h in enumerate(hunks(o or "", n or ""), 1)], "hunk int, start long, end long, text string")


def changed_blocks(rows: DataFrame) -> DataFrame:
    """modified, added and removed blocks of two versions (doc_id, old, new: arrays of texts), by a shortest edit script over whole blocks."""

    def changes(old, new):
        out = []
        for p, q, r, s in _script([x or "" for x in old or []], [x or "" for x in new or []]):
            k = min(q - p, s - r)
            out += [("modified", p + i + 1, r + i + 1) for i in range(k)] + [("removed", i + 1, None) for i in range(p + k, q)] + [("added", None, i + 1) for i in range(r + k, s)]
        return out

    return _mapped(rows.select("doc_id", "old", "new"), changes, "change string, old_block int, new_block int")


def soft_hyphens(texts: DataFrame, hyphens: DataFrame, keep: tuple[str, ...] | list[str]) -> DataFrame:
    """id, soft: whether the hyphen at the end of ``a`` only breaks the word that ``b`` goes on with (``hyphens``: doc_id, id, a, b).

    A document's own words decide (``texts``: doc_id, text): how often both parts occur, and whether the word occurs with or without a hyphen. They are counted by document and
    looked up by a join, so no row carries a document's words. Hyphens of documents that ``texts`` lacks make no row.
    """
    words = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(tx.WORD), F.lit(0))).alias("key")).groupBy("doc_id", F.lower("key").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("word"))
    joined = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+(?:-[A-Za-z]+)*"), F.lit(0))).alias("w")).select("doc_id", F.explode(F.array(F.lower("w"), F.replace(F.lower("w"), F.lit("-"), F.lit("")))).alias("key"))
    known = words.select("doc_id", "kind", "key", "n").unionByName(joined.distinct().select("doc_id", F.lit("seen").alias("kind"), "key", F.lit(1).cast("long").alias("n")))
    base = F.rtrim(F.regexp_replace("a", "-$", ""))
    p = hyphens.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "id", base.alias("base"), F.regexp_extract(base, "([A-Za-z]+)$", 1).alias("ra"), F.regexp_extract("b", "^([A-Za-z]+)", 1).alias("rb"))
    a, b = F.lower("ra"), F.lower("rb")
    roles = {"a": ("word", a), "b": ("word", b), "hyphened": ("seen", F.concat(a, F.lit("-"), b)), "whole": ("seen", F.concat(a, b))}
    asked = p.select("*", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(k).alias("kind"), key.alias("key")) for r, (k, key) in roles.items()))).alias("q")).select("doc_id", "id", "base", "ra", "rb", "q.*")
    found = asked.join(known, ["doc_id", "kind", "key"], "left").groupBy("doc_id", "id", "base", "ra", "rb").agg(*(F.coalesce(F.max(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).alias(f"n_{r}") for r in roles))
    soft = (
        F.when((a == "") | (b == ""), False).when(F.col("base").rlike("-[A-Za-z]+$"), False).when(F.col("rb").rlike("^[A-Z]") & ~F.col("rb").rlike("^[A-Z]+$"), False)
        .when(F.col("n_hyphened") > 0, False).when(F.col("n_whole") > 0, True).when(a.isin(list(keep)), False)
        .when((F.length("ra") >= 2) & (F.col("ra") == F.upper("ra")), False).when((F.length(a) >= 3) & (F.col("n_a") >= 2) & (F.col("n_b") >= 2), False).otherwise((F.length(a) >= 2) & (F.length(b) >= 2))
    )
    return found.select("id", soft.alias("soft"))
