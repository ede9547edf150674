"""Column functions over text: white space, normalisation, tokens, slugs, classifiers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the document formats mean it; Java's own class misses the Unicode ones.
SPACE = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Typographic characters and what they are matched as.
TYPOGRAPHIC = "‘’‚‛′" + "“”„‟″" + "‐‑‒–—―−" + "   　\t"
PLAIN = "'" * 5 + '"' * 5 + "-" * 7 + " " * 5
#: Fixed value: one token a placeholder, a CJK character, a run of letters and digits, a run of white space, or any other character.
TOKEN = "⟨[^⟩]*⟩|[㐀-鿿豈-﫿぀-ヿ가-힯]|[A-Za-z0-9À-ɏͰ-ϿЀ-ӿ]+|\\s+|[\\s\\S]"
WORD = "[A-Za-z]+"
HYPHENATED = "[A-Za-z]+(?:-[A-Za-z]+)+"
#: Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def non_space_chars(c: Column) -> Column:
    """Number of characters that are no white space."""
    return F.length(F.regexp_replace(c, SPACE + "+", "")).cast("long")


def normalized(c: Column) -> Column:
    """Typography folded to plain characters, then runs of spaces and line breaks to one space."""
    return F.regexp_replace(F.translate(c, TYPOGRAPHIC, PLAIN), "[ \n\r]+", " ")


def clipped(c: Column, n: int = 120) -> Column:
    """Line breaks shown as a mark, cut after n characters."""
    flat = F.regexp_replace(c, "\n", "⏎")
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("…"))).otherwise(flat)


def literal_hits(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences from the left, ASCII case aside."""
    low, n = F.lower(c), needle.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(n), F.lit("")))) / len(n)).cast("long")


def slug(c: Column) -> Column:
    """A heading as a link target: trimmed, lower-cased, letters, digits and hyphens only, white space to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\s-]", ""), r"\s+", "-")


def ligatures_expanded(c: Column) -> Column:
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.replace(c, F.lit("­"), F.lit(""))


def display_width(c: Column) -> Column:
    """Estimated width in em: CJK characters one, others 0.55."""
    wide = F.size(F.regexp_extract_all(c, F.lit("[⺀-鿿가-힯豈-﫿＀-｠]"), F.lit(0)))
    return F.round(wide + (F.length(c) - wide) * 0.55, 2)


#: Private code points of symbol fonts and what they show.
SYMBOLS = {"\uf0b7": "•", "\uf0e0": "→", "\uf0a3": "≤", "\uf0b3": "≥", "\uf0b1": "±", "\uf0b4": "×", "\uf0b9": "≠", "\uf0bb": "≈"}


def symbols_shown(c: Column) -> Column:
    """Private code points of symbol fonts as the characters that they show."""
    return F.translate(c, "".join(SYMBOLS), "".join(SYMBOLS.values()))


def letters_joined(c: Column) -> Column:
    """Letter-spaced text as words: single letters between single spaces are joined, wider gaps part words; other text stays."""
    spaced = c.rlike(r"^(?:\S {1,3}){3,}\S$")
    return F.when(spaced, F.replace(F.regexp_replace(F.regexp_replace(c, r" {2,}", "\x01"), " ", ""), F.lit("\x01"), F.lit(" "))).otherwise(c)


def token_kinds(c: Column) -> dict[str, Column]:
    """Numbers of placeholders, CJK characters, runs of letters and digits, runs of white space, and other characters."""
    n = lambda p, x: F.regexp_count(x, F.lit(p)).cast("long")
    rest = F.regexp_replace(c, "⟨[^⟩]*⟩", "")
    wide, word, space = "[㐀-鿿豈-﫿぀-ヿ가-힯]", "[A-Za-z0-9À-ɏͰ-ϿЀ-ӿ]+", r"[\t\n\x0c\r ]+"
    return {"placeholders": n("⟨[^⟩]*⟩", c), "wide": n(wide, rest), "words": n(word, rest), "spaces": n(space, rest), "others": F.length(F.regexp_replace(rest, f"{wide}|{word}|{space}", "")).cast("long")}


def estimated_tokens(chars: Column) -> Column:
    return F.ceil(chars / 2.5).cast("long")
