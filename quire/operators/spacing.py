"""Letter-spaced words: single letters set apart, put together again by the regularity of their gaps."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from quire.operators.pages import PAGE, _by_page

#: Letters of a run at least; how much a gap may differ from the run's median; the share of gaps that must be regular; from which multiple of the median words part.
LEAST, NEAR, REGULAR, PART = 4, 0.35, 0.6, 1.7
NAMES = ["elem", "text", "x0", "x1", "top", "bottom", "size", "font", "bold"]


def _words(page: list[dict]) -> list[tuple]:
    """The spans of one page, with words in place of their letters."""
    placed = [s for s in page if s["text"] is not None and s["text"].strip(" ") and None not in (s["x0"], s["x1"], s["top"], s["bottom"], s["size"])]
    rows: dict[float, list[tuple]] = {}
    for s in placed:
        rows.setdefault(s["bottom"], []).append((s["x0"], s["x1"], s["elem"]))
    for row in rows.values():
        row.sort()
    heights = sorted(rows)

    def parted(a: dict, b: dict) -> bool:
        """Whether anything else stands between two letters."""
        reach = 0.8 * b["size"]
        for y in heights[bisect_left(heights, b["bottom"] - reach - 0.001) : bisect_right(heights, b["bottom"] + reach + 0.001)]:
            if abs(y - b["bottom"]) <= reach:
                row = rows[y]
                for x0, x1, elem in row[bisect_left(row, (a["x1"] - 0.3,)) : bisect_right(row, (b["x0"] + 0.3, float("inf")))]:
                    if x1 <= b["x0"] + 0.3 and elem != a["elem"] and elem != b["elem"]:
                        return True
        return False

    runs: list[list[dict]] = []
    last = None
    for s in sorted((s for s in placed if len(s["text"].strip(" ")) == 1), key=lambda s: (s["bottom"], s["x0"], s["elem"])):
        alike = last is not None and abs(s["bottom"] - last["bottom"]) <= 0.3 and s["font"] is not None and s["font"] == last["font"] and s["size"] == last["size"] and s["bold"] == last["bold"]
        if alike and 0.08 * s["size"] <= s["x0"] - last["x1"] <= 1.2 * s["size"] and not parted(last, s):
            runs[-1].append(s)
        else:
            runs.append([s])
        last = s
    out, held = [], set()
    for run in runs:
        if len(run) < LEAST:
            continue
        gaps = [b["x0"] - a["x1"] for a, b in zip(run, run[1:], strict=False)]
        mid = sorted(gaps)[len(gaps) // 2]
        wide = PART * mid + 0.3
        if sum(x <= wide and abs(x - mid) <= NEAR * max(mid, 0.5) for x in gaps) < REGULAR * len(gaps):
            continue
        words = [run[:1]]
        for gap, s in zip(gaps, run[1:], strict=True):
            if gap > wide:
                words.append([s])
            else:
                words[-1].append(s)
        held.update(map(id, run))
        for w in words:
            f = w[0]
            out.append((f["elem"], "".join(s["text"] for s in w), f["x0"], w[-1]["x1"], min(s["top"] for s in w), max(s["bottom"] for s in w), f["size"], f["font"], f["bold"]))
    return [tuple(s[c] for c in NAMES) for s in page if id(s) not in held] + out


def merged_letters(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, page, elem, text, x0, x1, top, bottom, size, font, bold) with each run of single letters as its words; a word has its first letter's elem.

    Letters of one baseline, font, size and weight follow one another with gaps of 0.08 to 1.2 sizes, and nothing else stands between two of them. Of a run's gaps most are
    near their upper median; where one is much wider, a new word begins. The spans are shuffled once, by page, and each page's letters are followed in reading order; what
    stands between two is looked up by height and place. Spans with null or empty texts, or without a place, pass through.
    """
    s = spans.select(*PAGE, *NAMES)
    return _by_page(s, _words, ", ".join(f"{c} {s.schema[c].dataType.simpleString()}" for c in NAMES))
