"""Reading order and kinds of the lines of a scanned page.

A page's lines carry pixel boxes. Lines are body text, headlines, adverts or the page's head, told apart by how far they
stand in from their column's left edge; reading order is down each column, whatever the order of the lines in the text.
Where the columns of a page were merged into rows (cells between bars, tabs or wide blanks), rows are cut into cells, a
row's first and last cell are placed by the row's box, and the kind of a cell that has no box of its own is decided by a
classifier of words and shape, fitted on lines whose kind their boxes tell.

Lines without boxes are body text in the order of the text. Where the number of columns is NULL or not positive it is told
by the left borders of the lines; where no number explains them, every line below the page's head is body text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BODY, HEADLINE, ADVERT, HEAD = 0, 1, 2, 3
#: The scan's geometry in pixels: left margin, width of the text, space between columns, the zone of the page's head, and
#: how far in headlines and adverts stand at least.
MARGIN, TEXT_WIDTH, HEAD_ZONE, HEADLINE_IN, ADVERT_IN = 120, 2160, 200, 14, 45
#: Columns looked for where their number isn't known, and how far in any line of a column stands at most.
MOST_COLUMNS, MOST_IN = 8, 160
_BARS, _TAB, _BLANKS = "  |  ", "\t", "   "


def column_pitch(n_cols: int) -> float:
    return (TEXT_WIDTH + 40 + 30 * n_cols) / n_cols


def separator(text: str, lines: list[str], ys: list[int] | None) -> str | None:
    """What parts the cells of merged rows, or None where lines are whole."""
    for mark in (_BARS, _TAB, _BLANKS):
        if mark in text:
            rows = sum(mark in line for line, y in zip(lines, ys or [HEAD_ZONE] * len(lines)) if y >= HEAD_ZONE)
            if rows >= 2:
                return mark
    return None


def columns_of(x0: list[int]) -> int | None:
    """The least number of columns whose left edges the left borders of all lines stand at, None if there is none."""
    for n in range(1, MOST_COLUMNS + 1):
        pitch = column_pitch(n)
        places = [(int((x - MARGIN / 2) // pitch), x - MARGIN) for x in x0]
        if all(0 <= col < n and -HEADLINE_IN < x - col * pitch < MOST_IN for col, x in places):
            return n
    return None


def _unplaced(lines: list[str], starts: list[int], x0: list[int], y0: list[int]) -> list[tuple[int, int, int]]:
    """Lines of columns that no number of columns explains: body text but for the page's head, parted where left borders leave a gap."""
    borders = sorted(x for line, x, y in zip(lines, x0, y0) if y >= HEAD_ZONE and line.strip())
    edges = [b for a, b in zip(borders, borders[1:]) if b - a >= MOST_IN]
    out = []
    for line, s, x, y in zip(lines, starts, x0, y0):
        if line.strip():
            head = y < HEAD_ZONE
            out.append((-1 if head else bisect_right(edges, x), y, HEAD if head else BODY, s, s + len(line)))
    out.sort()
    return [(kind, s, e) for _, _, kind, s, e in out]


class LineKinds:
    """Naive Bayes over the words and the shape of a line: body text, headline or advert.

    ``MARGIN`` nats must speak for a headline or an advert: the short last line of a paragraph has few known words.
    """

    MARGIN = 2.0

    def __init__(self) -> None:
        self.counts = [Counter(), Counter(), Counter()]
        self.lines = [0, 0, 0]
        self.table: dict[str, tuple[float, float, float]] = {}
        self.prior = (0.0, -3.0, -3.0)
        self.unseen = (0.0, 0.0, 0.0)

    @staticmethod
    def features(line: str, fill: float) -> list[str]:
        words = _TOKENS.findall(line.casefold())
        out = [_DIGITS.sub("0", w) for w in words] if _DIGITS.search(line) else words.copy()
        if words:
            out += ["^" + out[0], out[-1] + "$"]
        last = line.rstrip()[-1:]
        return out + [f"fill{min(10, int(fill * 10))}", "end" + (last if last in _MARKS else "a" if last.isalpha() else "-"), "caps" if line.isupper() else "mixed"]

    def learn(self, line: str, kind: int, fill: float) -> None:
        self.lines[kind] += 1
        self.counts[kind].update(self.features(line, fill))

    def fit(self, least: int = 2) -> LineKinds:
        total = [sum(c.values()) for c in self.counts]
        keys = {k for c in self.counts for k, n in c.items() if n >= least}
        size = len(keys) + 1
        logs = [[math.log((c.get(k, 0) + 0.5) / (t + 0.5 * size)) for c, t in zip(self.counts, total)] for k in keys]
        self.table = {k: tuple(v) for k, v in zip(keys, logs)}
        self.unseen = tuple(math.log(0.5 / (t + 0.5 * size)) for t in total)
        n = sum(self.lines) + 3
        self.prior = tuple(math.log((x + 1) / n) for x in self.lines)
        self.counts = [Counter(), Counter(), Counter()]
        return self

    def kind(self, line: str, fill: float) -> int:
        a, b, c = self.prior
        for x, y, z in filter(None, map(self.table.get, self.features(line, fill))):
            a, b, c = a + x, b + y, c + z
        a += self.MARGIN
        return BODY if a >= b and a >= c else HEADLINE if b >= c else ADVERT


_TOKENS = re.compile(r"[฀-๿]{1,4}|[぀-ヿ㐀-鿿]|[^\W_]+|[+*—#&]")
_DIGITS = re.compile(r"\d+")
_MARKS = set(".!?…。！？؟।:;,\"”’»«“」』)")


def page_lines(text: str, n_cols: int | None, x0: list[int] | None, y0: list[int] | None, x1: list[int] | None, kinds: LineKinds | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every line or cell in reading order; start and end are places in ``text``."""
    lines = text.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    n = len(lines)
    if not x0 or len(x0) != n or None in x0 or None in y0:
        mark = separator(text, lines, None)
        if mark is None:
            return [(BODY, s, s + len(line)) for s, line in zip(starts, lines) if line.strip()]
        x0, y0, x1 = [MARGIN] * n, list(range(HEAD_ZONE, HEAD_ZONE + n)), [MARGIN + TEXT_WIDTH] * n
        n_cols = max(line.count(mark) + 1 for line in lines)
    known = n_cols is not None and n_cols > 0
    mark = separator(text, lines, y0) if not known or n_cols > 1 else None
    if known:
        cols = n_cols
    elif mark is not None:
        cols = max(line.count(mark) + 1 for line in lines)
    else:
        cols = columns_of([x for line, x, y in zip(lines, x0, y0) if y >= HEAD_ZONE and line.strip()])
        if cols is None:
            return _unplaced(lines, starts, x0, y0)
    pitch = column_pitch(cols)
    if mark is not None:
        if not x1 or len(x1) != n or None in x1:
            x1 = [MARGIN + TEXT_WIDTH if x is None else x for x in (x1 if x1 and len(x1) == n else [None] * n)]
        return _merged(lines, starts, cols, pitch, x0, y0, x1, mark, kinds)
    out = []
    for line, s, x, y in zip(lines, starts, x0, y0):
        if not line or line.isspace():
            continue
        if y < HEAD_ZONE:
            out.append((-1, y, HEAD, s, s + len(line)))
            continue
        col = int((x - MARGIN / 2) // pitch)
        inset = x - MARGIN - col * pitch
        out.append((col, y, ADVERT if inset >= ADVERT_IN else HEADLINE if inset >= HEADLINE_IN else BODY, s, s + len(line)))
    out.sort()
    return [(kind, s, e) for _, _, kind, s, e in out]


def _merged(lines: list[str], starts: list[int], cols: int, pitch: float, x0: list[int], y0: list[int], x1: list[int], mark: str, kinds: LineKinds | None) -> list[tuple[int, int, int]]:
    head, by_col = [], [[] for _ in range(cols)]
    live = list(range(cols))
    for i in sorted(range(len(lines)), key=lambda k: y0[k]):
        line, s = lines[i], starts[i]
        if not line.strip():
            continue
        if y0[i] < HEAD_ZONE:
            head.append((HEAD, s, s + len(line)))
            continue
        cells, at = [], 0
        for part in line.split(mark):
            cells.append((s + at, s + at + len(part), part))
            at += len(part) + len(mark)
        first = min(cols - 1, max(0, int((x0[i] - MARGIN / 2) // pitch)))
        # a column that has ended doesn't begin again, so the columns of a row are among those of the row before
        if len(cells) < len(live):
            final = min(cols - 1, max(first, int((x1[i] - MARGIN - 10) // pitch)))
            inner = [c for c in live if first <= c <= final]
            live = inner if len(inner) == len(cells) else (inner or live)[: len(cells)]
        for k, (a, b, part) in enumerate(cells):
            col = live[k] if k < len(live) else cols - 1
            inset = x0[i] - MARGIN - first * pitch if k == 0 else None
            by_col[col].append((a, b, part, inset))
    out = head
    for column in by_col:
        width = max((len(part) for *_, part, _ in column), default=1) or 1
        for a, b, part, inset in column:
            if not part.strip():
                continue
            if inset is not None:
                kind = ADVERT if inset >= ADVERT_IN else HEADLINE if inset >= HEADLINE_IN else BODY
            else:
                kind = kinds.kind(part, len(part) / width) if kinds else BODY
            out.append((kind, a, b))
    return out


def learn_kinds(pages: Iterable[tuple]) -> LineKinds:
    """The classifier from pages (text, n_cols, x0, y0, x1) whose rows aren't merged."""
    kinds = LineKinds()
    for text, n_cols, x0, y0, x1 in pages:
        if not text or not x0 or separator(text, text.split("\n"), y0):
            continue
        found = page_lines(text, n_cols, x0, y0, x1)
        width = max((e - s for kind, s, e in found if kind == BODY), default=1)
        for kind, s, e in found:
            if kind != HEAD:
                kinds.learn(text[s:e], kind, (e - s) / width)
    return kinds.fit()


#: Columns that pages_of() reads, for a select on the documents table; the boxes' other fields are not read.
PAGE_COLUMNS = ["text", "n_cols", "boxes.x0", "boxes.y0", "boxes.x1"]


def pages_of(batch: pa.RecordBatch) -> Iterable[tuple]:
    """(text, n_cols, x0, y0, x1) of each row of a batch with PAGE_COLUMNS."""
    return zip(batch.column("text").to_pylist(), batch.column("n_cols").to_pylist(), *(_lists(batch.column(k)) for k in ("x0", "y0", "x1")))


def _lists(column: pa.Array) -> list[list[int] | None]:
    """Like to_pylist() of a list column, by slices of one flat list."""
    flat = column.flatten()
    if column.null_count or flat.null_count:
        return column.to_pylist()
    values, ends = flat.to_numpy().tolist(), np.cumsum(pc.list_value_length(column).to_numpy()).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends)]


def fit_on_sample(documents, pages: int = 2000) -> LineKinds:
    """The classifier from a bounded sample of labelled pages: those ``pages`` documents whose ids hash lowest.

    Ids and texts of that many documents, and nothing else, come to the driver.
    """
    from pyspark.sql import functions as F

    ids = documents.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(pages)
    rows = documents.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", *PAGE_COLUMNS).toArrow()
    order = sorted(range(rows.num_rows), key=rows.column("doc_id").to_pylist().__getitem__)
    found = list(zip(*(rows.column(k).to_pylist() for k in ("text", "n_cols", "x0", "y0", "x1"))))
    return learn_kinds(found[i] for i in order)
