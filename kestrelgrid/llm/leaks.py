"""Passages of held-out items found in a corpus, through misread letters, broken words and mixed columns.

Pages are brought into reading order without headlines and adverts, their words are folded, and every window of
``words`` words is fingerprinted. Items are cut into the same windows; a Hamming index over these finds, for every
window of the corpus, all item windows within its radius. Candidates are verified by the exact weighted share of the item
window's words that the document's window holds, a word's weight being its length, then by walking from words that agree in
place in both directions, word by word, as far as the words stay the same or misreadings of each other. Windows are as long as
the shortest passage that counts, not as an item, as any part of an item is a leak. Passages whose fingerprints are too far apart are walked from two equal neighbouring words (three
equal characters) wherever these stand in document and item; a passage in which no two neighbouring words are whole is
found by its fingerprint only. A document holds an item if a walk covers ``words`` consecutive words of it (``letters``
characters for items in Chinese or Japanese).

The items are the stated query set: they are taken in blocks of ``block_windows`` windows, so what goes to the workers is
bounded (an item of more windows is a block of its own). Pages are laid out once: for several blocks, their texts in reading
order are written to the shared checkpoint folder first. Nothing of the corpus is collected or shuffled.

Defined results
---------------
* NULL, blank or short texts, items shorter than a passage: no rows. Repeated items: a row for each id.
* Very long texts are taken in stretches that overlap by a window. Equal rows of documents: one row each.
* Empty tables: no rows. Extra columns are ignored. NULL ids: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelgrid.llm.checkpoints import shared_checkpoint
from kestrelgrid.llm.folding import CJK, near, near_pairs, words
from kestrelgrid.llm.page_layout import BODY, PAGE_COLUMNS, LineKinds, page_lines, pages_of
from kestrelgrid.llm.simhash_windows import HammingIndex, window_fingerprints, word_vectors

_HYPHENS = "-=¬‐‑\xad"
#: Weighted share of an item window's words that a candidate needs to hold, wherever in the window.
LEAST_SHARE = 0.5
#: Candidates whose words are compared at once.
_COMPARED = 2_000
#: Words fingerprinted at once.
_STRETCH = 150_000
#: Seeds that are walked from at once, so many that they stay in the processor's cache, unless a single place of a document has more.
_SEEDED = 30_000
#: Units without letters before, between and behind the texts of a sequence. Walks end at the first of them, and look at most
#: ``_GAP`` units on from there.
_GAP = 4


def prose(text: str, n_cols, x0, y0, x1, kinds: LineKinds | None) -> str:
    """Body text in reading order, words broken at line ends joined."""
    parts = []
    for kind, s, e in page_lines(text, n_cols, x0, y0, x1, kinds):
        if kind != BODY:
            continue
        line = text[s:e].strip()
        if len(line) > 1 and line[-1] in _HYPHENS and line[-2].isalpha() and not CJK.match(line[-2]):
            parts.append(line[:-1])
        else:
            parts.append(line)
            parts.append("\n")
    return "".join(parts)


def letters_of(folded: list[str]) -> list[str]:
    """Characters of folded words."""
    return [c for word in folded for c in word if c.isalnum()]


#: Letters are counted by 12 kinds, five bits each; these are the lowest, the highest and all bits of every other kind.
_LOW, _HIGH, _OTHER = (np.uint64(sum(x << k for k in range(0, 60, by))) for x, by in ((1, 10), (16, 5), (31, 10)))


def _shapes(vocabulary: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length of each word, its letters of each of 12 kinds in one number (bit 62 where a kind has too many) and of each of 32 kinds, its first and its last letter."""
    words = list(vocabulary)
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), lengths)
    bags = np.bincount(row * 32 + (codes & 31), minlength=32 * len(words)).reshape(-1, 32).astype(np.int16)
    # a multiplier that keeps the letters apart that folding leaves of the Latin ones
    counts = np.bincount(row * 12 + (codes * 123 >> 5) % 12, minlength=12 * len(words)).reshape(-1, 12)
    packed = (np.minimum(counts, 7) << np.arange(0, 60, 5)).sum(axis=1) | ((counts > 7).any(axis=1).astype(np.int64) << 62)
    ends, codes = np.cumsum(lengths), np.append(codes, 0)
    return lengths, packed.astype(np.uint64), bags, codes[ends - lengths], codes[ends - 1]


def _lost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Letters of x that y has not, by packed numbers of each kind; 0 where a kind has too many."""
    left = (x | _HIGH) - y
    more = left & _HIGH
    left &= more - (more >> np.uint64(4))
    total = (left & _OTHER) + ((left >> np.uint64(5)) & _OTHER)
    return np.where((x | y) >> np.uint64(62), 0, (total * _LOW >> np.uint64(50) & np.uint64(1023)).astype(np.int64))


def _parted(ids: np.ndarray, starts: np.ndarray, empty: int) -> np.ndarray:
    """Units of texts, text k beginning at ``starts[k] + (k + 1) * _GAP``, with ``empty`` around each."""
    out = np.full(len(ids) + _GAP * len(starts), empty, np.int64)
    out[np.arange(len(ids)) + _GAP * np.repeat(np.arange(1, len(starts)), np.diff(starts))] = ids
    return out


#: Lengths that _fits() tells apart, of units and of two joined; longer ones count as that.
_ONE, _TWO = 15, 31
#: What lengths allow: units are near, two joined of the document are near one of the item, one of the document two joined of the item.
_SINGLE, _JOINED, _SPLIT = 1, 2, 4


def _fits() -> np.ndarray:
    """What lengths allow, by lengths of a unit and of that joined with the next, of the document and of the item."""
    one, two = (x.ravel() for x in np.meshgrid(np.arange(_ONE + 1), np.arange(_TWO + 1), indexing="ij"))
    allow = lambda n, m, cut: (np.abs(n - m) * 4 <= np.maximum(n, m)) & (np.maximum(n, m) > 2) | (n >= cut[0]) | (m >= cut[1])
    n1, n2, m1, m2 = one[:, None], two[:, None], one[None, :], two[None, :]
    # units without letters are near to none
    return (((n1 > 0) & (m1 > 0)) * (_SINGLE * allow(n1, m1, (_ONE, _ONE)) + _JOINED * allow(n2, m1, (_TWO, _ONE)) + _SPLIT * allow(n1, m2, (_ONE, _TWO)))).astype(np.uint8).ravel()


_FITS = _fits()


class _Pairs:
    """Units of documents beside units of items, by their places in sequences of _parted(); units without letters are near to none.

    Unless ``exact`` is set, units count as near wherever their lengths and letters allow it.
    """

    def __init__(self, known, whole, doc_words, doc_shape, flat, item_words, item_shape) -> None:
        self.known, self.whole, self.flat = known, whole, flat
        self.words, self.shapes = (doc_words, item_words), (doc_shape, item_shape)
        lengths = [np.where(ids >= 0, shape[0][ids], 0) for ids, shape in ((whole, doc_shape), (flat, item_shape))]
        # lengths of units and of each joined with the one in the direction of a walk
        self.codes = {step: [(np.minimum(n, _ONE) * (_TWO + 1) + np.minimum(n + np.roll(n, -step), _TWO)) * scale for n, scale in zip(lengths, ((_ONE + 1) * (_TWO + 1), 1))] for step in (1, -1)}
        self.alone = lengths[0] == 1
        self.exact = False

    def equal(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.known[p] == self.flat[q]

    def allowed(self, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
        """What the lengths allow of _SINGLE, _JOINED and _SPLIT, joined with the unit in the direction of ``step``."""
        of_doc, of_item = self.codes[step]
        return _FITS.take(of_doc[p] + of_item[q])

    def near(self, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
        """Whether near() holds."""
        ok = self.equal(p, q)
        k = np.flatnonzero((self.allowed(p, q, step) & _SINGLE) > ok)
        ok[k] = self.misread(p[k], q[k])
        return ok

    def misread(self, p: np.ndarray, q: np.ndarray, more_p: int = 0, more_q: int = 0) -> np.ndarray:
        """Whether near() holds, of units joined with the next in the direction of more_p or more_q: asked once for each pair whose lengths and letters allow it."""
        ok = np.zeros(len(p), bool)
        if not len(p):
            return ok
        a, b = self.whole[p], self.flat[q]
        c = self.whole[p + more_p] if more_p else self.flat[q + more_q]
        # the cheapest tests first, each on what the one before left
        (lengths, packed, bags, heads, tails), (item_lengths, item_packed, item_bags, item_heads, item_tails) = self.shapes
        n, m, x, y = lengths[a], item_lengths[b], packed[a], item_packed[b]
        if more_p:
            n, x = n + lengths[c], x + packed[c]
        if more_q:
            m, y = m + item_lengths[c], y + item_packed[c]
        most = np.maximum(n, m)
        limit = np.maximum(most >> 2, 1)
        # an edit takes away one letter at most and adds one at most, and a single one leaves the first letter or the last
        lost = _lost(x, y)
        k = np.flatnonzero((lost <= limit) & (lost - n + m <= limit) & (np.abs(n - m) << 2 <= most) & (most > 2) & (c >= 0))
        a, b, c = a[k], b[k], c[k]
        first, last, item_first, item_last = a, a, b, b
        if more_p:
            first, last = (a, c) if more_p > 0 else (c, a)
        if more_q:
            item_first, item_last = (b, c) if more_q > 0 else (c, b)
        may = np.flatnonzero((limit[k] > 1) | (heads[first] == item_heads[item_first]) | (tails[last] == item_tails[item_last]))
        k, a, b, c = k[may], a[may], b[may], c[may]
        if not self.exact:
            ok[k] = True
            return ok
        D, I = self.words
        size = max(len(D), len(I)) + 1
        keys, back = np.unique((a * size + c) * (len(I) + 1) + b, return_inverse=True)
        pairs, b = np.divmod(keys, len(I) + 1)
        a, c = np.divmod(pairs, size)
        bag = bags[a] - item_bags[b]
        bag += bags[c] if more_p else -item_bags[c] if more_q else np.int16(0)
        lacks, adds = np.maximum(-bag, 0).sum(axis=1), np.maximum(bag, 0).sum(axis=1)
        lengths = lengths[a] + (lengths[c] if more_p else 0)
        may = np.flatnonzero(np.maximum(lacks, adds) <= np.maximum(1, (lengths + np.maximum(lacks, adds)) // 4))
        held, (a, b, c) = np.zeros(len(keys), bool), (a[may], b[may], c[may])
        x, y = [D[i] for i in a.tolist()], [I[j] for j in b.tolist()]
        if more_p:
            x = [v + D[j] if more_p > 0 else D[j] + v for v, j in zip(x, c.tolist())]
        if more_q:
            y = [v + I[j] if more_q > 0 else I[j] + v for v, j in zip(y, c.tolist())]
        held[may] = near_pairs(x, y)
        ok[k] = held[back]
        return ok


class _Side:
    """Items of one kind of unit, words or letters, cut into windows of ``size``."""

    def __init__(self, items: list[tuple[int, list[str]]], size: int) -> None:
        self.size, self.items = size, [(i, t) for i, t in items if len(t) >= size]
        flat = [w for _, t in self.items for w in t]
        vocabulary = sorted(set(flat))
        number = {w: k for k, w in enumerate(vocabulary)}
        vectors, hashes = word_vectors(vocabulary)
        ids = [np.array([number[w] for w in t], np.int64) for _, t in self.items]
        self.hashes = [hashes[x] for x in ids]
        prints = [window_fingerprints(vectors, x, size) for x in ids]
        self.owner = np.repeat(np.arange(len(ids)), [len(p) for p in prints]) if ids else np.zeros(0, np.int64)
        self.place = np.concatenate([np.arange(len(p)) for p in prints]) if ids else np.zeros(0, np.int64)
        self.windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(h, size) for h in self.hashes]) if ids else np.zeros((0, size), np.uint64)
        weight = np.array([min(len(w), 8) for w in vocabulary], np.float32)
        self.weights = np.concatenate([np.lib.stride_tricks.sliding_window_view(weight[x], size) for x in ids]) if ids else np.zeros((0, size), np.float32)
        self.index = HammingIndex(np.concatenate(prints)) if ids else None
        self.starts = np.cumsum([0, *map(len, ids)])
        self.flat = _parted(np.concatenate(ids) if ids else np.zeros(0, np.int64), self.starts, -1)
        self.number, self.shapes = number, _shapes(vocabulary)
        keys, places = self._grams(self.flat)
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]

    def _grams(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, place) of every ``SEED`` neighbouring units of one text; ``known`` are numbers of the items' vocabulary, below 0 outside."""
        n = max(0, len(known) - self.SEED + 1)
        inside, keys = np.ones(n, bool), np.zeros(n, np.int64)
        for k in range(self.SEED):
            part = known[k : k + n]
            inside &= part >= 0
            keys = keys * (len(self.number) + 1) + part
        places = np.flatnonzero(inside)
        return keys[places], places

    def seeds(self, vocabulary: list[str], whole: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, place, place in the item) of equal neighbouring units that a passage may be walked from.

        Of a stretch of equal units only the first ``SEED`` are a seed. A seed is left out only where the walks from it surely
        end before they cover a passage.
        """
        numbers = np.array([*(self.number.get(w, -2) for w in vocabulary), -2], np.int64)
        whole = _parted(whole, starts, -1)
        known = numbers[whole]
        pairs = _Pairs(known, whole, vocabulary, _shapes(vocabulary), self.flat, list(self.number), self.shapes)
        keys, places = self._grams(known)
        first = np.searchsorted(self.keys, keys, side="left")
        count = np.searchsorted(self.keys, keys, side="right") - first
        some = np.flatnonzero(count)
        places, first, count = places[some], first[some], count[some]
        cuts = np.searchsorted(np.cumsum(count), np.arange(_SEEDED, int(count.sum()), _SEEDED))
        begins, own = (x[:-1] + _GAP * np.arange(1, len(x)) for x in (starts, self.starts))
        parts, held = np.split(np.arange(len(places)), np.unique(cuts[cuts > 0])), []
        for part in parts:
            n = count[part]
            p = np.repeat(places[part], n)
            q = self.places[np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(len(p))]
            new = np.flatnonzero(~pairs.equal(p - 1, q - 1))
            held.append(self._passages(pairs, p[new], q[new]))
            if part is not parts[-1] and sum(len(p) for p, _ in held) < _SEEDED:
                continue
            # edit distances are counted for many of the seeds that are left
            pairs.exact = True
            p, q = self._passages(pairs, *map(np.concatenate, zip(*held)))
            pairs.exact, held = False, []
            doc, owner = np.searchsorted(begins, p, side="right") - 1, np.searchsorted(own, q, side="right") - 1
            yield from zip(doc.tolist(), owner.tolist(), (p - begins[doc]).tolist(), (q - own[owner]).tolist())

    def _passages(self, pairs: _Pairs, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the seeds whose walks may cover a passage."""
        ahead, behind = self._reach(pairs, p + self.SEED - 1, q + self.SEED - 1, 1), self._reach(pairs, p, q, -1)
        k = np.flatnonzero(ahead + behind + self.SEED >= self.size)
        return p[k], q[k]

    def _reach(self, pairs: _Pairs, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
        """Units that a walk covers at most; ``size`` where a repair may take it on."""
        out, live, ended = np.zeros(len(p), np.int64), np.arange(len(p)), []
        for k in range(1, self.size):
            on = pairs.near(p[live] + k * step, q[live] + k * step, step)
            ended.append(live[np.flatnonzero(~on)])
            live = live[np.flatnonzero(on)]
            out[live] += 1
        # where walks end is asked at once for all of them
        off = np.concatenate(ended)
        at = (out[off] + 1) * step
        out[off[self._mendable(pairs, p[off] + at, q[off] + at, step)]] = self.size
        return out

    def _mendable(self, pairs: _Pairs, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
        """Whether _repair() may take the walks past the disagreements; true wherever it does."""
        raise NotImplementedError

    def find(self, docs: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, int, float]]:
        """(document, item id, length of the run, share) for documents as (number, units)."""
        docs = [(d, t) for d, t in docs if len(t) >= self.size]
        if self.index is None or not docs:
            return
        done: set[tuple[int, int]] = set()
        walked: dict[tuple[int, int], set[tuple[int, int]]] = {}
        encoded = pa.array([w for _, t in docs for w in t], pa.string()).dictionary_encode()
        vocabulary, whole = encoded.dictionary.to_pylist(), encoded.indices.to_numpy().astype(np.int64)
        vectors, hashes = word_vectors(vocabulary)
        start = np.cumsum([0, *(len(t) for _, t in docs)])
        for at in range(0, len(whole), _STRETCH):
            part = whole[at : at + _STRETCH + self.size - 1]
            rows, hits = self.index.search(window_fingerprints(vectors, part, self.size))
            if not len(rows):
                continue
            pairs = np.unique(rows.astype(np.int64) * len(self.owner) + hits)
            rows, hits = pairs // len(self.owner) + at, pairs % len(self.owner)
            doc = np.searchsorted(start, rows, side="right") - 1
            within = rows + self.size <= start[doc + 1]
            rows, hits, doc = rows[within], hits[within], doc[within]
            share, same = np.zeros(len(rows)), np.zeros((len(rows), self.size), bool)
            for k in range(0, len(rows), _COMPARED):
                cut = slice(k, k + _COMPARED)
                held, asked, weight = hashes[whole[rows[cut, None] + np.arange(self.size)]], self.windows[hits[cut]], self.weights[hits[cut]]
                same[cut] = held == asked
                anywhere = np.zeros(held.shape, bool)
                for unit in held.T:
                    anywhere |= unit[:, None] == asked
                share[cut] = (anywhere * weight).sum(axis=1) / weight.sum(axis=1)
            good = share >= LEAST_SHARE
            yield from self._verify(docs, start, rows[good], hits[good], doc[good], same[good], share[good], done, walked)
        for d, owner, p, q in self.seeds(vocabulary, whole, start):
            passed = walked.setdefault((d, owner), set())
            if (d, owner) not in done and (p, q) not in passed:
                run = self.run(docs[d][1], self.items[owner][1], p, q, passed)
                if run >= self.size:
                    done.add((d, owner))
                    yield docs[d][0], self.items[owner][0], run, self._share(docs[d][1], self.items[owner][1], p, q)

    def _share(self, doc: list[str], item: list[str], p: int, q: int) -> float:
        """Weighted share of equal units in the item's window that begins at the seed, or at its last window."""
        at = min(q, len(item) - self.size)
        asked = [(w, p - q + k) for k, w in enumerate(item[at : at + self.size], at)]
        return sum(min(len(w), 8) for w, k in asked if 0 <= k < len(doc) and doc[k] == w) / sum(min(len(w), 8) for w, _ in asked)

    def _verify(self, docs, start, rows, hits, doc, same, share, done, walked) -> Iterator[tuple[int, int, int, float]]:
        for k in np.argsort(-share, kind="stable").tolist():
            d, owner = int(doc[k]), int(self.owner[hits[k]])
            if (d, owner) in done:
                continue
            p, q = int(rows[k] - start[d]), int(self.place[hits[k]])
            passed = walked.setdefault((d, owner), set())
            # equal units no walk has passed stand beyond a break, and are walked from as well
            for seed in np.flatnonzero(same[k]).tolist():
                if (p + seed, q + seed) in passed:
                    continue
                run = self.run(docs[d][1], self.items[owner][1], p + seed, q + seed, passed)
                if run >= self.size:
                    done.add((d, owner))
                    yield docs[d][0], self.items[owner][0], run, float(share[k])
                    break

    def run(self, doc: list[str], item: list[str], p: int, q: int, passed: set[tuple[int, int]]) -> int:
        """Consecutive units of the item in the document around the equal units doc[p] and item[q]; their places are added to ``passed``."""
        passed.add((p, q))
        return 1 + self._walk(doc, item, p, q, 1, passed) + self._walk(doc, item, p, q, -1, passed)

    def _walk(self, doc: list[str], item: list[str], p: int, q: int, step: int, passed: set[tuple[int, int]]) -> int:
        covered, p, q = 0, p + step, q + step
        while 0 <= q < len(item) and 0 <= p < len(doc):
            if near(doc[p], item[q]):
                used, taken = 1, 1
                passed.add((p, q))
            else:
                mended = self._repair(doc, item, p, q, step)
                if mended is None:
                    break
                used, taken = mended
            covered += taken
            p, q = p + step * used, q + step * taken
        return covered

    def _repair(self, doc: list[str], item: list[str], p: int, q: int, step: int) -> tuple[int, int] | None:
        """(units of the document, units of the item) that take the walk past a disagreement, if any do."""
        raise NotImplementedError


class WordSide(_Side):
    SEED = 2

    def _mendable(self, pairs: _Pairs, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
        out, allowed = np.zeros(len(p), bool), pairs.allowed(p, q, step)
        k = np.flatnonzero(pairs.alone[p])
        out[k] = pairs.near(p[k] + step, q[k], step)
        k = np.flatnonzero(allowed & _JOINED)
        out[k] |= pairs.misread(p[k], q[k], step, 0)
        k = np.flatnonzero(allowed & _SPLIT)
        out[k] |= pairs.misread(p[k], q[k], 0, step)
        return out

    def _repair(self, doc: list[str], item: list[str], p: int, q: int, step: int) -> tuple[int, int] | None:
        p2, q2 = p + step, q + step
        in_doc, in_item = 0 <= p2 < len(doc), 0 <= q2 < len(item)
        join = (lambda a, b: a + b) if step > 0 else (lambda a, b: b + a)
        if in_doc and near(join(doc[p], doc[p2]), item[q]):
            return 2, 1
        if in_item and near(doc[p], join(item[q], item[q2])):
            return 1, 2
        if in_doc and len(doc[p]) == 1 and near(doc[p2], item[q]) and doc[p] != item[q]:
            return 2, 1
        return None


class LetterSide(_Side):
    #: A walk passes an error only before three equal letters.
    SEED = 3

    def _mendable(self, pairs: _Pairs, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
        agree = lambda a, b: np.logical_and.reduce([pairs.equal(a + k * step, b + k * step) for k in range(3)])
        return agree(p + step, q + step) | agree(p, q + step) | agree(p + step, q)

    def _repair(self, doc: list[str], item: list[str], p: int, q: int, step: int) -> tuple[int, int] | None:
        """A single misread, lost or added character between characters that agree."""
        agree = lambda a, b: all(0 <= a + k * step < len(doc) and 0 <= b + k * step < len(item) and doc[a + k * step] == item[b + k * step] for k in range(3))
        if doc[p].isdigit() and item[q].isdigit():
            return None
        if agree(p + step, q + step):
            return 1, 1
        if agree(p, q + step):
            return 0, 1
        if agree(p + step, q):
            return 1, 0
        return None


_BUILT: dict[str, tuple[WordSide, LetterSide]] = {}


def _sides(items: list[tuple[int, str]], size: int, letters: int) -> tuple[WordSide, LetterSide]:
    """The index of a block of items, built once in each worker."""
    key = hashlib.sha1(repr((items, size, letters)).encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        folded = [(i, words(t)) for i, t in items]
        by_letter = {i for i, t in items if len(CJK.findall(t)) * 2 > len(letters_of(words(t)))}
        _BUILT[key] = (
            WordSide([(i, t) for i, t in folded if i not in by_letter], size),
            LetterSide([(i, letters_of(t)) for i, t in folded if i in by_letter], letters),
        )
    return _BUILT[key]


def _blocks(items: Iterable[tuple[int, str]], size: int, most: int) -> list[list[tuple[int, str]]]:
    """Items in blocks of at most ``most`` windows, or of one item."""
    blocks, held = [[]], 0
    for i, text in items:
        n = max(0, len(words(text)) - size + 1)
        if held + n > most and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((i, text))
        held += n
    return blocks


def find_leaks(documents: DataFrame, items: DataFrame, *, size: int = 12, letters: int = 24, kinds: LineKinds | None = None, block_windows: int = 20_000) -> DataFrame:
    """documents: (doc_id, text, n_cols, boxes); items: (item_id, item_text). Result: (doc_id, item_id, run, share).

    ``run`` is the length of the longest walk found first, in words or characters; ``share`` the weighted share of equal
    words in the window that led to it.
    """
    pages = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", *PAGE_COLUMNS)
    asked = items.where(F.col("item_text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "item_text").distinct().orderBy("item_id", "item_text")
    kind = dict(documents.dtypes)["doc_id"]
    blocks = _blocks(((r.item_id, r.item_text) for r in asked.toLocalIterator()), size, block_windows)
    context = pages.sparkSession.sparkContext
    laid_out = len(blocks) > 1
    if laid_out:
        held = context.broadcast(kinds)

        def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([prose(*page, held.value) for page in pages_of(batch)], pa.string())], ["doc_id", "text"])

        pages = shared_checkpoint(pages.mapInArrow(lay_out, f"doc_id {kind}, text string"))

    def search(block: list[tuple[int, str]]) -> DataFrame:
        sent = context.broadcast((block, kinds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, line_kinds = sent.value
            by_word, by_letter = _sides(held, size, letters)
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    texts = batch.column("text").to_pylist() if laid_out else [prose(*page, line_kinds) for page in pages_of(batch)]
                    spelled, lettered = [], []
                    for k, text in enumerate(texts):
                        folded = words(text)
                        spelled.append((k, folded))
                        if by_letter.items and len(CJK.findall(text)) >= letters // 2:
                            lettered.append((k, letters_of(folded)))
                    found = [*by_word.find(spelled), *by_letter.find(lettered)]
                    if found:
                        d, i, n, share = zip(*found)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(share, pa.float64())], ["doc_id", "item_id", "run", "share"])

        return pages.mapInArrow(run, f"doc_id {kind}, item_id bigint, run int, share double")

    out = search(blocks[0])
    for block in blocks[1:]:
        out = out.unionByName(search(block))
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("share").alias("share"))
