"""Articles of a page as running text, with the way back to the page's characters."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

from kestrelgrid.llm.folding import CJK
from kestrelgrid.llm.page_layout import BODY, HEADLINE, LineKinds, page_lines

_HYPHENS = "-=¬‐‑\xad"
_SCRIPTS = (("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[㐀-鿿]")), ("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("ru", re.compile("[Ѐ-ӿ]")))
# Frequent words that tell languages of Latin script apart; none is in two lists.
_COMMON = {
    "en": {"the", "of", "and", "this", "every", "with", "to", "is", "was", "for", "that", "until", "while"},
    "de": {"der", "die", "das", "und", "den", "ein", "eine", "einen", "dem", "von", "mit", "nach", "zu", "im", "ist", "weil"},
    "fr": {"le", "les", "une", "des", "du", "et", "est", "dans", "pour", "avec", "au", "sans", "malgré", "chez"},
    "es": {"el", "los", "las", "una", "del", "y", "con", "por", "tras", "pero", "porque", "cerca", "pese", "hacia"},
    "it": {"il", "lo", "gli", "di", "della", "per", "non", "sono", "nel", "che", "anche"},
    "pt": {"os", "um", "uma", "não", "da", "dos", "com", "para", "em", "mas", "são"},
    "nl": {"het", "een", "van", "niet", "dat", "voor", "zijn", "wordt", "ook"},
}
_OTHER = re.compile("[぀-ヿ㐀-鿿฀-๿ऀ-ॿ؀-ۿЀ-ӿ]")
_LATIN = re.compile(r"[a-zà-öø-ÿ]+")
_WHOSE = {word: lang for lang, found in _COMMON.items() for word in found}
#: Languages written without spaces between words, and those without upper and lower case.
UNSPACED, CASELESS = {"zh", "ja"}, {"zh", "ja", "th", "hi", "ar"}


def language_of(text: str, page: str | None = None) -> str:
    """By the scripts of the whole text, languages of Latin script by their frequent words; by the whole page where a text has too few."""
    sample = text
    best, most = "", max(12, len(sample) // 8)
    for lang, pattern in _SCRIPTS if _OTHER.search(sample) else ():
        n = len(pattern.findall(sample))
        if lang == "ja" and n > 4 and n * 12 > len(sample):
            return lang
        if n > most:
            best, most = lang, n
    if best:
        return best
    words = Counter(_LATIN.findall(sample.lower()))
    counts: Counter = Counter()
    for word in words.keys() & _WHOSE.keys():
        counts[_WHOSE[word]] += words[word]
    best = counts.most_common(2)
    if page is not None and (not best or best[0][1] <= max(2, 2 * best[1][1] if len(best) > 1 else 0)):
        return language_of(page)
    return min((lang for lang, n in counts.items() if n == best[0][1]), default="und") if best else "und"


class Article:
    """Running text of an article: ``text``, its ``lang``, and ``place(i)``, where character i stands on the page."""

    __slots__ = ("text", "lang", "_at", "_page")

    def __init__(self, page: str, spans: list[tuple[int, int]]) -> None:
        self.lang = language_of("\n".join([page[s:e] for s, e in spans]), page)
        gap = "" if self.lang in UNSPACED else "\n"
        parts, self._at, self._page, at = [], [], [], 0
        for s, e in spans:
            bare = page[s:e].strip()
            if not bare:
                continue
            if page[s] != bare[0]:
                s = page.index(bare[0], s)
            broken = gap and bare[-1] in _HYPHENS and bare[-2:-1].isalpha()
            if broken:
                bare = bare[:-1]
            self._at.append(at)
            self._page.append(s)
            parts.append(bare)
            at += len(bare)
            if not broken and gap:
                parts.append(gap)
                at += 1
        self.text = "".join(parts)

    def place(self, i: int) -> int:
        k = bisect_right(self._at, i) - 1
        return self._page[k] + i - self._at[k]


def _written_unspaced(line: str) -> bool | None:
    """Whether most letters of a line are Chinese or Japanese; None where it has fewer than four letters."""
    letters = sum(map(str.isalpha, line))
    return None if letters < 4 else 2 * len(CJK.findall(line)) > letters


def articles(text: str, n_cols, x0, y0, x1, kinds: LineKinds | None) -> list[Article]:
    """Articles of a page in reading order; headlines part them, adverts and page heads are left out.

    Where boxes tell no headlines, an article also ends where lines written with spaces follow lines written without, or the reverse.
    """
    out, spans, unspaced = [], [], None
    for kind, s, e in page_lines(text, n_cols, x0, y0, x1, kinds):
        if kind == BODY:
            if not x0 and (own := _written_unspaced(text[s:e])) is not None:
                if unspaced is not None and own != unspaced and spans:
                    out.append(Article(text, spans))
                    spans = []
                unspaced = own
            spans.append((s, e))
        elif kind == HEADLINE and spans:
            out.append(Article(text, spans))
            spans = []
    if spans:
        out.append(Article(text, spans))
    return out
