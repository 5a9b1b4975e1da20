"""Sentence boundaries from statistics of the corpus: abbreviations, collocations and sentence starters.

Nothing is told about a language's words: over all documents, and for each language, it is counted how often a word
stands with a period and without, what follows it there, which words open sentences where the boundary is beyond doubt,
and what follows a quotation that ends in a question or an exclamation. Log-likelihood ratios turn the counts into

* abbreviations: words that take a period more often than chance, and go on after it as no sentence begins;
* starters: words far more frequent after sure boundaries than elsewhere;
* abbreviations that bind what follows (titles): hardly ever followed by a starter;
* words that name a speaker after a quotation;
* for Thai, which has no marks, what sentences begin and end with beside spaces.

Each mark is then judged by them (``ends``).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

from kestrelgrid.llm.folding import fold
from kestrelgrid.llm.prose import CASELESS, UNSPACED, Article

#: A ratio of this much or more speaks against chance at the level of 0.5 %.
LEAST_RATIO = 7.88
_STRONG = set("!?…。！？؟।॥｡")
_CLOSE = "\"”’»«“)]」』'）】"
_OPEN = "\"“‘«»„(¿¡[「『（'"
_MARKS = re.compile(r"[.!?…。！？؟।॥｡·,]+")
#: A place a sentence may end: marks, what closes right behind them, blanks and noise, what opens, and the next token.
_SITE_PARTS = rf"([.!?…。！？؟।॥｡·,]++)([{re.escape(_CLOSE)}]*+(?:[ \xa0\n]»(?=\s|$))?+)((?:\s|(?<=[\s{re.escape(_CLOSE)}»])[,·'.])*+)([{re.escape(_OPEN)}\s]*+)"
_SITE = re.compile(_SITE_PARTS + r"(?=(\S*))")
#: The same where case tells: nothing ends before a small letter.
_SITE_CASED = re.compile(_SITE_PARTS + r"(?![a-zß-öø-ÿа-яё])(?=(\S*))")
#: Rules of plausibility, in characters: a bracket that isn't closed within ASIDE is a misread mark and no aside; words that
#: name a speaker are a clause of at most SPEAKER, looked at after an abbreviation up to twice as far.
ASIDE, SPEAKER = 400, 60
_BRACKETS = re.compile(rf"[(（][^()（）]{{0,{ASIDE}}}[)）]")
_CONTEXT = re.compile(rf"(\S*?)([.!?…؟।॥]+)([{re.escape(_CLOSE)}]*)")
_CONTEXT_ENDS = set(".!?…؟।॥" + _CLOSE)
_SPEAKER = re.compile(rf"[?!？！؟]+[”\"»“«’」』]\s?([^।.!?。！？؟…]{{1,{SPEAKER}}})[।.!?。！？؟…]")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_SOFT = ".,·:;!?…؟।॥"
_ENDERS = ("." , "!", "?", "…", "؟", "।", "॥")
_MID = re.compile(rf"\s(?<=[a-zß-öø-ÿа-яё)]\s)([{re.escape(_OPEN)}]*)([A-ZÀ-ÖØ-ÞА-ЯЁ]\S*)")
_TH_SPACE = re.compile(r"(?=(.{4}) ([^\s\d]\S{6}))")
_DIGIT = re.compile(r"\d")
THAI_KEYS = (7, 5, 4)
SPEAKER_KEYS = (9, 3)


@lru_cache(maxsize=100_000)
def word_type(token: str) -> str:
    """A token without marks around it, in lower case but for single letters (initials); numbers are all one type."""
    bare = _EDGE.sub("", token)
    if len(bare) < 2 and not bare.isdigit():
        return bare
    return "##" if all(c.isdigit() or c in ".,:" for c in bare) else bare.lower()


@lru_cache(maxsize=100_000)
def next_type(token: str) -> str:
    """Like word_type, but an initial keeps its period: A. is no article."""
    t = word_type(token)
    return t + "." if len(t) == 1 and token.lstrip(_OPEN)[1:2] == "." else t


class Tally:
    """Counts of many articles, as {(lang, kind, a, b): n}."""

    def __init__(self) -> None:
        self.tokens: dict[str, Counter] = defaultdict(Counter)
        self.contexts: dict[str, Counter] = defaultdict(Counter)
        self.mid: dict[str, Counter] = defaultdict(Counter)
        self.pairs: dict[str, Counter] = defaultdict(Counter)
        self.other: Counter = Counter()

    def add(self, article: Article) -> None:
        text, lang = article.text, article.lang
        if lang == "th":
            self._thai(text)
            return
        for m in _SPEAKER.finditer(text):
            clause = m.group(1).strip()
            if clause:
                self.other[lang, "speaker", *_ends_of(clause, lang)] += 1
        if lang in UNSPACED:
            for piece in re.split("[。！？]", text):
                piece = piece.strip(_CLOSE + _OPEN)
                if piece:
                    self.other[lang, "clause", *_ends_of(piece, lang)] += 1
            return
        tokens = text.split()
        self.tokens[lang].update(tokens)
        self.contexts[lang].update(_contexts(tokens))
        if lang in CASELESS:
            self.pairs[lang].update(zip(tokens, tokens[1:]))
        else:
            self.mid[lang].update(_MID.findall(text))

    def _thai(self, text: str) -> None:
        for before, after in _TH_SPACE.findall(text):
            if before[-1].isdigit():
                continue
            self.other["th", "space_end", _DIGIT.sub("0", before), ""] += 1
            after = after.lstrip(_OPEN)
            for n in THAI_KEYS:
                self.other["th", "space_start", after[:n], ""] += 1
        lines = text.split("\n")
        for line in lines:
            bare = line.lstrip(_OPEN)
            if len(bare) > 8 and " " not in bare[:7]:
                for n in THAI_KEYS:
                    self.other["th", "line_start", bare[:n], ""] += 1
            if len(line) > 8:
                self.other["th", "line_end", _DIGIT.sub("0", line[-4:]), ""] += 1
        for gap, word in re.findall(r"[”\"»’]( ?)([^\s“]{9})", text):  # a line's end says nothing
            for n in SPEAKER_KEYS:
                self.other["th", "after_quote" if gap else "speaker", word[:n], ""] += 1

    def size(self) -> int:
        return len(self.other) + sum(len(c) for by in (self.tokens, self.contexts, self.mid, self.pairs) for c in by.values())

    def rows(self) -> list[tuple[str, str, str, str, int]]:
        """The counts, by word type; tokens and contexts are typed here, once for each that differs."""
        out = Counter(self.other)
        for lang, tokens in self.tokens.items():
            for token, n in tokens.items():
                t = word_type(token)
                if t:
                    if token.rstrip(_CLOSE)[-1:] in _ENDERS:
                        out[lang, "closed", t, ""] += n
                    out[lang, "period" if "." in token[-3:].rstrip(_CLOSE) or token.rstrip(_CLOSE)[-1:] in (",", "·") and len(t) < 6 else "bare", t, ""] += n
        for lang, contexts in self.contexts.items():
            cased = lang not in CASELESS
            for (word, marks, close, after), n in contexts.items():
                t, following = word_type(word), next_type(after)
                if not following:
                    continue
                upper = after[:1].isupper() if cased else True
                strong = marks != "." and any(c in _STRONG for c in marks)
                if strong and upper and (cased or not close):
                    out[lang, "start", following, ""] += n
                if marks == "." and t and not close:
                    if following == "##" or cased and not upper:
                        out[lang, "goes_on", t, ""] += n
                    else:
                        out[lang, "pair", t, following] += n
        for lang, found in self.mid.items():
            for (opened, token), n in found.items():
                t = word_type(token)
                if t and not token.isupper() and not (len(t) == 1 and token[len(t) :][:1] == ".") or len(token) == 1:
                    out[lang, "mid_quoted" if opened else "mid", t, ""] += n
        for lang, found in self.pairs.items():
            for (a, b), n in found.items():
                if a[-1] not in _SOFT and a.rstrip(_CLOSE)[-1:] not in _SOFT:
                    t, following = word_type(a), word_type(b)
                    if t and following:
                        out[lang, "next", t, following] += n
        return [(*k, n) for k, n in out.items()]


def _contexts(tokens: list[str]) -> Iterator[tuple[str, str, str, str]]:
    """(word, marks, what closes, next word) of each token that ends in marks and has a word behind it; what follows an opening quote is the next word only."""
    opened = -1
    for i in [i for i, token in enumerate(tokens) if token[-1] in _CONTEXT_ENDS]:
        if i == opened or i + 1 == len(tokens):
            continue
        found = _CONTEXT.fullmatch(tokens[i])
        after = tokens[i + 1].lstrip(_OPEN)
        if found and after:
            if len(after) < len(tokens[i + 1]):
                opened = i + 1
            yield *found.groups(), after


@lru_cache(maxsize=1000)
def _is_strong(marks: str) -> bool:
    return any(c in _STRONG for c in marks) or "..." in marks


def _ends_of(clause: str, lang: str) -> tuple[str, str]:
    if lang in UNSPACED:
        return clause[:1], clause[-3:]
    found = clause.split()
    return word_type(found[0]), word_type(found[-1])


def log_likelihood(both: float, a: float, b: float, n: float) -> float:
    """Dunning's ratio for ``both`` of ``a`` against the share b / n of all."""
    if not (a and n) or b >= n:
        return 0.0

    def term(k: float, m: float, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (m - k) * math.log(1 - p)

    rest = n - a
    return 2 * (term(both, a, both / a) + term(b - both, rest, (b - both) / rest if rest else 0) - term(both, a, b / n) - term(b - both, rest, b / n))


#: Totals of a word: by the kind of its count rows; what follows and what leads to it are summed over the other word.
TOTALS = (
    "period", "bare", "start", "goes_on", "closed", "mid", "pairs", "behind", "nexts", "first", "last", "any_first", "any_last",
    "space_start", "line_start", "space_end", "line_end", "speaker", "after_quote",
)


def starter_kinds(word: str, c: dict[str, int], all_of: dict[str, int]) -> Iterator[tuple[str, float]]:
    """What a word's totals ``c`` say of it as a starter; ``all_of`` are the totals of its language."""
    total, starts = all_of["period"] + all_of["bare"], all_of["start"]
    if not all_of["period"]:
        return
    s, t = c["start"], max(c["period"] + c["bare"], c["start"])
    if word != "##" and s >= 3 and s / t > starts / total and log_likelihood(s, t, starts, total) >= LEAST_RATIO:
        yield "starters", 1.0
        behind_mark = s + c["behind"]
        if behind_mark >= 10 and c["mid"] / (c["mid"] + behind_mark) < 0.1:
            yield "openers", 1.0


def word_kinds(lang: str, word: str, c: dict[str, int], all_of: dict[str, int], known: bool) -> Iterator[tuple[str, float]]:
    """What else a word's totals say, among them how often a starter follows it; ``known``: whether any starter is known."""
    if lang == "th":
        yield from _thai_kinds(c)
        return
    if c["nexts"] >= 10 and c["next_started"] / c["nexts"] < 0.03:
        yield "leads", c["next_started"] / c["nexts"]
    if all_of["period"]:
        yield from _period_kinds(lang, word, c, all_of, known)
    for own, general, what in (("first", "any_first", "speaker_first"), ("last", "any_last", "speaker_last")):
        spaced = ("period", "bare") if lang not in UNSPACED else ()
        total, n = max(1, sum(all_of[k] for k in (general, *spaced))), c[own]
        t = max(sum(c[k] for k in (general, *spaced)), n)
        if word and n >= 3 and n / t >= 0.3 and log_likelihood(n, t, all_of[own], max(total, all_of[own] + 1)) >= LEAST_RATIO:
            yield what, 1.0


def _period_kinds(lang: str, word: str, c: dict[str, int], all_of: dict[str, int], known: bool) -> Iterator[tuple[str, float]]:
    total, periods = all_of["period"] + all_of["bare"], all_of["period"]
    n, t = c["period"], c["period"] + c["bare"]
    # only shares that the search for lost marks asks for
    if t >= 5 and (c["closed"] / t >= 0.25 if lang in CASELESS else c["closed"] / t < 0.1):
        yield "closing", c["closed"] / t
    started, seen = c["pair_started"], c["goes_on"] + c["pairs"]
    if word == "##" and c["pairs"] >= 5 and (c["pairs"] - started) / c["pairs"] >= 0.2:
        yield "ordinal", 1.0
    if n < 3 or n / t < 0.7 or n / t <= periods / total or log_likelihood(n, t, periods, total) < LEAST_RATIO:
        return
    # where no starter is known, only what follows in lower case or as a number speaks for an abbreviation
    if seen >= 3 and (seen - started if known else c["goes_on"]) / seen >= 0.1:
        if word != "##":
            yield "abbreviations", 1.0
        # a collocation with what begins no sentence: starters follow it significantly less often than they follow marks at large
        if started / seen < 0.03 and (not known or log_likelihood(started, seen, all_of["started"], all_of["goes_on"] + all_of["pairs"] + all_of["start"]) >= LEAST_RATIO):
            yield "binding", 1.0


def _thai_kinds(c: dict[str, int]) -> Iterator[tuple[str, float]]:
    for at_space, at_line, what, least in (("space_start", "line_start", "thai_start", 4), ("space_end", "line_end", "thai_end", 4), ("speaker", "after_quote", "thai_speaker", 3)):
        if c[at_space] + c[at_line] >= least:
            yield what, c[at_space] / (c[at_space] + c[at_line])


class Model:
    """What the corpus says of each language: abbreviations, binding ones, starters, speakers' words, Thai edges."""

    def __init__(self) -> None:
        self.abbreviations: dict[str, set[str]] = defaultdict(set)
        self.binding: dict[str, set[str]] = defaultdict(set)
        self.starters: dict[str, set[str]] = defaultdict(set)
        self.openers: dict[str, set[str]] = defaultdict(set)
        self.leads: dict[str, dict[str, float]] = defaultdict(dict)
        self.closing: dict[str, dict[str, float]] = defaultdict(dict)
        self.ordinal: set[str] = set()
        self.speaker_first: dict[str, set[str]] = defaultdict(set)
        self.speaker_last: dict[str, set[str]] = defaultdict(set)
        self.thai_start: dict[str, float] = {}
        self.thai_end: dict[str, float] = {}
        self.thai_speaker: dict[str, float] = {}

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str, str, float]]) -> Model:
        """rows: (lang, what, word, value) of ``starter_kinds`` and ``word_kinds``."""
        model = cls()
        for lang, what, word, value in rows:
            held = getattr(model, what)
            if what == "ordinal":
                held.add(lang)
            elif what.startswith("thai"):
                held[word] = value
            elif what in ("leads", "closing"):
                held[lang][word] = value
            else:
                held[lang].add(word)
        return model

    def is_starter(self, lang: str, word: str) -> bool:
        return word in self.starters[lang] or word not in self.abbreviations[lang] and _fold(word) in self._folded(lang, "starters")

    def is_abbreviation(self, lang: str, word: str) -> bool:
        return word in self.abbreviations[lang] or 1 < len(word) <= 6 and _fold(word) in self._folded(lang, "abbreviations")

    def is_binding(self, lang: str, word: str) -> bool:
        return word in self.binding[lang] or word not in self.abbreviations[lang] and 1 < len(word) <= 6 and _fold(word) in self._folded(lang, "binding")

    def _folded(self, lang: str, what: str) -> set[str]:
        cache = self.__dict__.setdefault("_cache", {})
        if (lang, what) not in cache:
            cache[lang, what] = {fold(w) for w in getattr(self, what)[lang]}
        return cache[lang, what]


_fold = lru_cache(maxsize=100_000)(fold)


def ends(article: Article, model: Model) -> list[int]:
    """Places in the article's text just behind each sentence."""
    text, lang = article.text, article.lang
    if lang == "th":
        found = _thai_ends(text, model)
    elif lang in UNSPACED:
        found = _unspaced_ends(text, lang, model)
    else:
        found = _spaced_ends(text, lang, model)
    stop = len(text.rstrip())
    while stop and not (text[stop - 1].isalnum() or text[stop - 1] in _CLOSE or _MARKS.match(text[stop - 1]) or text[stop - 1] > "ऀ"):
        stop -= 1
    if stop and (not found or found[-1] < stop) and any(c.isalpha() for c in text[found[-1] if found else 0 : stop]):
        found.append(stop)
    return found


def _asides(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _BRACKETS.finditer(text)] if "(" in text or "（" in text else []


def _word_before(text: str, i: int) -> str:
    """The word that ends right before place i, '' behind a blank."""
    found = text[max(text.rfind(" ", 0, i), text.rfind("\n", 0, i)) + 1 : i].split()
    return found[-1] if found and not text[i - 1].isspace() else ""


def _inside(spans: list[tuple[int, int]], at: int, k: int) -> tuple[bool, int]:
    while k < len(spans) and spans[k][1] <= at:
        k += 1
    return k < len(spans) and spans[k][0] <= at, k


def _spaced_ends(text: str, lang: str, model: Model) -> list[int]:
    cased = lang not in CASELESS
    spans, k = _asides(text), 0
    out: list[int] = []
    for m in (_SITE_CASED if cased else _SITE).finditer(text):
        marks, close, gap, opened, token = m.groups()
        if not token or not (close or gap) and (not opened or token[0].isalnum()) and marks not in ("।", "॥"):
            continue
        if cased and token[0].islower():
            continue
        i, j = m.span(1)
        inside, k = _inside(spans, i, k)
        if inside:
            continue
        e, p, first = m.end(2), m.end(3), token[0]
        strong = _is_strong(marks)
        if strong:
            if e > j and _MARKS.match(text[e - 1]) is None and any(c in "!?؟" for c in marks) and _names_speaker(text, p, lang, model):
                continue
            out.append(e)
            continue
        word = _word_before(text, i)
        bare = _EDGE.sub("", word)
        own = word_type(word)
        following = next_type(token)
        if "." not in marks:
            # a comma or a dot in mid-line read for a period: only before what opens sentences
            if i and not text[i - 1].isspace() and (model.is_starter(lang, following) if cased else len(own) > 1 and not model.is_abbreviation(lang, own)):
                if not (cased and model.is_abbreviation(lang, own) and model.is_binding(lang, own)):
                    out.append(e)
            continue
        if e > j:
            out.append(e)
            continue
        if not bare:
            if word.endswith((")", "”", "»", '"')):
                out.append(e)
            continue
        if own == "##":
            if first.isdigit():
                continue
            if lang not in model.ordinal or model.is_starter(lang, following):
                out.append(e)
            continue
        if len(bare) == 1 and cased and bare.isupper() and len(token) > 1 and token.isupper() and model.is_starter(lang, following):
            own = bare.lower()  # an abbreviation in a line of capitals, not an initial
        elif len(bare) == 1 and (bare.isupper() if cased else True):
            if not cased and model.is_starter(lang, following) and not model.is_binding(lang, own) and own not in model.abbreviations[lang]:
                out.append(e)
            continue
        if model.is_abbreviation(lang, own):
            if first.isdigit() or model.is_binding(lang, own) or not model.is_starter(lang, following):
                continue
            out.append(e)
            continue
        if first.isdigit() and cased and len(bare) < 3:
            continue
        out.append(e)
    lost = _lost_by_case(text, lang, model, spans) if cased else _lost_by_order(text, lang, model, spans)
    return sorted({*out, *lost}) if lost else out


def _lost_by_case(text: str, lang: str, model: Model, spans: list[tuple[int, int]]) -> list[int]:
    """Ends of sentences that lost their mark: before a capital word that elsewhere only opens sentences."""
    out, k, openers = [], 0, model.openers[lang]
    for m in _MID.finditer(text):
        token = m.group(2)
        if word_type(token) not in openers or len(token) > 1 and (token.isupper() or len(token) == 2 and token[1] == "."):
            continue
        before = _word_before(text, m.start())
        if model.closing[lang].get(word_type(before), 1.0) < 0.1:
            continue
        inside, k = _inside(spans, m.start() - 1, k)
        if not inside or text[m.start() - 1] == ")":
            out.append(m.start())
    return out


def _lost_by_order(text: str, lang: str, model: Model, spans: list[tuple[int, int]]) -> list[int]:
    """Ends of sentences that lost their mark, without case: between a word that leads to no starter and a starter."""
    out, k, leads, starters, closing = [], 0, model.leads[lang], model.starters[lang], model.closing[lang]
    last, last_end = "", 0
    for m in re.finditer(r"\S+", text):
        token = m.group()
        t = word_type(token)
        if last and t in starters and leads.get(last, 1.0) < 0.03 and closing.get(last, 0.0) >= 0.25 and last not in model.abbreviations[lang]:
            inside, k = _inside(spans, last_end - 1, k)
            if not inside or text[last_end - 1] == ")":
                out.append(last_end)
        bare = token.rstrip(_CLOSE)
        last, last_end = ("" if token[-1] in _SOFT or bare[-1:] in _SOFT else t), m.end()
    return out


def _names_speaker(text: str, at: int, lang: str, model: Model) -> bool:
    """Whether the clause behind a quotation tells who speaks."""
    stop = _MARKS.search(text, at)
    clause = text[at : stop.start() if stop else len(text)]
    # an abbreviation may end the clause early; its first words still count
    if not clause.strip() or len(clause) > 2 * SPEAKER or clause[0] in _OPEN:
        return False
    found = clause.split()
    first, last = word_type(found[0]), word_type(found[-1])
    if first in model.speaker_first[lang]:
        return True
    if lang in CASELESS and lang != "ar":
        while last not in model.speaker_last[lang] and stop and stop.group() == "." and stop.end() < len(text) and len(clause) < SPEAKER:
            again = _MARKS.search(text, stop.end())
            clause, stop = text[at : again.start() if again else len(text)], again
            found = clause.split()
            last = word_type(found[-1]) if found else last
        return last in model.speaker_last[lang]
    return False


def _unspaced_ends(text: str, lang: str, model: Model) -> list[int]:
    spans, k, n = _asides(text), 0, len(text)
    out: list[int] = []
    quotes: dict[str, list[int]] = {}
    for m in _MARKS.finditer(text):
        i, j = m.span()
        marks = m.group()
        strong = _is_strong(marks)
        if not strong and (i and text[i - 1].isdigit() and j < n and text[j].isdigit() or i and text[i - 1].isascii() and text[i - 1].isalnum()):
            continue
        inside, k = _inside(spans, i, k)
        if inside:
            continue
        e = j
        while e < n and text[e] in _CLOSE and not (text[e] in "“\"'" and e + 1 < n and _opens(text, e, quotes)):
            e += 1
        if e == n:
            continue
        if e > j and any(c in "!?！？" for c in marks):
            stop = _MARKS.search(text, e)
            clause = text[e : stop.start() if stop else n].strip()
            if clause and clause[0] not in _OPEN and len(clause) <= 40 and (clause[-3:] in model.speaker_last[lang] or clause[:1] in model.speaker_first[lang]):
                continue
        out.append(e)
    return out


def _opens(text: str, e: int, quotes: dict[str, list[int]]) -> bool:
    """Whether a quote that looks alike at both ends opens a quotation here, an even number of it standing before; “ always does in Chinese and Japanese."""
    if text[e] == "“":
        return True
    if text[e] not in quotes:
        quotes[text[e]] = [m.start() for m in re.finditer(re.escape(text[e]), text)]
    return bisect_left(quotes[text[e]], e) % 2 == 0


def _thai_ends(text: str, model: Model) -> list[int]:
    spans, k, n = _asides(text), 0, len(text)
    out: list[int] = []
    for m in re.finditer(r"\s+|[!?…]+|(?<=[”\"»’])(?=\S)", text):
        i, j = m.span()
        inside, k = _inside(spans, i, k)
        if inside or not i:
            continue
        gap = m.group()
        if gap and not gap.isspace():
            e = j
            while e < n and text[e] in _CLOSE:
                e += 1
            if e < n and (text[e].isspace() or text[e] in _OPEN) and not (out and out[-1] == e):
                out.append(e)
            continue
        if not gap or j >= n:
            continue
        before, after = text[i - 1], text[j]
        if out and out[-1] >= i:
            continue
        if after.isdigit() or after in _CLOSE and after not in _OPEN:
            continue
        rest = text[j:].lstrip(_OPEN)
        share = _share(rest, model)
        if before.isdigit() and (share < 0.2 if share is not None else _counted(rest)):
            continue
        if before in _CLOSE and _speaker_share(rest, model) >= 0.5:
            continue
        if "\n" in gap:
            if before in "”\"»’" or after in "“":
                pass
            elif share is None or share < 0.2:
                continue
            elif not (before.isdigit() or before in ".…") and model.thai_end.get(_DIGIT.sub("0", text[max(0, i - 4) : i]), 1.0) < 0.05:
                continue
        out.append(i)
    return out


def _counted(rest: str) -> bool:
    """Whether what follows a number counts it: a short word before a space, a mark or a conjunction."""
    return bool(re.match(r"(คน|บาท|ใบ|วัน|ปี|เมตร|ตัน|ไมล์|[^\s]{1,2}[.·,])", rest))


def _share(rest: str, model: Model) -> float | None:
    """How often what begins like ``rest`` stands behind a space rather than at a line's start; None if unknown."""
    for size in THAI_KEYS:
        share = model.thai_start.get(rest[:size])
        if share is not None:
            return share
    return None


def _speaker_share(rest: str, model: Model) -> float:
    """How often what begins like ``rest`` stands right behind a quotation rather than apart from it; the longest known key tells."""
    return next((model.thai_speaker[rest[:n]] for n in SPEAKER_KEYS if rest[:n] in model.thai_speaker), 0.0)
