"""Texts and words with letters that scanners confuse folded into one."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from operator import eq

import numpy as np

# What a scanner reads for what, by the letter kept; letters that it reads as two are written as two first.
AS_TWO = {"d": "cl", "w": "vv", "k": "lc", "m": "rn", "ы": "ьт"}
LETTERS = {
    "e": "c6", "a": "o0", "i": "l1", "n": "u", "t": "fs5", "g": "q9", "h": "b8", "y": "v", "z": "2",
    "е": "сё", "о": "а", "и": "нй", "п": "л", "т": "г", "ш": "щ", "б": "6", "з": "э3", "ь": "ъ",
    "了": "丁", "工": "土士", "日": "曰目", "人": "入八", "己": "已巳", "末": "未", "木": "本", "大": "太犬",
    "い": "り", "た": "に", "は": "ほ", "め": "ぬ", "る": "ろ", "シ": "ツ", "ン": "ソ", "ク": "ワ", "口": "ロ", "力": "カ", "二": "ニ",
}
_TABLE = {ord(x): keep for keep, others in LETTERS.items() for x in others}
_TABLE |= {ord(x): two.translate(_TABLE) for x, two in AS_TWO.items()}
_CJK_DASH = re.compile(r"(?<=[぀-ヿ㐀-鿿])[-－—](?=[぀-ヿ㐀-鿿])")
_MARK = re.compile(r"[̀-ͯ]")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")


def plain(text: str) -> str:
    """Lower case, without accents on Latin, Greek and Cyrillic letters; compatibility forms replaced."""
    text = text.casefold()
    return text if text.isascii() else unicodedata.normalize("NFC", _MARK.sub("", unicodedata.normalize("NFKD", text)))


@lru_cache(maxsize=300_000)
def fold(word: str) -> str:
    """plain() with confusable letters folded. Case is gone before, so that O and 0, or l and I, meet."""
    return plain(word).translate(_TABLE)


def words(text: str) -> list[str]:
    """Folded words of a text; every character of Chinese and Japanese is a word, a dash between two of them the sign for one."""
    if CJK.search(text):
        text = _CJK_DASH.sub("一", text)
    return list(map(fold, WORD.findall(text)))


@lru_cache(maxsize=300_000)
def near(a: str, b: str) -> bool:
    """Whether one folded word can be a misreading of the other: a quarter of the letters, numbers none."""
    if a == b:
        return True
    n = max(len(a), len(b))
    limit = n // 4 if n > 3 else n == 3 and len(a) == len(b)
    if not limit or abs(len(a) - len(b)) > limit or a.isdigit() or b.isdigit():
        return False
    return distance_within(a, b, int(limit))


def distance_within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most ``limit``; rows beyond it end early."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0], least = row[0], i, i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            least = min(least, row[j])
        if least > limit:
            return False
    return row[-1] <= limit


#: Letters of words that are compared in one number each, and pairs of words compared at once.
_WIDTHS, _AT_ONCE = np.array([8, 16, 32, 64]), 4_096


def near_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """near() of each pair, edit distances being counted for all pairs at once."""
    n, m = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    out = np.fromiter(map(eq, a, b), bool, len(a))
    most = np.maximum(n, m)
    limit = np.where(most > 3, most // 4, (most == 3) & (n == m))
    asked = np.flatnonzero(~out & (limit > 0) & (np.abs(n - m) <= limit))
    asked = asked[np.array([not (a[i].isdigit() or b[i].isdigit()) for i in asked.tolist()], bool)]
    width = np.searchsorted(_WIDTHS, most[asked])
    for w in np.unique(width).tolist():
        k = asked[width == w]
        if w == len(_WIDTHS):
            out[k] = [distance_within(a[i], b[i], int(limit[i])) for i in k.tolist()]
            continue
        for at in range(0, len(k), _AT_ONCE):
            part = k[at : at + _AT_ONCE]
            out[part] = _distances([a[i] for i in part.tolist()], [b[i] for i in part.tolist()], n[part], m[part], _WIDTHS[w]) <= limit[part]
    return out


def _distances(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray, width: int) -> np.ndarray:
    """Edit distances of pairs of words of at most ``width`` letters: a column of differences is the bits of a number (Myers 1999, Hyyrö 2003)."""
    number = np.dtype(f"u{width // 8}").type
    x = np.array(a, f"U{width}").view(np.uint32).reshape(-1, width)
    y = np.array(b, f"U{int(m.max())}").view(np.uint32).reshape(len(b), -1)
    same = np.packbits(y.T[:, :, None] == x, axis=2, bitorder="little").view(number)[:, :, 0]
    last = (n - 1).astype(number)
    up, down, score = np.full(len(a), ~number(0)), np.zeros(len(a), number), n.astype(np.int16)
    out = score.copy()
    for j, equal in enumerate(same, 1):
        free = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more, less = down | ~(across | up), up & across
        score += ((more >> last) & number(1)).astype(np.int16)
        score -= ((less >> last) & number(1)).astype(np.int16)
        done = m == j
        out[done] = score[done]
        more, less = (more << number(1)) | number(1), less << number(1)
        up, down = less | ~(free | more), more & free
    return out
