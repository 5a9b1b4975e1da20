"""SimHash of every window of words, and all fingerprints within a Hamming radius by blocks.

A word's vector is the sum of the +-1 vectors of its letter trigrams, so a misread letter moves it a little; a window's
fingerprint has the signs of the sum over its words. The 64 bits are cut into three blocks: of two fingerprints that
differ in at most 8 bits, one block differs in at most 2. The index holds, for every value of a block, the queries whose
block is within 2 bits of it, so that a look-up in each block finds every query within the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, BLOCKS, RADIUS = 64, (22, 21, 21), 8
_NEAR = RADIUS // len(BLOCKS)
#: Queries compared at once, so many that they stay in the processor's cache.
_LOOKED_AT = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 64) int16 sums of trigram vectors, and a 64-bit hash of each word."""
    if not words:
        return np.zeros((0, BITS), np.int16), np.zeros(0, np.uint64)
    text = "".join(f"\x01{w}\x02" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 2)
    starts = ends - lengths - 2
    with np.errstate(over="ignore"):
        grams = _mix(codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9))
        place = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, lengths + 2).astype(np.uint64)
        whole = _mix(np.add.reduceat(_mix(codes + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), starts))
    inside = np.ones(len(grams), bool)
    for cut in (ends[:-1] - 1, ends[:-1] - 2):
        inside[cut] = False
    kept = grams[inside]
    signs = np.unpackbits(kept.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)
    signs += signs
    signs -= 1
    counts = np.maximum(lengths, 1)
    first = np.cumsum(counts) - counts
    return np.add.reduceat(signs, first, axis=0, dtype=np.int16), whole


def window_fingerprints(vectors: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` words of the sequence ``ids`` (rows of ``vectors``)."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    part, n = vectors[ids], len(ids) - size + 1
    if int(np.abs(vectors).max()) * size > np.iinfo(part.dtype).max:
        part = part.astype(np.int32)
    sums, at, width = None, 0, 1
    while True:  # sums of 1, 2, 4 ... words make those of ``size``
        if size & width:
            sums = part[at : at + n] if sums is None else sums + part[at : at + n]
            at += width
        if 2 * width > size:
            break
        part = part[:-width] + part[width:]
        width *= 2
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


class HammingIndex:
    """Query fingerprints, found by any fingerprint within RADIUS bits of them."""

    def __init__(self, queries: np.ndarray) -> None:
        self.queries = queries
        self.blocks = []
        shift = 0
        for width in BLOCKS:
            values = ((queries >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
            masks = np.array([sum(1 << b for b in bits) for k in range(_NEAR + 1) for bits in combinations(range(width), k)], np.int64)
            keys = (values[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            offsets = np.searchsorted(keys[order], np.arange((1 << width) + 1)).astype(np.int32)
            self.blocks.append((np.uint64(shift), np.uint64((1 << width) - 1), offsets, (order // len(masks)).astype(np.min_scalar_type(len(queries)))))
            shift += width

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, query) of all pairs within the radius, some perhaps more than once."""
        rows, hits = [], []
        for shift, mask, offsets, members in self.blocks:
            value = ((prints >> shift) & mask).astype(np.int64)
            first, count = offsets[value], offsets[value + 1] - offsets[value]
            some = np.flatnonzero(count)
            if not len(some):
                continue
            cuts = np.searchsorted(np.cumsum(count[some]), np.arange(_LOOKED_AT, int(count.sum()), _LOOKED_AT))
            for part in np.split(some, np.unique(cuts[cuts > 0])):
                n = count[part]
                ends = np.cumsum(n)
                at = np.repeat(first[part] - (ends - n), n)
                at += np.arange(len(at))
                near = members.take(at)
                close = np.flatnonzero(np.bitwise_count(np.repeat(prints[part], n) ^ self.queries[near]) <= RADIUS)
                rows.append(part[np.searchsorted(ends, close, side="right")])
                hits.append(near[close].astype(np.int32))
        return (np.concatenate(rows), np.concatenate(hits)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int32))
