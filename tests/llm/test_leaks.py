import random

import numpy as np

from kestrelgrid.llm import leaks as leaks_module
from kestrelgrid.llm.folding import distance_within, fold, near, near_pairs
from kestrelgrid.llm.leaks import WordSide, _GAP, _Pairs, _parted, _shapes, find_leaks
from kestrelgrid.llm.simhash_windows import RADIUS, HammingIndex, window_fingerprints, word_vectors

from .pages import page, rows

rnd = random.Random(12)
SYLLABLES = "ka lo mi ter vun sha pel dri os quen bar tof".split()
WORD = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(1, 5)))
ITEM = [WORD() for _ in range(40)]
HAN = "".join(chr(0x4E00 + 40 * k) for k in range(60))


def lines(words, width=6):
    return [" ".join(words[k : k + width]) for k in range(0, len(words), width)]


def noise(n):
    return ["".join(rnd.choice(("zug", "byf", "gwy", "uzz")) for _ in range(rnd.randrange(1, 5))) for _ in range(n)]


def leaks(spark, pages, items=None):
    items = items or [(1, " ".join(ITEM), "x"), (2, HAN, "x")]
    df = find_leaks(rows(spark, pages), spark.createDataFrame(items, "item_id bigint, item_text string, doc_id string"))
    got = [(r.doc_id, r.item_id) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_passages(spark):
    cut = ITEM[5:17]
    hyphen = lines(noise(3) + cut[:4], 20) + [cut[4][:2] + "-", cut[4][2:] + " " + " ".join(cut[5:])] if len(cut[4]) > 3 else lines(cut)
    misread = [w.replace("o", "0").replace("e", "c").upper() + "," for w in cut]
    pages = [
        page(1, [lines(noise(20) + cut + noise(20))]), page(2, [lines(noise(20) + ITEM[5:16] + noise(20))]), page(3, [hyphen]), page(4, [lines(noise(5) + misread + noise(5))]),
        page(5, [lines(noise(12) + cut[:6]) + [("advert", "Why pay more?")], lines(cut[6:] + noise(12))]), page(6, [lines(noise(12) + cut[:6]), lines(cut[6:] + noise(12))], merged="  |  "),
        page(7, [lines(ITEM[:6] + noise(3) + ITEM[6:12])]), page(8, [lines(noise(30))]), page(9, [lines(ITEM)]),
        page(10, [[HAN[3:20], HAN[20:28]]]), page(11, [[HAN[3:25]]]), page(12, [["一" + HAN[3:15] + "丁" + HAN[16:30]]]),
    ]
    assert leaks(spark, pages) == {(1, 1), (3, 1), (4, 1), (5, 1), (6, 1), (9, 1), (10, 2), (12, 2)}


def test_nulls_repeats_and_empty(spark):
    good = page(1, [lines(ITEM)])
    odd = [(2, None, 1, None, None, None, ""), (3, "", 1, None, None, None, ""), (None, " ".join(ITEM), 1, None, None, None, ""), (4, "short", 1, None, None, None, "")]
    items = [(1, " ".join(ITEM), "x"), (1, " ".join(ITEM), "x"), (7, " ".join(ITEM), "x"), (8, None, "x"), (9, "too short", "x"), (None, " ".join(ITEM), "x")]
    assert leaks(spark, [good, good, *odd], items) == {(1, 1), (1, 7)}
    assert leaks(spark, [good], items[3:5]) == set()
    assert find_leaks(rows(spark, [good]).limit(0), spark.createDataFrame(items[:1], "item_id bigint, item_text string, doc_id string")).count() == 0


def test_blocks_of_items_say_the_same(spark):
    items = [(k, " ".join(ITEM[k : k + 15]), "x") for k in range(5)]
    df = rows(spark, [page(1, [lines(ITEM)])])
    i = spark.createDataFrame(items, "item_id bigint, item_text string, doc_id string")
    assert {tuple(r)[:2] for r in find_leaks(df, i, block_windows=6).collect()} == {tuple(r)[:2] for r in find_leaks(df, i).collect()} == {(1, k) for k in range(5)}


def test_passages_behind_a_break(spark):
    words = [w + "qrst"[k % 4] + "kalomi" for k, w in enumerate(ITEM[:24])]
    doc = words[:11] + ["zugbyfgwyuzz"] + words[12:]
    doc[16], doc[20] = doc[16][:-1] + "x", doc[20][:-1] + "x"
    mirrored = doc[::-1]
    items = [(1, " ".join(words), "x"), (2, " ".join(words[::-1]), "x")]
    assert leaks(spark, [page(1, [lines(doc)]), page(2, [lines(mirrored)])], items) == {(1, 1), (2, 2)}


def test_long_text(spark):
    words = noise(160_000)
    words[151_000:151_012] = ITEM[:12]
    words[149_995:150_007] = ITEM[20:32]
    assert leaks(spark, [(1, " ".join(words), 1, None, None, None, "")]) == {(1, 1)}


def test_index_finds_all_within_the_radius():
    g = np.random.default_rng(3)
    queries = g.integers(0, 2**63, 200).astype(np.uint64)
    asked = []
    for q in queries[:50]:
        for k in range(13):
            x = int(q)
            for b in g.choice(64, k, replace=False):
                x ^= 1 << int(b)
            asked.append(x)
    asked = np.array(asked, np.uint64)
    rows_, hits = HammingIndex(queries).search(asked)
    want = {(i, j) for i in range(len(asked)) for j in range(len(queries)) if int(asked[i] ^ queries[j]).bit_count() <= RADIUS}
    assert set(zip(rows_.tolist(), hits.tolist())) == want and want


def test_windows():
    v, h = word_vectors(["abc", "d", "abc"])
    assert (v[0] == v[2]).all() and h[0] == h[2] != h[1]
    p = window_fingerprints(v, np.array([0, 1, 0, 1]), 2)
    assert len(p) == 3 and p[0] == p[1] == p[2]
    assert len(window_fingerprints(v, np.array([0]), 2)) == 0


def test_folding():
    assert fold("Rcv. Clerk") == fold("Rev. derk") and fold("A8OUT") == fold("about") and fold("fhe") == fold("the")
    assert near("ledger", "lcdger") and near("tramway", "tranway") and not near("ledger", "lodges") and not near("12", "13") and not near("a", "i")
    assert distance_within("abc", "abd", 1) and not distance_within("abc", "xyz", 2)


def test_shortest_passages_with_misreadings_and_torn_words(spark):
    """Found wherever two neighbouring words are whole, however far the windows' fingerprints are apart."""
    r = random.Random(5)
    words = ["".join(r.choice("ka lo mi ter vun sha pel dri".split()) for _ in range(4)) for _ in range(40)]
    pages = []
    for d in range(40):
        cut = words[d % 28 : d % 28 + 12]
        for k in (2, 3, 6, 7, 10):
            at = r.randrange(1, len(cut[k]) - 1)
            cut[k] = cut[k][:at] + "x" + cut[k][at + 1 :]
        cut[5] = cut[5][:3] + " " + cut[5][3:]
        pages.append(page(d, [lines(noise(20) + cut + noise(20))]))
    assert leaks(spark, pages, [(1, " ".join(words), "x")]) == {(d, 1) for d in range(40)}


def test_pairs_of_words_as_one_by_one():
    letters = "abé中1"
    word = lambda most: "".join(rnd.choice(letters) for _ in range(rnd.randrange(most)))
    a = [word(14) for _ in range(3000)]
    b = [w[:2] + word(3) + w[3:] if rnd.random() < 0.8 else word(14) for w in a]
    assert near_pairs(a, b).tolist() == [near(x, y) for x, y in zip(a, b)] and near_pairs([], []).tolist() == []


def test_long_words_as_one_by_one():
    r = random.Random(8)
    a = ["".join(r.choice("aeinrt") for _ in range(r.randrange(1, 90))) for _ in range(1500)]
    b = []
    for w in a:
        w = list(w)
        for _ in range(r.randrange(1 + len(w) // 3)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = r.choice(["", "e", "in"])
            w = w or ["a"]
        b.append("".join(w))
    assert near_pairs(a, b).tolist() == [near(x, y) for x, y in zip(a, b)]


def test_cheap_tests_of_words_leave_out_none_that_are_near():
    r = random.Random(9)
    word = lambda: "".join(r.choice("aei" if r.random() < 0.5 else "eeeeeeeint\u0e01") for _ in range(r.randrange(1, 14)))
    vocabulary = sorted({word() for _ in range(300)} | {"e" * n for n in range(1, 12)})
    texts = [[r.choice(vocabulary) for _ in range(40)] for _ in range(8)]
    texts += [[w if r.random() < 0.5 else w[:1] + w[2:] or "a" for w in t] for t in texts]
    texts += [[x + y for x, y in zip(t[::2], t[1::2])] for t in texts]
    words = sorted({w for t in texts for w in t})
    ids, starts = np.array([words.index(w) for t in texts for w in t]), np.cumsum([0, *map(len, texts)])
    flat, place = _parted(ids, starts, -1), np.array([s + _GAP * (k + 1) + i for k, s in enumerate(starts[:-1]) for i in range(len(texts[k]))])
    at = lambda p: words[flat[p]] if flat[p] >= 0 else None
    pairs = _Pairs(np.where(flat < 0, -2, flat), flat, words, _shapes(words), flat, words, _shapes(words))
    p, q = np.repeat(place, len(place)), np.tile(place, len(place))
    p, q = p[::7], q[::7]
    for step in (1, -1):
        join = lambda x, y: None if x is None or y is None else x + y if step > 0 else y + x
        of = [(at(a), at(b), join(at(a), at(a + step)), join(at(b), at(b + step))) for a, b in zip(p.tolist(), q.tolist())]
        want = {(0, 0): [near(a, b) for a, b, _, _ in of], (step, 0): [a2 is not None and near(a2, b) for _, b, a2, _ in of], (0, step): [b2 is not None and near(a, b2) for a, _, _, b2 in of]}
        for more, bit in (((0, 0), 1), ((step, 0), 2), ((0, step), 4)):
            held = np.array(want[more])
            # misread() is asked of what isn't equal and what the lengths allow
            asked = np.flatnonzero((pairs.allowed(p, q, step) & bit) > 0)
            assert more == (0, 0) or held[asked].sum() == held.sum() > 20
            for pairs.exact in (True, False):
                got = pairs.near(p, q, step) if more == (0, 0) else pairs.misread(p[asked], q[asked], *more)
                own = held if more == (0, 0) else held[asked]
                assert (got == own).all() if pairs.exact else (got >= own).all() and got.mean() < 0.5


def test_few_words_are_compared_letter_by_letter(monkeypatch):
    """Equal neighbours everywhere: edit distances are counted for a few words, at once, and no passage is left out."""
    r = random.Random(10)
    vocabulary = ["".join(r.choice("aeinrthyp") for _ in range(r.randrange(2, 10))) for _ in range(60)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, text(40)) for k in range(40)]
    docs = [(d, text(150)) for d in range(40)]
    for d, words in docs[::2]:
        cut = items[d][1][7:20]
        cut[4], cut[9] = cut[4] + "x" if len(cut[4]) > 3 else cut[4], cut[9][:2] + "z" + cut[9][3:] if len(cut[9]) > 3 else cut[9]
        words[50:63] = cut
    calls, asked = [], near_pairs
    monkeypatch.setattr(leaks_module, "near_pairs", lambda a, b: calls.append(len(a)) or asked(a, b))
    side = WordSide(items, 12)
    found = {(d, i) for d, i, _, _ in side.find(docs)}
    seeds = [(d, i, p, q) for d, doc in docs for i, item in items for p in range(len(doc) - 1) for q in range(len(item) - 1) if doc[p] == item[q] and doc[p + 1] == item[q + 1]]
    assert found == {(d, i) for d, i, p, q in seeds if side.run(docs[d][1], items[i][1], p, q, set()) >= 12} >= {(d, d) for d in range(0, 40, 2)}
    assert len(seeds) > 2000 and sum(calls) <= 150  # 256 when lengths and the kinds of letters alone told which to compare
