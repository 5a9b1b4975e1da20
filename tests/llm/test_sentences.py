"""Boundaries on made-up pages whose sentences are known."""

import random

from kestrelgrid.llm.sentence_split import corpus_counts, fit_model, split_sentences

from .pages import page, rows

rnd = random.Random(21)
NAMES = ["Tervun", "Osquen", "Kalomi", "Pelshar", "Dribart", "Mitofel", "Quenlo", "Sharvun"]
NOUNS = "mill tower ledger clerk ferry canal market lantern kiln chapel".split()
VERBS = "sold moved painted counted opened closed drained raised".split()
ENDS = ["at 7.25 p.m.", "near Lomi St.", "from the firm of Kalo & Co.", "without any notice.", "for 12 weeks.", "under lot No. 5.", "i.e. on the same day.", "after the long frost!", "on the far bank?", "at approx. 4.5 tons."]


def simple():
    who = rnd.choice([f"The {rnd.choice(NOUNS)}", f"Every {rnd.choice(NOUNS)}", f"A {rnd.choice(NOUNS)}", f"Mr. {rnd.choice(NAMES)}", f"Prof. {rnd.choice('BDK')}. {rnd.choice(NAMES)}"])
    return f"{who} {rnd.choice(VERBS)} the {rnd.choice(NOUNS)} {rnd.choice(ENDS)}"


def sentence():
    kind = rnd.random()
    if kind < 0.75:
        return [simple()]
    if kind < 0.83:
        return [f"“The {rnd.choice(NOUNS)} {rnd.choice(VERBS)} a {rnd.choice(NOUNS)}!” cried the keeper."]
    if kind < 0.9:
        return [f"The {rnd.choice(NOUNS)} {rnd.choice(VERBS)} a {rnd.choice(NOUNS)} (Mrs. {rnd.choice(NAMES)} {rnd.choice(VERBS)} it)."]
    return [f"“The {rnd.choice(NOUNS)} fell.", f"A {rnd.choice(NOUNS)} rose.”"]


def wrapped(sentences, width=34):
    """(lines, ends): words broken over lines now and then."""
    text, marks = " ".join(sentences), []
    at = 0
    for s in sentences:
        at += len(s)
        marks.append(at)
        at += 1
    lines, line, ends, pos = [], "", [], 0
    for word in text.split(" "):
        if len(line) + len(word) + (line != "") > width:
            lines.append(line)
            line = ""
        line += (" " if line else "") + word
        pos += len(word)
        if pos in marks:
            ends.append((len(lines), len(line)))
        pos += 1
    lines.append(line)
    return lines, ends


def corpus(n):
    pages, truth = [], set()
    for d in range(n):
        lines, ends = wrapped([x for _ in range(12) for x in sentence()])
        cells = [("head", "COUNCIL DIVIDED"), *lines]
        p = page(d, [cells])
        starts = [0]
        for line in p[1].split("\n"):
            starts.append(starts[-1] + len(line) + 1)
        truth |= {(d, starts[1 + k] + c) for k, c in ends}
        pages.append(p)
    return pages, truth


def cut(spark, df, **kw):
    return {tuple(r) for r in split_sentences(df, fit_model(df, None), None, **kw).collect()}


def test_learned_boundaries(spark):
    pages, truth = corpus(250)
    got = cut(spark, rows(spark, pages))
    right = len(got & truth)
    assert right / len(truth) > 0.98 and right / len(got) > 0.98, (sorted(truth - got)[:5], sorted(got - truth)[:5])


def test_words_seen_once_behind_an_abbreviation_count(spark):
    """Of what follows an abbreviation, each name but once, nothing is left out."""
    names = [f"{a}{b}{c}" for a in ("Ter", "Os", "Ka") for b in ("vun", "quen", "lom", "shar") for c in ("ato", "eli", "ira", "omu")]
    said = [f"The {NOUNS[k % 10]} of Capt. {name} {VERBS[k % 8]} the {NOUNS[k % 7]}!" for k, name in enumerate(names)]
    pages = [page(k, [wrapped(said[k : k + 4] + ["The mill sold the capt tower!"])[0]]) for k in range(0, len(said), 4)]
    df = rows(spark, pages)
    model = fit_model(df, None)
    assert "capt" in model.abbreviations["en"] and "capt" in model.binding["en"]


def texts(spark, pages):
    df = rows(spark, pages)
    return {r.sentence for r in split_sentences(df, fit_model(df, None), None, with_text=True).collect()}


def test_other_scripts(spark):
    zh = "旧仓库弄丢了账簿，门牌26号。“镇议会重漆了账簿？”看守喊道。新桥花费3.5元！「邮车来了。」"
    ja = "灯台守は帳簿を閉めた。『郵便馬車は帳簿を閉めた！』と番人が叫んだ。合唱隊は鐘を閉めた…"
    hi = "डॉ. हरतन पुल गिनता रहा। नया पुल बेच चुका है! पुराना गोदाम गया।"
    got = texts(spark, [page(100 + k, [[t]]) for t in (zh, ja, hi) for k in range(5)])
    for want in ("旧仓库弄丢了账簿，门牌26号。", "新桥花费3.5元！", "「邮车来了。」", "灯台守は帳簿を閉めた。", "合唱隊は鐘を閉めた…", "नया पुल बेच चुका है!", "पुराना गोदाम गया।", "“镇议会重漆了账簿？”看守喊道。", "『郵便馬車は帳簿を閉めた！』と番人が叫んだ。"):
        assert want in got, (want, got)


def test_broken_word_and_no_mark(spark):
    p = page(1, [["The mill sold a tow-", "er. The ferry lit the", "road without end", ("head", "Notes"), "It rained."]])
    df = rows(spark, [p])
    ends = sorted(r.end_pos for r in split_sentences(df, fit_model(df, None), None).collect())
    text = p[1]
    assert ends == [text.index("er.") + 3, text.index("end") + 3, len(text)]


def test_nulls_and_empty(spark):
    odd = [(1, None, 1, None, None, None, ""), (2, "", 1, None, None, None, ""), (3, " \n ", 1, None, None, None, ""), (None, "It rained.", 1, None, None, None, ""), (4, "— 5 —\n...", 1, None, None, None, "")]
    df = rows(spark, odd)
    assert corpus_counts(df, None).count() >= 0 and cut(spark, df) == set()
    assert cut(spark, df.limit(0)) == set()
    long = "The mill sold a tower. " * 20_000
    assert len(cut(spark, rows(spark, [(1, long, 1, None, None, None, "")]))) == 20_000
