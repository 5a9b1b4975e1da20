import pytest

from kestrelgrid.llm.mixing import SourceClassifier, _Mix, fit_classifier, mix_sources, sized_members, solve_rates

from .pages import rows

TARGET = "mix_name string, source string, target_share double, max_repeats int, text string"


def documents(spark, sizes):
    pages = []
    for s, n in sizes.items():
        for k in range(n):
            text = f"{s} page {k}\n" + f"the {s} moved tower {k} " * (3 + k % 5)
            pages.append((len(pages), text, 1, None, s, None, ""))
    return pages


@pytest.fixture(scope="module")
def pages():
    return documents(None, {"harrow-ledger": 300, "echo": 90, "tiny": 6})


def mixed(spark, pages, targets, **kw):
    d = rows(spark, pages)
    taken, report = mix_sources(d, spark.createDataFrame([(*t, "x") for t in targets], TARGET), fit_classifier(d), **kw)
    return taken.collect(), {(r.mix_name, r.source): r for r in report.collect()}


def test_shares_and_repeats(spark, pages):
    odd = [(9000, "harrow-ledger page\n" + "the harrow-ledger moved tower " * 5, 1, None, None, None, ""), (9001, "harrow-ledger", 1, None, " Harrow Ledger", None, ""), (9002, None, 1, None, "echo", None, ""), (9003, "", 1, None, "echo", None, "")]
    targets = [("m", "harrow-ledger", 0.5, 1), ("m", "echo", 0.3, 2), ("m", "tiny", 0.2, 8), ("n", "tiny", 0.6, 3), ("n", "ghost", 0.4, 2)]
    taken, report = mixed(spark, pages + odd + pages[:3], targets)
    for (mix, source), r in report.items():
        if mix == "m":
            assert abs(r.reached_share - r.target_share) < 0.03 and r.miss <= 1e-6, r
    assert report["n", "ghost"].reached_share == 0 and report["n", "ghost"].tokens == 0
    # the small source bounds the whole, so all its documents are taken as often as they may be
    assert report["n", "tiny"].copies == 18 and report["n", "tiny"].reached_share == 1.0
    caps = {(m, s): c for m, s, _, c in targets}
    assert all(1 <= r.copies <= caps[r.mix_name, r.source] for r in taken)
    assert len({(r.mix_name, r.doc_id) for r in taken}) == len(taken)
    assert not {r.doc_id for r in taken} & {9002, 9003}


def test_shares_within_a_document(spark, pages):
    targets = [("m", "harrow-ledger", 0.55, 2), ("m", "echo", 0.35, 3), ("m", "tiny", 0.1, 40), ("n", "harrow-ledger", 0.5, 1), ("n", "echo", 0.5, 1)]
    taken, report = mixed(spark, pages, targets)
    longest = max(r.tokens for r in taken)
    for mix in "mn":
        whole = sum(r.tokens for (m, _), r in report.items() if m == mix)
        for (m, source), r in report.items():
            assert m != mix or abs(r.tokens - r.target_share * whole) <= 2 * longest, r


def test_soft_members_meet_the_targets_in_few_steps(spark, pages):
    # half of echo and ledger unnamed, so that their documents are between the two
    unnamed = [(p[0], p[1], *p[2:4], None if p[0] % 2 else p[4], *p[5:]) for p in pages]
    d = rows(spark, unnamed)
    sized = sized_members(d, fit_classifier(d)).cache()
    mix = _Mix("m", {"harrow-ledger": (0.6, 1), "echo": (0.3, 2), "tiny": (0.1, 30)})
    solve_rates(sized, [mix])
    assert mix.miss <= 1e-6 and 1 <= mix.steps <= 12
    assert any(len(r.member) > 1 for r in sized.collect())


def test_more_than_there_is(spark, pages):
    taken, report = mixed(spark, pages, [("m", "echo", 0.5, 2), ("m", "tiny", 0.5, 2)], total_tokens=1e9)
    assert {r.copies for r in taken} == {2} and report["m", "echo"].documents == 90 and report["m", "tiny"].documents == 6


def test_empty(spark, pages):
    d = rows(spark, pages)
    none = spark.createDataFrame([], TARGET)
    taken, report = mix_sources(d, none, None)
    assert taken.count() == 0 and report.count() == 0
    taken, report = mix_sources(d.limit(0), spark.createDataFrame([("m", "echo", 1.0, 2, "x"), ("m", None, 0.1, 2, "x"), ("m", "null", None, None, "x")], TARGET), None)
    assert taken.count() == 0 and {r.reached_share for r in report.collect()} == {0.0}


def test_classifier(pages):
    c = SourceClassifier([(p[4], p[1]) for p in pages])
    top = c.posterior("tiny page 77\nthe tiny moved tower")
    assert top[0][0] == "tiny" and abs(sum(p for _, p in top) - 1) < 1e-9
    assert SourceClassifier([]).posterior("x") == []
