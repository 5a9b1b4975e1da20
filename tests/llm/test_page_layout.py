import random

from kestrelgrid.llm.page_layout import ADVERT, BODY, HEADLINE, learn_kinds, page_lines

from .pages import page

COLUMNS = [[("head", "Council divided"), "The mill sold a", "tower. The bell", ("advert", "+ + +"), ("advert", "Why pay more?"), "moved a clerk."], ["A ferry lit the", "long road home.", ("head", "Notes and notices"), "It was closed."]]


def read(p, kinds=None):
    _, text, n, boxes, *_ = p
    xs = [[b[k] for b in boxes] for k in (0, 1, 2)] if boxes else (None, None, None)
    return [(kind, text[s:e]) for kind, s, e in page_lines(text, n, *xs, kinds)]


def want():
    names = {"head": HEADLINE, "advert": ADVERT}
    return [(names[c[0]], c[1]) if isinstance(c, tuple) else (BODY, c) for column in COLUMNS for c in column]


def test_order_is_that_of_the_boxes():
    assert read(page(1, COLUMNS)) == want()
    assert read(page(1, COLUMNS, shuffle=random.Random(3).shuffle)) == want()


def test_merged_rows_are_cut():
    kinds = learn_kinds([(p[1], p[2], *[[b[k] for b in p[3]] for k in (0, 1, 2)]) for p in (page(k, COLUMNS) for k in range(30))])
    for mark in ("  |  ", "\t", "   "):
        assert read(page(1, COLUMNS, merged=mark), kinds) == want(), mark


def test_a_column_that_ended_stays_ended():
    columns = [["a one", "a two"], ["b one", "b two", "b three"], ["c one"]]
    p = page(1, columns, merged="  |  ")
    assert [t for _, t in read(p)] == ["a one", "a two", "b one", "b two", "b three", "c one"]


def test_without_boxes():
    assert read((1, "one\n\ntwo", None, None)) == [(BODY, "one"), (BODY, "two")]
    assert read((1, "", 1, None)) == []


def test_nulls_in_boxes():
    _, text, n, boxes, *_ = page(1, COLUMNS, merged="  |  ")
    xs = [[b[k] for b in boxes] for k in (0, 1, 2)]
    whole = [t for _, t in read(page(1, COLUMNS, merged="  |  "))]
    assert [text[s:e] for _, s, e in page_lines(text, n, xs[0], xs[1], [None] * len(boxes))] == whole
    assert page_lines(text, n, [None, *xs[0][1:]], xs[1], xs[2]) and page_lines(text, None, *xs) and page_lines(text, -3, xs[0][:-1], xs[1], xs[2])
    assert page_lines("one\ntwo", 2, [], [], []) == [(BODY, 0, 3), (BODY, 4, 7)]


def test_unknown_number_of_columns():
    for columns in (COLUMNS[:1], COLUMNS, [*COLUMNS, ["A clerk sold", "two lanterns."]]):
        for merged in (None, "  |  ") if len(columns) > 1 else (None,):
            p = page(1, columns, merged=merged)
            for n in (None, 0):
                assert read((p[0], p[1], n, p[3])) == read(p), (len(columns), merged, n)


def test_no_line_is_lost_where_no_number_of_columns_fits():
    text, x0, y0 = "head\na one\nb one\na two\nb two", [900, 300, 1500, 320, 1490], [100, 300, 300, 340, 340]
    found = page_lines(text, None, x0, y0, [x + 90 for x in x0])
    assert [text[s:e] for kind, s, e in found if kind == BODY] == ["a one", "a two", "b one", "b two"]
