import random

from kestrelgrid.llm.nearest_time import match_nearest

LEFT, RIGHT = "entity string, left_id bigint, t_ms bigint, tol_ms bigint, right_id string", "entity string, right_id bigint, t_ms bigint, tol_ms bigint, left_id string"


def matches(spark, left, right):
    df = match_nearest(spark.createDataFrame([(*r, "x") for r in left], LEFT), spark.createDataFrame([(*r, "y") for r in right], RIGHT))
    rows = df.collect()
    got = {(r.entity, r.left_id): (r.right_id, r.apart_ms) for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_brute_force(spark):
    rnd = random.Random(9)
    tol = {"hot": 37, "b": 250, "c": 0}
    left = [(e, k, rnd.randrange(-2000, 2000), tol[e]) for e in tol for k in range(120)]
    right = [(e, rnd.randrange(10_000), rnd.randrange(-2000, 2000), tol[e]) for e in ("hot", "hot", "b", "c", "d") for _ in range(150)  if e in tol]
    right += right[:20]
    want = {}
    for e, k, t, w in left:
        near = [(abs(t - u), i) for f, i, u, _ in right if f == e and abs(t - u) <= w]
        if near:
            d, i = min(near)
            want[e, k] = (i, d)
    assert matches(spark, left, right) == want and len(want) > 100


def test_ties_nulls_and_empty(spark):
    assert matches(spark, [("a", 1, 100, 10)], [("a", 7, 90, 10), ("a", 5, 110, 10), ("a", 9, 100 - 11, 10)]) == {("a", 1): (5, 10)}
    left = [("a", 1, None, 10), (None, 2, 5, 10), ("a", 3, 5, None), ("a", 4, 5, -1), ("a", 5, 5, 0), ("a", 5, 5, 0)]
    assert matches(spark, left, [("a", 1, 5, 0), ("a", 2, None, 0), (None, 3, 5, 0), ("a", None, 5, 0)]) == {("a", 5): (1, 0)}
    assert matches(spark, [], [("a", 1, 5, 0)]) == {} and matches(spark, left, []) == {}
