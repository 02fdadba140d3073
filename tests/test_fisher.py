"""Fisher's exact test against sums of binomial coefficients."""

import math
import random

import pytest

from ultradia.functions.dist import fisher_two_sided
from ultradia.operators import stats


def brute(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    ways = {k: math.comb(row, k) * math.comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
    return sum(w for w in ways.values() if w <= ways[a]) / sum(ways.values())


def test_tables_equal_brute_force():
    rng = random.Random(1)
    for t in [(0, 0, 0, 0), (0, 5, 5, 0), (3, 0, 0, 0)] + [tuple(rng.randrange(0, 30) for _ in range(4)) for _ in range(200)]:
        assert fisher_two_sided(*t) == pytest.approx(brute(*t), rel=1e-6)


def test_groups_against_the_rest(spark):
    rows = [("x", "m")] * 8 + [("x", "f")] * 2 + [("y", "m")] + [("y", "f")] * 9 + [(None, "m"), ("x", None)] + [("z", "m")] * 4
    got = {(r.grp, r.trait): ((r.a, r.b, r.c, r.d), r.p) for r in stats.fisher_one_vs_rest(spark.createDataFrame(rows, "g string, t string"), "g", "t").collect()}
    assert got[("x", "m")][0] == (8, 2, 5, 9) and got[("z", "f")][0] == (0, 4, 11, 9) and len(got) == 6
    assert all(p == pytest.approx(brute(*t), rel=1e-6) for t, p in got.values())
    assert stats.fisher_one_vs_rest(spark.createDataFrame([], "g string, t string"), "g", "t").count() == 0
