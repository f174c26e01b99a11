import random

import pytest

from maskloom.functions.spans import kept_spans
from maskloom.operators.intervals import meeting

import numpy as np


@pytest.mark.parametrize("wide", [3, 70, 1000])
def test_meeting_equals_all_pairs(spark, wide):
    r = random.Random(wide)
    some = lambda n: [(r.randint(0, 3), i, a, a + r.randint(0, wide)) for i in range(n) for a in [r.randint(0, 3000)]]
    rows, spans = some(300), some(40) + [(0, 40, 64, 128), (1, 41, 63, 64), (2, 42, 0, 64)]
    shape = "unit int, id int, start int, end int"
    got = sorted(x.id for x in meeting(spark.createDataFrame(rows, shape), spark.createDataFrame(spans, shape).select("unit", "start", "end"), ["unit"], "id").collect())
    assert got == sorted(i for u, i, a, b in rows if a < b and any(u == v and c < d and a < d and b > c for v, _, c, d in spans))


def test_thousands_over_each_other_form_no_pairs(spark):
    rows = spark.range(200_000).selectExpr("0 AS unit", "id", "id % 50 AS start", "id % 50 + 20 AS end")
    assert meeting(rows, rows.select("unit", "start", "end"), ["unit"], "id").count() == 200_000


def greedy(start, end, order):
    kept = []
    for i in sorted(range(len(start)), key=lambda i: (start[i] - end[i], start[i], order[i])):
        if all(not (start[i] < end[k] and end[i] > start[k]) for k in kept):
            kept.append(i)
    return sorted(kept, key=lambda i: start[i])


@pytest.mark.parametrize("seed", range(30))
def test_kept_spans_are_those_of_the_greedy_rule(seed):
    r = random.Random(seed)
    n, most = r.choice([0, 1, 5, 80, 300]), r.choice([3, 30, 400])
    start = np.array([r.randint(0, r.choice([20, 500])) for _ in range(n)], np.int64)
    end = start + np.array([r.randint(1, most) for _ in range(n)], np.int64)
    order = np.array([r.randint(0, 12) for _ in range(n)], np.int64)
    got, want = kept_spans(start, end, order).tolist(), greedy(start.tolist(), end.tolist(), order.tolist())
    assert [(start[i], end[i], order[i]) for i in got] == [(start[i], end[i], order[i]) for i in want]
