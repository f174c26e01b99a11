"""Cases against all pairs, counted plainly."""

import random
from itertools import combinations, product

from pyspark.sql import functions as F

from maskloom.operators.coverage import covered_pairs, negative_checklist, pairwise, positive_checklist, prime_from
from maskloom.operators import spec
from maskloom.plans import fixtures as X


def test_primes(spark):
    got = [r.p for r in spark.range(2, 60).select(prime_from(F.col("id")).alias("p")).collect()]
    assert got == [next(x for x in range(n, 200) if all(x % y for y in range(2, x))) for n in range(2, 60)]


def test_any_two_values_of_any_two_factors_meet(spark):
    rnd = random.Random(2)
    sizes = {g: [rnd.randrange(1, 2 + g % 6) for _ in range(n)] for g, n in enumerate([1, 2, 3, 4, 5, 9, 10, 17, 28, 40])}
    rows = [(g, f, [f"{f}:{v}" for v in range(n)], f"note {f}") for g, own in sizes.items() for f, n in enumerate(own)]
    cases = pairwise(spark.createDataFrame(rows, "g int, f int, values array<string>, note string"), "g", ["f"])
    assert cases.columns == ["g", "f", "values", "note", "case", "value"]
    got = {}
    for r in cases.collect():
        assert r.value in r["values"] and (r.g, r.case, r.f) not in got
        got[r.g, r.case, r.f] = r.value
    for g, own in sizes.items():
        n_cases = 1 + max(c for h, c, _ in got if h == g)
        assert {c for h, c, _ in got if h == g} == set(range(n_cases))
        for (f, n), (f2, n2) in combinations(enumerate(own), 2):
            met = {(got[g, c, f], got[g, c, f2]) for c in range(n_cases)}
            assert met == set(product([f"{f}:{v}" for v in range(n)], [f"{f2}:{v}" for v in range(n2)]))
        p = next(x for x in range(max(2, *own, 2), 99) if all(x % y for y in range(2, x)))
        digits = sum(p**d <= len(own) - 1 for d in range(20))
        assert n_cases == p + p * (p - 1) * digits
    pairs = {r.g: r.pairs for r in covered_pairs(cases, "g", "f").collect()}
    assert pairs == {g: sum(a * b for a, b in combinations(own, 2)) for g, own in sizes.items() if len(own) > 1}


def test_factors_without_values_and_no_factors(spark):
    rows = [("a", 1, []), ("a", 2, None), ("a", 3, ["x", "y"])]
    cases = pairwise(spark.createDataFrame(rows, "g string, f int, values array<string>"), "g", ["f"]).collect()
    assert {r.value for r in cases if r.f < 3} == {None} and {r.value for r in cases if r.f == 3} == {"x", "y"}
    assert pairwise(spark.createDataFrame([], "g string, f int, values array<string>"), "g", ["f"]).count() == 0


def test_lists_of_fields_that_may_and_may_not_be_filled(spark):
    params = spec.parameters(X.frame(spark, X.CELLS)).cache()
    rows = params.collect()
    shut = {r.id for r in rows if r.availability and r.availability.interpreted in ("read_only", "not_available")}
    auto = {r.id for r in rows if r.input_method and r.input_method.auto}
    assert {r.id for r in positive_checklist(params).collect()} == {r.id for r in rows if not r.ui.hidden} - shut - auto
    negative = {(r.id, r.expectation) for r in negative_checklist(params).collect()}
    assert {i for i, e in negative if e == "изменение невозможно"} == shut
    assert {i for i, e in negative if e == "ошибка"} == {r.id for r in rows if r.required.status == "required"}
