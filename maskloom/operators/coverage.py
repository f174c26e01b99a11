"""Test lists over a form's parameters: positive, negative, and all pairs of values in few cases. Our own design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pseudonyms import ranked
from .spec import required_checklist

#: What a field is tried with: filled in, left empty, and its default where it has one.
FILLED, EMPTY, DEFAULT = "filled", "empty", "default"


def prime_from(n: Column) -> Column:
    """The smallest prime that is n or more, for n from 2 on."""
    is_prime = lambda x: F.forall(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(F.sqrt(x)).cast("int"))), lambda y: (x == y) | (x % y != 0))
    return F.filter(F.sequence(n.cast("int"), 2 * n.cast("int")), is_prime)[0]


def pairwise(factors: DataFrame, group: str, order: list[str], values: str = "values") -> DataFrame:
    """factors with case (from 0 in each group) and value: any two values of any two factors of a group meet in some case.

    p is the smallest prime that no factor of the group has more values than, i a factor's place in its group by order. Case (a, b, d)
    gives the factor value a + b * (digit d of i to base p), modulo p. Two places differ in some digit x, y; there (a + bx, a + by)
    runs through all p * p pairs. So a group of n factors takes p + p(p - 1) * (digits of n - 1) cases, and each row comes from its
    own factor alone: nothing is searched, and no group is in one task. group: a column that is never null. A factor without values has null ones.
    """
    n_values = F.greatest(F.size(F.coalesce(values, F.array().cast(factors.schema[values].dataType))), F.lit(1))
    placed = ranked(factors, group, order, "_i").withColumn("_i", F.col("_i") - 1)
    sizes = placed.groupBy(group).agg((F.count("*") - 1).alias("_last"), prime_from(F.greatest(F.max(n_values), F.lit(2))).alias("_p"))
    digits = F.when(F.col("_last") == 0, 0).otherwise(F.length(F.conv(F.col("_last").cast("string"), 10, 2)))  # by halves, then by p
    sizes = sizes.withColumn("_digits", F.size(F.filter(F.sequence(F.lit(0), digits), lambda d: F.pow(F.col("_p"), d) <= F.col("_last"))))
    p, x = F.col("_p"), F.col("case") - F.col("_p")
    digit = F.floor(F.col("_i") / F.pow(p, F.floor(x / (p * (p - 1))))) % p
    value = F.when(x < 0, F.col("case")).otherwise((x % p + (F.floor(x / p) % (p - 1) + 1) * digit) % p)
    cases = placed.join(sizes, group).withColumn("case", F.explode(F.sequence(F.lit(0), p * (p - 1) * F.col("_digits") + p - 1)))
    return cases.withColumn("value", F.get(F.col(values), (value % n_values).cast("int"))).drop("_i", "_last", "_p", "_digits")


def covered_pairs(cases: DataFrame, group: str, factor: str) -> DataFrame:
    """(group, pairs): how many pairs of values of two factors the cases hold. For checks: it puts each two factors of a group side by side."""
    one, two = cases.select(group, "case", F.col(factor).alias("f"), F.col("value").alias("v")), cases.select(group, "case", F.col(factor).alias("f2"), F.col("value").alias("v2"))
    met = one.join(two, [group, "case"]).filter("f < f2")
    return met.select(group, "f", "v", "f2", "v2").distinct().groupBy(group).agg(F.count("*").alias("pairs"))


def with_values(params: DataFrame) -> DataFrame:
    """Parameters with the values they are tried with, and the part of the form (sheet and block) in which pairs are tried."""
    default = F.when(F.col("default_value.status") == "has_default", F.array(F.lit(DEFAULT))).otherwise(F.array().cast("array<string>"))
    part = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("sheet_index").cast("string"), F.coalesce("block", F.lit("")))
    return params.withColumn("values", F.concat(F.array(F.lit(FILLED), F.lit(EMPTY)), default)).withColumn("part", part)


def full_checklist(params: DataFrame) -> DataFrame:
    """(doc_id, block, case, id, row, value, step): cases for each block of a form; in its cases all pairs of values of two of its fields are met."""
    tried = with_values(params).select("doc_id", "block", "id", "row", "name", "values", "part")
    done = pairwise(tried, "part", ["row"])
    name = lambda verb: F.concat(F.lit(f"{verb} поле «"), F.col("name"), F.lit("»"))
    step = F.when(F.col("value") == FILLED, name("Заполнить")).when(F.col("value") == EMPTY, name("Оставить пустым")).otherwise(name("Не изменять"))
    return done.select("doc_id", "block", "case", "id", "row", "value", step.alias("step"))


def positive_checklist(params: DataFrame) -> DataFrame:
    """(doc_id, id, row, step, expectation) for fields that a user sees and may fill in."""
    closed = F.coalesce(F.col("availability.interpreted").isin("read_only", "not_available"), F.lit(False)) | F.coalesce(F.col("input_method.auto"), F.lit(False))
    step = F.concat(F.lit("Заполнить поле «"), F.col("name"), F.lit("» допустимым значением"))
    return params.filter(~closed & ~F.col("ui.hidden")).select("doc_id", "id", "row", step.alias("step"), F.lit("принято").alias("expectation"))


def negative_checklist(params: DataFrame) -> DataFrame:
    """(doc_id, id, step, expectation): required fields left empty, and fields that must not be changed."""
    locked = params.filter(F.col("availability.interpreted").isin("read_only", "not_available"))
    step = F.concat(F.lit("Изменить поле «"), F.col("name"), F.lit("»"))
    return required_checklist(params).unionByName(locked.select("doc_id", "id", step.alias("step"), F.lit("изменение невозможно").alias("expectation")))
