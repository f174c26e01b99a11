import pytest

import __spark_entry__ as entry
from maskloom.plans import catalog

from .compare import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(catalog.queries()[name](spark, SF), SF, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(catalog.cases()))
def test_case_equals_its_sql(spark, name):
    query, sql = catalog.cases()[name]
    assert_same(query(spark, SF), SF, sql)


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, SF).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_orders_of_more_customers_than_four_digits_number(spark, tmp_path):
    customers = [(k, f"Customer#{k}") for k in (7, 1000, 9999, 10000, 100001)]
    spark.createDataFrame(customers, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(list(enumerate(k for k, _ in customers)), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.text for r in catalog.queries()["restore_orders"](spark, str(tmp_path)).collect()}
    assert got == {i: f"order of {name}, again {name}" for i, (_, name) in enumerate(customers)}
