"""Steps that take most of the time of large tables: that they run once, on all cores, and find what they found."""

import re

import pytest
from pyspark.sql import functions as F

from maskloom.functions.fixed import CYRILLIC, LATIN, NORMAL_FROM, NORMAL_TO
from maskloom.functions.spans import find
from maskloom.functions.text import clean, is_ascii, is_wide
from maskloom.operators.detect import ANY_CYRILLIC, all_spans, detectors, with_spans
from maskloom.operators.dictionary import with_dictionary
from maskloom.plans import catalog
from maskloom.plans.catalog import dealt


def test_resolving_runs_the_detectors_once(spark):
    """The plan of a dictionary of any size looks for a detector's pattern as often as that of the detectors alone."""
    texts, entries = spark.createDataFrame([(1, "клиент Иванов Иван")], "k long, text string"), spark.createDataFrame([("ORG", "Иванов")], "type string, entry string")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (with_spans(texts), with_dictionary(texts, entries, ["k"]))]
    alone, both = (p.count(r"\d{3}-\d{3}-\d{3}") for p in plans)
    assert alone == both > 0


def test_detectors_find_what_they_find_alone(spark):
    """Parts that need the same are looked for together; a detector of one's own, without parts, still runs on every text."""
    texts = ["a@b.example", "1234 567890", "12-34-56-78 90", "123 45 67 89", "Клиент Иванов Иван", "ИНН 1234567890", "ACME pays", "ТЕСТБАНК", "тестᲄбанк 1", "индекс 123456, г. Тверь", "", None]
    own = {"BANK": ["Тестбанк", "ACME"], "ORG": ["7 морей"]}
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    registry = detectors(own) | {"OWN": lambda text: find(text, "pays", "OWN", 99)}
    got = {r.k: sorted((s.type, s.value) for s in r.s) for r in df.select("k", all_spans(F.col("text"), registry).alias("s")).collect()}
    alone = [df.select("k", d(F.col("text")).alias("s")).collect() for d in registry.values()]
    assert got == {k: sorted((s.type, s.value) for rows in alone for r in rows if r.k == k for s in r.s or []) for k in range(len(texts))}
    assert got[6] == [("BANK", "ACME"), ("OWN", "pays")] and ("PHONE", "123 45 67 89") in got[3] and ("BANK", "ТЕСТБАНК") in got[7] and ("ADDR", "123456") in got[9]


def test_look_alikes_only_in_words_of_both(spark):
    words = ["Bанк", "банк-Bank", "bank банк", "пере-a", "а--b", "банK1Bank", "Тест­бaнк", " x", "a-б-c д", "", None]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = [r.c for r in df.select(clean(F.col("t")).alias("c")).collect()]

    def plain(t):
        if t is None:
            return None
        t = t.translate(str.maketrans(dict(zip(NORMAL_FROM, NORMAL_TO.ljust(len(NORMAL_FROM), "\0"), strict=True)))).replace("\0", "")
        fixed = lambda m: m[0].translate(str.maketrans(LATIN, CYRILLIC)) if re.search("[А-Яа-яЁё]", m[0]) else m[0]
        return re.sub("[A-Za-zА-Яа-яЁё]+(?:-[A-Za-zА-Яа-яЁё]+)*", fixed, t)

    assert got == [plain(w) for w in words]


def test_plain_texts_are_told_cheaply(spark):
    """No pattern of Cyrillic runs on texts without a wide character, and none where all are of one byte; nothing is lost by that."""
    found = spark.range(1).select(F.lit("").alias("text")).select(all_spans(F.col("text"), detectors({"ORG": ["Рога"]})).alias("s"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "RLIKE(text" in plan and 0 < plan.index("octet_length(text") < min(plan.index(x) for x in ("[А-Яа-яЁё]", ANY_CYRILLIC, "ИНН"))
    texts = [(i, chr(i)) for i in [*range(0xD800), *range(0xE000, 0x10000)]]
    df = spark.createDataFrame([(i, f"a{c}b") for i, c in texts] + [(-1, None), (-2, ""), (-3, "abc"), (-4, "\U0001d7ce")], "i int, t string")
    t = F.col("t")
    rows = df.select("i", "t", is_wide(t).alias("wide"), is_ascii(t).alias("ascii"), (t.rlike(ANY_CYRILLIC) | t.rlike("(?iU)[а-яё]")).alias("some"), clean(t).alias("clean")).collect()
    assert [r.i for r in rows if r.some and not r.wide] == [] and sum(bool(r.some) for r in rows) > 300
    assert all(r.ascii == r.t.isascii() for r in rows if r.t is not None)
    to = {c: NORMAL_TO[i : i + 1] for i, c in enumerate(NORMAL_FROM)}
    expected = {i: f"а{c}в" if re.match("[А-Яа-яЁё]", c) else f"a{to.get(c, c)}b" for i, c in texts}
    assert [r.i for r in rows if r.i >= 0 and r.clean != expected[r.i]] == []


@pytest.mark.parametrize("text", ["A_0001 B_00022 c_1 _ D_123", "plain", "", None, "é_ AB_1234"])
def test_entities_are_counted_in_any_text(spark, monkeypatch, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    monkeypatch.setattr(catalog, "documents", lambda *a: df)
    monkeypatch.setattr(catalog, "anonymise", lambda units, *a, **b: (units, None))
    out = catalog.flagship(spark, "")
    assert out.collect()[0].n_entities == (None if text is None else len(re.findall(r"[A-Z]+_\d{4}", text)))
    assert "contains" in out._jdf.queryExecution().analyzed().toString().lower()


def test_a_small_file_is_dealt_to_all_cores(spark, tmp_path):
    rows = spark.range(0, 100_000, 1, 1).select(F.col("id").alias("c_custkey"), F.sha1(F.col("id").cast("string")).alias("c_name"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    df = dealt(spark, str(tmp_path), "customer")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism and df.count() == 100_000


@pytest.mark.parametrize("name", ["review_contexts", "review_customers"])
def test_reviewed_customers_are_dealt_to_all_cores(spark, monkeypatch, name):
    """Their table is one small file, which alone would be one task for all detectors and contexts."""
    seen = []
    monkeypatch.setattr(catalog.review, "candidates", lambda units, *a: seen.append(units))
    monkeypatch.setattr(catalog.review, "grouped", lambda *a: spark.range(0).selectExpr(*(f"id AS {c}" for c in ("c_nationkey", "value", "type_guess", "reason", "count"))))
    catalog.queries()[name](spark, "/root/testdata/sf0.1")
    assert seen[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
