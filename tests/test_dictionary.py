"""Dictionaries of any size against a plain search of every entry in every text."""

import random
import re

import pytest

from maskloom.functions.fixed import LETTERS
from maskloom.operators import dictionary as D


def plain(texts, entries):
    out = set()
    for kind, entry in {e for e in entries if e[1]}:
        plus = kind == "PRODUCT" and "+" in entry
        body = r"\s*\+\s*".join(re.escape(p.strip()) for p in entry.split("+")) if plus else re.escape(entry)
        for i, text in texts:
            for m in re.finditer(f"(?i)(?<![{LETTERS}]){body}(?![{LETTERS}])", text or ""):
                value = re.sub(r"\s*\+\s*", " + ", m[0]).strip() if plus else m[0]
                out.add((i, value, kind, m.start(), m.end()))
    return out


def found(spark, texts, entries):
    units = spark.createDataFrame(texts, "unit long, body string")
    rows = D.dictionary_spans(units, spark.createDataFrame(entries, "type string, entry string"), ["unit"], "body").collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {(r.unit, r.value, r.type, r.start, r.end) for r in rows}


WORDS = ["ООО", "АО", "Банк", "Рога", "и", "Копыта", "Юг", "1С", "24", "247", "7", "alpha", "АЛЬФА", "«", "»", "++", "+", "-", "日本", "é", "№", "§§", "a", "аа", " ", ", ", "\n"]


@pytest.mark.parametrize("block", [D.BLOCK, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_and_entries(spark, seed, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", block)
    r = random.Random(seed)
    some = lambda n: "".join(r.choice(WORDS) + r.choice(["", " ", " "]) for _ in range(n))
    entries = [(r.choice(["ORG", "BANK", "PRODUCT"]), some(r.randint(1, 4)).strip()) for _ in range(150)] + [("ORG", None), ("ORG", ""), ("ORG", "«»"), ("ORG", "++"), ("ORG", "ООО"), ("ORG", "ООО"), ("ORG", "24/7"), ("PRODUCT", "Юг + Рога"), ("ORG", "7")]
    texts = [(i, some(r.randint(0, 60))) for i in range(60)] + [(900, None), (901, ""), (902, "юг+РОГА Юг  +\tрога аЮг + Рога «»«» +++ ООО ООО 247 24/78")]
    assert found(spark, texts, entries) == plain(texts, entries)


def test_entries_over_themselves_and_at_the_ends_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    texts = [(1, "а а а а а " * 9), (2, "ООО Рога" * 1 + "." * 7 + "ООО Рога" + "." * 8 + "ООО Рога"), (3, "12 12 12 123"), (4, "x" * 15 + " ООО Рога " + "y" * 40)]
    entries = [("ORG", "а а"), ("ORG", "ООО Рога"), ("ORG", "12 12"), ("ORG", "..")]
    assert found(spark, texts, entries) == plain(texts, entries)


def test_hot_first_words_cost_no_pairs(spark):
    """Every text begins with the word that every entry begins with; only true matches become candidates."""
    n = 20_000
    units = spark.range(n).selectExpr("id AS unit", "concat('Поставщик ООО Customer#', lpad(cast(id AS string), 9, '0'), ' поставил') AS body")
    entries = spark.range(n).selectExpr("'ORG' AS type", "concat('ООО Customer#', lpad(cast(id AS string), 9, '0')) AS entry")
    assert D.candidates(units, entries, ["unit"], "body")[1].count() <= 2 * n
    assert D.dictionary_spans(units, entries, ["unit"], "body").count() == n


def test_empty_dictionary_and_empty_texts(spark):
    units, entries = spark.createDataFrame([(1, "ООО Рога")], "unit long, body string"), spark.createDataFrame([("ORG", "ООО Рога")], "type string, entry string")
    assert D.dictionary_spans(units, entries.limit(0), ["unit"], "body").collect() == []
    assert D.dictionary_spans(units.limit(0), entries, ["unit"], "body").collect() == []
