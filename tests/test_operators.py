import json
import random

import pytest
from pyspark.sql import functions as F

from maskloom.functions import text as T
from maskloom.functions.fixed import LONG_TOKEN, NORMAL_FROM, NORMAL_TO, PATTERNS
from maskloom.operators import review, spec
from maskloom.operators.detect import detectors, with_spans
from maskloom.operators.dictionary import dictionary_spans
from maskloom.operators.preview import totals
from maskloom.operators.pseudonyms import anonymise, check_types, ranked, restored, restored_json, token_counts
from maskloom.plans import fixtures as X
from maskloom.plans.runs import anonymise_known, preview

from . import model

ONLY_PATTERNS = sorted({k for k, _, _ in PATTERNS})


def random_texts(n, seed):
    r = random.Random(seed)
    bits = ["ИНН ", "771234567890", "7712345678", "паспорт ", "4001 654321", "40 01", "СНИЛС", ": ", "111-222-333 44", "+7 (812) 555-10-20", "8", "(495)", "123-45-67", " ", " ", ",", "a@b.ru", "x", "счёт ", "40700000000000000001", "5500 0000 0000 0004", " ", "­", "слово", "Cлово", "\n", "😀"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_spans_equal_the_model(spark):
    texts = random_texts(400, 1)
    registry = {k: v for k, v in detectors().items() if k in ONLY_PATTERNS}
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for row in with_spans(df, registry=registry).collect():
        t = model.clean(texts[row.i])
        assert row.text == t
        assert [(s.value, s.type, s.start, s.end) for s in row.spans] == [s[:4] for s in model.spans(t)], texts[row.i]


def test_numbering_equals_the_model_and_restores(spark):
    texts = random_texts(300, 2)
    registry = {k: v for k, v in detectors().items() if k in ONLY_PATTERNS}
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    after, mapping = anonymise(df, ["i"], registry=registry)
    expected, known = model.anonymise(texts)
    assert {(r.type, r.original): r.pseudonym for r in mapping.collect()} == known
    assert [r.text for r in after.orderBy("i").collect()] == expected
    back = [r.text for r in restored(after, mapping).orderBy("i").collect()]
    same = [a == b for a, b in zip(back, (model.clean(t) for t in texts), strict=True)]
    assert sum(same) > 280  # values whose blanks were stripped don't come back as they were


def test_second_run_keeps_numbers(spark):
    first = spark.createDataFrame([(0, "a@b.ru c@d.ru")], "i long, text string")
    _, mapping = anonymise(first, ["i"])
    after, later = anonymise(spark.createDataFrame([(0, "e@f.ru a@b.ru")], "i long, text string"), ["i"], mapping)
    assert after.first().text == "EMAIL_0003 EMAIL_0002"
    assert {r.original: r.pseudonym for r in later.collect()} == {"c@d.ru": "EMAIL_0001", "a@b.ru": "EMAIL_0002", "e@f.ru": "EMAIL_0003"}


def test_known_values_only(spark):
    df = spark.createDataFrame([(0, "a@b.ru x@y.ru")], "i long, text string")
    mapping = spark.createDataFrame([("EMAIL", "a@b.ru", "EMAIL_0007")], "type string, original string, pseudonym string")
    assert anonymise_known(df, mapping).first().text == "EMAIL_0007 x@y.ru"


def test_preview_and_types(spark):
    row = preview(spark.createDataFrame([(0, "пишите a@b.ru")], "i long, text string"), ["i"]).first()
    assert (row.before, row.after) == ("пишите a@b.ru", "пишите EMAIL_0001")
    with pytest.raises(ValueError):
        check_types(spark.createDataFrame([("X", "a", "X_1")], "type string, original string, pseudonym string"))


def test_five_digits(spark):
    assert spark.range(1).select(T.pseudonym(F.lit("PERSON"), F.lit(12345))).first()[0] == "PERSON_12345"


def test_ranked_is_total(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("o"))
    got = sorted((r.g, r.o, r.rank) for r in ranked(df, "g", ["o"]).collect())
    expected = []
    for g in range(3):
        expected += [(g, o, i + 1) for i, o in enumerate(sorted(-x for x in range(1000) if x % 3 == g))]
    assert got == sorted(expected)


def test_dictionary_join_equals_patterns(spark):
    texts = ["ПАО Тестбанк и тестбанк, Тестбанкир", "рога и КОПЫТА; Рога и копытах", "9Тестбанк_", None, ""]
    units = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    entries = spark.createDataFrame([(k, e) for k, es in X.DICTIONARY.items() if k in ("BANK", "ORG") for e in es], "type string, entry string")
    joined = {(r.i, r.value, r.start) for r in dictionary_spans(units, entries, ["i"]).collect()}
    registry = {k: v for k, v in detectors(X.DICTIONARY).items() if k in ("BANK", "ORG")}
    single = units.select("i", F.explode(F.coalesce(F.concat(*(d(F.col("text")) for d in registry.values())), F.array())).alias("s"))
    assert joined == {(r.i, r.s.value, r.s.start) for r in single.collect()}
    assert (2, "Тестбанк", 1) in joined


def test_review_context(spark):
    r = review.candidates(spark.createDataFrame([(1, "x" * 40 + " партнёра «ИП Василёк» и " + "y" * 40)], "i long, text string"), ["i"]).first()
    assert r.value == "ИП Василёк" and r.context.startswith("x" * 24) and "Василёк" in r.context


def test_optional_parts_are_null(spark):
    from maskloom.plans.fixtures import frame

    p = {r.id: r for r in spec.parameters(frame(spark, X.CELLS)).collect()}
    assert p["sheet0-row7"].input_method is None and p["sheet0-row7"].ui.hidden_evidence.column == "G"
    assert p["sheet0-row7"].required.status == "conditional" and p["sheet0-row7"].notes
    assert p["sheet0-row6"].input_method.auto and p["sheet0-row6"].default_value.source_cell == "F6"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "i long, text string")
    after, mapping = anonymise(empty, ["i"])
    assert after.count() == 0 and mapping.count() == 0
    assert review.candidates(empty, ["i"]).count() == 0
    assert spec.summary(spark.createDataFrame([], X.CELLS[0])).count() == 0


def test_numbers_past_four_digits_are_restored(spark):
    mapping = spark.createDataFrame([("PERSON", "Anna", "PERSON_1000"), ("PERSON", "Boris", "PERSON_10000"), ("PHONE", "555", "PHONE_0001")], "type string, original string, pseudonym string")
    texts = spark.createDataFrame([(1, "PERSON_10000, PERSON_1000 and PHONE_00015, PERSON_10001")], "i long, text string")
    r = restored(texts, mapping, token=LONG_TOKEN).first()
    assert (r.text, r.tokens, r.unknown) == ("Boris, Anna and 5555, PERSON_10001", 4, ["PERSON_10001"])
    files = spark.createDataFrame([(1, '["PERSON_10000", "PERSON_1000"]')], "i long, text string")
    assert json.loads(restored_json(files, mapping, token=LONG_TOKEN).first().text) == ["Boris", "Anna"]


def test_entity_sql_equals_the_model(spark, tmp_path, monkeypatch):
    """The SQL of whole documents against the plain model, on random texts. Look-alikes stay in the SQL, and here in the model."""
    plain = {ord(c): (NORMAL_TO[i] if i < len(NORMAL_TO) else None) for i, c in enumerate(NORMAL_FROM)}
    monkeypatch.setattr(model, "clean", lambda text: text.translate(plain))
    from maskloom.plans.entity_sql import AFTER, KEPT

    from .compare import duck

    texts = random_texts(3000, 11)
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    frame.coalesce(1).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    _, rows = duck(str(tmp_path), f"WITH {KEPT} SELECT doc_id, value, type, start_at, end_at FROM kept")
    got = {}
    for i, *s in rows:
        got.setdefault(i, []).append(tuple(s))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, []), key=lambda s: s[2]) == [s[:4] for s in model.spans(model.clean(t))], t
    _, after = duck(str(tmp_path), f"WITH {AFTER} SELECT doc_id, text FROM after ORDER BY doc_id")
    assert [t for _, t in after] == model.anonymise(texts)[0]


def test_occurrences_and_places(spark):
    r = random.Random(6)
    rows = [("".join(r.choice("abé日😀.") for _ in range(r.randint(0, 12))), "".join(r.choice("abé.") for _ in range(r.randint(1, 2))), r.randint(0, 4)) for _ in range(500)] + [("a\\Ea", "\\E", 0), ("aaaa", "aa", 1)]
    df = spark.createDataFrame(rows, "t string, v string, s int")
    for x in df.select("t", "v", "s", T.occurrences(F.col("t"), F.col("v"), F.col("s")).alias("all"), T.places(F.col("t"), F.col("v")).alias("apart")).collect():
        assert x["all"] == [i for i in range(x.s, len(x.t)) if x.t.startswith(x.v, i)]
        apart, at = [], x.t.find(x.v)
        while at >= 0:
            apart.append(at)
            at = x.t.find(x.v, at + len(x.v))
        assert x.apart == apart


def test_highlights_mark_longer_values_first(spark):
    from maskloom.operators.preview import highlights

    df = spark.createDataFrame([("Луч Плюс и Луч", ["Луч", "Луч Плюс"])], "t string, v array<string>")
    assert [(s.value, s.start) for s in df.select(highlights(F.col("t"), F.col("v")).alias("h")).first().h] == [("Луч Плюс", 0), ("Луч", 11)]


def test_filled_down_equals_a_loop(spark):
    from maskloom.operators.pseudonyms import filled_down

    r = random.Random(9)
    rows = [(0 if r.random() < 0.5 else r.randint(0, 9), i, r.choice([None, None, None, i])) for i in range(3000)]
    held, wanted = {}, {}
    for g, i, v in rows:
        held[g] = v if v is not None else held.get(g)
        wanted[i] = held[g]
    got = filled_down(spark.createDataFrame(rows, "g int, i int, v int"), "g", ["i"], "v", "up")
    assert {x.i: x.up for x in got.collect()} == wanted and got.columns == ["g", "i", "v", "up"]


def test_tokens_of_more_than_four_digits_are_counted_apart(spark):
    lines = spark.createDataFrame([(0, "EMAIL_1000 EMAIL_10000 EMAIL_10001 EMAIL_10001"), (0, "CARD_0001 EMAIL_00012"), (1, None)], "doc_id long, line string")
    assert sorted(map(tuple, token_counts(lines, ["doc_id"], "line").collect())) == [(0, "CARD", 1), (0, "EMAIL", 4)]
    assert [tuple(r) for r in totals(lines, ["doc_id"], "line").collect()] == [(0, 6, 2)]


def test_texts_with_many_spans(spark):
    """More spans than are resolved one by one, in one text: found, resolved and replaced as the plain model does."""
    r = random.Random(5)
    parts = ["a{}@b.example ", "8 900 555-10-{:02} ", "4001 {:06} ", "паспорт 4001 {:06} ", "7712{:08} ", "слово ", "5500 0000 0000 {:04} "]
    text = "".join(r.choice(parts).format(r.randint(0, 99)) for _ in range(600))
    units = spark.createDataFrame([(1, text), (2, "нет ничего"), (3, text[:300]), (4, None)], "i long, text string")
    got = {x.i: [(s.value, s.type, s.start, s.end) for s in x.spans] for x in with_spans(units).collect()}
    assert got[1] == [s[:4] for s in model.spans(text)] and len(got[1]) > 64 and got[2] == [] and got[4] == []
    assert got[3] == [s[:4] for s in model.spans(text[:300])]
    after, _ = anonymise(units.filter("i = 1"), ["i"])
    assert after.first().text == model.anonymise([text])[0][0]


def test_addresses_and_names_among_many(spark):
    one = "Клиент Сидоров Олег Львович, г. Тверь, ул. Мира, д. 7; " * 150 + "г. " + " " * 600 + "Тверь, ул. Дом Культуры. Заявитель: Петров О.Л."
    got = [(s.value, s.type) for s in with_spans(spark.createDataFrame([(one,)], "text string")).first().spans]
    assert got[:300] == [("Сидоров Олег Львович", "PERSON"), ("г. Тверь, ул. Мира, д. 7", "ADDR")] * 150
    # The phrase over six hundred blanks is read whole, and is longer than "Дом Культуры", which grows from a word within it.
    assert got[-1] == ("Петров О.Л.", "PERSON") and got[-2] == ("г. " + " " * 600 + "Тверь, ул. Дом", "ADDR") and len(got) == 302
