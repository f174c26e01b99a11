"""Restoring JSON against a walk over the parsed tree."""

import json
import random
import re

from pyspark.sql import functions as F

from maskloom.functions.fixed import LONG_TOKEN
from maskloom.functions.jsontext import GUARD, json_escaped, json_layout
from maskloom.operators.pseudonyms import restored_json

PIECES = ["a", '"', "\\", "\n", "\t", "\x01", "\x1f", "é", "я", "😀", ":", "{", "}", "[", "]", ",", "/", " ", "PERSON_0001", "ORG_10000", "ORG_1000", "BANK_0009", " ", "\x7f"]
KNOWN = {"PERSON_0001": 'Анна "А"\n\\', "ORG_10000": "ООО\x02", "ORG_1000": "Юг"}


def _text(rnd):
    return "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(8)))


def _tree(rnd, depth=0):
    kind = rnd.randrange(8 if depth < 5 else 5)
    if kind < 5:
        return [None, rnd.random() < 0.5, rnd.randrange(-(9**9), 9**9), rnd.random() * 100, _text(rnd)][kind]
    if kind == 5:
        return [_tree(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {_text(rnd) + str(i): _tree(rnd, depth + 1) for i in range(rnd.randrange(5))}


def _written(rnd, tree):
    separators = rnd.choice([None, (" , ", " : "), (",", ":")])
    return json.dumps(tree, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1, 4]), separators=separators)


def _walked(tree, found):
    if isinstance(tree, dict):
        return {k: _walked(v, found) for k, v in tree.items()}
    if isinstance(tree, list):
        return [_walked(v, found) for v in tree]
    if isinstance(tree, str):
        found.extend(re.findall(LONG_TOKEN, tree))
        return re.sub(LONG_TOKEN, lambda m: KNOWN.get(m[0], m[0]), tree)
    return tree


def _mapping(spark):
    return spark.createDataFrame([(p.split("_")[0], o, p) for p, o in KNOWN.items()], "type string, original string, pseudonym string")


def test_json_is_restored_as_a_walk_over_its_tree_does(spark):
    rnd = random.Random(5)
    trees = [_tree(rnd) for _ in range(500)]
    files = spark.createDataFrame([(i, _written(rnd, t)) for i, t in enumerate(trees)], "i int, text string")
    got = restored_json(files, _mapping(spark)).collect()
    assert len(got) == len(trees)
    for r in got:
        found = []
        want = json.dumps(_walked(trees[r.i], found), ensure_ascii=False, indent=2)
        assert (r.text, r.tokens, r.unknown) == (want, len(found), sorted({t for t in found if t not in KNOWN}))


def test_no_python_worker_restores_json(spark):
    plan = restored_json(spark.createDataFrame([(1, "[]")], "i int, text string"), _mapping(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keys_numbers_and_order_stay(spark):
    text = '{"PERSON_0001": "PERSON_0001", "b" : 1.50, "a":[1e400, 12345678901234567890123], "z": {}, "y": [ ], "k\\"PERSON_0001\\":": "\\":PERSON_0001"}'
    r = restored_json(spark.createDataFrame([(1, text)], "i int, text string"), _mapping(spark)).first()
    anna = json.dumps(KNOWN["PERSON_0001"], ensure_ascii=False)[1:-1]
    lines = [f'"PERSON_0001": "{anna}",', '"b": 1.50,', '"a": [', "  1e400,", "  12345678901234567890123", "],", '"z": {},', '"y": [],', f'"k\\"PERSON_0001\\":": "\\":{anna}"']
    assert r.text == "{\n" + "\n".join("  " + x for x in lines) + "\n}" and r.tokens == 2


def test_what_is_no_json_becomes_null(spark):
    texts = ["", "{'a': 1}", '{"a": 1', "nan", "[1,]", None, '"PERSON_0001', '["a" "b"]', '{"a": 1, "a": 2}']
    got = restored_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), _mapping(spark)).collect()
    assert sorted((r.i, r.text, r.tokens, r.unknown) for r in got) == [(i, None, 0, []) for i in range(len(texts))]
    assert restored_json(spark.createDataFrame([], "i int, text string"), _mapping(spark)).count() == 0


def test_long_strings_and_many_members(spark):
    tree = {"long": 'x\\"' * 300_000 + "PERSON_0001", "many": [{"PERSON_0001": f"{i} PERSON_0001"} for i in range(20_000)]}
    r = restored_json(spark.createDataFrame([(1, json.dumps(tree))], "i int, text string"), _mapping(spark)).first()
    assert r.text == json.dumps(_walked(tree, []), ensure_ascii=False, indent=2) and r.tokens == 20_001


def test_escapes_and_guards(spark):
    texts = ["".join(map(chr, range(40))), 'a"b\\c', "plain", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", json_escaped(F.col("t")).alias("e"), json_layout(F.concat(F.lit('{"'), json_escaped(F.col("t")), F.lit('":1}')), GUARD).alias("g")).collect():
        assert r.e == json.dumps(texts[r.i], ensure_ascii=False)[1:-1]
        assert r.g.replace(GUARD, "") == json.dumps({texts[r.i]: 1}, ensure_ascii=False, indent=2)
