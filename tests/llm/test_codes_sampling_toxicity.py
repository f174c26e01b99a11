"""Vector codes and importance resampling against plain versions, toxicity on held-out documents."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from maskloom.llm import queries, resampling, toxicity, vector_codes
from tests.compare import assert_same

SF = "/root/testdata/sf0.01"


# ---- vector codes


def plain_codes(rows, rounds=4):
    """(id, label, vector) -> the contract, without a tree."""
    kept = [(i, y, v) for i, y, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept = [(i, y, [math.floor(1024 * x) for x in v] + [0] * (-len(v) % 4)) for i, y, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    w = len(kept[0][2]) // 4
    parts = [[r[2][p * w : p * w + w] for p in range(4)] for r in kept]
    books = [[x[p] for x in parts[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda a, p: min((far(a, b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            of = defaultdict(list)
            for x in parts:
                of[near(x[p], p)[1]].append(x[p])
            for e, own in of.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[near(x[p], p) for p in range(4)] for x in parts]
    errors = [sum(d for d, _ in f) for f in found]
    by = Counter()
    for (_, y, _), d in zip(kept, errors, strict=True):
        by[y] += d
    return [(i, "".join(f"{e:02x}" for _, e in f), d, by[y], sha) for (i, y, _), f, d in zip(kept, found, errors, strict=True)]


def vectors(spark, rows):
    return spark.createDataFrame([Row(vec_id=i, label=y, embedding=v, code="x", _id=1, _v=2, error=3) for i, y, v in rows], "vec_id long, label int, embedding array<double>, code string, _id int, _v int, error int")


def same(df, rows):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(rows, key=key)


@pytest.mark.parametrize("dims, n, spread", [(8, 700, 0.01), (16, 400, 1.0), (6, 300, 0.002), (4, 40, 3.0)])
def test_codes_against_a_plain_version(spark, dims, n, spread):
    r = np.random.default_rng(n)
    rows = [(i, int(r.integers(0, 3)) if i % 7 else None, (r.normal(0, spread, dims)).tolist()) for i in range(n)]
    rows += [(n + i, 1, rows[5][2]) for i in range(200)]  # a vector that many share
    same(vector_codes.vector_codes(vectors(spark, rows)), plain_codes(rows))


def test_codes_of_odd_rows(spark):
    rows = [
        (3, 1, [0.5, 0.25, -0.1, 0.0]), (1, None, [0.5, 0.25, -0.1, 0.0]), (1, None, [0.5, 0.25, -0.1, 0.0]), (1, 2, [-1.0, 0.0, 0.0, 0.001]), (None, 2, [0.1, 0.1, 0.1, 0.1]), (4, 1, None), (5, 1, []),
        (6, 1, [0.1, None, 0.1, 0.1]), (7, 1, [0.1, math.nan, 0.1, 0.1]), (8, 1, [math.inf, 0.1, 0.1, 0.1]), (9, 1, [1.0] * 8), (10, 1, [-math.inf] * 4),
    ]
    same(vector_codes.vector_codes(vectors(spark, rows)), plain_codes(rows))
    assert vector_codes.vector_codes(vectors(spark, rows).limit(0)).collect() == []
    assert vector_codes.vector_codes(vectors(spark, rows).filter("vec_id = 4")).collect() == []
    huge = vector_codes.vector_codes(vectors(spark, [(1, 1, [1e300, -1e300, 0.0, 5.0]), (2, 1, [-1e300, 1e300, 0.0, 5.0])])).collect()
    assert len(huge) == 2 and all(0 <= r["error"] <= 2**63 - 1 for r in huge)


def test_tree_finds_the_nearest_and_the_lower_of_equals():
    r = np.random.default_rng(1)
    for trial in range(60):
        width, spread = int(r.integers(1, 17)), int(r.choice([1, 2, 5, 300, 2**27]))
        entries = r.integers(-spread, spread + 1, (int(r.integers(1, 257)), width))
        x = np.concatenate([r.integers(-spread, spread + 1, (300, width)), entries[:20]])
        at, d = vector_codes.nearest(vector_codes.ball_tree(entries), entries, x)
        far = [((entries.astype(object) - p.astype(object)) ** 2).sum(1) for p in x]
        assert at.tolist() == [min(range(len(f)), key=lambda e: (f[e], e)) for f in far], trial
        assert d.tolist() == [min(f) for f in far]


def test_tree_leaves_balls_out():
    """Of entries in groups far apart, distances are taken to a few only."""
    r = np.random.default_rng(2)
    entries = (r.integers(-3000, 3000, (16, 1, 8)) + r.integers(-9, 9, (16, 16, 8))).reshape(-1, 8)
    counted, plain = [0], vector_codes.squared
    vector_codes.squared = lambda x, c: counted.__setitem__(0, counted[0] + len(x) * len(c)) or plain(x, c)
    try:
        vector_codes.nearest(vector_codes.ball_tree(entries), entries, np.repeat(entries, 8, axis=0))
    finally:
        vector_codes.squared = plain
    assert counted[0] < 2048 * 256 / 3


def test_codes_by_sql(spark):
    assert_same(queries.op11_vector_codes(spark, SF), SF, queries.oracle_sql()["op11_vector_codes"])


# ---- importance resampling


def plain_resample(docs, target, order, buckets=10_000, percent=10, least=20, seed=2024):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    of = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for w in [words(t)] for k in range(1, order + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for x in target for b in of(x))
    S, T = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets))))
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = of(x)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(fit[: len(fit) * percent // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("nodes", [resampling.NODES, 50])
def test_resampling_against_a_plain_version(spark, odd, order, nodes, monkeypatch):
    monkeypatch.setattr(resampling, "NODES", nodes)
    r = np.random.default_rng(order)
    vocabulary = ["the", "The", "of", "über", "日本", "a1", "x-y", "naïve", "q", "zebra"]
    docs = [(int(i), " ".join(r.choice(vocabulary, int(r.integers(0, 60))))) for i in range(150)]
    docs += [(r_["doc_id"], r_["text"]) for r_ in odd.select("doc_id", "text").collect()] + [(900 + i, "spam " * 30) for i in range(60)]
    target = ["zebra über", None, "", "the zebra"]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), order=order)
    # Rows that repeat id and text are alike, so which of them has which rank isn't told.
    same(got, plain_resample(docs, target, order))


def test_resampling_of_odd_tables(spark, odd, nothing):
    got = resampling.resample(odd, nothing)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got, plain_resample([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()], [], 1))
    assert resampling.resample(nothing, odd).collect() == []


def test_resampling_by_sql(spark):
    assert_same(queries.op12_importance_resampling(spark, SF), SF, queries.oracle_sql()["op12_importance_resampling"])


def test_trie_goes_on_from_the_state_above():
    trie = resampling.Trie(10_000, lambda b: 0)
    for run in [(b"a",), (b"a", b"b"), (b"a", b"b", b"\xc3\xbc")]:
        assert trie.node(run)[0] == zlib.crc32(b" ".join(run))
    assert trie.size == 3


# ---- toxicity


def test_toxicity_on_held_out_documents(spark):
    sf = SF.replace("sf0.01", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["toxic"], r["predicted"]) for r in rows if r["held_out"]]
    found, clean = [p for y, p in held if y], [p for y, p in held if not y]
    print("recall", sum(found) / len(found), "of clean", sum(clean) / len(clean))
    assert sum(found) / len(found) > 0.9 and sum(clean) / len(clean) < 0.03


def test_held_out_labels_and_clean_labels_are_not_learnt_from(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.selectExpr("doc_id", "cast(CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS int) AS toxic")
    one, two = toxicity.train(docs, labels, prior=0.1), toxicity.train(docs, other, prior=0.1)
    assert np.array_equal(one.tells, two.tells) and all(np.array_equal(a.p["W"], b.p["W"]) for a, b in zip(one.members, two.members, strict=True))
    confirmed = toxicity.train(docs, labels.filter("toxic = 1"), prior=0.1)
    assert np.array_equal(one.tells, confirmed.tells)


def test_slopes_are_those_of_the_risk():
    r = np.random.default_rng(3)
    for shift in (0.0, 6.0):  # a negative risk on clean documents, the second time
        p, u = r.normal(0, 1, 5) + shift, r.normal(0, 1, 7) - shift
        positive, clean = toxicity.risk(p, u, 0.4)
        value = lambda a, b, c=clean: (lambda x: x[0] + x[1] if c >= 0 else -x[1])(toxicity.risk(a, b, 0.4))
        to_p, to_u = toxicity.slopes(p, u, 0.4)
        for g, slope, at in ((p, to_p, 0), (u, to_u, 1)):
            for i in range(len(g)):
                e = np.zeros(len(g))
                e[i] = 1e-5
                moved = [(g + e, u), (g - e, u)] if at == 0 else [(p, g + e), (p, g - e)]
                assert abs((value(*moved[0]) - value(*moved[1])) / 2e-5 - slope[i]) < 1e-6
    assert clean < 0


def test_gradient_of_the_network():
    c, r = toxicity.Classifier(seed=4), np.random.default_rng(4)
    x, slope = r.uniform(0, 2, (6, len(toxicity.LEVELS))), r.normal(0, 1, 6)
    for k, g in c.gradient(x, slope).items():
        for at in np.ndindex(*c.p[k].shape):
            c.p[k][at] += 1e-5
            high = c.logits(x) @ slope
            c.p[k][at] -= 2e-5
            low = c.logits(x) @ slope
            c.p[k][at] += 1e-5
            assert abs((high - low) / 2e-5 - g[at]) < 1e-5


def test_task_and_plain_description_agree(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    for text, got in toxicity.score(odd.withColumn("doc_id", odd.text), model).select("doc_id", "score").collect():
        b = toxicity.bag(text or "")
        want = model.scores(toxicity.described(b[:, 0], model.tells[b[:, 1:]].max(1, initial=-9))[None])[0]
        assert abs(got - want) < 1e-12


def test_toxicity_of_odd_tables(spark, odd, nothing):
    y = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (6, None), (12, 1), (10, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, y).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.toxicity(nothing, y).collect() == []
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(odd, y.filter("toxic = 0")).collect()} == {(0.0, 0)}
