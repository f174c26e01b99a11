import hashlib
import itertools
import random

import numpy as np
import xxhash
from maskloom.llm import minhash as M
from maskloom.llm import simhash as S
from maskloom.llm.components import components
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}


def slow_fingerprint(text):
    words = [w for w in (text or "").translate(LOW).encode().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints():
    for t in [None, "", "One", "One two", "a b c", "a b c d a b c", "É é\x0bx\x1cy z", "w " * 70_000]:
        assert S.fingerprint(t or "") == slow_fingerprint(t)


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    expected = union(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    for r in S.simhash_groups(docs).collect():
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", expected[r.doc_id])


def test_links_find_all_distances(spark):
    """Clusters and chains of distances 0 to 4 around random centres, each link by itself."""
    r = random.Random(5)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(1, 8)):
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps]
    expected = union(signed, [(signed[i], signed[j]) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    near = {r.node: r.root for r in components(S.links_within_2(df)).collect()}
    two = union(signed, [(signed[i], signed[j]) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    for a, b in itertools.combinations(signed, 2):
        assert (two[a] == two[b]) == (near.get(a, a) == near.get(b, b))
    grouped = spark.createDataFrame([(s, near.get(s, s)) for s in signed], "fp long, root long")
    links = [(r.a, r.b) for r in S.links_at_3(grouped).collect()]
    final = union(signed, [(s, near.get(s, s)) for s in signed] + links)
    assert {frozenset(i for i in signed if final[i] == k) for k in set(final.values())} == {frozenset(i for i in signed if expected[i] == k) for k in set(expected.values())}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 160)}) == 1 and got[0] != got[100] and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_rows(odd, nothing):
    rows = S.simhash_groups(odd).collect()
    assert len(rows) == odd.count() and S.simhash_groups(nothing).count() == 0
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {None, 1, 2, 3} and {r.component_id for r in zero} == {1}
    kept = S.one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.component_id for r in rows}


def test_one_row_of_each_group(spark):
    a, b = "alpha beta gamma delta " * 20, "one two three four five six " * 20
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, "lone words here"), (7, "lone words here"), (None, "quite other text"), (None, "quite other text")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in S.one_of_each(docs).collect()) == sorted([("1", a), ("5", b), ("7", "lone words here"), ("None", "quite other text")])


def test_a_shared_half_makes_no_pairs(spark):
    """Thousands of fingerprints with one half in common, a few of them near another: no group holds more than the balls do."""
    r = random.Random(8)
    own = r.getrandbits(32)
    fps = {own << 32 | r.getrandbits(32) for _ in range(3000)}
    fps |= {f ^ 0b10011 for f in list(fps)[:40]} | {f ^ (1 << 40 | 1 << 50 | 1 << 3) for f in list(fps)[:40]}
    fps = sorted(fps)
    signed = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps]
    near = [(signed[i], signed[j]) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    two = union(signed, [(a, b) for a, b in near if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    links = [(r.a, r.b) for r in S.links_at_3(spark.createDataFrame(list(two.items()), "fp long, root long")).collect()]
    assert union(signed, [*two.items(), *links]) == union(signed, near)


def likeness(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.translate(LOW).split(), b.translate(LOW).split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_likeness_is_close_to_jaccard():
    r = random.Random(3)
    off = []
    for _ in range(60):
        n = r.randint(60, 900)
        a = [f"w{r.randint(0, 9999)}" for _ in range(n)]
        b = [w if r.random() > 0.02 * r.randint(0, 6) else "x" for w in a]
        t, u = " ".join(a), " ".join(b)
        off.append(M.likeness(M.sketch(t), M.sketch(u)) - likeness(t, u))
    assert abs(np.mean(off)) < 0.01 and max(map(abs, off)) < 0.15


def test_report_equals_brute_force(spark, odd, nothing):
    for docs, ranges in ((spark.read.parquet(f"{SF}/documents.parquet"), 16), (odd, 3), (odd, 65_536), (odd.filter("doc_id = 8"), 1)):
        rows = M.fingerprint_report(docs, rows_in_range=ranges).collect()
        told = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
        order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text, r.doc_id, r.h) for r in told), key=lambda x: (x[0], x[1], x[4]))
        wanted = []
        for (_, _, text, i, _), (_, _, after, _, _) in zip(order, [*order[1:], order[0]], strict=True):
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            wanted.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), M.packed_hex(M.sketch(text)), M.packed_hex(M.sketch(edited)), round(M.likeness(M.sketch(text), M.sketch(edited)), 9), round(M.likeness(M.sketch(text), M.sketch(after)), 9)))
        got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
        assert sorted(got) == sorted(wanted)
    assert M.fingerprint_report(nothing).count() == 0
    named = docs.select(F.col("doc_id").cast("string").alias("name"), "text")
    assert M.fingerprint_report(named, "name").schema["name"].dataType.simpleString() == "string"
    assert M.fingerprints(odd).count() == odd.count()
