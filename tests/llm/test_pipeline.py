from collections import defaultdict

import corpus_pipeline as C
from maskloom.llm import packing, pii, quality, simhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}


def same(df, rows):
    assert sorted((str(r.doc_id), r.text) for r in df.collect()) == sorted((str(i), t) for i, t in rows)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    all_ = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = C.quality_filter(spark, docs, SF)
    left = {i: t for i, t in all_.items() if model.scores([quality.bag(t)])[0] >= 0.7}
    same(good, left.items())

    groups = defaultdict(list)
    for i, t in left.items():
        groups[t.translate(LOW)].append(i)
    left = {max(g): left[max(g)] for g in groups.values()}
    once = C.drop_copies(spark, good, SF)
    same(once, left.items())

    fps = {i: simhash.fingerprint(t) for i, t in left.items()}
    root = {}
    for i in sorted(fps):  # from the smallest id on, all that can be reached
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += [y for y in fps if y not in root and (fps[x] ^ fps[y]).bit_count() <= 3]
    left = {i: t for i, t in left.items() if root[i] == i}
    near = C.drop_near_copies(spark, once, SF)
    same(near, left.items())

    w = dict(pii.trained())
    left = {i: pii.masked(t, pii.all_spans(t, w)[1]) for i, t in left.items()}
    masked = C.mask_personal_data(spark, near, SF)
    same(masked, left.items())
    assert masked.columns == docs.columns and masked.filter(F.col("n_chars") != F.length("text")).count() == 0

    packed = C.pack(spark, masked, SF)
    n = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("o")).collect()
    assert all(r.n <= 1024 and r.o == 0 for r in n)
    assert packed.groupBy().sum("length").first()[0] == sum(len(packing.token_ids(t, packing.tokenizer_path())) for t in left.values())


def test_run(spark):
    rows = C.run(spark, SF)
    assert rows.count() > 0 and len(C.STAGES) == 5


def test_stages_with_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        for _, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
        C.STAGES[-1][1](spark, docs, SF).count()
