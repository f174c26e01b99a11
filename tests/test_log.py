"""The log of a mapping: writers at once, replays, merging, and what a batch reads."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from maskloom.sinks import log


def values(spark, kind, ids):
    return spark.createDataFrame([(kind, f"v{i}", i) for i in ids], "type string, original string, seen long")


def as_dict(df):
    rows = df.collect()
    found = {(r.type, r.original): r.pseudonym for r in rows}
    assert len(found) == len(rows)
    return found


def test_numbers_go_on_and_replays_keep_theirs(spark, tmp_path):
    path = str(tmp_path / "log")
    one = as_dict(log.add(spark, path, values(spark, "PERSON", [3, 1, 2]), ["seen"]))
    assert one == {("PERSON", "v1"): "PERSON_0001", ("PERSON", "v2"): "PERSON_0002", ("PERSON", "v3"): "PERSON_0003"}
    two = as_dict(log.add(spark, path, values(spark, "PERSON", [2, 9]).unionByName(values(spark, "EMAIL", [5])), ["seen"]))
    assert two == {("PERSON", "v2"): "PERSON_0002", ("PERSON", "v9"): "PERSON_0004", ("EMAIL", "v5"): "EMAIL_0001"}
    assert as_dict(log.add(spark, path, values(spark, "PERSON", [3, 1, 2]), ["seen"])) == one and log.state(spark, path).version == 2
    assert as_dict(log.read_log(spark, path)) == one | two
    assert log.add(spark, path, values(spark, "PERSON", []), ["seen"]).count() == 0


def test_two_writers_at_once_give_no_number_twice(spark, tmp_path):
    path = str(tmp_path / "log")
    sets = [range(0, 20), range(10, 30), range(25, 40), range(0, 40, 3)]
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda ids: as_dict(log.add(spark.newSession(), path, values(spark, "ORG", ids), ["seen"])), sets))
    whole = as_dict(log.read_log(spark, path))
    assert len(set(whole.values())) == len(whole) == 40 and sorted(whole.values()) == [f"ORG_{i:04d}" for i in range(1, 41)]
    assert all(whole[k] == v for f in found for k, v in f.items())


def test_a_commit_is_put_only_if_its_number_is_free(spark, tmp_path):
    path = str(tmp_path / "log")
    log._commit(spark, path, log.State(1, [], {"A": 2}))
    with pytest.raises(log.Taken):
        log._commit(spark, path, log.State(1, [], {"A": 7}))
    assert log.state(spark, path).next == {"A": 2}


def test_folders_are_merged_by_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "MERGED", 3)
    path = str(tmp_path / "log")
    for i in range(10):
        log.add(spark, path, values(spark, "INN", [2 * i, 2 * i + 1]), ["seen"])
    now = log.state(spark, path)
    assert sorted(level for _, level in now.folders) == [0, 2] and now.next == {"INN": 21}
    assert as_dict(log.read_log(spark, path)) == {("INN", f"v{i}"): f"INN_{i + 1:04d}" for i in range(20)}


def test_a_batch_reads_the_buckets_of_its_values_only(spark, tmp_path):
    path = str(tmp_path / "log")
    log.begin(spark, path, spark.range(5000).select(F.lit("INN").alias("type"), F.concat(F.lit("v"), "id").alias("original"), F.format_string("INN_%04d", F.col("id") + 1).alias("pseudonym")))
    assert log.state(spark, path).next == {"INN": 5001}
    own = log._bucketed(values(spark, "INN", [17, 6000]))
    read = log._read(spark, path, log.state(spark, path)).filter(F.col("bucket").isin([r.bucket for r in own.collect()]))
    assert 0 < len(read.select(F.input_file_name()).distinct().collect()) <= 2 and read.count() < 200
    assert as_dict(log.add(spark, path, values(spark, "INN", [17, 6000]), ["seen"])) == {("INN", "v17"): "INN_0018", ("INN", "v6000"): "INN_5001"}
