"""Exact deduplication through an extendible-hash index on shared files. DataFrame functions only.

The directory says for each slot, the leading bits of a text's hash, which bucket owns it. It is built from the distinct
hashes: a bucket that more than `bucket_rows` of them fall into is split by one more bit, which doubles the directory,
until all fit or hold one hash only. Every text goes through the directory to its bucket, and texts meet within buckets
only: there they are grouped by hash and bytes, which chains apart texts whose hashes collide. Copies are summed on the
map side first, so a text that a third of all rows share reaches its owner as one row per map task. Entries are written
by owner tasks with a range of buckets and keys each; rows are looked up by slot, bucket, hash and digest.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, own_name, stored, text_of

#: A directory is sent to all tasks up to so many slots (some 24 MB), beyond that it is joined by slot.
SENT_SLOTS = 1 << 20


def _slot(depth: int) -> Column:
    """The leading bits of the hash, as an unsigned number."""
    return F.shiftrightunsigned("_key", 64 - depth) if depth else F.lit(0).cast("long")


def bucket_size(n: int) -> int:
    """How many entries a bucket holds at most: about the root of all, so buckets and directory grow alike."""
    return max(256, 1 << math.ceil(math.log2(max(1, n)) / 2))


def directory(keys: DataFrame, n: int, bucket_rows: int) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) for each slot in use, and the directory's global depth. keys: the n distinct hashes (_key).

    `bucket` is the first slot that shares the bucket.
    """
    deep = max(0, math.ceil(math.log2(max(1, n / bucket_rows))))
    left, levels = keys, []
    while True:
        held = left.groupBy(_slot(deep).alias("slot")).agg(F.count("*").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high"))
        fits = (F.col("n") <= bucket_rows) | (F.col("low") == F.col("high"))
        level = stored(held.select("slot", fits.alias("fits")), "level")
        levels.append((deep, level.filter("fits").select("slot")))
        over = level.filter("not fits").select(F.col("slot").alias("_over"))
        if over.isEmpty():
            break
        left = left.withColumn("_over", _slot(deep)).join(over, "_over", "left_semi").select("_key")
        deep += 1
    used = keys.select(_slot(deep).alias("slot")).distinct()
    up = lambda d: F.shiftrightunsigned("slot", deep - d)
    parts = [used.join(level.select(F.col("slot").alias("_own")), up(d) == F.col("_own")).select("slot", F.shiftleft("_own", deep - d).alias("bucket"), F.lit(d).alias("local_depth")) for d, level in levels]
    return stored(reduce(DataFrame.unionByName, parts), "directory"), deep


def routed(rows: DataFrame, slots: DataFrame, deep: int, sent: bool) -> DataFrame:
    """rows (_key, ...) with the bucket that the directory names."""
    return rows.withColumn("slot", _slot(deep)).join(F.broadcast(slots) if sent else slots, "slot").drop("slot")


def _probes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, _sha) of each row, written once."""
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(text_of(text_col)).alias("_norm"))
    return stored(rows.select("_id", F.xxhash64("_norm").alias("_key"), F.unhex(F.sha2("_norm", 256)).alias("_sha")), "probes")


def build_index(docs: DataFrame, probes: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int | None = None) -> tuple[DataFrame, DataFrame, int, bool]:
    """The index, written to the shared folder, and its directory, global depth, and whether that is small enough to send.

    Entries, one for each distinct text: bucket, local_depth, _key, _sha, n_bytes, keep_id, group_size.
    """
    keys = stored(probes.select("_key").distinct(), "keys")
    n = keys.count()
    slots, deep = directory(keys, n, bucket_rows or bucket_size(n))
    sent = slots.count() <= SENT_SLOTS
    texts = docs.select(F.col(id_col).alias("_id"), ascii_lower(text_of(text_col)).alias("_norm")).withColumn("_key", F.xxhash64("_norm"))
    chained = routed(texts, slots, deep, sent).groupBy("bucket", "local_depth", "_key", "_norm").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = chained.select("bucket", "local_depth", "_key", F.unhex(F.sha2("_norm", 256)).alias("_sha"), F.octet_length("_norm").alias("n_bytes"), "keep_id", "group_size")
    owned = stored(entries, "entries").repartitionByRange("bucket", "_key").sortWithinPartitions("bucket", "_key")
    return stored(owned, "index"), slots, deep, sent


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, n_bytes, bucket, local_depth.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id stays. A null text
    counts as empty, and empty texts are equal to each other. A null id is smaller than any other; a group of null ids
    only keeps them all, and rows that repeat both id and text share the verdict, since nothing tells them apart.
    An empty table gives an empty result; columns other than the two named are not read.
    """
    probes = _probes(docs, id_col, text_col)
    index, slots, deep, sent = build_index(docs, probes, id_col, text_col, bucket_rows)
    # Only ids and hashes are probed. A hot text makes this join skewed, on narrow rows; Spark splits such partitions.
    found = routed(probes, slots, deep, sent).drop("local_depth").join(index, ["bucket", "_key", "_sha"])
    return found.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"), "n_bytes", "bucket", "local_depth"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows that repeat both id and text one stays, of groups of null
    ids as well."""
    probes = _probes(docs, id_col, text_col)
    index, _, _, _ = build_index(docs, probes, id_col, text_col)
    stay = index.select("keep_id", F.col("_sha").alias("_kept"))
    mine = own_name(docs, "_own")
    own = docs.withColumn(mine, F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256)))
    # The narrow side is hashed; whole rows stream by and are not sorted.
    left = own.join(stay.hint("shuffle_hash"), own[id_col].eqNullSafe(stay["keep_id"]) & (own[mine] == stay["_kept"]), "left_semi")
    if not probes.groupBy("_id", "_sha").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        left = left.dropDuplicates([id_col, mine])
    return left.drop(mine)
