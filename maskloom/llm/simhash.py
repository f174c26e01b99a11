"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Fingerprints are deduplicated first, so copies cost one row. Links up to distance 2 come from balls of radius 1: every
fingerprint emits itself and its 64 one-bit variants, and two that share a variant are at most 2 apart, so all that meet
at a variant (65 at most) link to one of them with no pair formed. For distance 3 the balls have radius 1 and 2: of two
fingerprints that differ in three bits, one has two of these set. It emits its variants with two set bits cleared, the
other its one-bit variants, and they meet in a whole fingerprint. At most 65 one-bit variants, already one group, and
2,016 others meet there, whatever the data, so no key is hot; each link found is at most 3 by construction.

Balls of radius 2 are emitted only by fingerprints that may have a partner at 3: one of two such has a half in which they
differ by at most one bit. Keys of halves are only counted, never paired: one that holds a single group is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, own_name, sliced, stored, text_of
from .components import components

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Hashes whose bits are counted at a time, so that a very long text needs no more memory than a short one.
_CHUNK = 1 << 15


def fingerprint(text: str, n: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the text's n-word shingles, repeats included, each hashed by XXH64."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()  # bytes.split() knows just the ASCII white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.dtype("<u8"))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, keep: list[Column] | None = None) -> DataFrame:
    """(id, fp) and the columns to keep, fp being the fingerprint's bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("_id"), *(keep or []), text_of(text_col).alias("_t"))
    schema = rows.drop("_t").schema.add("fp", "long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(t, n) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], schema.names)

    return rows.mapInArrow(hashed, schema).withColumnRenamed("_id", id_col)


def links_within_2(fps: DataFrame) -> DataFrame:
    """(a, b) that join all distinct fingerprints (fp) at most 2 bits apart, if not each such pair itself."""
    ball = fps.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("v"))
    met = ball.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("v")).alias("b"))
    return met.filter("a <> b").distinct()


def maybe_at_3(groups: DataFrame) -> DataFrame:
    """The fingerprints of (fp, root) that share a half, but for one bit, with one of another group: all that have a link at 3, and others."""
    halves = groups.select("fp", "root", F.explode(F.expr("array(struct(0L as h, fp & 4294967295L as p), struct(1L as h, shiftrightunsigned(fp, 32) as p))")).alias("x")).select("fp", "root", "x.h", "x.p")
    up = "transform(filter(sequence(0, 31), i -> (p & shiftleft(1L, i)) = 0), i -> p | shiftleft(1L, i))"
    ball = halves.select("fp", "root", F.expr(f"explode(transform(concat(array(p), {up}), v -> shiftleft(h, 32) | v))").alias("k"))
    shared = ball.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("k")
    return ball.join(shared, "k", "left_semi").select("fp", "root").distinct()


def links_at_3(groups: DataFrame) -> DataFrame:
    """(a, b): the roots of groups (fp, root) that have fingerprints at most 3 bits apart in two different groups."""
    near = stored(maybe_at_3(groups), "near")
    one = near.select("root", F.expr("explode(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))").alias("v"))
    set_bits = near.select("fp", F.col("root").alias("root2"), F.expr("filter(sequence(0, 63), i -> (fp & shiftleft(1L, i)) <> 0)").alias("bits"))
    pairs = "flatten(transform(bits, i -> transform(filter(bits, j -> j > i), j -> fp ^ shiftleft(1L, i) ^ shiftleft(1L, j))))"
    two = set_bits.select("root2", F.expr(f"explode({pairs})").alias("v"))
    # Both sides are variants, many rows however few bytes: merged, not sent to all tasks.
    met = two.join(one.groupBy("v").agg(F.min("root").alias("root")).hint("merge"), "v").filter("root <> root2")
    return met.select(F.least("root", "root2").alias("a"), F.greatest("root", "root2").alias("b")).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(_id, _hash, fp, root, component_id) for each row of docs; _hash: the text's."""
    found = stored(fingerprints(docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")), "_id", "_t", n, keep=[F.xxhash64("_t").alias("_hash")]), "fingerprints")
    distinct = stored(found.groupBy("fp").agg(F.min("_id").alias("least_id")), "distinct")
    near = components(links_within_2(distinct.select("fp")))
    grouped = stored(distinct.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "grouped")
    joined = components(links_at_3(grouped.select("fp", "root")))
    roots = grouped.join(joined.toDF("root", "top"), "root", "left").select("fp", "least_id", F.coalesce("top", "root").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = roots.join(ids, "root").select("fp", "root", "component_id")
    return found.join(by_fp, "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links of 3 bits or fewer).

    Texts without words have fingerprint zero and are linked like any other; a null text counts as empty. Rows whose id
    is null take part; a component of null ids only has a null component_id. Rows that repeat an id get a row each.
    Columns other than the two named are not read.
    """
    return _grouped(docs, id_col, text_col, n).select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component one, that with the smallest id.

    Where rows of one component repeat that id, the one with the least hash of its text stays, and of equal rows one. A
    null id comes after all others.
    """
    groups = stored(_grouped(docs, id_col, text_col, n).select("_id", "_hash", "root"), "groups")
    stay = groups.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("null"), "_id", "_hash")).alias("k")).select(F.col("k._id").alias("_kept"), F.col("k._hash").alias("_text"))
    mine = own_name(docs, "_own")
    own = docs.withColumn(mine, F.xxhash64(text_of(text_col)))
    # The narrow side is hashed; whole rows stream by and are not sorted.
    left = own.join(stay.hint("shuffle_hash"), own[id_col].eqNullSafe(stay["_kept"]) & (own[mine] == stay["_text"]), "left_semi")
    if not groups.groupBy("_id", "_hash").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        left = left.dropDuplicates([id_col, mine])
    return left.drop(mine)
