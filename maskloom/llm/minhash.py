"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Each distinct shingle of five words is hashed once; the hash's high bits choose a bin and each bin keeps its least hash.
An empty bin asks the others in an order drawn by hashing, the same for all documents, and takes the value of the first
full one, so that two documents' empty bins agree as often as their sets do. Only the low bits of each bin are stored; the chance
that those agree for unequal values is taken out of the estimate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, sliced, stored, text_of

SHINGLE, BINS, BITS = 5, 512, 4
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) | 1 for i in range(SHINGLE)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    for shift, by in ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB))):
        x = (x ^ (x >> shift)) * by
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words seen before, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """One hash for each place of n consecutive words; fewer words are one shingle, as is the empty text."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    m = max(1, len(h) - n + 1)
    out = np.full(m, np.uint64(min(len(h), n)), np.uint64)
    for i in range(min(n, len(h))):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + h[i : i + m] * _ODD[i]
    return _mixed(out)


@lru_cache(maxsize=4)
def _turns(k: int) -> np.ndarray:
    """turns[i, j]: when empty bin i asks bin j, by hashes of the pair; each bin asks all others in an order of its own."""
    i, j = np.meshgrid(np.arange(k, dtype=np.uint64), np.arange(k, dtype=np.uint64), indexing="ij")
    return np.argsort(np.argsort(_mixed(_mixed(i + np.uint64(1)) + j), axis=1), axis=1).astype(np.uint16)


def sketch(text: str, k: int = BINS, bits: int = BITS) -> np.ndarray:
    """The low bits of the k densified bins."""
    h = shingle_hashes(text)
    value = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    shift = np.uint64(64 - k.bit_length() + 1)
    np.minimum.at(value, (h >> shift).astype(np.int64), _mixed(h & ((np.uint64(1) << shift) - np.uint64(1))) >> np.uint64(1))
    there = value != np.iinfo(np.uint64).max
    full, empty = np.flatnonzero(there), np.flatnonzero(~there)
    if len(empty):
        value[empty] = value[full[_turns(k)[np.ix_(empty, full)].argmin(axis=1)]]
    return (value & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(low: np.ndarray, bits: int = BITS) -> bytes:
    return np.packbits(np.unpackbits(low[:, None], axis=1, count=bits, bitorder="little").ravel()).tobytes()


def packed_hex(low: np.ndarray, bits: int = BITS) -> str:
    return packed(low, bits).hex()


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    """The estimated Jaccard similarity: agreeing bins, less those that agree by chance."""
    chance = 0.5**bits
    return min(1.0, max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = BINS, bits: int = BITS) -> DataFrame:
    """(id, fingerprint) for each row of docs, whole texts; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed_hex(sketch(t, k, bits), bits) for t in batch.column(1).to_pylist()], pa.string())], ["_id", "fingerprint"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("_id", id_col)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NAMES = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
REPORT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _finished(text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    edited = _edited(text, following)
    e = sketch(edited)
    return len(text), hashlib.sha256(edited.encode()).digest(), packed(own), packed(e), likeness(own, e), likeness(own, theirs)


def _report_columns(out: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    return [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True)]


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_in_range: int = 65_536) -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document by ascending id; the first follows the last. Rows of one id come by a hash of the text, then by text; a null
    id comes first. Null texts count as empty; an only row follows itself; an empty table gives an empty result. Columns
    other than the two named are not read.

    Texts are shuffled once, into ranges of (id, hash of the text, place in the input), so no id is one task. A task goes
    through its range in order with one row held; only its last row waits for the first of the next range, and these two
    texts of each range are what is joined afterwards.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_in_range))
    dealt = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange(ranges, "_id", "_h", "_from").sortWithinPartitions("_id", "_h", "_t").select("_id", "_t")
    kind = rows.schema["_id"].dataType.simpleString()

    def rows_of(ids: pa.Array, out: list[tuple], part: int, edge: str | None = None, text: str | None = None) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([ids, *_report_columns(out), pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array([text] * n, pa.string())], [*NAMES, "part", "edge", "_t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blank = TaskContext.get().partitionId(), [(None,) * 6]
        held = None  # (id, text, sketch) waiting for what follows
        for batch in sliced(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            own = [sketch(t) for t in texts]
            last = ids.slice(len(ids) - 1), texts[-1], own[-1]
            if held is None:
                yield rows_of(ids.slice(0, 1), blank, part, "first", texts[0])
            else:
                ids, texts, own = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *own]
            out = [_finished(*x) for x in zip(texts, own, texts[1:], own[1:], strict=False)]
            yield rows_of(ids.slice(0, len(ids) - 1), out, part)
            held = last
        if held is not None:
            yield rows_of(held[0], blank, part, "last", held[1])

    done = stored(dealt.mapInArrow(run, f"_id {kind}, {REPORT}, part int, edge string, _t string"), "ranges")
    firsts = done.filter("edge = 'first'").select("part", F.col("_t").alias("following"))
    # One number for each range, in one window.
    order = firsts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    ends = done.filter("edge = 'last'").select("_id", "_t", "part").join(order, "part").join(firsts.withColumnRenamed("part", "next"), "next").select("_id", "_t", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_report_columns([_finished(a, sketch(a), b, sketch(b)) for a, b in pairs])], NAMES)

    whole = done.filter("edge is null").select(*NAMES).unionByName(ends.mapInArrow(finish, f"_id {kind}, {REPORT}"))
    shown = lambda c: F.lower(F.hex(c)).alias(c)  # noqa: E731  fingerprints are written packed, shown as text
    return whole.select(F.col("_id").alias(id_col), "n_chars", *map(shown, NAMES[2:5]), *NAMES[5:])
