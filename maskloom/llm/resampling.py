"""Target-distribution importance resampling by partition-local word tries.

A task grows a trie over the words of its texts: the way to a node spells a run of words, and the node holds how often
the run came and the CRC-32 state after its bytes, which the node below goes on from. Counts are summed by bucket, in the
task and then over all tasks, for the corpus and for the target. Every bucket then has a gain, the log of how much more the
target uses it. To score, a task walks its texts down tries whose nodes hold gains in place of counts. The draw adds
Gumbel noise made of a hash of the id, and ranks by ranges, so nothing is sorted in one task.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored, text_of

ORDER, BUCKETS = 1, 10_000
#: Nodes that a trie may have before its counts are summed and it is begun anew; nothing is lost by that.
NODES = 500_000
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(text: str) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_WORDS).split()


def runs(found: list[bytes], order: int) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """All runs of 1 to `order` words, with how often each comes."""
    yield from (((w,), n) for w, n in Counter(found).items())
    for k in range(2, order + 1):
        yield from Counter(zip(*(found[i:] for i in range(k)), strict=False)).items()


class Trie:
    """Nodes are [CRC state, what it holds, nodes below by word]. `fresh` gives what a new node of a bucket holds."""

    def __init__(self, buckets: int, fresh):
        self.buckets, self.fresh, self.size = buckets, fresh, 0
        self.top: list = [0, 0, {}]

    def node(self, run: tuple[bytes, ...]) -> list:
        at = self.top
        for w in run:
            below = at[2].get(w)
            if below is None:
                crc = zlib.crc32(w if at is self.top else b" " + w, at[0])
                below = at[2][w] = [crc, self.fresh(crc % self.buckets), {}]
                self.size += 1
            at = below
        return at

    def emptied(self) -> np.ndarray:
        """The sums of what nodes hold by bucket; the trie is empty afterwards."""
        totals, todo = np.zeros(self.buckets, np.int64), [self.top]
        while todo:
            for below in todo.pop()[2].values():
                totals[below[0] % self.buckets] += below[1]
                if below[2]:
                    todo.append(below)
        self.top, self.size = [0, 0, {}], 0
        return totals


def bucket_counts(texts: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends a row for each bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(buckets, lambda bucket: 0), np.zeros(buckets, np.int64)
        for batch in sliced(batches):
            for t in batch.column(0).to_pylist():
                for run, n in runs(words(t), order):
                    trie.node(run)[1] += n
                if trie.size > NODES:
                    totals += trie.emptied()
        totals += trie.emptied()
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], ["bucket", "n"])

    each = texts.select(text_of(text_col).alias("_t")).mapInArrow(counted, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """For each bucket floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def noise(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u made of the hash of seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(_id, n_words, n_features, weight) of each row of docs."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(len(gain), gain.__getitem__)
        for batch in sliced(batches):
            n_words, n_features, weight = [], [], []
            for t in batch.column(1).to_pylist():
                found = words(t)
                n_words.append(len(found))
                n_features.append(sum(max(0, len(found) - k) for k in range(order)))
                weight.append(sum(trie.node(run)[1] * n for run, n in runs(found, order)))
                if trie.size > NODES:
                    trie = Trie(len(gain), gain.__getitem__)
            longs = (pa.array(x, pa.int64()) for x in (n_words, n_features, weight))
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs], ["_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(scored, f"_id {rows.schema['_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(scores: DataFrame, drawn: Column, order: list[Column]) -> DataFrame:
    """scores, written before, with `rank` of the rows of `drawn` in a total order, from 1; null for the others, which come last.

    Rows are dealt by ranges and sorted within; a rank is the place in the range and the number of rows in those before.
    """
    n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.when(drawn, 0).otherwise(1), *order]
    dealt = stored(scores.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0) + 1))]).tolist()
    place = F.element_at(F.lit(before), (F.shiftright("_at", 33) + 1).cast("int")) + (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))) + 1
    return dealt.withColumn("rank", F.when(drawn, place.cast("long"))).drop("_at")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank (1, 2, 3... of those drawn, else null).

    percent of the documents with at least least_words words are drawn, the highest scores, of equal ones the smaller ids.
    Null and empty texts have no features, weight 0 and aren't drawn. An empty target gives each bucket the same share. A null
    id comes last of equal scores. Rows that repeat an id take part each on its own. Columns other than those named are not read.
    """
    gain = gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, text_col, order, buckets))
    scores = stored(weights(docs, gain, id_col, text_col, order).withColumn("score", F.col("weight") + noise(F.col("_id"), seed)), "scores")
    fit = F.col("n_words") >= least_words
    n = scores.filter(fit).count() * percent // 100
    found = ranked(scores, fit, [F.desc("score"), F.col("_id").asc_nulls_last()])
    return found.select(F.col("_id").alias(id_col), "n_features", "weight", "score", F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))
