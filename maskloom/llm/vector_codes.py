"""Vector code compression: four codebooks of 256 entries, found by rounds of assigning and averaging, searched by ball trees.

A part of a vector belongs to the nearest entry of its position. The entries of a position stand in a ball tree; a search
first goes down to the ball whose centre is nearest, then visits every ball that may hold an entry as near. Radii are
rounded up and distances to centres down, and a ball is visited where the bound equals the best distance, so no nearest
entry and no tie is missed; what decides is the exact integer distance, and of equal ones the lower index.

Tasks assign their vectors to the entries of the round, 1,024 at most, and send one row of counts and sums for each entry
used, so no entry and no label is gathered in one task, and the driver sees the entries alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Entries in a ball that is split no further.
LEAF = 16
#: Vectors that are searched for at a time.
_BATCH = 4096


@dataclass
class Ball:
    """A ball around some entries: its centre, a radius rounded up, and its two halves, or the entries' indexes."""

    centre: np.ndarray
    radius: float
    own: np.ndarray
    halves: list[Ball] = field(default_factory=list)


def up(x: np.ndarray) -> np.ndarray:
    """Roots of integers, rounded up."""
    return np.nextafter(np.sqrt(np.asarray(x, float)), np.inf)


def down(x: np.ndarray) -> np.ndarray:
    """Roots of integers, rounded down."""
    return np.maximum(np.nextafter(np.sqrt(np.asarray(x, float)), -np.inf), 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all c, exact. Products of small integers are taken as doubles, which is as exact and faster."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 2**52 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def ball_tree(entries: np.ndarray, own: np.ndarray | None = None) -> Ball:
    """Halved where the entries spread widest."""
    own = np.arange(len(entries)) if own is None else own
    points = entries[own]
    centre = points.sum(0) // len(points)
    ball = Ball(centre, float(up(squared(points, centre[None]).max())), own)
    if len(own) > LEAF:
        order = own[np.argsort(points[:, np.argmax(points.max(0) - points.min(0))], kind="stable")]
        ball.halves = [ball_tree(entries, order[: len(order) // 2]), ball_tree(entries, order[len(order) // 2 :])]
    return ball


def nearest(tree: Ball, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each x, the lower index of equal ones."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
    home = np.zeros(len(x), np.int64)  # the leaf that each began with

    def leaf(ball: Ball, rows: np.ndarray) -> None:
        own = np.sort(ball.own)
        d = squared(x[rows], entries[own])
        k = d.argmin(1)
        found, index = d[np.arange(len(rows)), k], own[k]
        better = (found < best[rows]) | (found == best[rows]) & (index < at[rows])
        best[rows[better]], at[rows[better]] = found[better], index[better]

    def begin(ball: Ball, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not ball.halves:
            home[rows] = id(ball)
            return leaf(ball, rows)
        left = squared(x[rows], np.stack([h.centre for h in ball.halves])).argmin(1) == 0
        begin(ball.halves[0], rows[left])
        begin(ball.halves[1], rows[~left])

    def visit(ball: Ball, rows: np.ndarray) -> None:
        rows = rows[down(squared(x[rows], ball.centre[None])[:, 0]) - ball.radius <= up(best[rows])]
        if not ball.halves:
            rows = rows[home[rows] != id(ball)]
        if not len(rows):
            return
        if not ball.halves:
            return leaf(ball, rows)
        for half in ball.halves:
            visit(half, rows)

    every = np.arange(len(x))
    begin(tree, every)
    visit(tree, every)
    return at, best


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(_id, _label, _v) of the rows that are kept, written: _v the floors of 1024 times the components, zeros added up to a multiple of four.

    Integers stop at a root of 2^60 by the number of components, so that no squared distance of a vector passes a long.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), v.alias("_x"))
    dims = F.size("_x") + F.pmod(-F.size("_x"), F.lit(PARTS))
    most = F.sqrt(F.lit(2.0**62) / dims) / 2
    kept = F.transform("_x", lambda x: F.greatest(-most, F.least(most, F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x)) * 1024).cast("double"))).cast("long"))
    padded = F.concat(kept, F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size("_x"), F.lit(PARTS))))
    return stored(rows.select("_id", "_label", padded.alias("_v")), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length, cut into parts: (rows, parts, components)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), PARTS, -1)


def _assigned(x: np.ndarray, books: np.ndarray, trees: list[Ball]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances), a column for each part."""
    found = [nearest(trees[p], books[p], x[:, p]) for p in range(PARTS)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def one_round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after assigning all vectors and averaging. books: (parts, entries, components)."""
    parts, n, width = books.shape
    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]
    schema = "part int, entry int, " + ", ".join(f"{c} decimal(38,0)" for c in names[2:])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [ball_tree(b) for b in books]
        count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for batch in batches:
            for i in range(0, len(batch), _BATCH):
                x = _matrix(batch.column(0).slice(i, _BATCH))
                at, _ = _assigned(x, books, trees)
                for p in range(parts):
                    used = np.unique(at[:, p])
                    order = np.argsort(at[:, p], kind="stable")
                    first = np.searchsorted(at[order, p], used)
                    count[p, used] += np.diff(np.append(first, len(order)))
                    total[p, used] += np.add.reduceat(x[order, p], first)
        at = np.argwhere(count > 0)
        whole = lambda values: pa.array(values).cast(pa.decimal128(38, 0))
        if len(at):
            p, e = at.T
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), whole(count[p, e]), *(whole(total[p, e, i]) for i in range(width))], names)

    met = vectors.select("_v").mapInArrow(sums, schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:]))
    after = books.copy()
    for r in met.collect():  # a row for each entry, 1,024 at most
        after[r["part"], r["entry"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(width)]
    return after


def codebooks(vectors: DataFrame, dims: int, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, components). The first entries are the parts of the vectors with the smallest ids, ascending."""
    first = vectors.orderBy(F.col("_id").asc_nulls_last(), "_v").select("_v").limit(ENTRIES).collect()
    books = np.array([r["_v"] for r in first], np.int64).reshape(len(first), PARTS, dims // PARTS).swapaxes(0, 1)
    for _ in range(rounds if first else 0):
        books = one_round(vectors, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per vector that is kept: id, code, error, label_error, codebooks_sha256.

    A vector that is null, empty or holds a component that is null or not finite is dropped, and so is one of another length
    than that of the vector with the smallest id. Zeros fill up lengths that four doesn't divide; components so large that
    a squared distance would pass a long are taken as the largest that doesn't. Null ids come last among ids; of rows that
    repeat an id the lesser vector comes first, and each gets a row of its own. Fewer than 256 vectors make so many entries,
    no vector an empty result. label_error sums over the rows of a label, null labels together, and stops at the largest
    long. Columns other than the three named are not read.
    """
    vectors = integers(table, id_col, vector_col, label_col)
    first = vectors.orderBy(F.col("_id").asc_nulls_last(), "_v").select(F.size("_v")).limit(1).collect()
    dims = first[0][0] if first else PARTS
    vectors = vectors.filter(F.size("_v") == dims)
    books = codebooks(vectors, dims, rounds)
    kinds = vectors.schema

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [ball_tree(b) for b in books if len(b)]
        for batch in batches:
            for i in range(0, len(batch), _BATCH):
                part = batch.slice(i, _BATCH)
                at, d = _assigned(_matrix(part.column(2)), books, trees)
                codes = [bytes(row).hex() for row in at.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(d.sum(1))], ["_id", "_label", "code", "error"])

    schema = f"_id {kinds['_id'].dataType.simpleString()}, _label {kinds['_label'].dataType.simpleString()}, code string, error long"
    found = stored(vectors.mapInArrow(coded, schema), "codes")
    sums = found.groupBy(F.col("_label").alias("_of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return found.join(sums, F.col("_label").eqNullSafe(F.col("_of"))).select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
