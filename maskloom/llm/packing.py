"""Best-fit packing of tokenised documents into sequences, by bin completion.

Lengths are whole numbers up to the capacity, so however many documents there are, the packing problem is the table of
how many pieces have each length: `capacity` rows at most. Bin completion runs on that table. It takes the largest
length left, goes through the undominated fillings of the room beside it, the one that wastes least first, and prunes
what can't beat the incumbent, best fit at first, by the waste it has already allowed; a filling is applied as often as
the counts let it.
The plan, runs of equal sequences, is then laid over the pieces, which are ranked within their length by Spark.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stored, text_of

EOS = 2
Filling = tuple[int, ...]


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken: the same ids at a quarter of the time. As there, the file's
    added tokens are taken out of a text first, each as its own id."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    # The printable stand-ins for bytes that such files use: bytes that print stand for themselves, the rest follow from U+0100.
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    added = {t["content"]: t["id"] for t in told["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in told["model"]["vocab"].items() if piece not in added and all(c in byte_of for c in piece)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def _slow_encoder(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(text: str, path: str) -> list[int]:
    """The text's ids, as tokenizers gives them by default, and the end.

    Runs of some hundred thousand blanks are more than the fast encoder's pattern can go back over; such texts are left to
    tokenizers itself.
    """
    try:
        return [*_encoder(path).encode(text, allowed_special="all"), EOS]
    except ValueError:
        return [*_slow_encoder(path).encode(text, add_special_tokens=False).ids, EOS]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents of up to `capacity` tokens whole, longer ones in full pieces after a first one of what is over."""
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at, out = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array(token_ids(text, path), "<u4")
                ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                for k, end in enumerate(ends):
                    start = max(0, end - capacity)
                    at.append(row)
                    out.append((k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["_id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_id", id_col)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: lengths above half fill a bin each, and what fits beside none of them needs bins of its own."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    half = capacity // 2
    mass = np.cumsum(n * np.arange(capacity + 1))  # mass[s]: all pieces of up to s
    above = np.cumsum(n[::-1])[::-1]  # above[s]: how many pieces of s or more
    a = np.arange(half + 1)
    large = int(above[half + 1])
    beside = above[half + 1] - np.append(above, 0)[capacity - a + 1]  # of the large ones, those that something of a fits beside
    held = mass[capacity - a] - mass[half]
    small = mass[half] - np.append(0, mass)[a]
    over = small - (beside * capacity - held)
    return max(-(-int(mass[-1]) // capacity), large + max(0, int((-(-over // capacity)).max())))


def lower_bound(counts: dict[int, int], capacity: int, most: int = 60) -> int:
    """The larger of least_bins() and what dual feasible functions give: lengths are rounded so that no bin holds more than
    before, lengths under a limit counting nothing and those that leave less than it a whole bin, and then summed."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    best = least_bins(counts, capacity)
    for limit in [0, *(s for s in sizes.tolist() if 2 * s <= capacity)]:
        x = np.where(sizes > capacity - limit, capacity, np.where(sizes < limit, 0, sizes))
        for k in range(1, most):
            rounded = np.where(x * (k + 1) % capacity == 0, x * k, x * (k + 1) // capacity * capacity)
            best = max(best, -(-int((rounded * n).sum()) // (k * capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Runs by best fit in falling order of length: each piece goes to the fullest bin that it fits in, alike bins at a time."""
    bins: dict[int, list[tuple[int, Filling]]] = {}
    rooms: list[int] = []

    def keep(times: int, held: Filling) -> None:
        room = capacity - sum(held)
        if room not in bins:
            insort(rooms, room)
        bins.setdefault(room, []).append((times, held))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                times, held = bins[rooms[i]].pop()
                each = rooms[i] // s
                if not bins[rooms[i]]:
                    del bins[rooms.pop(i)]
            else:
                times, held, each = -(-left // (capacity // s)), (), capacity // s
            full = min(times, left // each)
            over = left - full * each if full < times else 0
            if full:
                keep(full, held + (s,) * each)
            if over:
                keep(1, held + (s,) * over)
            if times - full - (over > 0) > 0:
                keep(times - full - (over > 0), held)
            left -= full * each + over
    return [run for runs in bins.values() for run in runs if run[1]]


def fillings(room: int, counts: dict[int, int], sizes: list[int]) -> Iterator[Filling]:
    """The undominated fillings of the room, one after the other: least waste first, then larger items first.

    Reachable sums of the sizes up to each one, as bits, lead straight to fillings, with no dead ends. A filling is dominated,
    and passed over, if what it wastes has room for a further item, for a larger one in place of one of its items, or for
    one item in place of two: whatever is packed with it can be packed with the other. sizes: those in counts, rising.
    """
    own = [s for s in sizes[: bisect_right(sizes, room)] if counts[s]]
    whole, reach = (1 << room + 1) - 1, [1]
    for s in own:
        bits, left, k = reach[-1], min(counts[s], room // s), 1
        while left:  # so many of s, by doubling
            k = min(k, left)
            bits |= bits << s * k
            left, k = left - k, 2 * k
        reach.append(bits & whole)

    def exact(left: int, i: int, used: Filling) -> Iterator[Filling]:
        while left and i:
            i = min(i, bisect_right(own, left))
            s = own[i - 1]
            for k in range(min(counts[s], left // s), 0, -1):
                if reach[i - 1] >> left - k * s & 1:
                    yield from exact(left - k * s, i - 1, used + (s,) * k)
            i -= 1
            if not reach[i] >> left & 1:
                return
        if not left:
            yield used

    def fits(low: int, high: int, used: Filling) -> bool:
        """Is there an item of low to high that `used` leaves?"""
        i = bisect_left(own, low)
        while i < len(own) and own[i] <= high:
            if counts[own[i]] > used.count(own[i]):
                return True
            i += 1
        return False

    for waste in range(room + 1):
        if not reach[-1] >> room - waste & 1:
            continue
        for f in exact(room - waste, len(own), ()):
            if waste and (fits(1, waste, f) or any(fits(x + 1, x + waste, f) for x in set(f))):
                continue
            if any(fits(x + y, x + y + waste, f) for i, x in enumerate(f) for y in f[i + 1 :]):
                continue
            yield f


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> list[tuple[int, Filling]]:
    """Runs (how many bins, the lengths in each) that pack `counts` (length -> how many) into few bins.

    Starts from best fit as the incumbent. Each node takes the largest length left and one undominated filling beside it, as
    often as the counts and the waste that is still affordable let it, and later once; so all packings are reached in
    the end. Stops with a proven optimum when the incumbent meets the lower bound or the search is exhausted, else after
    `nodes` nodes, whatever the size, with the best found.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    total = sum(s * n for s, n in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(n for n, _ in best)

    def children(left: dict[int, int], spare: int) -> Iterator[tuple[int, Filling]]:
        sizes = sorted(left)
        top = sizes[-1]
        rest = left | {top: left[top] - 1}
        several = False
        for once in (False, True):
            for f in fillings(capacity - top, rest, sizes):
                bin_ = (top, *f)
                waste = capacity - sum(bin_)
                if waste > spare:
                    break
                times = min(left[s] // k for s, k in Counter(bin_).items())
                several = several or times > 1
                if once and times == 1:
                    continue
                yield (1 if once else min(times, spare // waste) if waste else times), bin_
            if not several:
                break

    # Depth first, with one iterator of untried fillings for each level.
    path: list[tuple[int, Filling]] = []
    used = wasted = seen = 0
    left = dict(counts)
    spare = lambda: (fewest - 1) * capacity - total - wasted
    stack = [children(dict(left), spare())]
    while stack and fewest > bound and seen < nodes:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if not path:
                break
            n, b = path.pop()
        else:
            n, b = step
            seen += 1
            waste = n * (capacity - sum(b))
            if waste > spare():
                continue  # the incumbent has improved since this filling was listed
            used, wasted = used + n, wasted + waste
            for s in b:
                left[s] -= n
                if not left[s]:
                    del left[s]
            if left and used + least_bins(left, capacity) < fewest:
                path.append(step)
                stack.append(children(dict(left), spare()))
                continue
            if not left and used < fewest:
                fewest, best = used, [*path, step]
        used, wasted = used - n, wasted - n * (capacity - sum(b))
        for s in b:
            left[s] = left.get(s, 0) + n
    return best


def _ranges(plan: list[tuple[int, Filling]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each range, the sequence of that rank, and the place in the sequence."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for times, bin_ in plan:
        offset = 0
        for s in bin_:
            out.setdefault(s, []).append((used.get(s, 0), sequence, offset))
            used[s] = used.get(s, 0) + times
            offset += s
        sequence += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in out.items()}


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone. Null ids and repeated rows are packed like any others; which of two equal
    pieces goes where is no matter. An empty table gives an empty result. Columns other than the two named are not read.
    """
    cut = stored(pieces(docs, id_col, text_col, capacity, tokenizer), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    ranges = _ranges(bin_completion(counts, capacity))
    # Ranks within a length come from salted buckets, so that one frequent length is no task of its own.
    salts = 64 + sum(counts.values()) // 1_000_000
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_within", within).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_within"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for s in np.unique(n):
            at = n == s
            firsts, sequences, offsets = ranges[int(s)]
            i = np.searchsorted(firsts, r[at], "right") - 1
            sequence[at], offset[at] = sequences[i] + r[at] - firsts[i], offsets[i]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = ranked.withColumn("_at", place("length", "_rank"))
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
