"""Spans as array columns: finding them with offsets, resolving overlaps, splicing replacements."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, in_chunks, root, running

SPAN = "struct<value:string,type:string,start:int,end:int,ord:int>"
NONE = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(NONE)


def span(value: Column, kind: Column | str, start: Column, end: Column, order: int) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(value.alias("value"), kind.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(order).alias("ord")).cast(SPAN)


def find(text: Column, pattern: str | Column, kind: Column | str, order: int, group: int = 0, needs: str | None = None) -> Column:
    """All matches of the pattern, the same for all rows or each row's own, with their offsets. A group other than 0 has to end its match.

    The gaps between matches give the offsets, by their running sums. Texts without a match cost one
    test; needs, a set of characters one of which every match holds, makes that cheap for most texts.
    """
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    gaps = F.split(text, p, -1)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else matches

    def walk(x):
        ahead = running(F.zip_with(F.slice(x["g"], 1, F.size(x["m"])), x["m"], lambda g, m: F.length(g) + F.length(m)))
        parts = F.arrays_zip(F.slice(x["g"], 1, F.size(x["m"])).alias("g"), x["m"].alias("m"), x["v"].alias("v"), ahead.alias("at"))
        end = lambda y: y["at"] + F.length(y["g"]) + F.length(y["m"])
        return F.transform(parts, lambda y: span(y["v"], kind, end(y) - F.length(y["v"]), end(y), order))

    found = bound(F.struct(gaps.alias("g"), matches.alias("m"), values.alias("v")), walk)
    there = text.rlike(needs) & F.rlike(text, p) if needs else F.rlike(text, p)
    return F.when(there, found).otherwise(no_spans())


#: Spans of a text that are resolved by comparing each with all kept; more are resolved by where their ends are.
FEW = 64


def resolve(spans: Column) -> Column:
    """Non-overlapping spans: longest first, then leftmost, then by detector; in the order of the text. Touching is no overlap."""
    n = F.size(spans)
    many = F.arrow_udf(_resolve_many, NONE)(F.when(n > FEW, spans))
    return F.when(n < 2, spans).when(n > FEW, many).otherwise(_resolve_few(spans))


def _resolve_few(spans: Column) -> Column:
    def first(a, b):
        longer = (b["end"] - b["start"]) - (a["end"] - a["start"])
        return F.when(longer != 0, longer).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["ord"] - b["ord"])

    free = lambda acc, m: F.when(F.exists(acc, lambda o: (m["start"] < o["end"]) & (m["end"] > o["start"])), acc).otherwise(F.concat(acc, F.array(m)))
    return F.array_sort(F.aggregate(F.array_sort(spans, first), no_spans(), free), lambda a, b: a["start"] - b["start"])


def kept_spans(start: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The places of the spans that stay, in the order of the text.

    What is kept is at least as long as what comes after it, so a later span overlaps one of them only if one of its own
    ends lies within: two look-ups of who holds the stretch there, and every stretch is marked once.
    """
    points = np.unique(np.concatenate([start, end]))
    low, high = np.searchsorted(points, start).tolist(), np.searchsorted(points, end).tolist()
    holder = np.full(len(points) + 1, -1)
    kept = []
    for i in np.lexsort((order, start, start - end)).tolist():
        a, b = low[i], high[i]
        if a < b and holder[a] < 0 and holder[b - 1] < 0:
            holder[a:b] = i
            kept.append(i)
        elif a == b and (a == 0 or holder[a] < 0 or holder[a] != holder[a - 1]):
            kept.append(i)
    at = np.array(kept, np.int64)
    return at[np.argsort(start[at], kind="stable")]


def _resolve_many(spans: pa.Array) -> pa.Array:
    if spans.null_count == len(spans):
        return spans
    flat, sizes, taken = spans.flatten(), [], []
    columns = [flat.field(flat.type.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("start", "end", "ord")]
    at = 0
    for n, null in zip(spans.value_lengths().fill_null(0).to_pylist(), spans.is_null().to_pylist(), strict=True):
        found = kept_spans(*(c[at : at + n] for c in columns)) + at if n else np.zeros(0, np.int64)
        taken.append(found)
        sizes.append(None if null else len(found))
        at += n
    ends = np.cumsum([0, *(n or 0 for n in sizes)])
    offsets = pa.array([None if i < len(sizes) and sizes[i] is None else int(e) for i, e in enumerate(ends)], pa.int32())
    return pa.ListArray.from_arrays(offsets, flat.take(pa.array(np.concatenate([np.zeros(0, np.int64), *taken]))), type=spans.type)


def splice(text: Column, parts: Column) -> Column:
    """The text with parts (start, end, to), sorted and apart, replaced. In chunks, so that a long text isn't built up anew for each part."""

    def chunk(own, k, step):
        low = F.when(k == 0, 0).otherwise(F.element_at(parts, F.greatest(k * step, F.lit(1)))["end"])
        part = F.substring(text, low + 1, F.element_at(own, -1)["end"] - low)
        begun = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        one = lambda t: F.aggregate(own, begun, lambda acc, p: F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, p["start"] - low - acc["at"]), p["to"]).alias("out"), (p["end"] - low).alias("at")))["out"]
        return bound(part, one)

    chunks = bound(root(F.size(parts)), lambda step: F.transform(in_chunks(parts, step), lambda own, k: chunk(own, k, step)))
    spliced = F.concat(F.array_join(chunks, ""), F.substring(text, F.element_at(parts, -1)["end"] + 1, F.length(text)))
    return F.when(F.size(parts) == 0, text).otherwise(spliced)


def from_each(text: Column, pattern: str, reach: int = 400) -> Column:
    """(start, head) for each place where the pattern matches: head is the text from there on, `reach` characters at least if there are."""
    pieces = F.split(F.concat(F.lit("\u0000"), text), f"(?={pattern})", -1)

    def walk(p):
        starts = running(F.transform(p, lambda x: F.length(x)))
        one = lambda at, i: F.struct((at - 1).alias("start"), _joined(p, i, reach).alias("head"))
        return F.slice(F.transform(starts, one), 2, F.size(p))

    return bound(pieces, walk)


def _joined(pieces: Column, i: Column, reach: int) -> Column:
    """Pieces from i on, until they are `reach` long or there are no more; a few do for nearly all."""
    few = F.array_join(F.slice(pieces, i + 1, 8), "")
    return F.when((F.length(few) >= reach) | (i + 8 >= F.size(pieces)), few).otherwise(F.array_join(F.slice(pieces, i + 1, reach), ""))
