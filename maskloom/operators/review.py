"""Review candidates: values that look like entities in their context but were not replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CANDIDATE_START, LONG_TOKEN, REVIEW_PATTERNS, STOP_PREFIXES, STOP_WORDS
from ..functions.text import bound, occurrences, strip
from ..plans.storage import stored
from .detect import CYRILLIC, Dictionary, with_spans
from .intervals import meeting

CONTEXT = 25


_HIT = "array<struct<ord:int,reason:string,type_guess:string,start:int,end:int,raw:string>>"


def _context(text: Column, ord_: int, reason: str, pattern: str, groups: int, guess: str) -> Column:
    """All matches of one context pattern, with the first of its groups that holds something."""
    p = F.lit(pattern)
    raw = [f"r{i}" for i in range(1, groups + 1)]
    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, p, F.lit(0)).alias("m"), *(F.regexp_extract_all(text, p, F.lit(i)).alias(r) for i, r in enumerate(raw, 1)))

    def step(acc, x):
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        value = F.coalesce(*(F.nullif(x[r], F.lit("")) for r in raw), F.lit(""))
        one = F.struct(F.lit(ord_).alias("ord"), F.lit(reason).alias("reason"), F.lit(guess).alias("type_guess"), begin.alias("start"), end.alias("end"), value.alias("raw"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).cast(_HIT).alias("out"))

    def walk(x):
        zipped = F.arrays_zip(F.slice(x["g"], 1, F.size(x["m"])).alias("g"), x["m"].alias("m"), *(x[r].alias(r) for r in raw))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(_HIT).alias("out")), step, lambda acc: acc["out"])

    return F.when(text.rlike(CYRILLIC) & text.rlike(pattern), bound(parts, walk)).otherwise(F.array().cast(_HIT))


def _contexts(text: Column) -> Column:
    """All matches of the context patterns, pattern by pattern."""
    return F.concat(*(_context(text, i, reason, pattern, groups, guess) for i, (reason, pattern, groups, guess) in enumerate(REVIEW_PATTERNS)))


def candidates(units: DataFrame, key: list[str], ignore: DataFrame | None = None, dictionary: Dictionary | None = None, text_col: str = "text") -> DataFrame:
    """(key, value, type_guess, context, reason): once for each unit, value in any case and type.

    key has to tell units apart. ignore: (value_lower), values that people have looked at and let pass.
    """
    found = stored(with_spans(units.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(*key, F.col(text_col).alias("_text")), dictionary, "_text"), "found")
    hits = found.withColumn("_c", F.explode(_contexts(F.col("_text")))).select(*key, "_text", "_c.*").filter("raw <> ''")
    parts = hits.select("*", F.posexplode(F.split("raw", r"[,(\n]", -1)).alias("pos", "part"))
    value = F.btrim(F.btrim(strip(F.col("part")), F.lit("«»\"'")), F.lit(" ;:."))
    parts = parts.withColumn("value", value).withColumn("low", F.lower("value"))
    named = parts.filter((F.length("value") >= 2) & ~F.col("value").rlike(f"^{LONG_TOKEN}$") & F.col("value").rlike(CANDIDATE_START) & ~F.col("low").isin(STOP_WORDS))
    for prefix in STOP_PREFIXES:
        named = named.filter(~F.startswith("low", F.lit(prefix)))
    if ignore is not None:
        named = named.join(ignore.select(F.col("value_lower").alias("low")).distinct(), "low", "left_anti")
    near = occurrences(F.col("_text"), F.col("value"), F.greatest(F.col("start") - 5, F.lit(0)))
    places = named.withColumn("_near", near).withColumn("_at", F.when(F.size("_near") > 0, F.col("_near")).otherwise(occurrences(F.col("_text"), F.col("value"))))
    places = stored(places.drop("_near").withColumn("_row", F.monotonically_increasing_id()), "places")
    at = places.select(*key, "_row", F.explode("_at").alias("start"), F.length("value").alias("_n")).withColumn("end", F.col("start") + F.col("_n"))
    spans = found.select(*key, F.explode("spans").alias("s")).select(*key, "s.start", "s.end")
    over = meeting(at, spans, key, "_row")
    first = F.row_number().over(Window.partitionBy(*key, "low", "type_guess").orderBy("ord", "start", "pos"))
    low = F.greatest(F.col("start") - CONTEXT, F.lit(0))
    context = strip(F.substring(F.col("_text"), low + 1, F.col("end") + CONTEXT - low))
    return places.join(over, "_row", "left_anti").withColumn("_n", first).filter("_n = 1").select(*key, "value", "type_guess", context.alias("context"), "reason")


def grouped(found: DataFrame, by: list[str], order: list[str], loc: Column) -> DataFrame:
    """(by, value, type_guess, reason, example_context, locations, count): candidates of one value, in any case, and type."""
    at = F.struct(*order)
    first = lambda c: F.min_by(c, at).alias(c)
    return (
        found.groupBy(*by, F.lower("value").alias("_low"), "type_guess")
        .agg(first("value"), first("reason"), F.min_by("context", at).alias("example_context"), F.array_sort(F.collect_list(F.struct(at.alias("at"), loc.alias("loc")))).alias("_locs"), F.count("*").alias("count"))
        .withColumn("locations", F.transform("_locs", lambda x: x["loc"]))
        .drop("_low", "_locs")
    )


def by_type(groups: DataFrame, by: list[str]) -> DataFrame:
    return groups.groupBy(*by, "type_guess").agg(F.count("*").alias("n"))


def totals(groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, by_type): how many candidates, in all and by type."""
    counts = by_type(groups, by)
    return counts.groupBy(*by).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type_guess", "n")))).alias("by_type"))


def add_ignored(ignore: DataFrame, values: list[str]) -> DataFrame:
    """The ignore list with further values."""
    new = ignore.sparkSession.createDataFrame([(v.strip().lower(),) for v in values], "value_lower string")
    return ignore.unionByName(new).filter("value_lower <> ''").distinct()
