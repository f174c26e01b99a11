"""Pseudonyms: numbering of new values, anonymising texts, restoring them, and what is counted on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import ENTITY_TYPES, LONG_TOKEN, TOKEN
from ..functions.jsontext import GUARD, json_escaped, json_layout
from ..functions.spans import find, splice
from ..functions.text import pseudonym, strip
from ..plans.storage import stored
from .detect import Detector, Dictionary, with_spans

MAPPING = "type string, original string, pseudonym string"
#: The number of a text while its spans are joined apart from it.
UNIT = "_maskloom_unit"


def empty_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MAPPING)


def ranked(df: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """df with the rank of each row in its group, from 1, in a total order. No group is in one task.

    Rows are dealt by ranges of (group, order); a rank is that within the range plus what the group has in earlier ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = sizes.select(group, "_range", (F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    return dealt.withColumn("_within", within).join(before, [group, "_range"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")


def filled_down(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the last value in its group up to each row that isn't null, in a total order. No group is in one task.

    Rows are dealt by ranges of (group, order) and filled within a range; what a range ends with goes to the later ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ends = dealt.filter(F.col(value).isNotNull()).groupBy(group, "_range").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    held = dealt.select(group, "_range").distinct().join(ends, [group, "_range"], "left")  # a row for each range of a group
    above = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(group, "_range", F.last("_end", True).over(above).alias("_carried"))
    within = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn(name, F.last(value, True).over(within)).join(carried, [group, "_range"])
    return own.withColumn(name, F.coalesce(name, "_carried")).drop("_range", "_carried")


def suffix_number(token: Column) -> Column:
    """The number after the last underscore; null if there is none."""
    return F.when(F.contains(token, F.lit("_")), F.substring_index(token, "_", -1)).try_cast("int")


def next_numbers(mapping: DataFrame) -> DataFrame:
    """(type, next) for the types of the mapping; unparsable suffixes don't count."""
    return mapping.groupBy("type").agg((F.coalesce(F.max(suffix_number(F.col("pseudonym"))), F.lit(0)) + 1).alias("next"))


def first_seen(found: DataFrame, order: list[str]) -> DataFrame:
    """(type, original, seen): each value with its first place; within one text the right-most comes first."""
    spans = found.filter(F.size("spans") > 0).select(*order, F.explode("spans").alias("s"))
    return spans.groupBy(F.col("s.type").alias("type"), strip(F.col("s.value")).alias("original")).agg(F.min(F.struct(*order, (-F.col("s.start")).alias("back"))).alias("seen"))


def extended(mapping: DataFrame, seen: DataFrame) -> DataFrame:
    """The mapping with values (type, original, seen) that it lacks, numbered on from its largest numbers by first place."""
    new = seen.join(mapping, ["type", "original"], "left_anti")
    numbered = ranked(new, "type", ["seen", "original"]).join(next_numbers(mapping), "type", "left")
    n = F.coalesce("next", F.lit(1)) + F.col("rank") - 1
    return mapping.select("type", "original", "pseudonym").unionByName(numbered.select("type", "original", pseudonym(F.col("type"), n.cast("int")).alias("pseudonym")))


def replaced(found: DataFrame, mapping: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts with their spans replaced by pseudonyms. Only texts that have spans are joined, the spans apart from the texts. found:
    as found_in() gives it, or any other frame with a column spans, which is written first."""
    told = found if UNIT in found.columns else found_in(found)
    hits = told.filter(F.size("spans") > 0)
    spans = hits.select(UNIT, F.explode("spans").alias("s")).select(UNIT, "s.start", "s.end", F.col("s.type").alias("type"), strip(F.col("s.value")).alias("original"))
    parts = spans.join(mapping, ["type", "original"]).groupBy(UNIT).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("pseudonym").alias("to")))).alias("_parts"))
    done = hits.join(parts, UNIT).withColumn(text_col, splice(F.col(text_col), F.col("_parts"))).drop("_parts")
    return done.unionByName(told.filter(F.size("spans") == 0)).drop(UNIT, "spans")


def found_in(spans: DataFrame) -> DataFrame:
    """Texts with their spans, written, each row with a number of its own."""
    return stored(spans.withColumn(UNIT, F.monotonically_increasing_id()), "spans")


def anonymise(
    units: DataFrame, order: list[str], mapping: DataFrame | None = None, dictionary: Dictionary | None = None, text_col: str = "text", registry: dict[str, Detector] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(units with pseudonyms in their texts, the mapping with the new ones). order: columns that say which unit is visited first."""
    found = found_in(with_spans(units, dictionary, text_col, registry))
    known = mapping if mapping is not None else empty_mapping(units.sparkSession)
    after = stored(extended(known, first_seen(found, order)), "mapping")
    return replaced(found, after, text_col), after


def token_counts(lines: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """(by, type, n): distinct tokens like TYPE_0001 or TYPE_10000 of each type. Any such token counts, whoever wrote it."""
    tokens = lines.select(*by, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LONG_TOKEN), F.lit(0))).alias("token"))
    return tokens.distinct().groupBy(*by, F.regexp_replace("token", r"_\d+$", "").alias("type")).agg(F.count("*").alias("n"))


def formatted_counts(counts: DataFrame, by: list[str], kind: str = "type", name: str = "counts") -> DataFrame:
    """(by, 'A=1, B=2'), sorted by kind."""
    return counts.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat(kind, F.lit("="), F.col("n").cast("string")))), ", ").alias(name))


def mapping_stats(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("type").agg(F.count("*").alias("n"))


def check_types(mapping: DataFrame) -> None:
    unknown = [r["type"] for r in mapping.select("type").distinct().filter(~F.col("type").isin(list(ENTITY_TYPES))).collect()]
    if unknown:
        raise ValueError(f"unknown entity types: {sorted(unknown)}")


def original_of(mapping: DataFrame, token: str) -> DataFrame:
    return mapping.filter(F.col("pseudonym") == token).select("original")


def reverse_mapping(mapping: DataFrame) -> DataFrame:
    """(pseudonym, original): for a pseudonym that comes twice, the first by type in registry order, then by value."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ENTITY_TYPES)), F.col("type")), F.lit(99))
    return mapping.groupBy("pseudonym").agg(F.min_by("original", F.struct(F.when(rank == 0, 99).otherwise(rank), "type", "original")).alias("original"))


def _spliced(texts: DataFrame, known: DataFrame, text_col: str, token: str) -> DataFrame:
    """As restored(), with known (pseudonym, original) put in as it is."""
    told = stored(texts.withColumn("_unit", F.monotonically_increasing_id()).withColumn("_spans", find(F.coalesce(F.col(text_col), F.lit("")), token, "", 0)), "tokens")
    tokens = told.select("_unit", F.explode("_spans").alias("s")).select("_unit", "s.start", "s.end", F.col("s.value").alias("pseudonym"))
    joined = tokens.join(known, "pseudonym", "left")
    parts = joined.groupBy("_unit").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce("original", "pseudonym").alias("to")))).alias("_parts"),
        F.array_sort(F.collect_set(F.when(F.col("original").isNull(), F.col("pseudonym")))).alias("unknown"),
    )
    out = told.join(parts, "_unit", "left").withColumn("tokens", F.size("_spans"))
    return out.withColumn(text_col, F.when(F.col("_parts").isNull(), F.col(text_col)).otherwise(splice(F.col(text_col), F.col("_parts")))).withColumn(
        "unknown", F.coalesce("unknown", F.array().cast("array<string>"))
    ).drop("_unit", "_spans", "_parts")


def restored(texts: DataFrame, mapping: DataFrame, text_col: str = "text", token: str = LONG_TOKEN) -> DataFrame:
    """texts with the original values back, and columns tokens (how many) and unknown (distinct ones that the mapping lacks).

    token: the pattern of pseudonyms, TOKEN where numbers have four digits and no more, as in texts with digits right behind them.
    """
    return _spliced(texts, reverse_mapping(mapping), text_col, token)


def restored_json(files: DataFrame, mapping: DataFrame, json_col: str = "text", token: str = LONG_TOKEN) -> DataFrame:
    """JSON files with originals back in their string values; keys and numbers stay as written, members in their order, all laid out
    with an indent of two. Columns tokens and unknown as in restored(). A text that is no JSON becomes null, without tokens.

    The values are spliced where they stand in the text, so tokens meet the mapping in one join by key and no tree is built.
    """
    guarded = files.withColumn(json_col, json_layout(F.col(json_col), GUARD))
    known = reverse_mapping(mapping).withColumn("original", json_escaped(F.col("original")))
    return _spliced(guarded, known, json_col, token).withColumn(json_col, F.replace(F.col(json_col), F.lit(GUARD), F.lit("")))


def restore_stats(done: DataFrame, by: list[str]) -> DataFrame:
    """(by, replaced, unresolved): tokens less distinct unknown ones, as each file counts; repeats of an unknown token count as
    replaced. unresolved: how many different tokens are unknown; see unknown_tokens()."""
    counts = done.groupBy(*by).agg(F.sum(F.col("tokens") - F.size("unknown")).alias("replaced"))
    lost = unknown_tokens(done, by).groupBy(*by).agg(F.count("*").cast("int").alias("unresolved"))
    pairs = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = counts.join(lost.withColumnsRenamed({c: f"_{c}" for c in by}), pairs, "left")
    return joined.select(*by, "replaced", F.coalesce("unresolved", F.lit(0)).alias("unresolved"))


def unknown_tokens(done: DataFrame, by: list[str]) -> DataFrame:
    """(by, token): the different tokens that the mapping lacks."""
    return done.select(*by, F.explode("unknown").alias("token")).distinct()
