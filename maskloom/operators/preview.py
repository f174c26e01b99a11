"""What a preview shows: totals, places of a value one after the other, and what is highlighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import LONG_TOKEN
from ..functions.spans import NONE, resolve, span
from ..functions.text import bound, places


def totals(lines: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """(by, replaced, most): how many pseudonyms stand there, and how often the most frequent one does."""
    tokens = lines.select(*by, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LONG_TOKEN), F.lit(0))).alias("token"))
    counts = tokens.groupBy(*by, "token").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.sum("n").alias("replaced"), F.max("n").alias("most"))


def walk(texts: DataFrame, key: list[str], text_col: str = "text", value_col: str = "value") -> DataFrame:
    """(key, nth, start_at, previous_at, next_at): the places of each row's value in its text, each looked for behind the one
    before. The first place's previous is the last, the last one's next the first."""
    at = bound(places(F.col(text_col), F.col(value_col)), lambda p: F.transform(p, lambda x, i: F.struct(i.alias("nth"), x.alias("start_at"), p[F.pmod(i - 1, F.size(p))].alias("previous_at"), p[F.pmod(i + 1, F.size(p))].alias("next_at"))))
    return texts.select(*key, F.explode(at).alias("_p")).select(*key, "_p.*")


def highlights(text: Column, values: Column) -> Column:
    """Spans of the values in a text, an array: longer values first, so that none is marked within another."""
    found = F.flatten(F.transform(F.array_distinct(values), lambda v: F.transform(places(text, v), lambda i: span(v, "", i, i + F.length(v), 0))))
    return resolve(found.cast(NONE))
