"""Writers: texts and bytes under names of their own, mappings, the index of processed documents, output names."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import ENTITY_TYPES, OUTPUT_FOLDER, RESTORED_FOLDER
from ..functions.text import parent, restored_name, stem, suffix
from ..operators.pseudonyms import ranked


def write_files(df: DataFrame, path_col: str = "path", data_col: str = "data") -> int:
    """Writes each row's text or bytes to its path, one file each, and says how many. Paths are on a file system that all executors mount."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["data"], strict=True):
                path = path.removeprefix("file://").removeprefix("file:")
                if re.match("[A-Za-z][A-Za-z0-9+.-]*://?", path):
                    raise ValueError(f"files are written to a mounted file system, not to {path}")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.part-{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(bytes(data))
                os.replace(part, path)  # whole or not at all, also where a task runs twice
            yield pd.DataFrame({"n": [len(batch)]})

    data = F.col(data_col) if dict(df.dtypes)[data_col] == "binary" else F.encode(data_col, "UTF-8")
    return df.select(F.col(path_col).alias("path"), data.alias("data")).mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _aside(path: str) -> str:
    return f"{path.rstrip('/')}.old"


def swap(spark: SparkSession, new: str, path: str) -> None:
    """new takes the place of path. What was there is moved aside first and deleted last, so a run that breaks off leaves one
    of the two; recovered() brings it back."""
    fs, to = _at(spark, path)
    _, old = _at(spark, _aside(path))
    if fs.exists(to):
        fs.delete(old, True)
        fs.rename(to, old)
    if not fs.rename(_at(spark, new)[1], to):
        raise OSError(f"could not move {new} to {path}")
    fs.delete(old, True)


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at path, brought back from aside if a run broke off while it was replaced."""
    fs, to = _at(spark, path)
    _, old = _at(spark, _aside(path))
    if not fs.exists(to) and fs.exists(old):
        fs.rename(old, to)
    return fs.exists(to)


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """The column line, sorted by order, as one text file, replaced as a whole. One task writes it, sorted outside memory."""
    spark = lines.sparkSession
    beside = f"{path}.new"
    lines.repartition(1).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(beside)
    fs, folder = _at(spark, beside)
    part = next(x.getPath().toString() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    swap(spark, part, path)
    fs.delete(folder, True)


def mapping_lines(mapping: DataFrame) -> DataFrame:
    """(type, o, original, line): the lines of a mapping as indented JSON, types and values sorted, empty types left out."""
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    last = mapping.groupBy("type").agg(F.max("original").alias("last")).withColumn("more", F.lead("type").over(Window.orderBy("type")).isNotNull())
    comma = lambda more: F.when(more, ",").otherwise("")
    row = lambda df, o, original, line: df.select("type", F.lit(o).alias("o"), original.alias("original"), line.alias("line"))
    none = F.lit("")
    heads = row(last, 0, none, F.concat(F.lit("  "), quoted("type"), F.lit(": {")))
    tails = row(last, 2, none, F.concat(F.lit("  }"), comma(F.col("more"))))
    body = row(mapping.join(last, "type"), 1, F.col("original"), F.concat(F.lit("    "), quoted("original"), F.lit(": "), quoted("pseudonym"), comma(F.col("original") != F.col("last"))))
    ends = mapping.sparkSession.createDataFrame([("", -1, "", "{"), (chr(0x10FFFF), 3, "", "}")], "type string, o int, original string, line string")
    return heads.unionByName(body).unionByName(tails).unionByName(ends)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """A mapping as JSON {type: {original: pseudonym}} where path ends in .json, else as Parquet; replaced as a whole."""
    if path.endswith(".json"):
        write_lines(mapping_lines(mapping), ["type", "o", "original"], path)
        return
    beside = f"{path.rstrip('/')}.new"
    mapping.write.mode("overwrite").parquet(beside)
    swap(mapping.sparkSession, beside, path)


def append_lines(spark: SparkSession, path: str, values: list[str]) -> None:
    """Values, one a line, at the end of a text file that may not be there yet, such as an ignore list."""
    new = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "late int, at long, line string")
    if recovered(spark, path):
        old = spark.read.text(path).select(F.lit(0).alias("late"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
        new = old.unionByName(new)
    write_lines(new, ["late", "at"], path)


def mapping_json(mapping: DataFrame) -> DataFrame:
    """(type, json): each type's bucket as a JSON object with sorted keys; a bucket is one row, so for mappings of moderate size."""
    bucket = F.map_from_entries(F.array_sort(F.collect_list(F.struct("original", "pseudonym"))))
    return mapping.filter(F.col("type").isin(list(ENTITY_TYPES))).groupBy("type").agg(F.to_json(bucket).alias("json"))


def output_names(paths: DataFrame, path_col: str = "path", order_col: str = "doc_ord") -> DataFrame:
    """paths with base, the output's name without its suffix: <stem>_anon, next <stem>_<suffix>_anon, then with a number from 2 on.

    Names are reserved over the whole run. The first of a stem in order takes the first form; the others take the second
    by suffix, and a name that was taken meanwhile by another stem moves the number on. Ranks are taken over ranges: a tree in which
    all files have one name is no single task.
    """
    own = paths.withColumn("_stem", stem(F.col(path_col))).withColumn("_tag", F.coalesce(F.nullif(F.substring(suffix(F.col(path_col)), 2, 100), F.lit("")), F.lit("src")))
    own = ranked(own, "_stem", [order_col], "_nth")
    # <stem>_<tag>_anon may also be the first form of a file whose stem is <stem>_<tag>; it counts as taken if that file comes earlier.
    firsts = own.filter("_nth = 1").select(F.concat("_stem", F.lit("_anon")).alias("_name"), F.col(order_col).alias("_taken"))
    rest = own.filter("_nth > 1").withColumn("_name", F.concat("_stem", F.lit("_"), "_tag", F.lit("_anon"))).join(firsts, "_name", "left")
    shift = F.when(F.col("_taken") < F.col(order_col), 1).otherwise(0)
    nth = F.col("_again") + shift
    rest = ranked(rest, "_name", [order_col], "_again").withColumn("base", F.when(nth == 1, F.col("_name")).otherwise(F.concat("_name", F.lit("_"), nth.cast("string"))))
    first = own.filter("_nth = 1").withColumn("base", F.concat("_stem", F.lit("_anon")))
    return first.drop("_stem", "_tag", "_nth").unionByName(rest.select(*paths.columns, "base"))


def output_dir(path: Column) -> Column:
    """Beside the source, in a folder of its own."""
    return F.concat(parent(path), F.lit(f"/{OUTPUT_FOLDER}"))


def restored_path(path: Column, out: str | None = None) -> Column:
    """Where a restored artifact goes: out, or beside the folder of outputs, or below the artifact's own folder."""
    folder = parent(path)
    beside = F.when(F.lower(F.substring_index(folder, "/", -1)) == OUTPUT_FOLDER, F.concat(parent(folder), F.lit(f"/{RESTORED_FOLDER}"))).otherwise(F.concat(folder, F.lit(f"/{RESTORED_FOLDER}")))
    return F.concat(F.lit(out) if out else beside, F.lit("/"), restored_name(path))


def index_upsert(old: DataFrame | None, new: DataFrame, key: str = "output") -> DataFrame:
    """The index with new entries in place of those of the same key."""
    if old is None:
        return new.orderBy(key)
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(key)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """An index written before; None if there is none. One that is there and can't be read is an error, not a new index."""
    return spark.read.parquet(path) if recovered(spark, path) else None
