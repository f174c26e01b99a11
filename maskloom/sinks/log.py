"""A mapping that many runs and batches add to, as a log of numbered commits.

A commit is one small file that names the folders of Parquet which make up the mapping and the next number of each type.
It is written under the number after the last, and only if no other writer was first; a writer that comes second looks
up its values again and numbers what is still new from where the other ended. So no number is given twice, and nothing is
read to find the next.

Values lie in `BUCKETS` folders by their hash, so a batch reads only the buckets of its own values. Small folders are merged with
others of their size, eight at a time, so their number grows with the logarithm of the commits.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pseudonym
from ..operators.pseudonyms import MAPPING, next_numbers, ranked
from ..plans.storage import stored
from .files import _at

BUCKETS = 64
#: Folders of one level that are merged into one of the next.
MERGED = 8
#: How often a writer tries again when others are first.
TRIES = 50


@dataclass
class State:
    """version: the last commit; folders: (name, level); next: by type."""

    version: int = 0
    folders: list[tuple[str, int]] = field(default_factory=list)
    next: dict[str, int] = field(default_factory=dict)


class Taken(Exception):
    """Another writer was first."""


def _name(version: int) -> str:
    return f"{version:020d}.json"


def is_log(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, f"{path}/_commits")
    return fs.exists(at)


def state(spark: SparkSession, path: str) -> State:
    """What the last commit says. Only the two latest are kept, so this is one listing and one small file."""
    fs, at = _at(spark, f"{path}/_commits")
    if not fs.exists(at):
        return State()
    names = sorted(n for n in (x.getPath().getName() for x in fs.listStatus(at)) if n.endswith(".json") and n[0].isdigit())
    for name in reversed(names):
        stream = fs.open(_at(spark, f"{path}/_commits/{name}")[1])
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        with contextlib.suppress(ValueError):  # one that is just being written: the commit before holds
            told = json.loads(text)
            return State(told["version"], [tuple(f) for f in told["folders"]], told["next"])
    return State()


def _commit(spark: SparkSession, path: str, new: State) -> None:
    """Writes the commit if its number is free; Taken if it isn't."""
    jvm = spark.sparkContext._jvm
    fs, folder = _at(spark, f"{path}/_commits")
    fs.mkdirs(folder)
    _, at = _at(spark, f"{path}/_commits/{_name(new.version)}")
    text = json.dumps(asdict(new), ensure_ascii=False).encode()
    try:
        if fs.getScheme() == "file":  # a hard link is whole and fails if the name is there
            local = jvm.java.nio.file.Paths
            whole, none = at.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
            beside = local.get(f"{whole}.{uuid.uuid4().hex}", none)
            jvm.java.nio.file.Files.write(beside, text, spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
            try:
                jvm.java.nio.file.Files.createLink(local.get(whole, none), beside)
            finally:
                jvm.java.nio.file.Files.delete(beside)
        else:
            out = fs.create(at, False)
            out.write(text)
            out.close()
    except Exception as e:
        if fs.exists(at):
            raise Taken from e
        raise
    with contextlib.suppress(Exception):
        fs.delete(_at(spark, f"{path}/_commits/{_name(new.version - 2)}")[1], False)


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("type", "original"), F.lit(BUCKETS)).cast("int"))


def _read(spark: SparkSession, path: str, now: State) -> DataFrame:
    columns = MAPPING + ", bucket int"
    if not now.folders:
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).option("basePath", f"{path}/data").parquet(*(f"{path}/data/part={name}" for name, _ in now.folders))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(type, original, pseudonym) as of the last commit."""
    return _read(spark, path, state(spark, path)).select("type", "original", "pseudonym")


def _written(df: DataFrame, path: str) -> str:
    name = uuid.uuid4().hex
    _bucketed(df.select("type", "original", "pseudonym")).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/part={name}")
    return name


def _merged(spark: SparkSession, path: str, now: State) -> list[tuple[str, int]]:
    """The folders, those of a level that has enough of them made into one of the next."""
    folders = list(now.folders)
    for level in range(64):
        own = [f for f in folders if f[1] == level]
        if len(own) < MERGED:
            continue
        whole = _read(spark, path, State(folders=own)).drop("bucket")
        folders = [f for f in folders if f[1] != level] + [(_written(whole, path), level + 1)]
    return folders


def add(spark: SparkSession, path: str, seen: DataFrame, order: list[str]) -> DataFrame:
    """The pseudonyms of the values seen (type, original and the columns of order): known ones as they are, new ones numbered by order and committed.

    Values that are run through again are known by then and keep their numbers. A writer that breaks off before its
    commit uses up no number. Folders that no commit names are left behind by writers that came second.
    """
    seen = stored(_bucketed(seen), "seen")
    buckets = [r["bucket"] for r in seen.select("bucket").distinct().collect()]  # BUCKETS at most
    for attempt in range(TRIES):
        now = state(spark, path)
        known = _read(spark, path, now).filter(F.col("bucket").isin(buckets)).join(seen.select("bucket", "type", "original"), ["bucket", "type", "original"], "left_semi")
        known = stored(known.select("type", "original", "pseudonym"), "known")
        new = stored(seen.join(known, ["type", "original"], "left_anti"), "new")
        counts = {r["type"]: r["n"] for r in new.groupBy("type").agg(F.count("*").alias("n")).collect()}  # a row for each type
        if not counts:
            return known
        first = F.coalesce(*(F.when(F.col("type") == t, F.lit(now.next.get(t, 1))) for t in counts))
        numbered = ranked(new, "type", [*order, "original"]).select("type", "original", pseudonym(F.col("type"), (first + F.col("rank") - 1).cast("int")).alias("pseudonym"))
        numbered = stored(numbered, "numbered")
        try:
            name = _written(numbered, path)
            told = now.next | {t: now.next.get(t, 1) + n for t, n in counts.items()}
            _commit(spark, path, State(now.version + 1, _merged(spark, path, State(folders=[*now.folders, (name, 0)])), told))
            return known.unionByName(numbered)
        except Taken:
            time.sleep(min(2.0, 0.05 * 2**attempt))
    raise RuntimeError(f"{path}: other writers were first {TRIES} times")


def begin(spark: SparkSession, path: str, mapping: DataFrame) -> None:
    """A log that begins with a mapping, where there is none yet. Next numbers follow the largest of each type."""
    if state(spark, path).version:
        return
    told = {r["type"]: r["next"] for r in next_numbers(mapping).collect()}
    with contextlib.suppress(Taken):
        _commit(spark, path, State(1, [(_written(mapping, path), 0)], told))
