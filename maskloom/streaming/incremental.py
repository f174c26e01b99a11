"""Anonymising documents as they arrive: a stream of texts numbered against one mapping, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import Dictionary, with_spans
from ..operators.pseudonyms import first_seen, found_in, replaced
from ..plans.storage import stored, stored_here
from ..sinks.files import recovered, swap
from ..sinks.log import add, begin, is_log
from ..sources.files import read_mapping


def _as_log(spark: SparkSession, path: str) -> None:
    """A mapping written before, as one folder, becomes a log that begins with it."""
    if recovered(spark, path) and not is_log(spark, path):
        beside = f"{path.rstrip('/')}.new"
        begin(spark, beside, read_mapping(spark, path))
        swap(spark, beside, path)


def anonymise_stream(stream: DataFrame, order: list[str], out: str, mapping_path: str, checkpoint: str, dictionary: Dictionary | None = None, available_now: bool = False) -> StreamingQuery:
    """Writes the anonymised texts to out, a folder for each batch, and commits the new values of each batch to the mapping's log.

    Several streams and runs may add to one mapping. A batch reads the buckets of its own values, however many came before. One
    that is run again finds its values known, numbers them alike, and writes its folder anew.
    """
    if mapping_path.endswith(".json"):
        raise ValueError("a stream adds to its mapping; give it a folder")
    _as_log(stream.sparkSession, mapping_path)

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        with stored_here():
            found = found_in(with_spans(df, dictionary))
            mapping = stored(add(spark, mapping_path, first_seen(found, order), ["seen"]), "mapping")
            replaced(found, mapping).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
