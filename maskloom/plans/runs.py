"""Whole runs: folders in, anonymised documents, datasets, reviews and an index out; and back again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import LONG_TOKEN
from ..functions.text import clean, file_name, parent, suffix
from ..operators import render, review, spec
from ..operators.pseudonyms import anonymise, empty_mapping, replaced, restore_stats, restored, restored_json, token_counts, unknown_tokens
from ..operators.detect import Dictionary, with_spans
from ..sinks.files import append_lines, index_upsert, output_dir, output_names, read_index, recovered, restored_path, write_files, write_mapping
from ..sources.files import read_blocks, read_cells, read_dictionary, read_ignore, read_mapping, read_media, scan, scan_artifacts
from .storage import stored


def block_units(blocks: DataFrame) -> DataFrame:
    """(doc_id, phase, a, b, c, text): texts and table cells in the order in which they are visited."""
    texts = blocks.filter("kind = 'text'").select("doc_id", F.lit(0).alias("phase"), F.col("block_index").alias("a"), F.lit(-1).alias("b"), F.lit(-1).alias("c"), "text")
    cells = blocks.filter("kind = 'table'").select("doc_id", F.lit(0).alias("phase"), F.col("block_index").alias("a"), F.posexplode("rows").alias("b", "_row")).select("doc_id", "phase", "a", "b", F.posexplode("_row").alias("c", "text"))
    return texts.unionByName(cells)


def cell_units(cells: DataFrame, params: DataFrame) -> DataFrame:
    """(doc_id, phase, a, b, c, text): a workbook's titles and string cells, then its dataset's texts."""
    titles = cells.groupBy("doc_id", F.col("sheet_index").alias("a")).agg(F.first("sheet_name", True).alias("text")).select("doc_id", F.lit(1).alias("phase"), "a", F.lit(0).alias("b"), F.lit(0).alias("c"), "text")
    own = cells.filter("value_type = 'string'").select("doc_id", F.lit(1).alias("phase"), F.col("sheet_index").alias("a"), F.col("row").alias("b"), F.col("col").alias("c"), F.col("value").alias("text"))
    fields = params.select("doc_id", F.lit(2).alias("phase"), F.col("sheet_index").alias("a"), F.col("row").alias("b"), F.col("field_ord").alias("c"), "text")
    return titles.unionByName(own).unionByName(fields)


def name_units(names: DataFrame) -> DataFrame:
    """(doc_id, phase, a, b, c, text): the file names of workbooks (doc_id, path), after their texts."""
    zero = F.lit(0)
    return names.filter(suffix(F.col("path")) == ".xlsx").select("doc_id", F.lit(3).alias("phase"), zero.alias("a"), zero.alias("b"), zero.alias("c"), file_name(F.col("path")).alias("text"))


#: Unknown tokens that a report lists; unknown_tokens() has all.
SHOWN = 1000
ORDER = ["doc_id", "phase", "a", "b", "c"]


def anonymise_folder(spark: SparkSession, target: str, out: str | None = None, mapping_path: str | None = None, dictionaries: str | None = None, reset: bool = False) -> dict:
    """Anonymises all files below target; writes texts, assets, datasets, reviews, the index and the mapping; returns the report.

    target may be one file: it gets the first form of its name, <stem>_anon, whatever else its folder holds. One mapping is
    written by one run at a time; a path that ends in .json is a file of JSON, any other a folder of Parquet.
    """
    files = stored(scan(spark, target), "files")
    dictionary: Dictionary = read_dictionary(spark, dictionaries) if dictionaries else {}
    ignore = read_ignore(spark, f"{dictionaries}/ignore.txt") if dictionaries and recovered(spark, f"{dictionaries}/ignore.txt") else None
    known = read_mapping(spark, mapping_path) if mapping_path and not reset and recovered(spark, mapping_path) else empty_mapping(spark)
    ids = files.select("path", "doc_id")
    folder = F.lit(out) if out else output_dir(F.col("path"))
    named = stored(output_names(ids, "path", "doc_id").withColumn("dir", folder), "names")
    read = stored(read_blocks(files).join(ids, "path"), "blocks")
    sheets_read = stored(read_cells(files).join(ids, "path"), "cells")
    media = stored(read_media(files).join(ids, "path"), "media")
    blocks, cells = read.filter("error is null"), sheets_read.filter("error is null")
    found_rows = stored(spec.rows(cells), "rows")
    fields = spec.text_units(found_rows)

    units, mapping = anonymise(block_units(blocks).unionByName(cell_units(cells, fields)).unionByName(name_units(ids)), ORDER, known, dictionary)
    units = stored(units, "units")
    texts = units.filter("phase = 0")
    table_rows = texts.filter("b >= 0").groupBy("doc_id", "a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]).alias("cells")).groupBy("doc_id", "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "cells"))), lambda x: x["cells"]).alias("new_rows"))
    plain = texts.filter("b < 0").select("doc_id", "a", F.col("text").alias("new_text"))
    done = blocks.withColumn("a", F.col("block_index")).join(plain, ["doc_id", "a"], "left").join(table_rows, ["doc_id", "a"], "left")
    done = done.withColumn("text", F.coalesce("new_text", "text")).withColumn("rows", F.coalesce("new_rows", "rows"))
    lines = render.document_lines(done).select("doc_id", F.col("block_index").alias("o"), "n", "line")
    titles = units.filter("phase = 1 and b = 0").select("doc_id", F.col("a").alias("sheet_index"), F.col("text").alias("title"))
    shown = cells.join(units.filter("phase = 1 and b > 0").select("doc_id", F.col("a").alias("sheet_index"), F.col("b").alias("row"), F.col("c").alias("col"), F.col("text").alias("new")), ["doc_id", "sheet_index", "row", "col"], "left").join(titles, ["doc_id", "sheet_index"], "left")
    shown = shown.withColumn("value", F.coalesce("new", "value")).withColumn("sheet_name", F.coalesce("title", "sheet_name"))
    all_lines = stored(lines.unionByName(render.sheet_lines(shown).select("doc_id", F.col("sheet_index").alias("o"), "n", "line")), "lines")
    sources = named.select("doc_id", file_name(F.col("path")).alias("source"), F.substring(suffix(F.col("path")), 2, 10).alias("source_format"))
    ok = blocks.select("doc_id").union(cells.select("doc_id")).distinct()
    assets = blocks.filter(F.col("kind").isin("image", "attachment")).select("doc_id", "kind").unionByName(media.select("doc_id", F.lit("media").alias("kind")))
    texts_out = render.joined(all_lines, ["o", "n"], render.headers(all_lines, sources.join(ok, "doc_id"), assets))
    place = named.select("doc_id", F.concat("dir", F.lit("/"), "base").alias("at"))
    write_files(texts_out.join(place, "doc_id").select(F.concat("at", F.lit(".md")).alias("path"), F.col("text").alias("data")))

    data = blocks.filter("asset is not null").select("doc_id", render.asset_file().alias("file"), "asset.data").unionByName(media.select("doc_id", F.concat(F.lit("assets/"), "asset_id", F.lit("."), "ext").alias("file"), "data"))
    write_files(data.join(place, "doc_id").select(F.concat("at", F.lit("_assets/"), "file").alias("path"), "data"))
    manifests = render.manifest(blocks, F.col("source_format")).join(sources, "doc_id").select("doc_id", F.to_json(F.struct("source", "source_format", "assets"), {"ignoreNullFields": "false"}).alias("data"))
    write_files(manifests.join(place, "doc_id").select(F.concat("at", F.lit("_assets/index.json")).alias("path"), "data"))

    field_units = units.filter("phase = 2").join(fields.select("doc_id", F.col("sheet_index").alias("a"), F.col("row").alias("b"), F.col("field_ord").alias("c"), "field"), ["doc_id", "a", "b", "c"]).select("doc_id", F.col("a").alias("sheet_index"), F.col("b").alias("row"), "field", "text")
    params = stored(spec.with_pseudonyms(spec.parameters(cells), field_units), "parameters")
    known_as = units.filter("phase = 3").select("doc_id", F.struct(F.col("text").alias("file_name_anon")).alias("source"))
    agent = F.struct(F.lit("maskloom-spec").alias("name"), F.lit("1.0").alias("version"))
    dataset = spec.dataset(cells, params, field_units, titles).join(known_as, "doc_id").select("doc_id", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "source", agent.alias("agent"), "sheets", "summary"), {"ignoreNullFields": "false", "pretty": "true"}).alias("data"))
    write_files(dataset.join(place, "doc_id").select(F.concat("at", F.lit(".json")).alias("path"), "data"))

    raw = block_units(blocks).unionByName(cell_units(cells, fields).filter("phase = 1 and b > 0"))
    found = stored(review.candidates(raw, ORDER, ignore, dictionary), "candidates")
    loc = F.struct(F.when(F.col("phase") == 0, F.col("a")).alias("block_index"), F.when(F.col("phase") == 1, F.col("a")).alias("sheet_index"), F.nullif("b", F.lit(-1)).alias("row"), F.nullif("c", F.lit(-1)).alias("col"))
    groups = stored(review.grouped(found, ["doc_id"], ORDER, loc), "groups")
    reviews = review.totals(groups, ["doc_id"]).join(groups.groupBy("doc_id").agg(F.collect_list(F.struct("value", "type_guess", "reason", "example_context", "locations", "count")).alias("candidates")), "doc_id")
    write_files(reviews.join(place, "doc_id").select(F.concat("at", F.lit("_review.json")).alias("path"), F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.struct("total", "by_type").alias("summary"), "candidates"), {"ignoreNullFields": "false"}).alias("data")))

    entity_counts = stored(token_counts(all_lines, ["doc_id"], "line"), "entities")
    per_doc = entity_counts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("entities"))
    entry = sources.join(ok, "doc_id").join(place, "doc_id").join(per_doc, "doc_id", "left").join(review.totals(groups, ["doc_id"]).select("doc_id", F.col("total").alias("review_candidates")), "doc_id", "left")
    entry = entry.select(F.concat("at", F.lit(".md")).alias("output"), "source", "source_format", "entities", F.coalesce("review_candidates", F.lit(0)).alias("review_candidates"))
    index_path = f"{(out or parent_of(target))}/index"
    write_mapping(stored(index_upsert(read_index(spark, index_path), entry), "index"), index_path)
    if mapping_path:
        write_mapping(mapping, mapping_path)
    errors = read.select("path", "error").union(sheets_read.select("path", "error")).filter("error is not null").distinct()
    return {
        "processed": ok.count(), "errors": {r["path"]: r["error"] for r in errors.limit(1000).collect()}, "error_count": errors.count(),
        "entities": {r["type"]: r["n"] for r in entity_counts.groupBy("type").agg(F.sum("n").alias("n")).collect()}, "review_candidates": groups.count(),
    }


def parent_of(target: str) -> str:
    from ..functions.fixed import OUTPUT_FOLDER

    return f"{target.rstrip('/')}/{OUTPUT_FOLDER}"


def restore_folder(spark: SparkSession, target: str, mapping_path: str, out: str | None = None) -> dict:
    """Restores the artifacts below target and returns how many tokens were replaced and unknown; of these the first `SHOWN`. Files named .json that hold none are skipped."""
    if not recovered(spark, mapping_path):
        raise FileNotFoundError(f"no mapping at {mapping_path}")
    mapping = read_mapping(spark, mapping_path)
    found = scan_artifacts(spark, target)
    done = restored(found.filter(suffix(F.col("path")) == ".md"), mapping, token=LONG_TOKEN).unionByName(restored_json(found.filter(suffix(F.col("path")) == ".json"), mapping, token=LONG_TOKEN))
    done = stored(done, "restored")
    skipped = done.filter("text is null")  # no JSON
    done = done.filter("text is not null")
    n = write_files(done.select(restored_path(F.col("path"), out).alias("path"), F.col("text").alias("data")))
    stats = restore_stats(done.withColumn("all", F.lit(1)), ["all"]).first()
    lost = unknown_tokens(done, []).orderBy("token").limit(SHOWN)
    return {"files": n, "replaced": stats["replaced"] if stats else 0, "unresolved": stats["unresolved"] if stats else 0, "unknown": [r["token"] for r in lost.collect()], "skipped": [r["path"] for r in skipped.select("path").orderBy("path").limit(SHOWN).collect()]}


def preview(texts: DataFrame, order: list[str], mapping: DataFrame | None = None, dictionary: Dictionary | None = None, text_col: str = "text") -> DataFrame:
    """Before and after, side by side, with nothing written."""
    after, _ = anonymise(texts.withColumn("before", F.col(text_col)), order, mapping, dictionary, text_col)
    return after.withColumnRenamed(text_col, "after")


def ignore_values(spark: SparkSession, dictionaries: str, values: list[str]) -> None:
    """Values that people have looked at and let pass, added to the ignore list; later runs leave them out of reviews."""
    append_lines(spark, f"{dictionaries}/ignore.txt", values)


def anonymise_known(units: DataFrame, mapping: DataFrame, dictionary: Dictionary | None = None, text_col: str = "text") -> DataFrame:
    """units with the values that the mapping has replaced; new values stay. Needs no numbering, so many runs can share a mapping."""
    return replaced(with_spans(units, dictionary, text_col), mapping, text_col)


__all__ = ["anonymise_folder", "anonymise_known", "block_units", "cell_units", "clean", "ignore_values", "parent", "preview", "restore_folder"]
