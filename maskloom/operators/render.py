"""Rendering blocks and sheets as lines, with asset comments, anchors, manifests and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md_table, strip
from .pseudonyms import formatted_counts, token_counts

ASSET = "struct<asset_id:string,data:binary,ext:string,src_page:int,original_filename:string,prog_id:string,note:string>"
BLOCKS = f"doc_id long, block_index int, kind string, text string, rows array<array<string>>, asset {ASSET}"


def _shown(c: Column) -> Column:
    """A value as it is put into a comment: None for null."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def asset_file() -> Column:
    name = F.concat("asset.asset_id", F.lit("__"), "asset.original_filename")
    return F.when(F.col("kind") == "image", F.concat(F.lit("assets/"), "asset.asset_id", F.lit("."), "asset.ext")).when(F.col("kind") == "attachment", F.concat(F.lit("attachments/"), name))


def with_anchors(blocks: DataFrame) -> DataFrame:
    """blocks with the lines that each gives and, as anchor, how many lines stand before it (the header not counted)."""
    size = F.when(F.col("kind").isin("image", "attachment"), 2).when(F.col("kind") == "table", F.when(F.size("rows") > 0, F.size("rows") + 1).otherwise(0)).otherwise(1)
    before = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("n_lines", size).withColumn("anchor", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).cast("int"))


def document_lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_index, n, line): texts, tables, and two lines for each asset. Texts are rendered as they come."""
    file, note = asset_file(), _shown(F.col("asset.note"))
    image = F.array(
        F.format_string('<!-- ASSET: %s | kind=image | file=%s | anchor=para-%d | src_page=%s | note="%s" -->', "asset.asset_id", file, "anchor", _shown(F.col("asset.src_page")), note),
        F.format_string("[ИЗОБРАЖЕНИЕ %s — см. %s]", "asset.asset_id", file),
    )
    attachment = F.array(
        F.format_string('<!-- ASSET: %s | kind=attachment | file=%s | original=%s | prog_id=%s | anchor=para-%d | note="%s" -->', "asset.asset_id", file, "asset.original_filename", "asset.prog_id", "anchor", note),
        F.format_string("[ВЛОЖЕНИЕ %s — %s — см. %s]", "asset.asset_id", "asset.original_filename", file),
    )
    lines = F.when(F.col("kind") == "image", image).when(F.col("kind") == "attachment", attachment).when(F.col("kind") == "table", md_table(F.col("rows"))).otherwise(F.array("text"))
    return with_anchors(blocks).select("doc_id", "block_index", F.posexplode(lines).alias("n", "line"))


def original_lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_index, n, line) before anonymisation, asset for asset in step with document_lines."""
    note = _shown(F.col("asset.note"))
    image = F.array(F.format_string('<!-- изображение %s | src_page=%s | note="%s" -->', "asset.asset_id", _shown(F.col("asset.src_page")), note), F.format_string("[изображение %s]", "asset.asset_id"))
    attachment = F.array(
        F.format_string('<!-- вложение %s | original=%s | prog_id=%s | note="%s" -->', "asset.asset_id", "asset.original_filename", "asset.prog_id", note),
        F.format_string("[вложение %s — %s]", "asset.asset_id", "asset.original_filename"),
    )
    lines = F.when(F.col("kind") == "image", image).when(F.col("kind") == "attachment", attachment).when(F.col("kind") == "table", md_table(F.col("rows"))).otherwise(F.array("text"))
    return blocks.select("doc_id", "block_index", F.posexplode(lines).alias("n", "line"))


def manifest(blocks: DataFrame, source_format: Column | None = None) -> DataFrame:
    """(doc_id, assets): for documents with assets, an array of what each asset is and where it stands."""
    a = with_anchors(blocks).filter(F.col("kind").isin("image", "attachment"))
    one = F.struct(
        "block_index", F.struct(
            F.col("asset.asset_id").alias("id"), "kind", asset_file().alias("file"), "asset.original_filename", "asset.prog_id", "anchor", "asset.src_page",
            (source_format if source_format is not None else F.lit(None).cast("string")).alias("src_format"), F.col("asset.note").alias("note"),
        ).alias("a"),
    )
    return a.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["a"]).alias("assets"))


def asset_counts(assets: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, n); an asset without a kind counts as 'asset'."""
    return assets.groupBy(*by, F.coalesce("kind", F.lit("asset")).alias("kind")).agg(F.count("*").alias("n"))


def asset_ordinals(assets: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """assets with asset_id: img-001, att-001 and so on for each document and kind."""
    n = F.row_number().over(Window.partitionBy(*by, "kind").orderBy(*order))
    return assets.withColumn("asset_id", F.format_string("%s-%03d", F.when(F.col("kind") == "attachment", "att").otherwise("img"), n))


def sheet_lines(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet_index, n, line): a heading, the table of rows with content, and an empty line for each sheet."""
    by_row = cells.groupBy("doc_id", "sheet_index", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("v")))).alias("m"), F.max(F.length(strip(F.coalesce("value", F.lit("")))) > 0).alias("full"))
    width = cells.groupBy("doc_id", "sheet_index").agg(F.max("col").alias("width"), F.first("sheet_name", True).alias("sheet_name"))
    rows = by_row.filter("full").join(width.select("doc_id", "sheet_index", "width"), ["doc_id", "sheet_index"])
    row = F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.coalesce(F.col("m")[c], F.lit("")))
    tables = rows.groupBy("doc_id", "sheet_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", row.alias("cells")))), lambda x: x["cells"]).alias("rows"))
    all_ = width.join(tables, ["doc_id", "sheet_index"], "left")
    lines = F.concat(F.array(F.concat(F.lit("## Лист: "), F.coalesce("sheet_name", F.lit("")))), F.when(F.col("rows").isNull(), F.array().cast("array<string>")).otherwise(md_table(F.col("rows"))), F.array(F.lit("")))
    return all_.select("doc_id", "sheet_index", F.posexplode(lines).alias("n", "line"))


def preview_lines(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet_index, row, line): a sheet's rows as 'a | b', row 0 its title."""
    width = cells.groupBy("doc_id", "sheet_index").agg(F.max("col").alias("width"), F.first("sheet_name", True).alias("sheet_name"))
    by_row = cells.groupBy("doc_id", "sheet_index", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("v")))).alias("m"))
    rows = by_row.join(width, ["doc_id", "sheet_index"]).withColumn("line", F.array_join(F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.coalesce(F.col("m")[c], F.lit(""))), " | "))
    full = F.exists(F.map_values("m"), lambda v: F.length(strip(v)) > 0)
    titles = width.select("doc_id", "sheet_index", F.lit(0).alias("row"), F.concat(F.lit("=== Лист: "), "sheet_name", F.lit(" ===")).alias("line"))
    return titles.unionByName(rows.filter(full).select("doc_id", "sheet_index", "row", "line"))


def headers(lines: DataFrame, sources: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc_id, line): the comment at a document's top. sources: (doc_id, source, source_format); assets: (doc_id, kind)."""
    entities = formatted_counts(token_counts(lines, ["doc_id"], "line"), ["doc_id"], "type", "entities")
    kinds = formatted_counts(asset_counts(assets, ["doc_id"]), ["doc_id"], "kind", "assets")
    told = sources.join(entities, "doc_id", "left").join(kinds, "doc_id", "left")
    none = lambda c: F.coalesce(c, F.lit("0"))
    return told.select("doc_id", F.format_string("<!-- DOC: source=%s | format=%s | entities: %s | assets: %s -->", "source", "source_format", none("entities"), none("assets")).alias("line"))


def joined(lines: DataFrame, order: list[str], tops: DataFrame) -> DataFrame:
    """(doc_id, text): each document's lines in order under its header, every line ended."""
    body = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("body"))
    out = tops.join(body, "doc_id", "left")
    return out.select("doc_id", F.concat("line", F.lit("\n"), F.when(F.col("body").isNull(), "").otherwise(F.concat("body", F.lit("\n")))).alias("text"))
