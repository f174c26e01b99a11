"""Readers: folders of documents into blocks, cells and assets; dictionaries, ignore lists, mappings and artifacts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import ENTITY_TYPES, OUTPUT_FOLDER
from ..functions.text import is_supported, normalise, suffix
from ..operators.pseudonyms import MAPPING
from . import doc, pdf

READ = "path string, source_format string, block_index int, kind string, text string, rows array<array<string>>, asset struct<asset_id:string,data:binary,ext:string,src_page:int,original_filename:string,prog_id:string,note:string>, error string"
CELLS = "path string, sheet_index int, sheet_name string, row int, col int, value string, value_type string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_O = "{urn:schemas-microsoft-com:office:office}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def scan(spark: SparkSession, target: str) -> DataFrame:
    """(path, content, doc_id): the supported files below a folder, or a file itself; outputs of earlier runs are left out.

    doc_id numbers the paths in their order, from 0.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(target)
    kept = found.filter(is_supported(F.col("path")) & ~F.col("path").rlike(f"/{OUTPUT_FOLDER}/"))
    from ..operators.pseudonyms import ranked

    ids = ranked(kept.select("path", F.lit(0).alias("all")), "all", ["path"]).select("path", (F.col("rank") - 1).alias("doc_id"))
    return kept.select("path", "content").join(ids, "path")


def _docx(data: bytes) -> Iterator[dict]:
    """Paragraphs and tables of the body in order, with the images and attachments that stand in each paragraph."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        related = {}
        if "word/_rels/document.xml.rels" in z.namelist():
            for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")).iter(f"{_PACKAGE}Relationship"):
                to = r.get("Target", "")
                related[r.get("Id")] = to.lstrip("/") if to.startswith("/") else f"word/{to}"
        text = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t"))
        n = {"img": 0, "att": 0}

        def asset(kind: str, rid: str | None, program: str | None = None) -> Iterator[dict]:
            name = related.get(rid or "")
            if name is None or name not in z.namelist():
                return
            n[kind] += 1
            base = name.rsplit("/", 1)[-1]
            ext = base.rsplit(".", 1)[-1] if "." in base else ("png" if kind == "img" else "bin")
            a = {"asset_id": f"{kind}-{n[kind]:03d}", "data": z.read(name), "ext": ext, "note": ""}
            if kind == "att":
                a |= {"original_filename": base, "prog_id": program or ""}
            yield {"kind": "image" if kind == "img" else "attachment", "asset": a}

        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        for child in body if body is not None else ():
            if child.tag == f"{_W}p":
                if own := text(child).strip():
                    yield {"kind": "text", "text": own}
                for blip in child.iter(f"{_A}blip"):
                    yield from asset("img", blip.get(f"{_R}embed"))
                for ole in child.iter(f"{_O}OLEObject"):
                    yield from asset("att", ole.get(f"{_R}id"), ole.get("ProgID"))
            elif child.tag == f"{_W}tbl":
                rows = []
                for tr in child.findall(f"{_W}tr"):
                    cells = [" ".join(text(p) for p in tc.findall(f"{_W}p")).strip() for tc in tr.findall(f"{_W}tc")]
                    if any(cells):
                        rows.append(cells)
                if rows:
                    yield {"kind": "table", "rows": rows}


def _pdf(data: bytes) -> Iterator[dict]:
    n = 0
    for number, (lines, images) in enumerate(pdf.pages(data), 1):
        yield from ({"kind": "text", "text": line} for line in lines)
        for image, ext in images:
            n += 1
            yield {"kind": "image", "asset": {"asset_id": f"img-{n:03d}", "data": image, "ext": ext, "src_page": number, "note": ""}}


def _doc(data: bytes) -> Iterator[dict]:
    yield from ({"kind": "text", "text": p} for p in doc.paragraphs(data))


def read_blocks(files: DataFrame) -> DataFrame:
    """Blocks of the text documents among files (path, content): texts, tables and assets in order. A file that can't be read is one row with its error."""
    plain = files.filter(suffix(F.col("path")) == ".txt")
    lines = F.split(F.decode("content", "UTF-8"), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1)
    kept = plain.select("path", F.posexplode(lines).alias("_at", "text")).filter(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f\x85]"))
    asset = READ.split("asset ")[1].split(", error")[0]
    texts = kept.select("path", F.lit("txt").alias("source_format"), F.col("_at").alias("block_index"), F.lit("text").alias("kind"), "text", F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast(asset).alias("asset"), F.lit(None).cast("string").alias("error"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {"docx": _docx, "pdf": _pdf, "doc": _doc}
        keys = ["asset_id", "data", "ext", "src_page", "original_filename", "prog_id", "note"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                out = []
                try:
                    for i, b in enumerate(readers[kind](bytes(content))):
                        a = b.get("asset")
                        out.append((path, kind, i, b["kind"], b.get("text"), b.get("rows"), {k: a.get(k) for k in keys} if a else None, None))
                except Exception as e:  # noqa: BLE001  one file's fault is not the run's
                    out.append((path, kind, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["path", "source_format", "block_index", "kind", "text", "rows", "asset", "error"])

    office = files.filter(suffix(F.col("path")).isin(".docx", ".pdf", ".doc")).select("path", "content").mapInPandas(parse, READ)
    both = texts.unionByName(office)
    return both.withColumn("text", normalise(F.col("text"))).withColumn("rows", F.transform("rows", lambda r: F.transform(r, normalise)))


def _xlsx(data: bytes) -> Iterator[tuple]:
    """(sheet_index, sheet_name, row, col, value, value_type) of each cell that has a value; formulas as their text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_S}t")))
        rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
        for index, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")):
            to = rels.get(sheet.get(f"{_R}id"), "")
            member = to.lstrip("/") if to.startswith("/") else f"xl/{to}"
            at_row = 0
            for row in ElementTree.fromstring(z.read(member)).iter(f"{_S}row"):
                at_row = int(row.get("r") or at_row + 1)
                at_col = 0
                for c in row.findall(f"{_S}c"):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    at_col = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) if letters else at_col + 1
                    kind, v, f = c.get("t", "n"), c.find(f"{_S}v"), c.find(f"{_S}f")
                    if f is not None and f.text:
                        yield index, sheet.get("name"), at_row, at_col, "=" + f.text, "string"
                    elif kind == "inlineStr":
                        yield index, sheet.get("name"), at_row, at_col, "".join(t.text or "" for t in c.iter(f"{_S}t")), "string"
                    elif v is not None and v.text is not None:
                        if kind == "s":
                            yield index, sheet.get("name"), at_row, at_col, shared[int(v.text)], "string"
                        elif kind == "b":
                            yield index, sheet.get("name"), at_row, at_col, "True" if v.text == "1" else "False", "bool"
                        elif kind in ("str", "e"):
                            yield index, sheet.get("name"), at_row, at_col, v.text, "string"
                        else:
                            x = float(v.text)
                            yield index, sheet.get("name"), at_row, at_col, str(int(x)) if re.fullmatch(r"-?\d+", v.text) else repr(x), "number"


def read_cells(files: DataFrame) -> DataFrame:
    """Cells of the workbooks among files (path, content), with an error row for a workbook that can't be read."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet_index", "sheet_name", "row", "col", "value", "value_type", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out = [(path, *cell, None) for cell in _xlsx(bytes(content))]
                except Exception as e:  # noqa: BLE001
                    out = [(path, *[None] * 6, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=names)

    return files.filter(suffix(F.col("path")) == ".xlsx").select("path", "content").mapInPandas(parse, CELLS)


def read_media(files: DataFrame) -> DataFrame:
    """(path, asset_id, data, ext, src_path): the images of workbooks, in the order of the archive."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for name in z.namelist():
                            if name.startswith("xl/media/") and not name.endswith("/"):
                                out.append((path, f"img-{len(out) + 1:03d}", z.read(name), name.rsplit(".", 1)[-1].lower() if "." in name else "png", name))
                except zipfile.BadZipFile:
                    pass
                yield pd.DataFrame(out, columns=["path", "asset_id", "data", "ext", "src_path"])

    return files.filter(suffix(F.col("path")) == ".xlsx").select("path", "content").mapInPandas(parse, "path string, asset_id string, data binary, ext string, src_path string")


def entries(lines: DataFrame) -> DataFrame:
    """The entries among lines (value): trimmed, without blank lines and comments."""
    value = F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
    return lines.select(value.alias("entry")).filter((F.col("entry") != "") & ~F.startswith("entry", F.lit("#")))


def read_dictionary(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Entries by type from <folder>/<name>.txt, longest first; a missing file is an empty dictionary. For dictionaries that people keep by hand."""
    out = {}
    for kind, name in ENTITY_TYPES.items():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.txt")
        if name and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            found = [r["entry"] for r in entries(spark.read.text(f"{folder}/{name}.txt")).collect()]
            out[kind] = sorted(found, key=lambda e: -len(e))
    return out


def read_ignore(spark: SparkSession, path: str) -> DataFrame:
    return entries(spark.read.text(path)).select(F.lower("entry").alias("value_lower")).distinct()


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(type, original, pseudonym) from a mapping: a log of commits, Parquet, or JSON {type: {original: pseudonym}}; buckets that are no objects are skipped."""
    if not path.endswith(".json"):
        from ..sinks.log import is_log, read_log

        if is_log(spark, path):
            return read_log(spark, path)
        return spark.read.parquet(path).select(*(c.split()[0] for c in MAPPING.split(", ")))
    text = spark.read.text(path, wholetext=True)
    buckets = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("type", "bucket")).filter(F.startswith(F.ltrim("bucket"), F.lit("{")))
    return buckets.select("type", F.explode(F.from_json("bucket", "map<string,string>")).alias("original", "pseudonym"))


def scan_artifacts(spark: SparkSession, target: str) -> DataFrame:
    """(path, text): the .md and .json files below a folder that are not within a folder of assets."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(target)
    kept = found.filter(suffix(F.col("path")).isin(".md", ".json") & ~F.col("path").rlike("/(assets|attachments|[^/]*_assets)/"))
    return kept.select("path", F.decode("content", "UTF-8").alias("text"))
