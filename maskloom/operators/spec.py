"""Mining form specifications: cells of sheets -> roles of columns, blocks, parameters, ambiguous rows and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import (
    AUTO_INPUT, DEFAULT_IF, HEADER_MARKERS, HEADER_ROWS, HIDDEN_MARKERS, NO_DEFAULT, NOT_REQUIRED, NOTE_HIDDEN, NOTE_NO_HEADER, NOTE_NO_NAME, READ_ONLY, REASON_NAMELESS, REQUIRED_IF, ROLE_MARKERS,
)
from ..functions.text import column_letter, marker, strip

CELLS = "doc_id long, sheet_index int, sheet_name string, row int, col int, value string, value_type string"
SHEET = ["doc_id", "sheet_index"]
ROLES = [role for role, _ in ROLE_MARKERS]
DATA_ROLES = ["type", "availability", "required", "input_method", "default_value", "behavior_notes", "constraints"]


def has_any(text: Column, markers: list[str]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(m)) for m in markers))


def required_status(raw: Column) -> Column:
    """'необязательное' holds 'обязательное' and so is required, as the source of these rules has it."""
    r = marker(raw)
    return (
        F.when(r == "", "unknown").when(r == "обязательное", "required")
        .when(F.contains(r, F.lit("обязательное")), F.when(has_any(r, REQUIRED_IF), "conditional").otherwise("required"))
        .when(r.isin(NOT_REQUIRED) | (F.startswith(r, F.lit("нет")) & (F.length(r) <= 8)), "no").otherwise("conditional")
    )


def default_status(raw: Column) -> Column:
    r = marker(raw)
    empty = r.isin(NO_DEFAULT) | r.rlike("^[—–]")
    return F.when(r == "", "no_default").when(empty, "empty_default").when(has_any(r, DEFAULT_IF), "needs_manual_check").otherwise("has_default")


def availability_status(raw: Column) -> Column:
    r = marker(raw)
    return (
        F.when(r == "", "unknown").when(F.contains(r, F.lit("недоступ")) | (r == "нет"), "not_available").when(has_any(r, READ_ONLY), "read_only")
        .when(F.contains(r, F.lit("доступно")), "available").otherwise("conditional")
    )


def is_auto_input(raw: Column) -> Column:
    return has_any(marker(raw), AUTO_INPUT)


def is_hidden(raw: Column) -> Column:
    return has_any(marker(raw), HIDDEN_MARKERS)


def role_of(header: Column) -> Column:
    """The first role, by priority, whose marker the header holds; null if none."""
    h = marker(header)
    return F.coalesce(*(F.when(has_any(h, markers), F.lit(role)) for role, markers in ROLE_MARKERS))


def header_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet_index, header_row): the first of the leading rows that holds a marker."""
    found = cells.filter((F.col("row") <= HEADER_ROWS) & F.col("value").isNotNull()).filter(has_any(marker(F.col("value")), HEADER_MARKERS))
    return found.groupBy(*SHEET).agg(F.min("row").alias("header_row"))


def roles(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet_index, header_row, role, col, header). A column takes its first role and no other; a role its first column."""
    heads = cells.filter(F.col("row") <= HEADER_ROWS).join(header_rows(cells), SHEET).filter("row = header_row and value is not null")
    own = heads.withColumn("role", role_of(F.col("value"))).filter("role is not null")
    return own.groupBy(*SHEET, "header_row", "role").agg(F.min("col").alias("col"), strip(F.min_by("value", "col")).alias("header"))


def sheets(cells: DataFrame) -> DataFrame:
    """A row for each sheet: name, header_row, headers (role -> text), notes (why it was skipped), usable."""
    all_ = cells.groupBy(*SHEET).agg(F.first("sheet_name", True).alias("sheet_name"))
    owned = roles(cells).groupBy(*SHEET).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "header")))).alias("headers"))
    out = all_.join(header_rows(cells), SHEET, "left").join(owned, SHEET, "left")
    out = out.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    usable = F.col("header_row").isNotNull() & F.map_contains_key("headers", "field_name")
    notes = F.when(F.col("header_row").isNull(), F.array(F.lit(NOTE_NO_HEADER))).when(~usable, F.array(F.lit(NOTE_NO_NAME))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("usable", usable).withColumn("notes", notes)


def rows(cells: DataFrame) -> DataFrame:
    """A row for each sheet row below its header: the roles' raw values, hidden evidence, row_kind and the block it stands in.

    row_kind: block (a name and nothing else), empty, ambiguous (data without a name), parameter.
    """
    owned = roles(cells)
    named = owned.filter("role = 'field_name'").select(*SHEET, "header_row")
    body = cells.join(named, SHEET).filter("row > header_row and value is not null").join(owned.select(*SHEET, "col", "role"), [*SHEET, "col"], "left")
    raw = F.nullif(strip(F.col("value")), F.lit(""))
    hidden = F.when(is_hidden(F.col("value")), F.struct(column_letter(F.col("col")).alias("column"), F.col("row"), strip(F.col("value")).alias("text")))
    by_row = body.groupBy(*SHEET, "row").agg(*(F.max(F.when(F.col("role") == r, raw)).alias(r) for r in ROLES), F.min_by(hidden, F.when(hidden.isNotNull(), F.col("col"))).alias("hidden_evidence"))
    data = F.coalesce(*(F.col(r) for r in DATA_ROLES)).isNotNull()
    name = F.col("field_name").isNotNull()
    kind = F.when(name & ~data, "block").when(~name & ~data, "empty").when(~name, "ambiguous").otherwise("parameter")
    above = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return by_row.withColumn("row_kind", kind).withColumn("block", F.last(F.when(F.col("row_kind") == "block", F.col("field_name")), True).over(above))


def blocks(found: DataFrame) -> DataFrame:
    return found.filter("row_kind = 'block'").select(*SHEET, "row", F.col("field_name").alias("name"))


def ambiguous(found: DataFrame) -> DataFrame:
    """(doc_id, sheet_index, row, reason, values): data without a name."""
    values = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(r).alias("k"), F.col(r).alias("v")) for r in DATA_ROLES)), lambda x: x["v"].isNotNull()))
    return found.filter("row_kind = 'ambiguous'").select(*SHEET, "row", F.lit(REASON_NAMELESS).alias("reason"), values.alias("values"))


def parameters(cells: DataFrame) -> DataFrame:
    """The form's parameters with their raw values, statuses and the cells they come from. Optional parts are null, not structs of nulls."""
    wide = roles(cells).groupBy(*SHEET).agg(*(F.max(F.when(F.col("role") == r, F.col("col"))).alias(f"_{r}") for r in ("required", "default_value")), F.max("col").alias("_last"))
    names = cells.groupBy(*SHEET).agg(F.first("sheet_name", True).alias("sheet_name"))
    p = rows(cells).filter("row_kind = 'parameter'").join(wide, SHEET).join(names, SHEET)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    hidden = F.col("hidden_evidence").isNotNull()
    status = required_status(F.col("required"))
    softened = hidden & (status == "required")
    return p.select(
        *SHEET, "row",
        F.format_string("sheet%d-row%d", "sheet_index", "row").alias("id"), F.col("field_name").alias("name"), "block", text("type").alias("type"),
        F.when(F.col("availability").isNotNull(), F.struct(F.col("availability").alias("raw"), availability_status(F.col("availability")).alias("interpreted"))).alias("availability"),
        F.struct(text("required").alias("raw"), F.when(softened, "conditional").otherwise(status).alias("status"), F.when(F.col("_required").isNotNull(), F.struct(column_letter(F.col("_required")).alias("column"), F.col("row"))).alias("evidence")).alias("required"),
        F.when(F.col("input_method").isNotNull(), F.struct(F.col("input_method").alias("raw"), is_auto_input(F.col("input_method")).alias("auto"))).alias("input_method"),
        F.struct(text("default_value").alias("raw"), text("default_value").alias("interpreted"), default_status(F.col("default_value")).alias("status"), F.when(F.col("_default_value").isNotNull(), F.concat(column_letter(F.col("_default_value")), F.col("row").cast("string"))).alias("source_cell")).alias("default_value"),
        text("behavior_notes").alias("behavior_notes"), text("constraints").alias("constraints"),
        F.struct(hidden.alias("hidden"), "hidden_evidence").alias("ui"),
        F.struct(F.col("sheet_name").alias("sheet"), "row", F.format_string("A%d:%s%d", F.col("row"), column_letter(F.col("_last")), F.col("row")).alias("cell_range")).alias("source"),
        F.when(softened, F.array(F.lit(NOTE_HIDDEN))).otherwise(F.array().cast("array<string>")).alias("notes"),
    )


#: The texts of a parameter in the order in which they are visited for numbering.
TEXTS = ["block_name", "name", "type", "availability", "required", "input_method", "default_value", "behavior_notes", "constraints"]


def text_units(found: DataFrame) -> DataFrame:
    """(doc_id, sheet_index, row, field, field_ord, text): the texts of blocks and parameters to be anonymised."""
    of = {"block_name": F.when(F.col("row_kind") == "block", F.col("field_name")), "name": F.when(F.col("row_kind") == "parameter", F.col("field_name"))}
    cells = [F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord"), of.get(f, F.when(F.col("row_kind") == "parameter", F.col(f) if f in found.columns else F.lit(None))).alias("text")) for i, f in enumerate(TEXTS)]
    return found.select(*SHEET, "row", F.explode(F.array(*cells)).alias("c")).select(*SHEET, "row", "c.*").filter("text is not null")


def with_pseudonyms(params: DataFrame, units: DataFrame) -> DataFrame:
    """Parameters with the anonymised texts (units as text_units gives, anonymised) in place of the raw ones; name stays raw, name_anon is added."""
    by_row = units.groupBy(*SHEET, "row").agg(*(F.max(F.when(F.col("field") == f, F.col("text"))).alias(f"_{f}") for f in TEXTS))
    above = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    by_row = by_row.withColumn("_block", F.last("_block_name", True).over(above))
    out = params.join(by_row, [*SHEET, "row"], "left")
    for f in ("type", "behavior_notes", "constraints"):
        out = out.withColumn(f, F.coalesce(F.col(f"_{f}"), F.lit("")))
    for f in ("availability", "required", "input_method", "default_value"):
        changed = F.col(f).withField("raw", F.coalesce(F.col(f"_{f}"), F.lit("")))
        if f == "default_value":
            changed = changed.withField("interpreted", F.coalesce(F.col("_default_value"), F.lit("")))
        out = out.withColumn(f, F.when(F.col(f).isNotNull(), changed))
    return out.withColumn("name_anon", F.col("_name")).withColumn("block", F.col("_block")).drop(*(f"_{f}" for f in TEXTS), "_block")


#: A parameter's parts in the order in which the dataset lists them.
LISTED = ["id", "name", "name_anon", "block", "type", "availability", "required", "input_method", "default_value", "behavior_notes", "constraints", "ui", "source", "notes"]


def dataset(cells: DataFrame, params: DataFrame, units: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, sheets, summary): each workbook's sheets with headers, blocks, parameters, ambiguous rows and notes.

    params: with pseudonyms; units: the anonymised texts of text_units(); titles: (doc_id, sheet_index, title), anonymised. A
    sheet without a title of its own is not named, as names of sheets and blocks may give away what they are about.
    """

    def listed(df: DataFrame, name: str, *columns) -> DataFrame:
        one = F.struct(F.col("row").alias("_at"), F.struct(*columns).alias("x"))
        return df.groupBy(*SHEET).agg(F.transform(F.array_sort(F.collect_list(one), lambda a, b: a["_at"] - b["_at"]), lambda v: v["x"]).alias(name))

    found = sheets(cells).join(titles, SHEET, "left")
    named = params.join(titles, SHEET, "left").withColumn("source", F.col("source").withField("sheet", F.coalesce("title", F.lit(""))))
    parts = {
        "blocks": listed(units.filter("field = 'block_name'"), "blocks", F.col("text").alias("name_anon"), "row"),
        "parameters": listed(named, "parameters", *LISTED),
        "ambiguous_cases": listed(ambiguous(rows(cells)), "ambiguous_cases", "row", "reason", "values"),
    }
    for name, part in parts.items():
        found = found.join(part, SHEET, "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    sheet = F.struct(F.coalesce("title", F.lit("")).alias("sheet_name_anon"), "sheet_index", "header_row", "headers", "blocks", "parameters", "ambiguous_cases", "notes")
    by_doc = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sheet_index", sheet.alias("x"))), lambda a, b: a["sheet_index"] - b["sheet_index"]), lambda v: v["x"]).alias("sheets"))
    counts = summary(cells)
    return by_doc.join(counts.select("doc_id", F.struct(*(c for c in counts.columns if c != "doc_id")).alias("summary")), "doc_id")


def summary(cells: DataFrame) -> DataFrame:
    """The nine counters of each document."""
    count = lambda c: F.count_if(c)
    p = parameters(cells).groupBy("doc_id").agg(
        F.count("*").alias("total_parameters"), count(F.col("required.status") == "required").alias("required"), count(F.col("required.status") == "conditional").alias("conditional_required"),
        count(F.col("default_value.status") == "has_default").alias("with_default"), count(F.col("default_value.status").isin("no_default", "empty_default")).alias("without_default"),
        count(F.col("default_value.status") == "needs_manual_check").alias("default_needs_manual_check"), count(F.col("ui.hidden")).alias("hidden_fields"),
    )
    n = cells.groupBy("doc_id").agg(F.countDistinct("sheet_index").alias("total_sheets"))
    a = rows(cells).groupBy("doc_id").agg(F.count_if(F.col("row_kind") == "ambiguous").alias("ambiguous_cases"))
    return n.join(p, "doc_id", "left").join(a, "doc_id", "left").na.fill(0)


def required_checklist(params: DataFrame) -> DataFrame:
    """(doc_id, id, step, expectation) for fields that must be filled in. Our own design."""
    wanted = params.filter(F.col("required.status").isin("required", "conditional"))
    step = F.concat(F.lit("Оставить пустым поле «"), F.col("name"), F.lit("»"))
    return wanted.select("doc_id", "id", step.alias("step"), F.when(F.col("required.status") == "required", "ошибка").otherwise("ошибка при выполнении условия").alias("expectation"))


def default_checklist(params: DataFrame) -> DataFrame:
    step = F.concat(F.lit("Открыть форму, поле «"), F.col("name"), F.lit("»"))
    return params.filter(F.col("default_value.status") == "has_default").select("doc_id", "id", step.alias("step"), F.col("default_value.raw").alias("expectation"))


def availability_checklist(params: DataFrame) -> DataFrame:
    step = F.concat(F.lit("Изменить поле «"), F.col("name"), F.lit("»"))
    return params.filter(F.col("availability").isNotNull()).select("doc_id", "id", step.alias("step"), F.col("availability.interpreted").alias("expectation"))


def dataset_diff(old: DataFrame, new: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """(key, change): rows added, removed or changed between two versions; equal ones are left out."""
    digest = lambda: F.xxhash64(F.to_json(F.struct(*compared)))
    a, b = old.select(*key, digest().alias("_a")), new.select(*key, digest().alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(*key, change.alias("change")).filter("change is not null")
