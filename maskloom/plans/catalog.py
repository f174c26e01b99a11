"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import LONG_TOKEN, TOKEN
from ..functions.spans import NONE, find, resolve
from ..operators import preview as preview_ops
from ..operators import coverage, render, review, spec
from ..operators.detect import detectors, each_span, with_spans
from ..operators.dictionary import dictionary_spans, with_dictionary
from ..operators.intervals import meeting
from ..operators.pseudonyms import (
    anonymise, extended, filled_down, first_seen, found_in, mapping_stats, next_numbers, ranked, replaced, restore_stats, restored, restored_json, token_counts,
)
from ..sinks.files import _at, index_upsert, output_names, restored_path
from . import fixtures as X
from .entity_sql import AFTER, KEPT, kept_of
from .fixtures import frame, values
from .storage import stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


#: Queries over small made-up tables and their SQL: for tests only, not registered.
_CASES: dict[str, Query] = {}
_CASES_SQL: dict[str, str] = {}


def _kept(sql: str | None, queries: dict[str, Query], by_sql: dict[str, str]):
    def keep(f: Query) -> Query:
        queries[f.__name__] = f
        if sql:
            by_sql[f.__name__] = sql
        return f

    return keep


def _query(sql: str | None = None):
    return _kept(sql, _QUERIES, _SQL)


def _fixture(sql: str | None = None):
    return _kept(sql, _CASES, _CASES_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table that are worth dealing, and those that one task reads at most.
DEALT, SPLIT = 1 << 16, 1 << 27


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows cost much more time than their bytes tell. Where its files would make fewer tasks than there are cores,
    as one file of any number of short rows does, its rows are dealt to all."""
    df = table(spark, sf_dir, name).select(*(columns or "*"))
    fs, at = _at(spark, f"{sf_dir}/{name}.parquet")
    found, cores = fs.getContentSummary(at), spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if found.getLength() > DEALT and max(found.getFileCount(), found.getLength() // SPLIT) < cores else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """doc_id and text, or other columns."""
    return dealt(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, anonymised by all detectors, with the entities in each."""
    after, _ = anonymise(documents(spark, sf_dir), ["doc_id"], dictionary=X.DICTIONARY)
    tokens = F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    # Most texts have no underscore, which is told without decoding them.
    return after.select("doc_id", "text", F.when(~F.contains("text", F.lit("_")), 0).otherwise(tokens).cast("long").alias("n_entities"))


# ---- whole documents

EMAIL_SQL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
#: Matches of a pattern with their offsets, as (doc_id, i, value, start_at).
SPANS_SQL = """
m AS (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM documents),
s AS (SELECT doc_id, i, m[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start_at
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m))"""
_EMAILS = SPANS_SQL.format(p=EMAIL_SQL)
_NUMBERED = f"""WITH {_EMAILS},
first AS (SELECT value, min((doc_id, -start_at)) AS k FROM s GROUP BY value),
n AS (SELECT value, 'EMAIL_' || lpad(CAST(row_number() OVER (ORDER BY k) AS VARCHAR), 4, '0') AS pseudonym FROM first)"""


@_query("""SELECT doc_id, i AS line_no, line FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
           WHERE regexp_matches(line, '\\S')""")
def doc_lines(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"\S")).select("doc_id", F.col("line_no").cast("long"), "line")


@_query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.substring_index(F.substring_index("url", "://", -1), "/", 1).alias("host"))


@_query(f"WITH {_EMAILS} SELECT doc_id, value, start_at, start_at + length(value) AS end_at FROM s")
def email_spans(spark, sf_dir):
    spans = each_span(documents(spark, sf_dir).select("doc_id", detectors()["EMAIL"](F.col("text")).alias("spans")))
    return spans.select("doc_id", "s.value", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


@_query(r"""SELECT doc_id, translate(value, chr(2) || chr(3), '') AS value FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([0-9]+)', chr(2) || '\1' || chr(3), 'g'), '\x02(?:[0-9]{4}(?:\x03[\s-]\x02)?){3}[0-9]{4}\x03')) AS value FROM documents)""")
def card_spans(spark, sf_dir):
    spans = each_span(documents(spark, sf_dir).select("doc_id", detectors()["CARD"](F.col("text")).alias("spans")))
    return spans.select("doc_id", "s.value")


@_query(f"{_NUMBERED} SELECT 'EMAIL' AS type, value AS original, pseudonym FROM n")
def email_mapping(spark, sf_dir):
    found = with_spans(documents(spark, sf_dir), registry={"EMAIL": detectors()["EMAIL"]})
    return extended(frame(spark, (X.SEEDED[0], [])), first_seen(found, ["doc_id"]))


@_query(f"""{_NUMBERED},
parts AS (SELECT s.doc_id, string_agg(m.g[s.i] || n.pseudonym, '' ORDER BY s.i) AS head FROM s JOIN n USING (value) JOIN m USING (doc_id) GROUP BY s.doc_id)
SELECT m.doc_id, md5(coalesce(parts.head, '') || m.g[-1]) AS text_md5 FROM m LEFT JOIN parts USING (doc_id)""")
def anonymise_emails(spark, sf_dir):
    after, _ = anonymise(documents(spark, sf_dir), ["doc_id"], registry={"EMAIL": detectors()["EMAIL"]})
    return after.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_query(f"WITH {AFTER} SELECT doc_id, text, CAST(len(regexp_extract_all(text, '[A-Z]+_[0-9]{{4}}')) AS BIGINT) AS n_entities FROM after")
def anonymise_documents(spark, sf_dir):
    return flagship(spark, sf_dir)


@_query(f"WITH {KEPT} SELECT doc_id, type, value, start_at, end_at FROM kept")
def entity_spans(spark, sf_dir):
    """All types over all documents, overlaps resolved."""
    spans = each_span(with_spans(documents(spark, sf_dir), X.DICTIONARY).select("doc_id", "spans"))
    return spans.select("doc_id", "s.type", "s.value", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


@_query(f"WITH {KEPT} SELECT source, type, count(*) AS n, count(DISTINCT value) AS n_values FROM kept JOIN cleaned USING (doc_id) GROUP BY source, type")
def entity_counts_by_source(spark, sf_dir):
    spans = each_span(with_spans(documents(spark, sf_dir, "source", "text"), X.DICTIONARY).select("source", "spans"))
    return spans.groupBy("source", F.col("s.type").alias("type")).agg(F.count("*").alias("n"), F.countDistinct("s.value").alias("n_values"))


# ---- numbering and mappings


@_query("SELECT c_name AS original, 'PERSON_' || lpad(CAST(rn AS VARCHAR), greatest(4, length(CAST(rn AS VARCHAR)))::INTEGER, '0') AS pseudonym FROM (SELECT c_name, row_number() OVER (ORDER BY min(c_custkey)) AS rn FROM customer GROUP BY c_name)")
def pseudonym_customers(spark, sf_dir):
    first = table(spark, sf_dir, "customer").groupBy("c_name").agg(F.min("c_custkey").alias("seen")).withColumn("type", F.lit("PERSON"))
    return ranked(first, "type", ["seen"]).select(F.col("c_name").alias("original"), T.pseudonym(F.col("type"), F.col("rank").cast("int")).alias("pseudonym"))


@_query("SELECT n_name AS nation, s_name AS original, n_name || '_' || lpad(CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS VARCHAR), 4, '0') AS pseudonym FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def pseudonym_suppliers(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    r = ranked(own.select(F.col("n_name").alias("nation"), F.col("s_name").alias("original"), "s_suppkey"), "nation", ["s_suppkey"])
    return r.select("nation", "original", T.pseudonym(F.col("nation"), F.col("rank").cast("int")).alias("pseudonym"))


@_query(f"""WITH {values(X.SEEDED, "seeded")},
seen AS (SELECT 'Customer#' || o_custkey AS original, min(o_orderkey) AS k FROM orders GROUP BY 1),
fresh AS (SELECT original, 3 + row_number() OVER (ORDER BY k) AS n FROM seen WHERE original NOT IN (SELECT original FROM seeded WHERE type = 'PERSON'))
SELECT type, original, pseudonym FROM seeded UNION ALL SELECT 'PERSON', original, 'PERSON_' || lpad(CAST(n AS VARCHAR), greatest(4, length(CAST(n AS VARCHAR)))::INTEGER, '0') FROM fresh""")
def pseudonym_incremental(spark, sf_dir):
    value = F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string"))
    seen = table(spark, sf_dir, "orders").groupBy(F.lit("PERSON").alias("type"), value.alias("original")).agg(F.min("o_orderkey").alias("seen"))
    return extended(frame(spark, X.SEEDED), seen)


@_fixture(f"WITH {values(X.SEEDED, 'seeded')} SELECT type, count(*) AS n FROM seeded GROUP BY type")
def mapping_counts(spark, sf_dir):
    return mapping_stats(frame(spark, X.SEEDED))


@_fixture(f"WITH {values(X.SEEDED, 'seeded')} SELECT type, coalesce(max(try_cast(string_split(pseudonym, '_')[-1] AS INTEGER)), 0) + 1 AS next FROM seeded GROUP BY type")
def next_pseudonyms(spark, sf_dir):
    return next_numbers(frame(spark, X.SEEDED))


# ---- detectors, overlaps, dictionaries


@_fixture(f"WITH {values(X.DETECTOR_CASES, 'c')} SELECT case_id, type, value, start_at FROM c WHERE value IS NOT NULL")
def detector_cases(spark, sf_dir):
    spans = each_span(with_spans(frame(spark, X.DETECTOR_CASES).select("case_id", "text"), X.DICTIONARY).select("case_id", "spans"))
    return spans.select("case_id", "s.type", "s.value", F.col("s.start").cast("long").alias("start_at"))


@_fixture(f"WITH {values(X.NORMAL_CASES, 'c')} SELECT case_id, normal, fixed FROM c")
def normal_and_fixed_text(spark, sf_dir):
    return frame(spark, X.NORMAL_CASES).select("case_id", T.normalise(F.col("text")).alias("normal"), T.clean(F.col("text")).alias("fixed"))


@_fixture(f"WITH {values(X.OVERLAP_CASES, 'c')} SELECT case_id, value, type, start_at, end_at FROM c WHERE kept")
def resolve_overlaps(spark, sf_dir):
    s = F.struct("value", "type", F.col("start_at").alias("start"), F.col("end_at").alias("end"), "ord")
    grouped = frame(spark, X.OVERLAP_CASES).groupBy("case_id").agg(F.collect_list(s).cast(NONE).alias("spans"))
    return grouped.select("case_id", F.explode(resolve(F.col("spans"))).alias("s")).select("case_id", "s.value", "s.type", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@_query("""WITH words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS entry FROM part)
SELECT p_partkey, entry AS value, CAST(instr(' ' || p_name || ' ', ' ' || entry || ' ') - 1 AS INTEGER) AS start_at FROM part JOIN words ON contains(' ' || p_name || ' ', ' ' || entry || ' ')""")
def dictionary_join(spark, sf_dir):
    """A dictionary of any size, met by first words."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    entries = part.select(F.lit("PRODUCT").alias("type"), F.explode(F.split("p_name", " ")).alias("entry")).distinct()
    found = dictionary_spans(part, entries, ["p_partkey"], "p_name")
    return found.select("p_partkey", "value", F.col("start").alias("start_at"))


@_query("SELECT p_name AS entry, row_number() OVER (ORDER BY length(p_name) DESC, p_name) AS place FROM (SELECT DISTINCT p_name FROM part)")
def longest_first(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(F.col("p_name").alias("entry")).distinct()
    r = ranked(entries.select("entry", F.lit("PRODUCT").alias("type"), (-F.length("entry")).alias("len")), "type", ["len", "entry"])
    return r.select("entry", F.col("rank").alias("place"))


# ---- restoring


@_query("SELECT o_orderkey, 'order of ' || c_name || ', again ' || c_name AS text FROM orders JOIN customer ON o_custkey = c_custkey")
def restore_orders(spark, sf_dir):
    """Texts with a token for each order's customer, and their originals back."""
    token = lambda k: T.pseudonym(F.lit("PERSON"), F.col(k).cast("int"))
    customer = table(spark, sf_dir, "customer")
    mapping = customer.select(F.lit("PERSON").alias("type"), F.col("c_name").alias("original"), token("c_custkey").alias("pseudonym"))
    known = table(spark, sf_dir, "orders").join(customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    texts = known.select("o_orderkey", F.concat(F.lit("order of "), token("o_custkey"), F.lit(", again "), token("o_custkey")).alias("text"))
    return restored(texts, mapping, token=LONG_TOKEN).select("o_orderkey", "text")


_RESTORED = "SELECT * FROM (VALUES (1, 'Анна и Борис, снова Анна', 3, 0), (2, 'Тестбанк, X_0001 и X_0001', 2, 1), (3, 'Вера0 без границ', 1, 0), (4, 'ничего', 0, 0), (5, '', 0, 0)) AS t(doc_id, text, replaced, unresolved)"


@_fixture(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM ({_RESTORED})")
def restore_texts(spark, sf_dir):
    return restored(frame(spark, X.TOKEN_TEXTS), frame(spark, X.TOKEN_MAPPING), token=TOKEN).select("doc_id", "text")


@_fixture(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(replaced AS BIGINT) AS replaced, CAST(unresolved AS INTEGER) AS unresolved FROM ({_RESTORED})")
def restore_counts(spark, sf_dir):
    return restore_stats(restored(frame(spark, X.TOKEN_TEXTS), frame(spark, X.TOKEN_MAPPING), token=TOKEN), ["doc_id"]).select("doc_id", "replaced", "unresolved")


@_fixture("""SELECT CAST(1 AS BIGINT) AS doc_id, '{' || chr(10) || '  "PERSON_0001": "Анна",' || chr(10) || '  "list": [' || chr(10) || '    "Борис и Z_0009",' || chr(10) || '    7' || chr(10) || '  ]' || chr(10) || '}' AS text, 3 AS tokens""")
def restore_json(spark, sf_dir):
    files = spark.createDataFrame([(1, '{"PERSON_0001": "PERSON_0001", "list": ["PERSON_0002 и Z_0009", 7]}')], "doc_id long, text string")
    return restored_json(files, frame(spark, X.TOKEN_MAPPING)).select("doc_id", "text", "tokens")


@_fixture("""WITH p(path) AS (VALUES ('/d/anonimized/x_anon.md'), ('/d/anonimized/x_anon_review.json'), ('/d/anonimized/index.json'), ('/d/other/y.json'))
SELECT path, CASE path WHEN '/d/anonimized/x_anon.md' THEN '/d/deanonimized/x_deanon.md' WHEN '/d/anonimized/x_anon_review.json' THEN '/d/deanonimized/x_deanon_review.json'
  WHEN '/d/anonimized/index.json' THEN '/d/deanonimized/_deanon_index.json' ELSE '/d/other/deanonimized/y_deanon.json' END AS restored FROM p""")
def restored_paths(spark, sf_dir):
    df = spark.createDataFrame([("/d/anonimized/x_anon.md",), ("/d/anonimized/x_anon_review.json",), ("/d/anonimized/index.json",), ("/d/other/y.json",)], "path string")
    return df.select("path", restored_path(F.col("path")).alias("restored"))


# ---- counts


@_query("SELECT CAST(o_custkey % 97 AS BIGINT) AS doc_id, upper(o_orderstatus) AS type, count(DISTINCT o_custkey % 1000) AS n FROM orders GROUP BY ALL")
def entity_counts(spark, sf_dir):
    """Distinct tokens by type over lines that hold a token for each order."""
    token = F.format_string("%s_%04d", F.col("o_orderstatus"), (F.col("o_custkey") % 1000).cast("int"))
    lines = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).cast("long").alias("doc_id"), F.concat(F.lit("a "), token, F.lit(" b")).alias("line"))
    return token_counts(lines, ["doc_id"], "line").select("doc_id", "type", "n")


# ---- review


@_fixture(f"WITH {values(X.REVIEW_EXPECTED, 'e')} SELECT case_id, value, type_guess, reason FROM e")
def review_candidates(spark, sf_dir):
    return review.candidates(frame(spark, X.REVIEW_CASES), ["case_id"], dictionary=X.DICTIONARY).select("case_id", "value", "type_guess", "reason")


@_fixture(f"WITH {values(X.REVIEW_EXPECTED, 'e')} SELECT min_by(value, case_id) AS value, type_guess, min_by(reason, case_id) AS reason, count(*) AS count, string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_id) AS locations FROM e GROUP BY lower(value), type_guess")
def review_grouped(spark, sf_dir):
    found = review.candidates(frame(spark, X.REVIEW_CASES), ["case_id"], dictionary=X.DICTIONARY).withColumn("all", F.lit(1))
    g = review.grouped(found, ["all"], ["case_id"], F.col("case_id").cast("string"))
    return g.select("value", "type_guess", "reason", "count", F.array_join("locations", ",").alias("locations"))


@_fixture(f"WITH {values(X.REVIEW_EXPECTED, 'e')} SELECT type_guess, count(DISTINCT lower(value)) AS n FROM e GROUP BY type_guess")
def review_by_type(spark, sf_dir):
    found = review.candidates(frame(spark, X.REVIEW_CASES), ["case_id"], dictionary=X.DICTIONARY).withColumn("all", F.lit(1))
    return review.by_type(review.grouped(found, ["all"], ["case_id"], F.col("case_id").cast("string")), ["all"]).select("type_guess", "n")


@_fixture(f"WITH {values(X.REVIEW_EXPECTED, 'e')} SELECT case_id, value, type_guess FROM e WHERE lower(value) NOT IN ('гармония', 'юг')")
def review_ignored(spark, sf_dir):
    ignore = review.add_ignored(spark.createDataFrame([("юг",)], "value_lower string"), ["ГАРМОНИЯ "])
    return review.candidates(frame(spark, X.REVIEW_CASES), ["case_id"], ignore, X.DICTIONARY).select("case_id", "value", "type_guess")


# ---- specifications

_C = values(X.CELLS, "cells")
_MARK = "lower(translate(trim({}), 'ёЁ', 'еЕ'))"
_HEADER = "header AS (SELECT doc_id, sheet_index, min(row) AS header_row FROM cells WHERE row <= 15 AND (" + " OR ".join(f"contains({_MARK.format('value')}, '{m}')" for m in spec.HEADER_MARKERS) + ") GROUP BY ALL)"
_ROLE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_MARK.format('value')}, '{m}')" for m in markers) + f" THEN '{role}'" for role, markers in spec.ROLE_MARKERS) + " END"
_ROLES = f"roles AS (SELECT doc_id, sheet_index, header_row, role, min(col) AS col FROM (SELECT c.*, h.header_row, {_ROLE} AS role FROM cells c JOIN header h USING (doc_id, sheet_index) WHERE c.row = h.header_row) WHERE role IS NOT NULL GROUP BY ALL)"
_WIDE = f"""WITH {_C}, {_HEADER}, {_ROLES},
named AS (SELECT doc_id, sheet_index, header_row FROM roles WHERE role = 'field_name'),
body AS (SELECT c.*, r.role FROM cells c JOIN named n USING (doc_id, sheet_index) LEFT JOIN roles r USING (doc_id, sheet_index, col) WHERE c.row > n.header_row),
w AS (SELECT doc_id, sheet_index, row, {", ".join(f"max(value) FILTER (role = '{r}') AS {r}" for r in spec.ROLES)}, bool_or({" OR ".join(f"contains({_MARK.format('value')}, '{m}')" for m in spec.HIDDEN_MARKERS)}) AS hidden FROM body GROUP BY ALL),
k AS (SELECT *, coalesce({", ".join(spec.DATA_ROLES)}) IS NOT NULL AS filled, CASE WHEN field_name IS NOT NULL AND coalesce({", ".join(spec.DATA_ROLES)}) IS NULL THEN 'block' WHEN field_name IS NULL AND coalesce({", ".join(spec.DATA_ROLES)}) IS NULL THEN 'empty' WHEN field_name IS NULL THEN 'ambiguous' ELSE 'parameter' END AS row_kind FROM w)"""


def _req(c: str) -> str:
    r = f"lower(translate(trim(coalesce({c}, '')), 'ёЁ', 'еЕ'))"
    conditional = " OR ".join(f"contains({r}, '{m}')" for m in spec.REQUIRED_IF)
    negative = ", ".join(f"'{m}'" for m in spec.NOT_REQUIRED)
    return f"CASE WHEN {r} = '' THEN 'unknown' WHEN {r} = 'обязательное' THEN 'required' WHEN contains({r}, 'обязательное') THEN CASE WHEN {conditional} THEN 'conditional' ELSE 'required' END WHEN {r} IN ({negative}) OR ({r} LIKE 'нет%' AND length({r}) <= 8) THEN 'no' ELSE 'conditional' END"


@_fixture(f"WITH {_C}, {_HEADER} SELECT doc_id, sheet_index, header_row FROM header")
def spec_header_row(spark, sf_dir):
    return spec.header_rows(frame(spark, X.CELLS))


@_fixture(f"WITH {_C}, {_HEADER}, {_ROLES} SELECT doc_id, sheet_index, role, col FROM roles")
def spec_roles(spark, sf_dir):
    return spec.roles(frame(spark, X.CELLS)).select("doc_id", "sheet_index", "role", "col")


@_fixture("SELECT * FROM (VALUES (0, true, 0), (1, false, 1), (2, false, 1)) AS t(sheet_index, usable, n_notes)")
def spec_sheets(spark, sf_dir):
    return spec.sheets(frame(spark, X.CELLS)).select("sheet_index", "usable", F.size("notes").alias("n_notes"))


def _status(kind: str) -> str:
    return f"WITH {values(X.STATUS_CASES, 'c')} SELECT case_id, expected AS status FROM c WHERE kind = '{kind}'"


def _of_kind(spark, kind: str, status) -> DataFrame:
    return frame(spark, X.STATUS_CASES).filter(F.col("kind") == kind).select("case_id", status(F.col("raw")).cast("string").alias("status"))


@_fixture(_status("required"))
def spec_required(spark, sf_dir):
    return _of_kind(spark, "required", spec.required_status)


@_fixture(_status("default"))
def spec_default(spark, sf_dir):
    return _of_kind(spark, "default", spec.default_status)


@_fixture(_status("availability"))
def spec_availability(spark, sf_dir):
    return _of_kind(spark, "availability", spec.availability_status)


@_fixture(_status("auto"))
def spec_auto(spark, sf_dir):
    return _of_kind(spark, "auto", spec.is_auto_input)


@_fixture(_status("hidden"))
def spec_hidden(spark, sf_dir):
    return _of_kind(spark, "hidden", spec.is_hidden)


@_fixture(f"{_WIDE} SELECT doc_id, sheet_index, row, row_kind, last_value(CASE WHEN row_kind = 'block' THEN field_name END IGNORE NULLS) OVER (PARTITION BY doc_id, sheet_index ORDER BY row) AS block, coalesce(hidden, false) AS hidden FROM k")
def spec_rows(spark, sf_dir):
    return spec.rows(frame(spark, X.CELLS)).select("doc_id", "sheet_index", "row", "row_kind", "block", F.col("hidden_evidence").isNotNull().alias("hidden"))


@_fixture(f"""{_WIDE} SELECT 'sheet' || sheet_index || '-row' || row AS id, field_name AS name, coalesce(type, '') AS type, CASE WHEN hidden AND {_req("required")} = 'required' THEN 'conditional' ELSE {_req("required")} END AS required,
  'F' || row AS source_cell, 'A' || row || ':H' || row AS cell_range, hidden FROM k WHERE row_kind = 'parameter'""")
def spec_parameters(spark, sf_dir):
    p = spec.parameters(frame(spark, X.CELLS))
    return p.select("id", "name", "type", F.col("required.status").alias("required"), "default_value.source_cell", "source.cell_range", "ui.hidden")


@_fixture(f"{_WIDE} SELECT doc_id, sheet_index, row, CAST((type IS NOT NULL)::INT + (availability IS NOT NULL)::INT AS INTEGER) AS n_values FROM k WHERE row_kind = 'ambiguous'")
def spec_ambiguous(spark, sf_dir):
    return spec.ambiguous(spec.rows(frame(spark, X.CELLS))).select("doc_id", "sheet_index", "row", F.size("values").alias("n_values"))


@_fixture("SELECT CAST(1 AS BIGINT) AS doc_id, CAST(3 AS BIGINT) AS total_sheets, CAST(4 AS BIGINT) AS total_parameters, CAST(1 AS BIGINT) AS required, CAST(2 AS BIGINT) AS conditional_required, CAST(1 AS BIGINT) AS with_default, CAST(2 AS BIGINT) AS without_default, CAST(1 AS BIGINT) AS default_needs_manual_check, CAST(1 AS BIGINT) AS hidden_fields, CAST(1 AS BIGINT) AS ambiguous_cases")
def spec_summary(spark, sf_dir):
    return spec.summary(frame(spark, X.CELLS))


@_query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS above FROM events")
def forward_fill(spark, sf_dir):
    """The rule that gives a form's rows their block, over events: the last click above each."""
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    return filled_down(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", click.alias("click")), "user_id", ["ts", "event_id"], "click", "above").select("event_id", "user_id", "above")


@_fixture(f"""{_WIDE} SELECT 'sheet' || sheet_index || '-row' || row AS id, CASE WHEN {_req("required")} = 'required' AND NOT hidden THEN 'ошибка' ELSE 'ошибка при выполнении условия' END AS expectation
  FROM k WHERE row_kind = 'parameter' AND {_req("required")} IN ('required', 'conditional')""")
def required_checklist(spark, sf_dir):
    return spec.required_checklist(spec.parameters(frame(spark, X.CELLS))).select("id", "expectation")


@_fixture(f"{_WIDE} SELECT 'sheet' || sheet_index || '-row' || row AS id, default_value AS expectation FROM k WHERE row_kind = 'parameter' AND default_value = 'RUB'")
def default_checklist(spark, sf_dir):
    return spec.default_checklist(spec.parameters(frame(spark, X.CELLS))).select("id", "expectation")


@_fixture(f"{_WIDE} SELECT 'sheet' || sheet_index || '-row' || row AS id, CASE availability WHEN 'Доступно' THEN 'available' WHEN 'Только для чтения' THEN 'read_only' WHEN 'Недоступно' THEN 'not_available' ELSE 'conditional' END AS expectation FROM k WHERE row_kind = 'parameter' AND availability IS NOT NULL")
def availability_checklist(spark, sf_dir):
    return spec.availability_checklist(spec.parameters(frame(spark, X.CELLS))).select("id", "expectation")


@_query("""WITH a AS (SELECT s_suppkey * 3 AS k, s_nationkey AS nation, s_acctbal AS balance FROM supplier), b AS (SELECT c_custkey * 2 AS k, c_nationkey AS nation, c_acctbal AS balance FROM customer)
SELECT k, CASE WHEN a.nation IS NULL THEN 'added' WHEN b.nation IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k)
WHERE a.nation IS NULL OR b.nation IS NULL OR a.nation <> b.nation OR a.balance <> b.balance""")
def dataset_diff(spark, sf_dir):
    """All suppliers and all customers as two versions of one data set, under keys that some have in common."""
    old = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    new = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return spec.dataset_diff(old, new, ["k"], ["nation", "balance"])



# ---- index, names, rendering


@_query("SELECT doc_id, quality + 10 AS quality FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, quality FROM labels WHERE toxic <> 1")
def index_merge(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    new = labels.filter("toxic = 1").select("doc_id", (F.col("quality") + 10).alias("quality"))
    return index_upsert(labels.select("doc_id", "quality"), new, "doc_id")


@_fixture(f"WITH {values(X.PATHS, 'p')} SELECT path, base FROM p")
def name_plan(spark, sf_dir):
    return output_names(frame(spark, X.PATHS).select("path", "doc_ord")).select("path", "base")


def _turn_blocks(spark, sf_dir) -> DataFrame:
    """Conversations as documents: turns of users are texts, those of others images."""
    asset = render.ASSET
    c = table(spark, sf_dir, "conversations").withColumn("kind", F.when(F.col("role") == "user", "text").otherwise("image"))
    numbered = render.asset_ordinals(c.filter("kind = 'image'"), ["conv_id"], ["turn"]).select("conv_id", "turn", "asset_id")
    c = c.join(numbered, ["conv_id", "turn"], "left")
    a = F.struct("asset_id", F.lit(None).cast("binary").alias("data"), F.lit("png").alias("ext"), F.lit(None).cast("int").alias("src_page"), F.lit(None).cast("string").alias("original_filename"), F.lit(None).cast("string").alias("prog_id"), F.lit("").alias("note"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_index"), "kind", "text", F.lit(None).cast("array<array<string>>").alias("rows"), F.when(F.col("kind") == "image", a).cast(asset).alias("asset"))


@_query("SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS block_index, 'img-' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 3, '0') AS asset_id FROM conversations WHERE role <> 'user'")
def asset_ordinals(spark, sf_dir):
    return _turn_blocks(spark, sf_dir).filter("asset is not null").select("doc_id", "block_index", "asset.asset_id")


@_query("SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS block_index, CAST(coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 2 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS anchor FROM conversations")
def anchors(spark, sf_dir):
    return render.with_anchors(_turn_blocks(spark, sf_dir)).select("doc_id", "block_index", "anchor")


@_query("SELECT conv_id AS doc_id, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY conv_id")
def asset_manifest_counts(spark, sf_dir):
    m = render.manifest(_turn_blocks(spark, sf_dir))
    return m.select("doc_id", F.explode("assets").alias("a")).groupBy("doc_id").agg(F.count("*").alias("n"))


@_query("SELECT conv_id AS doc_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 2 END)::BIGINT AS n_lines FROM conversations GROUP BY conv_id")
def document_lines(spark, sf_dir):
    return render.document_lines(_turn_blocks(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@_query("SELECT p_partkey, replace(replace(p_name || '|' || chr(10) || p_brand, '|', '\\|'), chr(10), ' ') AS cell FROM part")
def md_escape(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.md_cell(F.concat("p_name", F.lit("|\n"), "p_brand")).alias("cell"))


@_query("""SELECT n_regionkey, line FROM (SELECT n_regionkey, unnest(['| key | name |', '| --- | --- |'] || list('| ' || n_nationkey || ' | ' || n_name || ' |' ORDER BY n_nationkey) || ['| end |  |']) AS line FROM nation GROUP BY n_regionkey)""")
def md_tables(spark, sf_dir):
    """A table for each region, its last row ragged."""
    row = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]).alias("body"))
    whole = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.col("body"), F.array(F.array(F.lit("end"))))
    return rows.select("n_regionkey", F.explode(T.md_table(whole)).alias("line"))


@_fixture("SELECT n, CASE WHEN n <= 26 THEN chr(64 + n::INT) WHEN n <= 702 THEN chr(64 + ((n - 1) // 26)::INT) || chr(65 + ((n - 1) % 26)::INT) ELSE chr(65 + ((n - 703) // 676)::INT) || chr(65 + ((n - 703) // 26 % 26)::INT) || chr(65 + ((n - 703) % 26)::INT) END AS letter FROM range(1, 2000) AS t(n)")
def a1_coordinates(spark, sf_dir):
    return spark.range(1, 2000).select(F.col("id").alias("n"), T.column_letter(F.col("id")).alias("letter"))


@_query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS n, length(text[:greatest(instr(text, 'the') - 1, 0)]) - length(replace(text[:greatest(instr(text, 'the') - 1, 0)], chr(10), '')) + 1 AS line FROM documents WHERE contains(text, 'the')")
def occurrences(spark, sf_dir):
    """How often a value stands in each document, and the line of its first place."""
    d = documents(spark, sf_dir).filter(F.contains("text", F.lit("the")))
    starts = find(F.col("text"), "the", "", 0)
    return d.select("doc_id", F.size(starts).alias("n"), F.split(T.line_and_column(F.col("text"), starts[0]["start"]), r"\.")[0].cast("long").alias("line"))


@_query("""WITH c AS (SELECT doc_id, string_split(text, 'the') AS g FROM documents WHERE contains(text, 'the')),
p AS (SELECT doc_id, i AS nth, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + 3 * (i - 1) AS INTEGER) AS start_at FROM (SELECT *, unnest(range(1, len(g))) AS i FROM c))
SELECT doc_id, CAST(nth - 1 AS INTEGER) AS nth, start_at, coalesce(lag(start_at) OVER w, last_value(start_at) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_at,
  coalesce(lead(start_at) OVER w, first_value(start_at) OVER w) AS next_at FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY nth)""")
def occurrence_walk(spark, sf_dir):
    """Every place of a value in each document with the ones before and after it, round and round."""
    return preview_ops.walk(documents(spark, sf_dir).withColumn("value", F.lit("the")), ["doc_id", "value"]).drop("value")


@_query("""WITH t AS (SELECT CAST(o_custkey % 97 AS BIGINT) AS doc_id, o_orderstatus || '_' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 4, '0') AS token FROM orders),
c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS replaced, max(n) AS most FROM c GROUP BY doc_id""")
def preview_totals(spark, sf_dir):
    """How many replacements a preview shows, and the most of one value."""
    token = F.format_string("%s_%04d", F.col("o_orderstatus"), (F.col("o_custkey") % 1000).cast("int"))
    lines = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).cast("long").alias("doc_id"), F.concat(F.lit("a "), token, F.lit(" b")).alias("line"))
    return preview_ops.totals(lines, ["doc_id"], "line")


@_query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def round_trip(spark, sf_dir):
    """Anonymised by e-mail addresses and cards without separators, then restored: the documents again."""
    own = {k: v for k, v in detectors().items() if k in ("EMAIL", "CARD")}
    found = found_in(with_spans(documents(spark, sf_dir), registry=own))
    mapping = stored(extended(frame(spark, (X.SEEDED[0], [])), first_seen(found, ["doc_id"])), "mapping")
    return restored(replaced(found, mapping), mapping, token=LONG_TOKEN).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---- the same operators over whole tables

_CUSTOMER_TEXTS = """(SELECT c_custkey AS doc_id, c_mktsegment AS source, CASE c_custkey % 9
  WHEN 0 THEN 'ИНН: ' || lpad(CAST(c_custkey AS VARCHAR), 10, '7') WHEN 1 THEN 'код ' || lpad(CAST(c_custkey AS VARCHAR), 12, '5') || ' указан' WHEN 2 THEN 'СНИЛС ' || lpad(CAST(c_custkey AS VARCHAR), 11, '3')
  WHEN 3 THEN 'паспорт 4001 ' || lpad(CAST(c_custkey AS VARCHAR), 6, '6') WHEN 4 THEN 'р/с ' || lpad(CAST(c_custkey AS VARCHAR), 20, '4') WHEN 5 THEN 'карта 5500 0000 ' || lpad(CAST(c_custkey AS VARCHAR), 8, '2')
  WHEN 6 THEN 'звоните +7 (812) 555-10-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ', c' || c_custkey || '@mail.example' WHEN 7 THEN '111-222-333 ' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ' и 8 900 555-10-20' ELSE c_name END AS text FROM customer)"""


@_query(f"WITH {kept_of(_CUSTOMER_TEXTS)} SELECT doc_id, type, value, start_at FROM kept")
def customer_entities(spark, sf_dir):
    """Values of eight types in texts made of all customers."""
    k = F.col("c_custkey")
    pad = lambda n, c: F.lpad(k.cast("string"), n, c)
    two = F.lpad((k % 100).cast("string"), 2, "0")
    texts = [
        F.concat(F.lit("ИНН: "), pad(10, "7")), F.concat(F.lit("код "), pad(12, "5"), F.lit(" указан")), F.concat(F.lit("СНИЛС "), pad(11, "3")), F.concat(F.lit("паспорт 4001 "), pad(6, "6")),
        F.concat(F.lit("р/с "), pad(20, "4")), F.concat(F.lit("карта 5500 0000 "), pad(8, "2")), F.concat(F.lit("звоните +7 (812) 555-10-"), two, F.lit(", c"), k.cast("string"), F.lit("@mail.example")), F.concat(F.lit("111-222-333 "), two, F.lit(" и 8 900 555-10-20")),
    ]
    text = F.coalesce(*(F.when(k % 9 == i, t) for i, t in enumerate(texts)), F.col("c_name"))
    spans = each_span(with_spans(stored(dealt(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text")), "texts")).select("doc_id", "spans"))
    return spans.select("doc_id", "s.type", "s.value", F.col("s.start").cast("long").alias("start_at"))


@_query("""WITH l AS (SELECT l_orderkey, list([{'line': l_linenumber, 's': CAST(l_linenumber * 3 + l_quantity % 5 AS INTEGER), 'e': CAST(l_linenumber * 3 + l_quantity % 5 + 1 + l_partkey % 9 AS INTEGER)}]
  ORDER BY l_partkey % 9 DESC, l_linenumber * 3 + l_quantity % 5, l_suppkey % 13 * 100 + l_linenumber) AS l FROM lineitem GROUP BY l_orderkey),
g AS (SELECT l_orderkey, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda o: x[1].s < o.e AND x[1].e > o.s)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS k FROM l)
SELECT l_orderkey, k.line AS line_no, k.s AS start_at, k.e AS end_at FROM g""")
def resolve_lines(spark, sf_dir):
    """Overlaps resolved among the lines of each order, taken as spans."""
    at = (F.col("l_linenumber") * 3 + F.col("l_quantity") % 5).cast("int")
    s = F.struct(F.col("l_linenumber").cast("string").alias("value"), F.lit("").alias("type"), at.alias("start"), (at + 1 + (F.col("l_partkey") % 9).cast("int")).alias("end"), (F.col("l_suppkey") % 13 * 100 + F.col("l_linenumber")).cast("int").alias("ord"))
    kept = each_span(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(s).cast(NONE).alias("spans")).select("l_orderkey", resolve(F.col("spans")).alias("spans")))
    return kept.select("l_orderkey", F.col("s.value").cast("int").alias("line_no"), F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@_query("SELECT doc_id, md5(translate(text, 'aeo', ' -')) AS text_md5 FROM documents")
def normal_documents(spark, sf_dir):
    """Documents with unusual spaces, hyphens and zero-width characters in place of letters, normalised."""
    odd = F.translate("text", "aeo", "\u00a0\u2010\u200b")
    return documents(spark, sf_dir).select("doc_id", F.md5(T.normalise(odd).cast("binary")).alias("text_md5"))


@_query("""WITH t AS (SELECT o_orderkey, o_custkey % 97 AS doc_id, o_custkey % 3 = 0 AS lost, o_custkey FROM orders)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(sum(2 - lost::INT) AS BIGINT) AS replaced, CAST(count(DISTINCT CASE WHEN lost THEN o_custkey END) AS INTEGER) AS unresolved FROM t GROUP BY doc_id""")
def restore_order_counts(spark, sf_dir):
    """What restoring counts over texts for all orders, a third of whose customers the mapping lacks; each text has its token twice."""
    token = T.pseudonym(F.lit("PERSON"), F.col("o_custkey").cast("int"))
    orders = table(spark, sf_dir, "orders")
    texts = orders.select((F.col("o_custkey") % 97).cast("long").alias("doc_id"), F.concat(token, F.lit(" "), token).alias("text"))
    known = orders.filter("o_custkey % 3 <> 0").select(F.lit("PERSON").alias("type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("original"), token.alias("pseudonym")).distinct()
    return restore_stats(restored(texts, known, token=LONG_TOKEN), ["doc_id"])


@_query("""SELECT event_id, '{' || chr(10) || '  "' || event_type || '": "user ' || user_id || '",' || chr(10) || '  "seen": [' || chr(10) || '    1,' || chr(10) || '    "user ' || user_id || ', user ' || user_id || '"' || chr(10) || '  ]' || chr(10) || '}' AS text, 3 AS tokens FROM events""")
def restore_event_json(spark, sf_dir):
    """A JSON file for each event, with tokens in its values, restored."""
    token = T.pseudonym(F.lit("PERSON"), F.col("user_id").cast("int"))
    events = table(spark, sf_dir, "events")
    files = events.select("event_id", F.concat(F.lit('{"'), "event_type", F.lit('": "'), token, F.lit('", "seen": [1, "'), token, F.lit(", "), token, F.lit('"]}')).alias("text"))
    known = events.select("user_id").distinct().select(F.lit("PERSON").alias("type"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("original"), token.alias("pseudonym"))
    return restored_json(files, known, token=LONG_TOKEN).select("event_id", "text", "tokens")


@_query("""SELECT c_nationkey, c_mktsegment AS value, CASE WHEN c_custkey % 2 = 0 THEN 'ORG' ELSE 'PRODUCT' END AS type_guess, CASE WHEN c_custkey % 2 = 0 THEN 'партнёр' ELSE 'продукт' END AS reason, count(*) AS count FROM customer GROUP BY ALL""")
def review_customers(spark, sf_dir):
    """Review candidates in a text for each customer, grouped by nation."""
    c = dealt(spark, sf_dir, "customer", "c_nationkey", "c_custkey", "c_mktsegment")
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("для партнёра «"), "c_mktsegment", F.lit("» и"))).otherwise(F.concat(F.lit("по продукту "), "c_mktsegment", F.lit(": срок")))
    found = review.candidates(c.select("c_nationkey", "c_custkey", text.alias("text")), ["c_nationkey", "c_custkey"])
    return review.grouped(found, ["c_nationkey"], ["c_custkey"], F.col("c_custkey").cast("string")).select("c_nationkey", "value", "type_guess", "reason", "count")


#: A form for each nation: a title, the header in row 3, then its suppliers, each tenth a block and some without a name.
_FORM = {"Название поля": "CASE WHEN s_suppkey % 13 <> 0 THEN s_name END", "Тип поля": "CASE WHEN s_suppkey % 10 <> 0 THEN 'Строка' END", "Обязательность": "CASE WHEN s_suppkey % 10 <> 0 THEN CASE s_suppkey % 4 WHEN 0 THEN 'Обязательное' WHEN 1 THEN 'Нет' WHEN 2 THEN 'Обязательное, если есть счёт' END END",
         "Значение по умолчанию": "CASE WHEN s_suppkey % 10 <> 0 AND s_acctbal > 0 THEN CAST(s_suppkey AS VARCHAR) END", "Прочие особенности поведения": "CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 10 <> 0 THEN 'Поле скрыто на ЭФ' END"}
_FORM_SQL = "cells AS (SELECT CAST(s_nationkey AS BIGINT) AS doc_id, 0 AS sheet_index, 3 + CAST(s_suppkey AS INTEGER) AS row, col, value FROM (" + " UNION ALL ".join(f"SELECT s_nationkey, s_suppkey, {i} AS col, {v} AS value FROM supplier" for i, v in enumerate(_FORM.values(), 1)) + ") WHERE value IS NOT NULL UNION ALL SELECT DISTINCT CAST(s_nationkey AS BIGINT), 0, 3, h.col, h.value FROM supplier, (VALUES " + ", ".join(f"({i}, '{h}')" for i, h in enumerate(_FORM, 1)) + ") AS h(col, value))"
_FORM_WIDE = _WIDE.replace(_C, _FORM_SQL)


def _form_cells(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    own = [F.struct(F.lit(i).alias("col"), F.expr(v.replace("VARCHAR", "STRING")).alias("value")) for i, v in enumerate(_FORM.values(), 1)]
    head = [F.struct(F.lit(i).alias("col"), F.lit(h).alias("value")) for i, h in enumerate(_FORM, 1)]
    shape = lambda df: df.select(F.col("s_nationkey").cast("long").alias("doc_id"), F.lit(0).alias("sheet_index"), F.lit("Форма").alias("sheet_name"), "row", "c.col", "c.value", F.lit("string").alias("value_type"))
    rows = s.withColumn("row", (F.col("s_suppkey") + 3).cast("int")).withColumn("c", F.explode(F.array(*own))).filter("c.value is not null")
    heads = s.select("s_nationkey").distinct().withColumn("row", F.lit(3)).withColumn("c", F.explode(F.array(*head)))
    return shape(rows).unionByName(shape(heads))


@_query(f"{_FORM_WIDE} SELECT doc_id, row, row_kind, last_value(CASE WHEN row_kind = 'block' THEN field_name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row) AS block, coalesce(hidden, false) AS hidden FROM k")
def form_rows(spark, sf_dir):
    """Kinds and blocks of the rows of forms made of all suppliers."""
    return spec.rows(_form_cells(spark, sf_dir)).select("doc_id", "row", "row_kind", "block", F.col("hidden_evidence").isNotNull().alias("hidden"))


@_query(f"""{_FORM_WIDE} SELECT doc_id, row, field_name AS name, coalesce(type, '') AS type, CASE WHEN hidden AND {_req("required")} = 'required' THEN 'conditional' ELSE {_req("required")} END AS required,
  CASE WHEN default_value IS NULL THEN 'no_default' ELSE 'has_default' END AS default_status, 'D' || row AS source_cell, coalesce(hidden, false) AS hidden FROM k WHERE row_kind = 'parameter'""")
def form_parameters(spark, sf_dir):
    p = spec.parameters(_form_cells(spark, sf_dir))
    return p.select("doc_id", "row", "name", "type", F.col("required.status").alias("required"), F.col("default_value.status").alias("default_status"), "default_value.source_cell", "ui.hidden")


@_query(f"""{_FORM_WIDE} SELECT doc_id, CAST(1 AS BIGINT) AS total_sheets, coalesce(count_if(row_kind = 'parameter'), 0) AS total_parameters, coalesce(count_if(row_kind = 'parameter' AND {_req("required")} = 'required' AND NOT coalesce(hidden, false)), 0) AS required,
  coalesce(count_if(row_kind = 'parameter' AND ({_req("required")} = 'conditional' OR {_req("required")} = 'required' AND hidden)), 0) AS conditional_required, coalesce(count_if(row_kind = 'parameter' AND default_value IS NOT NULL), 0) AS with_default,
  coalesce(count_if(row_kind = 'parameter' AND default_value IS NULL), 0) AS without_default, CAST(0 AS BIGINT) AS default_needs_manual_check, coalesce(count_if(row_kind = 'parameter' AND hidden), 0) AS hidden_fields, coalesce(count_if(row_kind = 'ambiguous'), 0) AS ambiguous_cases
  FROM (SELECT DISTINCT doc_id FROM cells) LEFT JOIN k USING (doc_id) GROUP BY doc_id""")
def form_summary(spark, sf_dir):
    """The counters of each form; zeros for one that has a header and nothing below it."""
    return spec.summary(_form_cells(spark, sf_dir)).select("doc_id", *(F.col(c).cast("long") for c in ("total_sheets", "total_parameters", "required", "conditional_required", "with_default", "without_default", "default_needs_manual_check", "hidden_fields", "ambiguous_cases")))


#: The parameters of the forms with their block and how many values each is tried with.
_FORM_VALUES = f"""{_FORM_WIDE}, blocked AS (SELECT *, last_value(CASE WHEN row_kind = 'block' THEN field_name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row) AS block FROM k),
v AS (SELECT doc_id, block, row, field_name, required, hidden, CASE WHEN default_value IS NULL THEN 2 ELSE 3 END AS n, row_number() OVER (PARTITION BY doc_id, block ORDER BY row) - 1 AS i FROM blocked WHERE row_kind = 'parameter')"""


@_query(f"""{_FORM_VALUES}, g AS (SELECT doc_id, block, max(n) AS p, count(*) - 1 AS last FROM v GROUP BY ALL),
c AS (SELECT doc_id, block, p, a, b, d FROM g, range(3) AS x(a), range(3) AS y(b), range(40) AS z(d) WHERE a < p AND b < p AND (b = 0 AND d = 0 OR b > 0 AND p ** d <= last))
SELECT v.doc_id, v.block, CASE WHEN b = 0 THEN a ELSE p + (d * (p - 1) + b - 1) * p + a END AS "case", row, ['filled', 'empty', 'default'][CAST((a + b * (i // CAST(p ** d AS BIGINT) % p)) % p % n AS BIGINT) + 1] AS value
FROM v JOIN c ON v.doc_id = c.doc_id AND v.block IS NOT DISTINCT FROM c.block""")
def form_cases(spark, sf_dir):
    """Test cases for each block of forms made of all suppliers, in which all pairs of values meet."""
    return coverage.full_checklist(spec.parameters(_form_cells(spark, sf_dir))).select("doc_id", "block", F.col("case").cast("long"), "row", "value")


@_query(f"{_FORM_VALUES} SELECT doc_id, block, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS pairs FROM v GROUP BY doc_id, block HAVING count(*) > 1")
def form_pairs(spark, sf_dir):
    """How many pairs of values the cases of each block cover: by the SQL, all that there are."""
    cases = coverage.full_checklist(spec.parameters(_form_cells(spark, sf_dir))).withColumn("part", F.struct("doc_id", F.coalesce("block", F.lit("")).alias("block")))
    return coverage.covered_pairs(cases, "part", "row").select("part.doc_id", F.nullif("part.block", F.lit("")).alias("block"), "pairs")


@_query(f"""{_FORM_VALUES} SELECT doc_id, 'sheet0-row' || row AS id, 'positive' AS list, 'принято' AS expectation FROM v WHERE NOT coalesce(hidden, false)
UNION ALL SELECT doc_id, 'sheet0-row' || row, 'negative', CASE WHEN {_req("required")} = 'required' AND NOT coalesce(hidden, false) THEN 'ошибка' ELSE 'ошибка при выполнении условия' END FROM v WHERE {_req("required")} IN ('required', 'conditional')""")
def form_checks(spark, sf_dir):
    """Positive and negative lists over forms made of all suppliers."""
    params = stored(spec.parameters(_form_cells(spark, sf_dir)), "parameters")
    lists = [("positive", coverage.positive_checklist(params)), ("negative", coverage.negative_checklist(params))]
    one, two = (df.select("doc_id", "id", F.lit(name).alias("list"), "expectation") for name, df in lists)
    return one.unionByName(two)


@_query("""WITH p AS (SELECT o_orderkey, 'f' || (o_custkey % 300) AS stem, CASE o_custkey % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' ELSE 'docx' END AS ext, '/in/' || o_orderkey || '/f' || (o_custkey % 300) AS place FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY o_orderkey) AS nth FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY stem, ext, nth > 1 ORDER BY o_orderkey) AS again FROM n)
SELECT place || '.' || ext AS path, CASE WHEN nth = 1 THEN stem || '_anon' WHEN again = 1 THEN stem || '_' || ext || '_anon' ELSE stem || '_' || ext || '_anon_' || again END AS base FROM r""")
def order_names(spark, sf_dir):
    """Names of outputs for a file of each order, reserved over all of them."""
    ext = F.element_at(F.array(F.lit("txt"), F.lit("pdf"), F.lit("docx")), (F.col("o_custkey") % 3 + 1).cast("int"))
    path = F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"), F.lit("/f"), (F.col("o_custkey") % 300).cast("string"), F.lit("."), ext)
    return output_names(table(spark, sf_dir, "orders").select(path.alias("path"), F.col("o_orderkey").alias("doc_ord"))).select("path", "base")


# ---- dictionaries, names and addresses over whole tables

#: A number in Cyrillic letters, for names that the detectors know.
_LETTERED = "translate(CAST({} AS {}), '0123456789', 'абвгдежзик')"


def _lettered(column: str) -> Column:
    return F.translate(F.col(column).cast("string"), "0123456789", "абвгдежзик")


@_query("""WITH t AS (SELECT o_orderkey, 'Заказ ' || o_orderkey || ' для ' AS head, 'ООО ' || c_name AS one, '; плательщик ' AS mid, 'ооо ' || upper(c_name) AS two FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, 'ORG' AS type, one AS value, CAST(length(head) AS BIGINT) AS start_at FROM t UNION ALL SELECT o_orderkey, 'ORG', two, CAST(length(head || one || mid) AS BIGINT) FROM t""")
def order_organisations(spark, sf_dir):
    """A dictionary of an organisation for each customer, in a text for each order: every entry begins with the same word, and a third place is beside a letter."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    one = F.concat(F.lit("ООО "), "c_name")
    text = F.concat(F.lit("Заказ "), F.col("o_orderkey").cast("string"), F.lit(" для "), one, F.lit("; плательщик "), F.lower(F.lit("ООО ")), F.upper("c_name"), F.lit(", не "), one, F.lit("а"))
    texts = stored(table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", text.alias("text")), "texts")
    found = dictionary_spans(texts, customer.select(F.lit("ORG").alias("type"), one.alias("entry")), ["o_orderkey"])
    return found.select("o_orderkey", "type", "value", F.col("start").cast("long").alias("start_at"))


@_query("""WITH t AS (SELECT c_custkey, '§' || c_custkey || '§' AS one, 'тариф ' || upper(c_name) || '  +' || chr(9) || 'плюс, клиент ' AS mid, c_name FROM customer)
SELECT c_custkey, 'BANK' AS type, one AS value, CAST(5 AS BIGINT) AS start_at FROM t UNION ALL SELECT c_custkey, 'PRODUCT', upper(c_name) || ' + плюс', CAST(length('банк ' || one || ', тариф ') AS BIGINT) FROM t
UNION ALL SELECT c_custkey, 'ORG', '«' || c_custkey || '»', CAST(length('банк ' || one || ', ' || mid) AS BIGINT) FROM t""")
def customer_entries(spark, sf_dir):
    """Entries without letters, products with a plus sign and numbers in quotes, all detectors and a dictionary of any size together, overlaps resolved."""
    c, k = dealt(spark, sf_dir, "customer", "c_custkey", "c_name"), F.col("c_custkey").cast("string")
    entries = {"BANK": F.concat(F.lit("§"), k, F.lit("§")), "PRODUCT": F.concat("c_name", F.lit(" + Плюс")), "ORG": F.concat(F.lit("«"), k, F.lit("»"))}
    listed = c.select(F.explode(F.array(*(F.struct(F.lit(t).alias("type"), v.alias("entry")) for t, v in entries.items()))).alias("x")).select("x.*")
    text = F.concat(F.lit("банк §"), k, F.lit("§, тариф "), F.upper("c_name"), F.lit("  +\tплюс, клиент «"), k, F.lit("»"))
    spans = each_span(with_dictionary(c.select("c_custkey", text.alias("text")), listed, ["c_custkey"]).select("c_custkey", "spans"))
    return spans.select("c_custkey", "s.type", "s.value", F.col("s.start").cast("long").alias("start_at"))


@_query(f"""WITH t AS (SELECT o_orderkey, {_LETTERED.format("o_custkey", "VARCHAR")} AS x FROM orders), n AS (SELECT o_orderkey, 'Сид' || x || ' Олег Львович' AS one, 'Пет' || x || ' О.Л.' AS two FROM t)
SELECT o_orderkey, 'PERSON' AS type, one AS value, CAST(7 AS BIGINT) AS start_at FROM n UNION ALL SELECT o_orderkey, 'PERSON', two, CAST(length('Клиент ' || one || '; заявитель: ') AS BIGINT) FROM n""")
def order_persons(spark, sf_dir):
    """Full names and initials behind their key words, in a text for each order."""
    x = _lettered("o_custkey")
    text = F.concat(F.lit("Клиент Сид"), x, F.lit(" Олег Львович; заявитель: Пет"), x, F.lit(" О.Л. и далее"))
    spans = each_span(with_spans(stored(dealt(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", text.alias("text")), "texts")).select("o_orderkey", "spans"))
    return spans.select("o_orderkey", "s.type", "s.value", F.col("s.start").cast("long").alias("start_at"))


@_query(f"""WITH t AS (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '1') AS code, 'г. Тверь, ул. Мир' || {_LETTERED.format("o_custkey", "VARCHAR")} || ', д. ' || (o_custkey % 100) AS place FROM orders)
SELECT o_orderkey, 'ADDR' AS type, code AS value, CAST(7 AS BIGINT) AS start_at FROM t UNION ALL SELECT o_orderkey, 'ADDR', place, CAST(length('индекс ' || code || ': ') AS BIGINT) FROM t""")
def order_addresses(spark, sf_dir):
    """Postal indexes and addresses grown from their words, in a text for each order."""
    text = F.concat(F.lit("индекс "), F.lpad(F.col("o_custkey").cast("string"), 6, "1"), F.lit(": г. Тверь, ул. Мир"), _lettered("o_custkey"), F.lit(", д. "), (F.col("o_custkey") % 100).cast("string"), F.lit("; срок"))
    spans = each_span(with_spans(stored(dealt(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", text.alias("text")), "texts")).select("o_orderkey", "spans"))
    return spans.select("o_orderkey", "s.type", "s.value", F.col("s.start").cast("long").alias("start_at"))


@_query("""WITH c AS (SELECT c_nationkey, c_custkey, c_mktsegment AS value, ['ORG', 'PRODUCT', 'PRODUCT', 'INS', 'PERSON'][c_custkey % 5 + 1] AS type_guess, ['партнёр', 'программа', 'продукт', 'значения для выбора', 'пользователь'][c_custkey % 5 + 1] AS reason
FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_custkey % 10 <> 9) SELECT c_nationkey, value, type_guess, min_by(reason, c_custkey) AS reason, count(*) AS count FROM c GROUP BY c_nationkey, value, type_guess""")
def review_contexts(spark, sf_dir):
    """All five contexts over a text for each customer, with a list of values to ignore; a value within an entity's place is no candidate."""
    c = dealt(spark, sf_dir, "customer", "c_nationkey", "c_custkey", "c_mktsegment")
    v = F.col("c_mktsegment")
    texts = [
        F.concat(F.lit("для партнёра «"), v, F.lit("» и")), F.concat(F.lit("по программе "), v, F.lit(" для")), F.concat(F.lit("по продукту "), v, F.lit(": срок")), F.concat(F.lit("Для выбора: "), v, F.lit(";")),
        F.when(F.col("c_custkey") % 10 == 9, F.concat(F.lit("пользователь «C"), F.col("c_custkey").cast("string"), F.lit("@mail.example» не"))).otherwise(F.concat(F.lit("пользователь «"), v, F.lit("» не"))),
    ]
    text = F.coalesce(*(F.when(F.col("c_custkey") % 5 == i, t) for i, t in enumerate(texts)))
    ignore = review.add_ignored(c.select(F.lower(v).alias("value_lower")).filter("value_lower = 'nothing'"), ["Machinery "])
    found = review.candidates(c.select("c_nationkey", "c_custkey", text.alias("text")), ["c_nationkey", "c_custkey"], ignore)
    return review.grouped(found, ["c_nationkey"], ["c_custkey"], F.col("c_custkey").cast("string")).select("c_nationkey", "value", "type_guess", "reason", "count")


@_query("""WITH l AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS line, l_returnflag AS flag, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) * 4 AS s, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) * 4 + 1 + CAST(l_quantity AS INTEGER) % 30 AS e FROM lineitem)
SELECT DISTINCT l_suppkey, line, CAST(s AS INTEGER) AS start_at, CAST(e AS INTEGER) AS end_at FROM l WHERE flag = 'N' AND NOT EXISTS (SELECT 1 FROM l r WHERE r.flag = 'R' AND r.l_suppkey = l.l_suppkey AND l.s < r.e AND l.e > r.s)""")
def lines_apart(spark, sf_dir):
    """Lines on their way while none that came back was, of the same supplier: candidates whose place no span overlaps."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")) * 4
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_returnflag", day("l_shipdate").alias("start"), (day("l_shipdate") + 1 + F.col("l_quantity").cast("int") % 30).alias("end"))  # noqa: E741
    rows, spans = l.filter("l_returnflag = 'N'").drop("l_returnflag").distinct(), l.filter("l_returnflag = 'R'")
    rows = rows.withColumn("row", F.struct("l_suppkey", "line", "start", "end"))
    return rows.join(meeting(rows, spans, ["l_suppkey"], "row"), "row", "left_anti").select("l_suppkey", "line", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def cases() -> dict[str, tuple[Query, str | None]]:
    """Queries over small made-up tables, with their SQL: shapes that the given tables do not hold."""
    return {name: (f, _CASES_SQL.get(name)) for name, f in _CASES.items()}
