"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_dedup
from .html_text import extract
from .katz import katz_scores
from .license_scan import license_scan
from .minhash import fingerprint_report
from .packing import packed
from .pieces import encode
from .pii import pii_report
from .quality import classify
from .resampling import resample
from .simhash import simhash_groups
from .toxicity import toxicity
from .vector_codes import ENTRIES, PARTS, ROUNDS, vector_codes


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scan, op2_best_fit_packing, op3_simhash_near_dedup, op4_document_fingerprints, op5_pii, op6_html_extraction, op7_katz_backoff, op8_quality_classifier, op9_exact_dedup, op10_sentencepiece,
        op11_vector_codes, op12_importance_resampling, op13_toxicity,
    )
    return {f.__name__: f for f in found}


def _vector_codes_sql() -> str:
    """Every round compares all parts with all entries, component by component."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
            near{k} AS MATERIALIZED (
                SELECT r, part, min({{'d': d, 'entry': entry}}) AS best FROM (
                    SELECT x.r, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN book{k} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL)
                GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
            book{k + 1} AS MATERIALIZED (
                SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
                    SELECT x.part, n.best.entry AS entry, x.pos, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM x JOIN near{k} n ON x.r = n.r AND x.part = n.part GROUP BY ALL) m
                ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)""")
    last = f"near{ROUNDS}"
    return f"""
            WITH kept AS MATERIALIZED (
                SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, embedding FROM embeddings
                WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
            x AS MATERIALIZED (
                SELECT r, (i // (n // {PARTS})) AS part, (i % (n // {PARTS})) AS pos, CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) AS v
                FROM (SELECT r, len(embedding) AS n, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM kept)),
            book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, v FROM x WHERE r <= {ENTRIES}),{",".join(steps)},
            codes AS (
                SELECT k.vec_id, k.label, string_agg(printf('%02x', n.best.entry), '' ORDER BY n.part) AS code, CAST(sum(n.best.d) AS BIGINT) AS error
                FROM kept k JOIN {last} n ON k.r = n.r GROUP BY k.r, k.vec_id, k.label)
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
                (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
            FROM codes"""


#: CRC-32 byte by byte: the table of its 256 remainders by the reflected polynomial, then a fold over a word's bytes.
_RESAMPLING_SQL = r"""
            WITH crcs AS MATERIALIZED (
                SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
            docs AS MATERIALIZED (
                SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
            source AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM docs) GROUP BY ALL),
            target AS MATERIALIZED (
                SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL),
            vocabulary AS MATERIALIZED (
                SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda i: CAST(('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INT), 2)) AS BIGINT))),
                    lambda c, b: xor(c >> 8, crcs.t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
                FROM (SELECT w FROM source UNION SELECT w FROM target), crcs),
            s AS (SELECT bucket, sum(n) AS n FROM source JOIN vocabulary USING (w) GROUP BY ALL),
            t AS (SELECT bucket, sum(n) AS n FROM target JOIN vocabulary USING (w) GROUP BY ALL),
            totals AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS s_all, CAST(coalesce((SELECT sum(n) FROM t), 0) AS DOUBLE) AS t_all),
            gains AS MATERIALIZED (
                SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((s.n + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain
                FROM s LEFT JOIN t USING (bucket), totals),
            weights AS (SELECT r, sum(n * gain) AS weight FROM source JOIN vocabulary USING (w) JOIN gains USING (bucket) GROUP BY r),
            scores AS (
                SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
                FROM docs LEFT JOIN weights USING (r)),
            places AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scores)
            SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM scores WHERE n_features >= 20) THEN place END AS rank FROM places"""


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": """
            WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
            g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
            SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
            FROM t JOIN g ON t.norm = g.norm""",
        "op11_vector_codes": _vector_codes_sql(),
        "op12_importance_resampling": _RESAMPLING_SQL,
    }
