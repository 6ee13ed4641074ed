"""Queries on the project's tables for the general data problems 1, 2, 4 and 6, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import diff_copies
from ..operators.masks import changes, load_metrics, mask_table, mask_violations, profile
from ..operators.orphans import find_orphans, orphan_counts
from ..operators.packed import unpack
from ..sources.tables import table
from .sqltext import clean_sql, strip_sql

MIRRORED = ["titulo_original", "cultura", "url_imagen"]
PROFILED = ["description", "technique", "provenance", "license"]
CMA_PACKED = ["terminos_andinos_recuperados", "terminos_textiles_recuperados", "consultas_origen_recuperadas"]


def _packed(spark: SparkSession, d: str) -> list:
    return [
        ("paper_corpus", table(spark, d, "paper_corpus"), "row_id", ["material_original"]),
        ("cma_principal_enriched_v1", table(spark, d, "cma_principal_enriched_v1"), "row_id", CMA_PACKED),
    ]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack(_packed(spark, d))


def p1_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """Fields, and values over all their positions, by table and field."""
    return unpack(_packed(spark, d), 1).groupBy("src_table", "field_name").agg(F.count(F.when(F.col("pos") == 1, 1)).alias("fields"), F.count(F.lit(1)).alias("values"), F.max("pos").alias("most_values"))


# Texts in which nothing but semicolons can separate and nothing protects them.
_SIMPLE = r'^[^"\x27\[\]{}()0-9,/|·•、；，\n\r\t\\]*;[^"\x27\[\]{}()0-9,/|·•、；，\n\r\t\\]*$'


def p1_simple_lists(spark: SparkSession, d: str) -> DataFrame:
    """What p1_found says of the texts whose reading SQL can tell too: lists with semicolons only."""
    simple = table(spark, d, "paper_corpus").filter(F.col("material_original").rlike(_SIMPLE)).select("row_id")
    return p1_found(spark, d).filter("src_table = 'paper_corpus'").join(simple, "row_id", "left_semi").select("row_id", "pos", "value_text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return diff_copies(table(spark, d, "met_principal_enriched_v1"), table(spark, d, "met_principal_enriched_v1_mirror"), "id_fuente", MIRRORED)


def p2_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("diff").agg(F.count(F.lit(1)).alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changes(load_metrics(mask_table(table(spark, d, "paper_corpus"), PROFILED)), not_novel=("description",))


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile(table(spark, d, "paper_corpus"), PROFILED)


def p4_mask_violations(spark: SparkSession, d: str) -> DataFrame:
    return mask_violations(mask_table(table(spark, d, "paper_corpus"), PROFILED, keep=True))


def _links(spark: SparkSession, d: str) -> list:
    return [
        ("met_principal_enriched_v1", table(spark, d, "met_principal_enriched_v1"), "id_fuente", "met_inventario_base", table(spark, d, "met_inventario_base"), "id_objeto"),
        ("cma_principal_enriched_v1", table(spark, d, "cma_principal_enriched_v1"), "id_objeto", "cma_andes_textiles_candidates", table(spark, d, "cma_andes_textiles_candidates"), "source_id"),
    ]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_orphans(_links(spark, d))


def p6_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(p6_found(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_value_counts, p1_simple_lists, p2_found, p2_diff_counts, p4_found, p4_profile, p4_mask_violations, p6_found, p6_orphan_counts)}


def _p2_sql() -> str:
    side = lambda t: f"SELECT {clean_sql('id_fuente')} AS id_fuente, " + ", ".join(f"max({clean_sql(f)}) AS {f}" for f in MIRRORED) + f" FROM {t} GROUP BY 1"
    fields = " UNION ALL ".join(f"SELECT a.id_fuente, '{f}' AS diff FROM a JOIN b USING (id_fuente) WHERE a.{f} <> b.{f}" for f in MIRRORED)
    return f"""WITH a AS (SELECT * FROM ({side("met_principal_enriched_v1")}) WHERE id_fuente <> ''), b AS (SELECT * FROM ({side("met_principal_enriched_v1_mirror")}) WHERE id_fuente <> '')
        SELECT id_fuente, 'only_main' AS diff FROM a ANTI JOIN b USING (id_fuente) UNION ALL
        SELECT id_fuente, 'only_mirror' AS diff FROM b ANTI JOIN a USING (id_fuente) UNION ALL {fields}"""


def _long_sql() -> str:
    return " UNION ALL ".join(f"SELECT load_id, '{f}' AS field_name, {clean_sql(f)} AS value FROM paper_corpus WHERE load_id IS NOT NULL" for f in PROFILED)


def _p4_sql() -> str:
    return f"""WITH long AS ({_long_sql()}), f AS (SELECT field_name, value, min(load_id) AS first_load FROM long WHERE value <> '' GROUP BY 1, 2),
        m AS (SELECT field_name, load_id, count(*) AS n, count(CASE WHEN value = '' THEN 1 END) AS missing, count(CASE WHEN value <> '' THEN 1 END) AS present,
              sum(length(value)) / nullif(count(CASE WHEN value <> '' THEN 1 END), 0) AS mean, count(CASE WHEN first_load = load_id THEN 1 END) AS novel
              FROM long LEFT JOIN f USING (field_name, value) GROUP BY 1, 2),
        x AS (SELECT *, lag(load_id) OVER w AS lb, lag(missing / n) OVER w AS rb, lag(mean) OVER w AS mb FROM m WINDOW w AS (PARTITION BY field_name ORDER BY load_id))
        SELECT load_id, field_name, 'missing' AS kind FROM x WHERE lb IS NOT NULL AND abs(missing / n - rb) >= 0.15 UNION ALL
        SELECT load_id, field_name, 'length' AS kind FROM x WHERE lb IS NOT NULL AND (mean >= 1.4 * mb OR mb >= 1.4 * mean) UNION ALL
        SELECT load_id, field_name, 'novel' AS kind FROM x WHERE lb IS NOT NULL AND field_name <> 'description' AND present > 0 AND novel >= 0.25 * present"""


def _masks_sql() -> str:
    """CTEs long (with mask) and by_mask (per field, load and mask)."""
    m = r"regexp_replace(regexp_replace(regexp_replace(value, '[\p{Ll}\p{Lo}\p{Lm}\p{M}]+', 'a', 'g'), '[\p{Lu}\p{Lt}]+', 'A', 'g'), '\p{N}+', '9', 'g')"
    return f"""raw AS ({_long_sql()}), shaped AS (SELECT *, {m} AS m FROM raw),
        long AS (SELECT *, CASE WHEN length(value) <= 80 THEN m ELSE array_to_string(list_sort(list_distinct(string_split(m, ''))), '') END AS mask FROM shaped),
        by_mask AS (SELECT field_name, load_id, mask, count(*) AS n FROM long WHERE mask <> '' GROUP BY 1, 2, 3),
        f AS (SELECT field_name, sum(n) AS field_n FROM by_mask GROUP BY 1), fm AS (SELECT field_name, mask, sum(n)::BIGINT AS mask_n FROM by_mask GROUP BY 1, 2)"""


def _violations_sql() -> str:
    return f"WITH {_masks_sql()} SELECT load_id, field_name, mask, n, mask_n FROM by_mask JOIN fm USING (field_name, mask) JOIN f USING (field_name) WHERE mask_n < 0.001 * field_n"


def _profile_sql() -> str:
    h = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / (p + q)) ELSE 0 END"
    return f"""WITH {_masks_sql()}, first AS (SELECT field_name, value, min(load_id) AS first_load FROM long WHERE value <> '' GROUP BY 1, 2),
        t AS (SELECT field_name, load_id, sum(n) AS total, lead(load_id) OVER (PARTITION BY field_name ORDER BY load_id) AS next_load FROM by_mask GROUP BY 1, 2),
        pq AS (SELECT field_name, own_load, mask, sum(p) AS p, sum(q) AS q FROM (SELECT field_name, load_id AS own_load, mask, n / total AS p, 0 AS q FROM by_mask JOIN t USING (field_name, load_id)
            UNION ALL SELECT field_name, next_load, mask, 0, n / total FROM by_mask JOIN t USING (field_name, load_id) WHERE next_load IS NOT NULL) GROUP BY 1, 2, 3),
        js AS (SELECT field_name, own_load AS load_id, CASE WHEN sum(q) > 0 THEN round(sum(0.5 * ({h("p")}) + 0.5 * ({h("q")})), 9) END AS mask_divergence FROM pq GROUP BY 1, 2),
        d AS (SELECT field_name, load_id, count(CASE WHEN mask_n >= 0.01 * field_n THEN 1 END) AS dominant_masks, coalesce(sum(CASE WHEN mask_n < 0.001 * field_n THEN n END), 0)::BIGINT AS violations
            FROM by_mask JOIN fm USING (field_name, mask) JOIN f USING (field_name) GROUP BY 1, 2),
        g AS (SELECT load_id, field_name, count(*) AS rows_total, count(CASE WHEN value = '' THEN 1 END) AS missing, count(DISTINCT nullif(value, '')) AS distinct_values,
            min(length(nullif(value, ''))) AS chars_min, max(length(nullif(value, ''))) AS chars_max, coalesce(sum(length(value)), 0)::BIGINT AS chars_sum, min(nullif(value, '')) AS value_min,
            max(nullif(value, '')) AS value_max, count(CASE WHEN first_load = load_id THEN 1 END) AS novel_rows FROM long LEFT JOIN first USING (field_name, value) GROUP BY 1, 2)
        SELECT load_id, field_name, rows_total, missing, missing / rows_total AS missing_rate, distinct_values, chars_min, chars_max, chars_sum, value_min, value_max, novel_rows,
            coalesce(dominant_masks, 0) AS dominant_masks, coalesce(violations, 0) AS violations, mask_divergence FROM g LEFT JOIN d USING (field_name, load_id) LEFT JOIN js USING (field_name, load_id)"""


def _p6_sql() -> str:
    links = [("met_principal_enriched_v1", "id_fuente", "met_inventario_base", "id_objeto"), ("cma_principal_enriched_v1", "id_objeto", "cma_andes_textiles_candidates", "source_id")]
    parts = []
    for i, (src, ck, dst, pk) in enumerate(links):
        parts.append(f"""SELECT '{src}' AS src_table, c.row_id, strftime(c.t, '%Y-%m') AS period,
            CASE WHEN count(p.key) = 0 THEN 'missing' WHEN count(CASE WHEN p.t <= c.t THEN 1 END) > 0 THEN 'deleted' ELSE 'late' END AS kind
            FROM (SELECT row_id, loaded_at AS t, {clean_sql(ck)} AS key FROM {src}) c LEFT JOIN (SELECT loaded_at AS t, deleted_at AS e, {clean_sql(pk)} AS key FROM {dst}) p ON c.key = p.key
            WHERE c.key <> '' GROUP BY c.row_id, c.t HAVING count(CASE WHEN p.t <= c.t AND (p.e IS NULL OR p.e > c.t) THEN 1 END) = 0""")
    return " UNION ALL ".join(parts)


_P1_SIMPLE_SQL = f"""WITH s AS (SELECT row_id, list_filter(list_transform(string_split(material_original, ';'), lambda x: {strip_sql("x")}), lambda x: x <> '') AS vs
    FROM paper_corpus WHERE regexp_matches(material_original, '{_SIMPLE}')), p AS (SELECT row_id, vs, unnest(range(1, len(vs) + 1))::INTEGER AS pos FROM s WHERE len(vs) >= 2)
    SELECT row_id, pos, vs[pos] AS value_text FROM p"""

SQL = {
    "p1_simple_lists": _P1_SIMPLE_SQL,
    "p2_found": _p2_sql(),
    "p2_diff_counts": f"SELECT diff, count(*) AS n FROM ({_p2_sql()}) GROUP BY 1",
    "p4_found": _p4_sql(),
    "p4_profile": _profile_sql(),
    "p4_mask_violations": _violations_sql(),
    "p6_found": _p6_sql(),
    "p6_orphan_counts": f"SELECT src_table, period, kind, count(*) AS n FROM ({_p6_sql()}) GROUP BY 1, 2, 3",
}
