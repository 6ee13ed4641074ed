"""Queries for the curation operators on the project's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..functions.text import clean, coalesce_non_empty, first_non_empty, iso_timestamp_valid, item_id, strip
from ..operators import checks, keys, profiles
from ..operators.checks import Expectations, completeness, corpus_metrics
from ..operators.contract import Contract, violations
from ..operators.mapping import mapping_sql, prefixed
from ..sources.csv import csv_strings, csv_with_fallback
from ..sources.sinks import as_text, write_csv_parts
from ..sources.tables import table
from .museums import CMA, COMPLETE, COVERED, MAPPINGS, MET, REQUIRED, BuildInfo, SourceSpec
from .pipeline import adapt, build_corpus, enrich, unite
from .sqltext import clean_sql, first_non_empty_sql, strip_sql

INFO = BuildInfo("2026-01-31T00:00:00Z")
LATEST = ["loaded_at", "row_id"]
# Fields of the profiles.
PROFILED = ["id_fuente", "titulo_original", "titulo_es_sugerido", "cultura", "fecha_objeto", "procedencia", "tipo_objeto", "tipo_superficie", "material", "material_normalizado", "tecnica", "url_objeto", "url_imagen", "campo_ausente"]
PROFILED_CMA = ["id_objeto", "numero_acceso", "titulo_original", "cultura", "periodo", "clasificacion_original", "nombre_objeto_original", "tecnica_original", "material_original", "descripcion_original", "url_objeto", "url_imagen", "tipo_objeto_manual", "cultura_manual", "periodo_manual", "notas_iconograficas", "notas_tecnicas", "iiif"]
RECOVERED = {
    "MET": ["titulo_original", "titulo_es_sugerido", "cultura", "fecha_objeto", "tipo_objeto", "material", "tecnica", "clasificacion_original_recuperada", "clasificacion_normalizada_recuperada", "pais_recuperado", "region_recuperada"],
    "CMA": ["numero_acceso", "titulo_original", "cultura", "periodo", "clasificacion_original", "tecnica_original", "material_original", "descripcion_original", "departamento_recuperado", "licencia_recuperada"],
}
EXPECTED = Expectations(0, 42, group_counts={}, complete=COMPLETE, single_values={"dataset_split": "principal", "review_status": "aprobado"}, timestamp=INFO.timestamp)
URLS = "^https?://"
CONTRACT = Contract(
    fields=tuple(MAPPINGS["MET"](INFO)), required=REQUIRED, unique=(("item_id",), ("museum", "source_object_id")), allowed={"museum": ("MET", "CMA"), "dataset_split": ("principal",)},
    patterns={"image_url": URLS, "object_url": URLS, "source_commit": "^[0-9a-f]{40}$"},
)


def _reviewed(spark: SparkSession, d: str, s: SourceSpec) -> DataFrame:
    """The last delivery of each reviewed object, as the reviewer left it."""
    return keys.latest_by_key(table(spark, d, s.reviewed_table).select(*s.reviewed_fields, *LATEST), s.reviewed_key, LATEST).select(*s.reviewed_fields)


def _enrichment(spark: SparkSession, d: str, s: SourceSpec) -> DataFrame:
    return keys.latest_by_key(table(spark, d, s.enrichment_table).select(s.enrichment_key, *s.enrichment_fields, *LATEST), s.enrichment_key, LATEST).drop(*LATEST)


def _enriched(spark: SparkSession, d: str, s: SourceSpec) -> DataFrame:
    # latest_by_key makes both keys unique, so the check would only count again
    return enrich(s, _reviewed(spark, d, s), _enrichment(spark, d, s), check=False)


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return unite([adapt(s, _enriched(spark, d, s), INFO) for s in (MET, CMA)])


def _latest_sql(t: str, key: str, cols: tuple[str, ...]) -> str:
    return f"SELECT {', '.join(cols)} FROM {t} WHERE {clean_sql(key)} <> '' QUALIFY row_number() OVER (PARTITION BY {clean_sql(key)} ORDER BY loaded_at DESC, row_id DESC) = 1"


def _ctes(s: SourceSpec) -> str:
    m = s.museum.lower()
    fills = {c: f"coalesce(nullif({clean_sql('r.' + c)}, ''), {clean_sql('e.' + d)})" for c, d in s.coalesced.items()}
    kept = [f"{fills[c]} AS {c}" if c in fills else f"r.{c} AS {c}" for c in s.reviewed_fields]
    new = [f"{clean_sql('e.' + d)} AS {c}" for c, d in s.recovered.items()]
    return f"""{m}_r AS ({_latest_sql(s.reviewed_table, s.reviewed_key, s.reviewed_fields)}), {m}_e AS ({_latest_sql(s.enrichment_table, s.enrichment_key, (s.enrichment_key, *s.enrichment_fields))}),
        {m}_x AS (SELECT {", ".join(kept + new)}, '{s.recovery_source}' AS metadata_recovery_source, '{s.recovery_version}' AS metadata_recovery_version
        FROM {m}_r r LEFT JOIN {m}_e e ON {clean_sql("r." + s.reviewed_key)} = {clean_sql("e." + s.enrichment_key)})"""


def _adapted_sql(s: SourceSpec) -> str:
    return f"WITH {_ctes(s)} {mapping_sql(MAPPINGS[s.museum](INFO), s.museum.lower() + '_x')}"


_CORPUS = f"corpus AS (SELECT * FROM ({_adapted_sql(MET)}) UNION ALL SELECT * FROM ({_adapted_sql(CMA)}))"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str = ""):
    def add(f):
        QUERIES[name or f.__name__] = f
        SQL[name or f.__name__] = sql
        return f

    return add


# ---- text

_CLEANED = ["culture", "material", "technique", "title"]


@query("SELECT row_id, " + ", ".join(f"{clean_sql(c)} AS {c}" for c in _CLEANED) + " FROM paper_corpus")
def clean_text(spark, d):
    return table(spark, d, "paper_corpus").select("row_id", *[clean(c).alias(c) for c in _CLEANED])


@query(f"SELECT row_id, {clean_sql('id_fuente')} AS key FROM met_principal_enriched_v1")
def normalize_key(spark, d):
    return table(spark, d, "met_principal_enriched_v1").select("row_id", clean("id_fuente").alias("key"))


@query(f"SELECT row_id, {strip_sql('id_fuente')} AS key FROM met_principal_enriched_v1")
def normalize_key_strip(spark, d):
    return table(spark, d, "met_principal_enriched_v1").select("row_id", strip("id_fuente").alias("key"))


@query(f"SELECT row_id, {first_non_empty_sql('culture', 'culture_original')} AS culture FROM paper_corpus", "coalesce_non_empty")
def coalesce_columns(spark, d):
    return table(spark, d, "paper_corpus").select("row_id", coalesce_non_empty("culture", "culture_original").alias("culture"))


@query(f"SELECT row_id, {first_non_empty_sql('material', 'technique', 'object_type')} AS value FROM paper_corpus", "first_non_empty")
def first_value(spark, d):
    return table(spark, d, "paper_corpus").select("row_id", first_non_empty("material", "technique", "object_type").alias("value"))


@query(f"SELECT row_id, CASE WHEN {clean_sql('id_fuente')} = '' THEN '' ELSE 'MET:' || {clean_sql('id_fuente')} END AS item_id FROM met_principal_enriched_v1")
def build_item_id(spark, d):
    return table(spark, d, "met_principal_enriched_v1").select("row_id", item_id("MET", "id_fuente", "blank").alias("item_id"))


@query(
    r"""SELECT row_id, coalesce(regexp_matches(coalesce(processing_timestamp, ''), '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$')
        AND try_cast(regexp_replace(processing_timestamp, 'Z$', '+00:00') AS TIMESTAMPTZ) IS NOT NULL, false) AS valid FROM paper_corpus""",
    "iso_timestamp_valid",
)
def iso_timestamps(spark, d):
    return table(spark, d, "paper_corpus").select("row_id", F.coalesce(iso_timestamp_valid("processing_timestamp"), F.lit(False)).alias("valid"))


@query(f"SELECT row_id, {strip_sql('title')} AS title FROM paper_corpus WHERE {strip_sql('title')} <> ''")
def filter_non_empty(spark, d):
    return table(spark, d, "paper_corpus").select("row_id", strip("title").alias("title")).filter(F.col("title") != "")


# ---- projections and joins


@query("SELECT id_objeto, " + ", ".join(f"{f} AS inventory_{f}" for f in MET.enrichment_fields) + " FROM met_inventario_base")
def project_prefix_rename(spark, d):
    return prefixed(table(spark, d, "met_inventario_base"), ["id_objeto", *MET.enrichment_fields], "inventory_", "id_objeto")


@query(
    f"WITH {_ctes(MET)} SELECT {clean_sql('r.id_fuente')} AS _join_key, e.pais AS inventory_pais, e.region AS inventory_region, CASE WHEN e.id_objeto IS NULL THEN 'left_only' ELSE 'both' END AS _merge_status FROM met_r r LEFT JOIN met_e e ON {clean_sql('r.id_fuente')} = {clean_sql('e.id_objeto')}"
)
def enrich_left_join(spark, d):
    j = keys.checked_left_join(_reviewed(spark, d, MET), _enrichment(spark, d, MET), "id_fuente", "id_objeto", "inventory_", ["pais", "region"])
    return j.select("_join_key", "inventory_pais", "inventory_region", "_merge_status")


@query(f"WITH {_ctes(MET)} SELECT * FROM met_x")
def enrich_coalesce(spark, d):
    return _enriched(spark, d, MET)


@query(f"WITH {_ctes(CMA)} SELECT * FROM cma_x")
def enrich_coalesce_b(spark, d):
    return _enriched(spark, d, CMA)


@query(f"SELECT row_id, '{MET.recovery_source}' AS metadata_recovery_source, '{MET.recovery_version}' AS metadata_recovery_version FROM met_principal_enriched_v1")
def lineage_columns(spark, d):
    return table(spark, d, "met_principal_enriched_v1").select("row_id", F.lit(MET.recovery_source).alias("metadata_recovery_source"), F.lit(MET.recovery_version).alias("metadata_recovery_version"))


@query(f"WITH {_ctes(MET)} SELECT {clean_sql('r.id_fuente')} AS _join_key FROM met_r r ANTI JOIN met_e e ON {clean_sql('r.id_fuente')} = {clean_sql('e.id_objeto')}")
def join_unmatched(spark, d):
    j = keys.checked_left_join(_reviewed(spark, d, MET), _enrichment(spark, d, MET), "id_fuente", "id_objeto", "inventory_", ["pais"], check=False)
    return j.filter(F.col("_merge_status") != "both").select("_join_key")


_L, _R = f"SELECT {strip_sql('id_fuente')} AS key FROM met_principal_enriched_v1 WHERE {strip_sql('id_fuente')} <> ''", f"SELECT {strip_sql('id_objeto')} AS key FROM met_inventario_base WHERE {strip_sql('id_objeto')} <> ''"


def _pair(spark, d, s: SourceSpec = MET):
    return table(spark, d, s.reviewed_table), table(spark, d, s.enrichment_table), s.reviewed_key, s.enrichment_key


@query(f"{_L} INTERSECT {_R}")
def join_matched_keys(spark, d):
    return keys.matched_keys(*_pair(spark, d))


@query(f"{_L} EXCEPT {_R}")
def join_missing_keys(spark, d):
    return keys.missing_keys(*_pair(spark, d))


@query(f"{_R} EXCEPT {_L}")
def join_unused_keys(spark, d):
    l, r, lk, rk = _pair(spark, d)
    return keys.missing_keys(r, l, rk, lk)


@query(f"SELECT key FROM ({_L} EXCEPT {_R}) ORDER BY key LIMIT 25")
def missing_keys_top25(spark, d):
    return keys.first_missing_keys(*_pair(spark, d))


def _audit_sql(s: SourceSpec) -> str:
    return f"""SELECT '{s.museum}' AS museum, metric, value, ordinal FROM (WITH l AS (SELECT {strip_sql(s.reviewed_key)} AS k FROM {s.reviewed_table}), r AS (SELECT {strip_sql(s.enrichment_key)} AS k FROM {s.enrichment_table}),
        ld AS (SELECT DISTINCT k FROM l WHERE k <> ''), rd AS (SELECT DISTINCT k FROM r WHERE k <> ''),
        v AS (SELECT (SELECT count(*) FROM l) a, (SELECT count(*) FROM r) b, (SELECT count(*) FROM l WHERE k = '') c, (SELECT count(*) FROM r WHERE k = '') e, (SELECT count(*) FROM ld) f, (SELECT count(*) FROM rd) g, (SELECT count(*) FROM ld SEMI JOIN rd USING (k)) h)
        """ + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, ({x})::DOUBLE AS value, {i}::INTEGER AS ordinal FROM v"
        for i, (m, x) in enumerate(zip(keys.AUDIT_METRICS, ("a", "b", "c", "e", "a - c - f", "b - e - g", "h", "f - h", "CASE WHEN a > 0 THEN h / a ELSE 0 END", "g - h")))
    ) + ")"


@query(f"{_audit_sql(MET)} UNION ALL {_audit_sql(CMA)}")
def join_audit(spark, d):
    one = lambda s: keys.join_audit(s.museum, *_pair(spark, d, s))
    return one(MET).unionByName(one(CMA))


# ---- aggregates and profiles


@query(f"WITH {_CORPUS} SELECT " + ", ".join(f"count(CASE WHEN {strip_sql(c)} = '' THEN 1 END) AS {c}" for c in COMPLETE) + " FROM corpus")
def completeness_check(spark, d):
    return completeness(_corpus(spark, d), list(COMPLETE))


@query("SELECT museum, count(*) AS n FROM paper_corpus WHERE museum IS NOT NULL GROUP BY 1")
def group_counts(spark, d):
    return profiles.group_counts(table(spark, d, "paper_corpus"), "museum")


@query("SELECT culture AS value, count(*) AS n FROM paper_corpus GROUP BY 1 ORDER BY n DESC, culture NULLS FIRST LIMIT 20")
def top_values(spark, d):
    return profiles.top_values(table(spark, d, "paper_corpus"), "culture")


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang NULLS FIRST LIMIT 15")
def top_languages(spark, d):
    return profiles.top_values(table(spark, d, "documents"), "lang", 15)


def _unique_sql(t: str, k: str) -> str:
    c = clean_sql(k)
    return f"SELECT count(*) AS rows, count(CASE WHEN {c} = '' THEN 1 END) AS empty_keys, count(CASE WHEN {c} <> '' THEN 1 END) - count(DISTINCT nullif({c}, '')) AS duplicate_keys FROM {t}"


@query(_unique_sql("documents", "text"))
def duplicate_key_count(spark, d):
    return keys.unique_key_metrics(table(spark, d, "documents"), "text")


@query(_unique_sql("paper_corpus", "item_id"))
def validate_unique_key(spark, d):
    return keys.unique_key_metrics(table(spark, d, "paper_corpus"), "item_id")


@query("SELECT row_id, museum, source_object_id FROM paper_corpus QUALIFY count(*) OVER (PARTITION BY museum, source_object_id) > 1")
def duplicate_rows_all(spark, d):
    return keys.duplicate_rows(table(spark, d, "paper_corpus").select("row_id", "museum", "source_object_id"), ["museum", "source_object_id"])


def _profile_sql(t: str, label: str, fields: list[str], absent: tuple[str, ...] = (), available: bool = True, distinct: bool = True) -> str:
    def one(i: int, f: str) -> str:
        v = "''" if f in absent else strip_sql(f)
        a = f"{'false' if f in absent else 'true'} AS available, " * available
        u = f", count(DISTINCT nullif({v}, '')) AS unique_non_empty" * distinct
        n = f"count(CASE WHEN {v} <> '' THEN 1 END)"
        return f"SELECT '{label}' AS museum, '{f}' AS field, {a}{n} AS non_empty, count(*) AS total, CASE WHEN count(*) > 0 THEN {n} / count(*) ELSE 0.0 END AS coverage{u}, {i}::INTEGER AS ordinal FROM {t}"

    return " UNION ALL ".join(one(i, f) for i, f in enumerate(fields))


@query(_profile_sql("met_principal_enriched_v1", "MET", PROFILED, ("campo_ausente",)))
def profile_columns(spark, d):
    return profiles.profile_columns(table(spark, d, "met_principal_enriched_v1"), PROFILED, "MET")


@query(_profile_sql("cma_principal_enriched_v1", "CMA", PROFILED_CMA, ("iiif",)))
def profile_columns_b(spark, d):
    return profiles.profile_columns(table(spark, d, "cma_principal_enriched_v1"), PROFILED_CMA, "CMA")


@query(" UNION ALL ".join(_profile_sql(s.reviewed_table, s.museum, RECOVERED[s.museum], available=False) for s in (MET, CMA)))
def profile_recovered(spark, d):
    one = lambda s: profiles.profile_columns(table(spark, d, s.reviewed_table), RECOVERED[s.museum], s.museum, with_available=False)
    return one(MET).unionByName(one(CMA))


@query(
    "WITH g AS (SELECT museum AS grp, * EXCLUDE (museum) FROM paper_corpus UNION ALL SELECT 'ALL' AS grp, * EXCLUDE (museum) FROM paper_corpus) "
    + " UNION ALL ".join(f"SELECT grp AS museum, '{f}' AS field, count(CASE WHEN {strip_sql(f)} <> '' THEN 1 END) AS non_empty, count(*) AS total, count(CASE WHEN {strip_sql(f)} <> '' THEN 1 END) / count(*) AS coverage FROM g GROUP BY grp" for f in COVERED)
)
def coverage_by_group(spark, d):
    return profiles.coverage_by_group(table(spark, d, "paper_corpus"), "museum", list(COVERED))


@query(_profile_sql("met_inventario_base", "MET", ["id_objeto", *MET.enrichment_fields], available=False, distinct=False))
def coverage_all_columns(spark, d):
    return profiles.profile_columns(table(spark, d, "met_inventario_base"), ["id_objeto", *MET.enrichment_fields], "MET", with_available=False, distinct=False)


@query(_profile_sql("cma_principal_enriched_v1", "CMA", ["url_objeto", "url_imagen", "iiif"], ("iiif",), distinct=False))
def coverage_selected(spark, d):
    return profiles.profile_columns(table(spark, d, "cma_principal_enriched_v1"), ["url_objeto", "url_imagen", "iiif"], "CMA", distinct=False)


_IDS = ["row_id", "item_id", "source_object_id", "source_accession_number"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(CASE WHEN {strip_sql(f'CAST({c} AS VARCHAR)')} = '' THEN 1 END) AS empty, count(CASE WHEN {strip_sql(f'CAST({c} AS VARCHAR)')} <> '' THEN 1 END) - count(DISTINCT nullif({strip_sql(f'CAST({c} AS VARCHAR)')}, '')) AS duplicates FROM paper_corpus" for c in _IDS))
def identifier_quality(spark, d):
    return profiles.identifier_quality(table(spark, d, "paper_corpus"), _IDS)


_STRUCTURED = ["met_principal_enriched_v1", "met_inventario_base", "cma_principal_enriched_v1", "cma_andes_textiles_candidates", "paper_corpus"]
_TOKENS = ", ".join(f"('{c}', '{t}')" for c, ts in profiles.CATEGORY_TOKENS.items() for t in ts)


@query(f"SELECT DISTINCT c.table_name, k.category, c.column_name FROM information_schema.columns c JOIN (VALUES {_TOKENS}) k(category, token) ON contains(lower(trim(c.column_name)), k.token) WHERE c.table_name IN ({', '.join(repr(t) for t in _STRUCTURED)})")
def find_columns(spark, d):
    return profiles.find_columns(spark, {t: table(spark, d, t).columns for t in _STRUCTURED})


_SHOWN = ["lang", "source", "text", "accession_number"]


@query("WITH f AS (SELECT * FROM documents ORDER BY doc_id LIMIT 1) " + " UNION ALL ".join(f"SELECT '{c}' AS field, left({strip_sql(c)}, 160) AS value FROM f WHERE {strip_sql(c)} <> ''" for c in _SHOWN))
def first_row_preview(spark, d):
    return profiles.first_row_preview(table(spark, d, "documents").select("doc_id", *_SHOWN), "doc_id")


# ---- sources and their checks


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ["id_objeto", *MET.enrichment_fields]) + " FROM met_inventario_base")
def scan_csv_strings(spark, d):
    """The inventory written as CSV parts and scanned again: every column a string, missing as ''."""
    path = _scratch(spark, "inventory")
    write_csv_parts(table(spark, d, "met_inventario_base").select("id_objeto", *MET.enrichment_fields), path)
    return csv_strings(spark, path)


@query("SELECT CAST(entry_id AS VARCHAR) AS entry_id, coalesce(field_name, '') AS field_name, coalesce(label, '') AS label, coalesce(label_en, '') AS label_en FROM canonical_terms")
def scan_csv_fallback(spark, d):
    """The reference list in Latin-1 with semicolons, which only the last attempt reads in columns."""
    path = _scratch(spark, "terms")
    as_text(table(spark, d, "canonical_terms")).write.options(header=True, escape='"', sep=";", encoding="ISO-8859-1").csv(path)
    return csv_with_fallback(spark, path)


@query("SELECT 'canonical_terms' AS source, count(*) AS rows, 150::BIGINT AS expected, CASE WHEN count(*) = 150 THEN 'APROBADO' ELSE 'REVISAR' END AS verdict FROM canonical_terms UNION ALL SELECT 'load_log', count(*), 9, CASE WHEN count(*) = 9 THEN 'APROBADO' ELSE 'REVISAR' END FROM load_log UNION ALL SELECT 'no_such_table', NULL, 1, 'ERROR AnalysisException'")
def source_verdicts(spark, d):
    read = lambda t: lambda: table(spark, d, t)
    found = checks.source_verdicts({t: (read(t), n) for t, n in (("canonical_terms", 150), ("load_log", 9), ("no_such_table", 1))})
    return spark.createDataFrame(found, "source string, rows long, expected long, verdict string")


_NEEDED = {MET.reviewed_table: [*MET.reviewed_fields, "campo_ausente"], CMA.reviewed_table: [*CMA.reviewed_fields], MET.enrichment_table: ["id_objeto", "otro_ausente"]}
_PAIRS = ", ".join(f"('{t}', '{c}')" for t, cs in _NEEDED.items() for c in cs)


@query(f"SELECT n.t AS source, n.c AS column_name FROM (VALUES {_PAIRS}) n(t, c) WHERE NOT EXISTS (SELECT 1 FROM information_schema.columns i WHERE i.table_name = n.t AND i.column_name = n.c)")
def missing_columns(spark, d):
    """Required columns that a source lacks, as require_columns tells them."""
    found = [(t, c) for t, cs in _NEEDED.items() for c in checks.absent_columns(table(spark, d, t), cs)]
    return spark.createDataFrame(found, "source string, column_name string")


# ---- the corpus


@query(_adapted_sql(MET))
def adapt_source_a(spark, d):
    return adapt(MET, _enriched(spark, d, MET), INFO)


@query(_adapted_sql(CMA))
def adapt_source_b(spark, d):
    return adapt(CMA, _enriched(spark, d, CMA), INFO)


@query(f"WITH {_CORPUS} SELECT * FROM corpus")
def corpus_union(spark, d):
    return _corpus(spark, d)


@query(f"WITH {_CORPUS} SELECT museum, source_object_id, item_id FROM corpus ORDER BY museum, source_object_id")
def corpus_sorted(spark, d):
    return _corpus(spark, d).select("museum", "source_object_id", "item_id").orderBy("museum", "source_object_id")


@query(f"WITH {_CORPUS} SELECT * FROM corpus ORDER BY museum, source_object_id")
def corpus_build(spark, d):
    return build_corpus([(s, _reviewed(spark, d, s), _enrichment(spark, d, s)) for s in (MET, CMA)], INFO, check=False)


@query(f"WITH {_ctes(MET)} SELECT count(*) AS rows, count(CASE WHEN e.id_objeto IS NULL THEN 1 END) AS unmatched FROM met_r r LEFT JOIN met_e e ON {clean_sql('r.id_fuente')} = {clean_sql('e.id_objeto')}")
def validate_complete_match(spark, d):
    return keys.complete_match_metrics(keys.checked_left_join(_reviewed(spark, d, MET), _enrichment(spark, d, MET), "id_fuente", "id_objeto", "inventory_", ["pais"], check=False))


@query(
    f"WITH {_CORPUS} SELECT count(*) AS rows, "
    + ", ".join(f"count(CASE WHEN {strip_sql(c)} = '' THEN 1 END) AS empty_{c}" for c in COMPLETE)
    + ", count(CASE WHEN dataset_split IS DISTINCT FROM 'principal' THEN 1 END) AS other_dataset_split, count(CASE WHEN review_status IS DISTINCT FROM 'aprobado' THEN 1 END) AS other_review_status,"
    + " count(CASE WHEN processing_timestamp IS NULL THEN 1 END) AS null_timestamps, min(processing_timestamp) AS timestamp_min, max(processing_timestamp) AS timestamp_max,"
    + " count(*) - count(DISTINCT item_id) AS duplicate_ids, count(*) - count(DISTINCT (museum, source_object_id)) AS duplicate_source_keys, 42::INTEGER AS columns FROM corpus"
)
def validate_corpus_metrics(spark, d):
    return corpus_metrics(_corpus(spark, d), EXPECTED)


def _contract_sql() -> str:
    parts = [f"SELECT 'required' AS rule, '{f}' AS field, count(CASE WHEN {strip_sql(f)} = '' THEN 1 END) AS violations FROM corpus" for f in CONTRACT.required]
    parts += [f"SELECT 'allowed', '{f}', count(CASE WHEN {strip_sql(f)} <> '' AND {f} NOT IN ({', '.join(repr(v) for v in vs)}) THEN 1 END) FROM corpus" for f, vs in CONTRACT.allowed.items()]
    parts += [f"SELECT 'pattern', '{f}', count(CASE WHEN {strip_sql(f)} <> '' AND NOT regexp_matches({f}, '{p}') THEN 1 END) FROM corpus" for f, p in CONTRACT.patterns.items()]
    parts += [f"SELECT 'unique', '{'+'.join(k)}', count(*) - count(DISTINCT ({', '.join(k)})) FROM corpus" for k in CONTRACT.unique]
    return f"WITH {_CORPUS} " + " UNION ALL ".join(parts)


@query(_contract_sql())
def schema_contract_rules(spark, d):
    return violations(_corpus(spark, d), CONTRACT)
