"""The two sources of the harmonised corpus as data: keys, fields and mappings."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.mapping import Clean, Const, First, ItemId, Target


@dataclass(frozen=True)
class SourceSpec:
    """All that tells one source from another; the pipeline itself is the same for all."""

    museum: str
    reviewed_table: str
    reviewed_key: str
    reviewed_fields: tuple[str, ...]
    enrichment_table: str
    enrichment_key: str
    enrichment_fields: tuple[str, ...]
    prefix: str
    coalesced: dict[str, str]  # reviewed column: enrichment column that fills it
    recovered: dict[str, str]  # new column: enrichment column
    recovery_source: str
    recovery_version: str
    mapping: dict = field(default_factory=dict)


@dataclass(frozen=True)
class BuildInfo:
    """Lineage constants of a build; its timestamp is always given (see plans.config)."""

    timestamp: str
    branch: str = "main"
    commit: str = "0" * 40
    adapter_version: str = "1.0.0"


def _tail(museum: str, info: BuildInfo) -> Target:
    """Lineage columns, the same for all sources but for names."""
    m = museum.lower()
    return {
        "source_branch": Const(info.branch), "source_commit": Const(info.commit), "source_file": Const(f"{m}_reviewed"), "enrichment_source_file": Const(f"{m}_enrichment"),
        "metadata_recovery_source": Clean("metadata_recovery_source"), "metadata_recovery_version": Clean("metadata_recovery_version"),
        "adapter_name": Const(f"{m}_enriched_adapter"), "adapter_version": Const(info.adapter_version), "processing_timestamp": Const(info.timestamp),
        "image_local_path": Const(), "image_sha256": Const(), "image_phash": Const(),
    }


# The columns of the harmonised schema in contract order, with the source columns they come from.
def met_mapping(info: BuildInfo) -> Target:
    return {
        "item_id": ItemId("MET", "id_fuente"), "museum": Const("MET"), "source_object_id": Clean("id_fuente"), "source_accession_number": Const(),
        "title": First("titulo_es_sugerido", "titulo_original"), "title_original": Clean("titulo_original"), "description": Const(),
        "culture": Clean("cultura"), "culture_original": Clean("cultura"), "period": Clean("fecha_objeto"), "period_original": Clean("fecha_objeto"),
        "object_type": Clean("tipo_objeto"), "object_type_original": Clean("tipo_objeto"), "material": First("material_normalizado", "material"), "material_original": Clean("material"),
        "technique": Clean("tecnica"), "technique_original": Clean("tecnica"), "provenance": Clean("procedencia"),
        "classification": First("clasificacion_normalizada_recuperada", "clasificacion_original_recuperada"), "country": Clean("pais_recuperado"), "region": Clean("region_recuperada"),
        "image_url": Clean("url_imagen"), "object_url": Clean("url_objeto"), "license": Clean("licencia"), "dataset_split": Const("principal"), "review_status": Const("aprobado"),
        "review_decision_original": Clean("decision_revision"), "review_reason": Clean("motivo_curacion"), "reviewer": Clean("revisor"), "review_date": Clean("fecha_revision"),
        **_tail("MET", info),
    }


def cma_mapping(info: BuildInfo) -> Target:
    return {
        "item_id": ItemId("CMA", "id_objeto"), "museum": Const("CMA"), "source_object_id": Clean("id_objeto"), "source_accession_number": Clean("numero_acceso"),
        "title": Clean("titulo_original"), "title_original": Clean("titulo_original"), "description": Clean("descripcion_original"),
        "culture": First("cultura_manual", "cultura"), "culture_original": Clean("cultura"), "period": First("periodo_manual", "periodo"), "period_original": Clean("periodo"),
        "object_type": First("tipo_objeto_manual", "nombre_objeto_original"), "object_type_original": Clean("nombre_objeto_original"), "material": Clean("material_original"), "material_original": Clean("material_original"),
        "technique": Clean("tecnica_original"), "technique_original": Clean("tecnica_original"), "provenance": Const(), "classification": Clean("clasificacion_original"),
        "country": Const(), "region": Const(), "image_url": Clean("url_imagen"), "object_url": Clean("url_objeto"), "license": Clean("licencia_recuperada"),
        "dataset_split": Const("principal"), "review_status": Const("aprobado"), "review_decision_original": Clean("decision_auditoria"), "review_reason": Clean("motivo_auditoria"),
        "reviewer": Clean("revisor"), "review_date": Clean("fecha_revision"),
        **_tail("CMA", info),
    }


# Names, keys and fields of the source tables, and which field fills or recovers which.
MET = SourceSpec(
    museum="MET",
    reviewed_table="met_principal_enriched_v1",
    reviewed_key="id_fuente",
    reviewed_fields=(
        "id_fuente", "titulo_original", "titulo_es_sugerido", "cultura", "fecha_objeto", "procedencia", "tipo_objeto", "tipo_superficie", "material", "material_normalizado",
        "tecnica", "estado_curacion", "motivo_curacion", "url_objeto", "url_imagen", "licencia", "decision_revision", "revisor", "fecha_revision",
    ),
    enrichment_table="met_inventario_base",
    enrichment_key="id_objeto",
    enrichment_fields=(
        "titulo_original", "titulo_es_sugerido", "cultura", "fecha_objeto", "pais", "region", "clasificacion_original", "clasificacion_normalizada", "nombre_objeto_original",
        "material_original", "dimensiones", "url_objeto", "url_imagen", "etiquetas_originales",
    ),
    prefix="inventory_",
    coalesced={"titulo_original": "titulo_original", "titulo_es_sugerido": "titulo_es_sugerido", "cultura": "cultura", "fecha_objeto": "fecha_objeto", "tipo_objeto": "nombre_objeto_original", "material": "material_original", "url_objeto": "url_objeto", "url_imagen": "url_imagen"},
    recovered={
        "clasificacion_original_recuperada": "clasificacion_original", "clasificacion_normalizada_recuperada": "clasificacion_normalizada", "pais_recuperado": "pais",
        "region_recuperada": "region", "dimensiones_recuperadas": "dimensiones", "etiquetas_originales_recuperadas": "etiquetas_originales",
    },
    recovery_source="met_inventario_base",
    recovery_version="1.0.0",
)

CMA = SourceSpec(
    museum="CMA",
    reviewed_table="cma_principal_enriched_v1",
    reviewed_key="id_objeto",
    reviewed_fields=(
        "id_objeto", "numero_acceso", "titulo_original", "cultura", "periodo", "clasificacion_original", "nombre_objeto_original", "tecnica_original", "material_original",
        "descripcion_original", "url_objeto", "url_imagen", "decision_auditoria", "motivo_auditoria", "tipo_objeto_manual", "cultura_manual", "periodo_manual", "revisor",
        "fecha_revision", "notas_iconograficas", "notas_tecnicas",
    ),
    enrichment_table="cma_andes_textiles_candidates",
    enrichment_key="source_id",
    enrichment_fields=(
        "accession_number", "title", "culture", "creation_date", "classification", "technique", "medium", "department", "description", "url", "image_url",
        "share_license_status", "andean_terms", "textile_terms", "raw_queries",
    ),
    prefix="candidate_",
    coalesced={
        "numero_acceso": "accession_number", "titulo_original": "title", "cultura": "culture", "periodo": "creation_date", "clasificacion_original": "classification",
        "tecnica_original": "technique", "material_original": "medium", "descripcion_original": "description", "url_objeto": "url", "url_imagen": "image_url",
    },
    recovered={
        "departamento_recuperado": "department", "licencia_recuperada": "share_license_status", "terminos_andinos_recuperados": "andean_terms",
        "terminos_textiles_recuperados": "textile_terms", "consultas_origen_recuperadas": "raw_queries",
    },
    recovery_source="cma_andes_textiles_candidates",
    recovery_version="1.0.0",
)

MAPPINGS = {"MET": met_mapping, "CMA": cma_mapping}

# Fields that must be complete in the corpus, and fields of the coverage report.
COMPLETE = (
    "item_id", "museum", "source_object_id", "title", "culture", "period", "object_type", "classification", "image_url", "object_url", "license", "dataset_split", "review_status",
    "source_branch", "source_commit", "source_file", "enrichment_source_file", "metadata_recovery_source", "metadata_recovery_version", "adapter_name", "adapter_version", "processing_timestamp",
)
COVERED = ("title", "description", "culture", "period", "object_type", "material", "technique", "provenance", "classification", "license", "image_url", "object_url")
REQUIRED = tuple(c for c in COMPLETE if c not in ("culture", "period", "object_type", "classification", "license"))
