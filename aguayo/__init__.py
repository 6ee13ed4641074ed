"""Curation, enrichment and audit of tabular corpora as lazy Spark plans."""
