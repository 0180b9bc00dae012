"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from . import html_extract, language_id, license_scan, line_dedup, mixing, packing, pq, simhash, spotsigs, toxicity
from .common import docs_of


def queries() -> dict:
    return {
        "op1_line_dedup": lambda s, d: line_dedup.line_dedup(docs_of(s, d)).select("doc_id", "text", "n_lines", "n_dropped"),
        "op2_mixing": lambda s, d: mixing.mix(docs_of(s, d), docs_of(s, d, "labels")),
        "op3_html_extract": lambda s, d: html_extract.html_extract(docs_of(s, d, "pages")),
        "op4_toxicity": lambda s, d: toxicity.toxicity(docs_of(s, d), docs_of(s, d, "labels")),
        "op5_packing": lambda s, d: packing.pack(docs_of(s, d)),
        "op6_license_scan": lambda s, d: license_scan.license_scan(docs_of(s, d)),
        "op7_language_id": lambda s, d: language_id.language_id(docs_of(s, d)),
        "op8_embedding_pq": lambda s, d: pq.near_embeddings(docs_of(s, d, "embeddings")),
        "op9_spotsigs": lambda s, d: spotsigs.spotsigs(docs_of(s, d)),
        "op10_simhash": lambda s, d: simhash.duplicates(docs_of(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op2_mixing": mixing.sql(), "op5_packing": packing.sql(), "op8_embedding_pq": pq.sql()}
