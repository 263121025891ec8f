"""All registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (embedding_dedup, language_id, license_scan, line_quality, merkle, mixing, near_dedup, packing,
               passage_dedup, pivot_search, ranked_search, token_counts, token_files)

MODULES = (language_id, mixing, packing, line_quality, pivot_search, token_files, near_dedup, passage_dedup, embedding_dedup, license_scan,
           token_counts, merkle, ranked_search)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
