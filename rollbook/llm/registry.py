"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from rollbook.llm import clustering, collocations, decontamination, exact_dedup, html_extraction, language_id, lm_scoring, mixing, quality, sharding, simhash_dedup, sp_sampling, token_files

MODULES = (quality, token_files, lm_scoring, html_extraction, exact_dedup, sp_sampling, language_id, decontamination, simhash_dedup, sharding, mixing, collocations, clustering)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
