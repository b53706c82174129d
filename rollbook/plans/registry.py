"""The registered queries and their SQL."""

from __future__ import annotations

from rollbook.plans import core, ingest, structure
from rollbook.plans.catalog import Catalog

FLAGSHIP = "subject_stats"
ALL = Catalog().add(core.CATALOG).add(structure.CATALOG).add(ingest.CATALOG)
QUERIES, ORACLES = ALL.queries, ALL.oracles
