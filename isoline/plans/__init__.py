"""All registered queries: importing this package fills the registry."""

from isoline.plans import contracts, fields, frames, geometry, meshing, overlays, payloads, planning, rules, sequence, stats
from isoline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "contracts", "fields", "frames", "geometry", "meshing", "overlays", "payloads", "planning", "rules", "sequence", "stats"]
