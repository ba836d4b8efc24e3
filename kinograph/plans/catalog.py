"""All registered queries of the core with their SQL."""

from __future__ import annotations

from kinograph.plans import cohorts, evaluation, media, problems

MODULES = (problems, cohorts, media, evaluation)
FLAGSHIP = "loo_split_summary"
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
