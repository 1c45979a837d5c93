"""The subpackage's queries and oracle SQL, gathered from its operator modules."""

from __future__ import annotations

from glossa.llm import bayes_minhash, debruijn, decontaminate, heap_lloyd, jpeg, mixing, ppm, quality, resharding, simhash, toxicity, url_filter, voronoi

MODULES = [ppm, jpeg, debruijn, simhash, resharding, url_filter, mixing, decontaminate, quality, toxicity, voronoi, bayes_minhash, heap_lloyd]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
