"""All registered queries by name, with the SQL that DuckDB runs beside them."""

from __future__ import annotations

from chainloom.plans import graphs, learning, records, replay, resolution, statistics

MODULES = (resolution, graphs, statistics, replay, learning, records)


def queries() -> dict:
    return {n: f for m in MODULES for n, f in m.build(m.QUERIES)[0].items()}


def oracle_sql() -> dict:
    return {n: s for m in MODULES for n, s in m.build(m.QUERIES)[1].items()}
