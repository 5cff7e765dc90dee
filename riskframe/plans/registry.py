"""Registration of queries: a name, a function over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskframe.sources.adapters import adapter_sql

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``uses`` names the adapters the SQL reads as leading subqueries."""

    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if uses:
                heads = ", ".join(adapter_sql(u) for u in uses)
                if body.upper().startswith("WITH RECURSIVE"):
                    body = f"WITH RECURSIVE {heads}, {body[len('WITH RECURSIVE') :].strip()}"
                elif body.upper().startswith("WITH"):
                    body = f"WITH {heads}, {body[4:].strip()}"
                else:
                    body = f"WITH {heads} {body}"
            ORACLES[name] = body
        return run

    return register
