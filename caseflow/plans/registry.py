"""Query registry: name -> (spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)``, derives the entity views it needs from
the driver tables and returns the operator's DataFrame, untouched by the
driver.  The oracle SQL restates the same result independently.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from caseflow.sources.tables import Tables


@dataclass
class Entry:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules registers their queries
    from caseflow.plans import (  # noqa: F401
        q_access, q_audit, q_commit, q_identity, q_lifecycle, q_metrics, q_portfolio, q_sources, q_streams, q_text, q_validate,
    )
    return REGISTRY


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    reg = load_all()

    def bind(e: Entry):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return e.build(Tables(spark, sf_dir))
        run.__name__ = e.name
        return run

    return {n: bind(e) for n, e in reg.items()}


def oracles() -> dict[str, str]:
    return {n: e.sql for n, e in load_all().items() if e.sql is not None}
