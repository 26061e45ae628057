"""All registered queries that need no optional package, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Readings as the oracles see them.
READINGS = "m AS (SELECT event_id, user_id, event_type AS metric_type, ts, value, props AS meta FROM events)"


def register(name: str, run: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    """Register a query over the readings. The oracle may use the relation ``m``."""
    from pulseloom.sources.readings import readings

    QUERIES[name] = lambda spark, sf_dir: run(readings(spark, sf_dir))
    if oracle:
        ORACLES[name] = with_readings(oracle)


def register_tables(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    """Register a query over any tables of a folder."""
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = with_readings(oracle)


def with_readings(sql: str) -> str:
    sql = sql.strip()
    return f"WITH RECURSIVE {READINGS}, {sql[4:].lstrip()}" if sql[:5].upper() == "WITH " else f"WITH {READINGS} {sql}"
