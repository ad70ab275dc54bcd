"""Query registry of the market, macro, ledger and venue operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.plans import books, catalogue, desk, dialect, frames, payloads, records, tables
from quayside.plans.views import full_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return tables.QUERIES | frames.QUERIES | desk.QUERIES | books.QUERIES | payloads.QUERIES | records.QUERIES


def oracle_sql() -> dict[str, str]:
    texts = catalogue.ORACLES | frames.ORACLES | desk.ORACLES | books.ORACLES | payloads.ORACLES | records.ORACLES
    return {name: full_sql(sql, dialect.Duck()) for name, sql in texts.items()}
