"""The registered queries and their SQL, from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import benchmark, built, consensus, control, panel, text

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [consensus, panel, benchmark, text, control, built]


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
