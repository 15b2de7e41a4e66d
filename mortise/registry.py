"""The queries of the library's own operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mortise.plans import calibration, ensembles, fusion, keywords, lattices, models, records, relations, retrieval, shaping, sites, sources, statistics, structures

_MODULES = (statistics, ensembles, relations, calibration, records, structures, retrieval, shaping, sources, keywords, models, lattices, sites, fusion)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
