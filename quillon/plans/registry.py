"""All queries of the library but those of the llm subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import data, evaluations, kernels, measures, records, sequences

_ALL = data.QUERIES | measures.QUERIES | kernels.QUERIES | sequences.QUERIES | evaluations.QUERIES | records.QUERIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, (f, _) in _ALL.items()}
SQL: dict[str, str] = {k: s for k, (_, s) in _ALL.items() if s is not None}
