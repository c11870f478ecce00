"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def llm_query(name: str, oracle: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in LLM_QUERIES:
            raise ValueError(f"{name} is registered twice")
        LLM_QUERIES[name] = fn
        if oracle is not None:
            LLM_ORACLES[name] = oracle.strip()
        return fn

    return register
