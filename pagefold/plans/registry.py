"""Registry of queries: name -> (spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pagefold.session import ensure_session_defaults, table


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_session_defaults(spark)
            return fn(lambda t: table(spark, sf_dir, t))
        REGISTRY[name] = Query(name, build, oracle, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from pagefold.plans import (  # noqa: F401
        q_capture, q_content, q_cookies, q_documents, q_events, q_forms, q_observation, q_readiness, q_rules, q_sources, q_streaming,
    )
    return REGISTRY
