"""Registry of driver queries: name -> (Spark builder, DuckDB oracle SQL).

Names are ``<id>_<operator>`` with the operator ids of SURVEY §2.  Each
Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the parquet tables of ``sf_dir`` (or data Spark derives from them).  An
oracle of ``None`` means the result has no SQL equivalent and is checked
by unit tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_compare, q_idioms, q_inject, q_quality, q_structure, q_diagnose, q_outcome, q_assurance, q_sources, q_lifecycle  # noqa: F401
