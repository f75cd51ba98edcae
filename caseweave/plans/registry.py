"""The queries over the shared tables and their SQL. Whole numbers are 64-bit on both sides."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

TOPICS = ("audit", "signin", "text", "mail", "thread", "score", "evidence", "config")
#: Columns that the SQL makes of 32-bit literals.
NARROW = {
    "aitm_score": ("score",), "page_cap_truncation": ("smallest", "largest", "page_cap"), "single_leg_scores": ("score",), "url_risk": ("risk",), "attachment_substitution": ("score",), "thread_precursor": ("bonus",), "thread_roots": ("steps",),
    "findings": ("seq", "weight"), "message_tiers": ("tier",), "tiering": ("tier",), "ioc_rollup": ("best_tier",), "top_domains": ("highest_tier",),
}


def _wide(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        narrow = {c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"}
        return df.withColumns(narrow) if narrow else df

    return run


def _wide_sql(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in NARROW.get(name, ()))
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _topic in TOPICS:
    _module = import_module(f"caseweave.plans.{_topic}_queries")
    QUERIES.update({n: _wide(q) for n, q in _module.QUERIES.items()})
    ORACLES.update({n: _wide_sql(n, q) for n, q in _module.ORACLES.items()})
