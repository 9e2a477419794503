"""Registered queries: one per operator, each a ``(spark, sf_dir) ->
DataFrame`` callable, with an optional DuckDB oracle SQL string that must
return the same rows (same column names)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailsift.operators import gate as G
from mailsift.plans.fixtures import mail_messages, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def spread(df: DataFrame) -> DataFrame:
    """Regex work is CPU-bound. A table in few large splits is dealt out over
    ``mailsift.input.partitions`` partitions (a job parameter, e.g. the number
    of cores; unset: the splits as they are read)."""
    n = df.sparkSession.conf.get("mailsift.input.partitions", None)
    return df.repartition(int(n)) if n else df


# ----------------------------------------------------------------- shared bases
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_messages(spread(table(spark, sf_dir, "documents")))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.run_gate(messages(spark, sf_dir))


def load_all() -> None:
    """Import every query module so its registrations run."""
    from mailsift.plans import q_analytics, q_gate, q_model, q_sources, q_stream, q_text  # noqa: F401
