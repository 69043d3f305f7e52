"""Arrow batch sizing for the Python stages, and names for working columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 512


def unused(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores added as it takes to be the start of no column of ``docs``."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name += "_"
    return name


def bound_batches(spark: SparkSession, rows: int = MAX_ROWS) -> None:
    """Let no Arrow batch hold more than ``rows`` texts, so that a Python worker's memory follows the text sizes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
