"""SQL-callable functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

SLIDING_WINDOWS = """CREATE OR REPLACE TEMPORARY FUNCTION sliding_windows(n INT, w INT, hop INT) RETURNS TABLE (start INT)
RETURN SELECT explode(concat(
  CASE WHEN n >= w THEN sequence(0, n - w, hop) ELSE array() END,
  CASE WHEN n > w AND (floor((n - w) / hop) + 1) * hop < n THEN array(n - w) ELSE array() END))"""


def register(spark: SparkSession) -> None:
    """``sliding_windows(n, w, hop)``: starts of the training windows of a series, tail included."""
    spark.sql(SLIDING_WINDOWS)
