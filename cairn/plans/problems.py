"""Queries of the general training-data problems (3 and 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.operators import column_profile, fill
from cairn.session import read

Query = Callable[[SparkSession, str], DataFrame]


def _p3_found(s: SparkSession, d: str) -> DataFrame:
    return column_profile.findings(s, f"{d}/demo_churn.parquet", read(s, d, "snapshots"), read(s, d, "column_stat"))


def _p3_profile(s: SparkSession, d: str) -> DataFrame:
    p = column_profile.profile(column_profile.value_counts(s, f"{d}/demo_churn.parquet"))
    return p.select("snapshot_id", "column_name", "n", "nulls", "unique_count", "lo", "hi", "mean")


QUERIES: dict[str, Query] = {
    "p3_found": _p3_found,
    "p3_profile": _p3_profile,
    "p6_found": lambda s, d: fill.found(read(s, d, "demo_churn"), read(s, d, "snapshots")),
    "p6_filled": lambda s, d: fill.fill_missing(read(s, d, "demo_churn"), read(s, d, "snapshots")),
}

_TEXT = "('', '-', '--', '?', 'n.a.', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'unknown', '#n/a')"
ORACLES: dict[str, str] = {
    "p6_found": f"""
SELECT row_id, 'age' AS field_name FROM demo_churn WHERE age IS NULL OR isnan(age) OR age IN (-1, 0, 999)
UNION ALL SELECT row_id, 'tenure_months' FROM demo_churn WHERE tenure_months IS NULL OR tenure_months IN (-1, -99, 9999)
UNION ALL SELECT row_id, 'monthly_charges' FROM demo_churn WHERE monthly_charges IS NULL OR isnan(monthly_charges) OR monthly_charges IN (-1, -999, 99999)
UNION ALL SELECT row_id, 'contract' FROM demo_churn WHERE contract IS NULL OR lower(trim(contract)) IN {_TEXT}""",
    "p3_profile": """
WITH long AS (
  SELECT snapshot_id, 'age' AS column_name, age AS num, CAST(NULL AS VARCHAR) AS text FROM demo_churn
  UNION ALL SELECT snapshot_id, 'tenure_months', CAST(tenure_months AS DOUBLE), NULL FROM demo_churn
  UNION ALL SELECT snapshot_id, 'monthly_charges', monthly_charges, NULL FROM demo_churn
  UNION ALL SELECT snapshot_id, 'support_calls', CAST(support_calls AS DOUBLE), NULL FROM demo_churn
  UNION ALL SELECT snapshot_id, 'churned', CAST(churned AS DOUBLE), NULL FROM demo_churn
  UNION ALL SELECT snapshot_id, 'contract', NULL, contract FROM demo_churn),
m AS (
  SELECT *, (num IS NULL OR isnan(num)) AND text IS NULL AS missing,
    CASE WHEN num IS NULL OR isnan(num) THEN NULL
         WHEN column_name = 'age' AND num IN (-1, 0, 999) THEN NULL
         WHEN column_name = 'tenure_months' AND num IN (-1, -99, 9999) THEN NULL
         WHEN column_name = 'monthly_charges' AND num IN (-1, -999, 99999) THEN NULL ELSE num END AS x
  FROM long)
SELECT snapshot_id, column_name, COUNT(*) AS n, SUM(CASE WHEN missing THEN 1 ELSE 0 END)::BIGINT AS nulls,
  (COUNT(DISTINCT CASE WHEN NOT isnan(num) THEN num END) + COUNT(DISTINCT text))::BIGINT AS unique_count,
  MIN(x) AS lo, MAX(x) AS hi, AVG(x) AS mean
FROM m GROUP BY snapshot_id, column_name""",
}
