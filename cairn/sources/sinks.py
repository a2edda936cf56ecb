"""Sinks: files, neutralised CSV, append-only stores and reports of small results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.operators.clean import safe_cell
from cairn.operators.profile import text_columns


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV whose text cells no spreadsheet runs as formulas."""
    texts = set(text_columns(df.schema))
    df.select(*[safe_cell(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Rows added to a Parquet store, partitioned by a column if given."""
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def latest(spark: SparkSession, path: str, key: str, time: str, n: int = 1) -> DataFrame:
    """The newest n rows of each key of a store."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))
    return spark.read.parquet(path).withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def report(parts: dict[str, DataFrame], most: int = 1000) -> str:
    """Markdown tables of small results; more than ``most`` rows are an error, as a report shows results, not data."""
    out = []
    for title, df in parts.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{title} has more than {most} rows")
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)


def as_json(df: DataFrame, most: int = 1000) -> str:
    """A small result as JSON; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], default=str)
