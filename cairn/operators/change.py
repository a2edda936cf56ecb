"""Changes between two loads of a table: schema, numbers, categories and gaps, with a severity for each column.

Each side is aggregated once per kind of column; what is joined has a row per column, or per category that
occurs. Nothing is collected. Columns of one side only are schema changes; an empty side gives null
measures and no issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.profile import finite, numeric_columns, text_columns, value

# Relative change of mean and deviation, and change of the missing share, that count.
MEAN, STD, MISSING = 0.10, 0.25, 0.05


def schema_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column_name, change, type_a, type_b): columns that are added, removed or of another type; as many rows as columns."""
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    out = [(c, "removed" if c not in tb else "added" if c not in ta else "retyped", ta.get(c), tb.get(c)) for c in sorted(set(ta) | set(tb)) if ta.get(c) != tb.get(c)]
    return a.sparkSession.createDataFrame(out, "column_name string, change string, type_a string, type_b string")


def _numbers(df: DataFrame, names: list[str], side: str) -> DataFrame:
    """(column_name, mean, std, least, most) of each column, suffixed by the side."""
    aggs = [F.struct(F.lit(c).alias("column_name"), *[f(finite(df.schema, c)).cast("double").alias(f"{k}_{side}") for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("least", F.min), ("most", F.max))]) for c in names]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def _gaps(df: DataFrame, names: list[str], side: str) -> DataFrame:
    """(column_name, missing share)."""
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    return df.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), (F.count_if(value(df.schema, c).isNull()) / n).alias(f"missing_{side}")) for c in names]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def _categories(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, new_values, gone_values, top_a, top_b): one shuffle of the categories of all columns and both sides."""
    cells = lambda d, s: d.select(F.lit(s).alias("s"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in names])).alias("x")).select("s", "x.*")
    c = cells(a, "a").union(cells(b, "b")).where("v IS NOT NULL").groupBy("column_name", "v").agg(F.count_if(F.col("s") == "a").alias("na"), F.count_if(F.col("s") == "b").alias("nb"))
    top = lambda n: F.max(F.struct(F.col(n), F.col("v")))["v"]  # noqa: E731  ties to the greater value
    return c.groupBy("column_name").agg(F.count_if(F.col("na") == 0).alias("new_values"), F.count_if(F.col("nb") == 0).alias("gone_values"), top("na").alias("top_a"), top("nb").alias("top_b"))


def table_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per column that changed: (column_name, kind, mean_change, std_change, new_min, new_max, new_values,
    gone_values, top_changed, missing_change, issues, severity).

    Numbers count a change of the mean, of the deviation and a new least or greatest value as an issue each;
    categories new values, gone ones and another most frequent one; both a change of the missing share. One
    issue is low, two are medium, more are high; added, removed and retyped columns are high.
    """
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    both = [c for c in a.columns if ta[c] == tb.get(c)]
    nums = [c for c in numeric_columns(a.schema) if c in both]
    texts = [c for c in text_columns(a.schema) if c in both]
    rel = lambda k: F.abs(F.col(f"{k}_b") - F.col(f"{k}_a")) / F.nullif(F.abs(F.col(f"{k}_a")), F.lit(0.0))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    schema = schema_changes(a, b)
    out = schema.select("column_name", F.concat(F.lit("schema_"), "change").alias("kind"), F.lit(1).alias("issues"), F.lit("high").alias("severity"))
    gaps = _gaps(a, both, "a").join(_gaps(b, both, "b"), "column_name").select("column_name", (F.col("missing_b") - F.col("missing_a")).alias("missing_change")) if both else None
    gap = yes(F.abs("missing_change") >= MISSING)

    def graded(df: DataFrame, kind: str, issues: Column) -> DataFrame:
        x = df.join(gaps, "column_name").withColumn("kind", F.lit(kind)).withColumn("issues", issues + gap).where("issues > 0")
        return x.withColumn("severity", F.when(F.col("issues") == 1, "low").when(F.col("issues") == 2, "medium").otherwise("high"))

    if nums:
        n = _numbers(a, nums, "a").join(_numbers(b, nums, "b"), "column_name")
        n = n.select("column_name", rel("mean").alias("mean_change"), rel("std").alias("std_change"), (F.col("least_b") < F.col("least_a")).alias("new_min"), (F.col("most_b") > F.col("most_a")).alias("new_max"))
        out = out.unionByName(graded(n, "numeric", yes(F.col("mean_change") >= MEAN) + yes(F.col("std_change") >= STD) + yes(F.col("new_min") | F.col("new_max"))), allowMissingColumns=True)
    if texts:
        t = _categories(a, b, texts).select("column_name", "new_values", "gone_values", (F.col("top_a") != F.col("top_b")).alias("top_changed"))
        out = out.unionByName(graded(t, "categorical", yes(F.col("new_values") > 0) + yes(F.col("gone_values") > 0) + yes(F.col("top_changed"))), allowMissingColumns=True)
    rest = [c for c in both if c not in nums and c not in texts]
    if rest:
        out = out.unionByName(graded(a.sparkSession.createDataFrame([(c,) for c in rest], "column_name string"), "other", F.lit(0)), allowMissingColumns=True)
    for c, t in {"mean_change": "double", "std_change": "double", "new_min": "boolean", "new_max": "boolean", "new_values": "long", "gone_values": "long", "top_changed": "boolean", "missing_change": "double"}.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out.select("column_name", "kind", "mean_change", "std_change", "new_min", "new_max", "new_values", "gone_values", "top_changed", "missing_change", F.col("issues").cast("int").alias("issues"), "severity")


def verdict(changes: DataFrame) -> DataFrame:
    """(changed_columns, high, medium, low, verdict) of ``table_changes``: any high or three medium ones are high, any medium one or three low ones medium."""
    n = lambda s: F.count_if(F.col("severity") == s)
    x = changes.agg(F.count(F.lit(1)).alias("changed_columns"), n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"))
    return x.withColumn("verdict", F.when((F.col("high") > 0) | (F.col("medium") >= 3), "high").when((F.col("medium") > 0) | (F.col("low") >= 3), "medium").when(F.col("low") > 0, "low").otherwise("none"))
