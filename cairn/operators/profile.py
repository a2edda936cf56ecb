"""Profiles and aggregates: each function is one scan with map-side partial aggregation.

Defined results for all: an empty table gives counts of zero and null statistics; NaN counts as missing,
infinities are left out of moments; booleans are categories. Repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StructType


def numeric_columns(schema: StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, NumericType)]


def text_columns(schema: StructType) -> list[str]:
    return [f.name for f in schema if f.dataType.simpleString() == "string"]


def value(schema: StructType, name: str) -> Column:
    """The column with NaN as null."""
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if isinstance(schema[name].dataType, (DoubleType, FloatType)) else c


def finite(schema: StructType, name: str) -> Column:
    """The column as a double, missing and infinite values as null."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def corr(a: Column, b: Column) -> Column:
    """Pearson's correlation over the rows that have both; null without spread on either side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def _long(wide: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """One row of a struct per column to one row per column."""
    items = F.array(*[F.struct(F.lit(n).alias("column_name"), *[F.col(f"`{n}`.{f}").alias(f) for f in fields]) for n in names])
    return wide.select(F.explode(items).alias("x")).select("x.*")


def full_profile(df: DataFrame) -> DataFrame:
    """One row per column: n, nulls, distinct, min, max, mean (numbers) and the most frequent value (others, ties to the smaller).

    Each column is its own branch of one job: a scan of that column only, counted by value with map-side
    combining; everything else follows from the value counts. Several distinct counts in one aggregation
    would multiply every row by the number of columns instead.
    """
    nums, out = set(numeric_columns(df.schema)), None
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    for f in df.schema:
        num = f.name in nums
        c = df.select(value(df.schema, f.name).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        x, k = F.col("v").cast("double"), F.when(F.col("v").isNotNull(), F.col("c"))
        row = c.agg(
            F.lit(f.name).alias("column_name"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct_count"),
            (F.min(x) if num else null_d).alias("min_value"), (F.max(x) if num else null_d).alias("max_value"), (F.sum(x * k) / F.sum(k) if num else null_d).alias("mean_value"),
            (null_s if num else F.min_by(F.col("v").cast("string"), F.when(F.col("v").isNotNull(), F.struct(-k, F.col("v").cast("string"))))).alias("top_value"),
        )
        out = row if out is None else out.unionAll(row)
    return out


def quick_profile(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """The profile for very large tables: sketches for distinct counts and quartiles, one scan."""
    s, fields = df.schema, ["n", "nulls", "approx_distinct", "q25", "q50", "q75"]
    nums = set(numeric_columns(s))
    aggs = []
    for f in s:
        v = value(s, f.name)
        q = F.percentile_approx(v.cast("double") if f.name in nums else F.lit(None).cast("double"), [0.25, 0.5, 0.75], 10000)
        aggs.append(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.approx_count_distinct(v, rsd).alias("approx_distinct"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75")).alias(f.name))
    return _long(df.agg(*aggs), s.names, fields)


def cell_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, v, n): how often each value occurs, as text, of all columns in one shuffle; missing ones left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), value(df.schema, c).cast("string").alias("v")) for c in names]))
    return df.select(cells.alias("x")).select("x.*").where("v IS NOT NULL").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))


def missing_values(df: DataFrame) -> DataFrame:
    """(column_name, missing)."""
    wide = df.agg(*[F.count_if(value(df.schema, c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column_name", "missing")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n, duplicates): rows that repeat an earlier row, nulls equal to nulls."""
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def hash_duplicates(df: DataFrame) -> DataFrame:
    """(n, duplicates) by a 128-bit digest of the whole row, for wide rows; one string travels instead of the row."""
    row = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]), {"ignoreNullFields": "false"}))
    return df.groupBy(row.alias("h")).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def descriptive(df: DataFrame, names: list[str], exact: bool = True) -> DataFrame:
    """Count, moments, quartiles and shape of each column; kurtosis in excess of the normal one.

    Quartiles are exact, from value counts of all columns in one pass, or with ``exact=False`` from sketches.
    """
    from cairn.operators.relational import quantiles

    fields = ["n", "nan_count", "mean_value", "std_pop", "std_samp", "var_samp", "min_value", "max_value", "range_value", "sum_value", "q1", "median_value", "q3", "iqr", "skew", "kurt", "cv_pct"]
    aggs = []
    for c in names:
        v = finite(df.schema, c)
        q = F.percentile_approx(v, [0.25, 0.5, 0.75], 10000) if not exact else F.array(*[F.lit(None).cast("double")] * 3)
        aggs.append(F.struct(
            F.count(v).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("nan_count"), F.avg(v).alias("mean_value"), F.stddev_pop(v).alias("std_pop"), F.stddev_samp(v).alias("std_samp"), F.var_samp(v).alias("var_samp"),
            F.min(v).alias("min_value"), F.max(v).alias("max_value"), (F.max(v) - F.min(v)).alias("range_value"), F.sum(v).alias("sum_value"),
            q[0].alias("q1"), q[1].alias("median_value"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"),
            (F.stddev_pop(v) / F.abs(F.avg(v)) * 100).alias("cv_pct"),
        ).alias(c))
    out = _long(df.agg(*aggs), names, fields)
    if not exact or not names:
        return out
    q = quantiles(df, {c: finite(df.schema, c) for c in names}, [0.25, 0.5, 0.75]).select(F.col("column_name").alias("_c"), "q")
    out = out.join(F.broadcast(q), F.col("column_name") == F.col("_c"))  # a row per column
    given = {"q1": F.col("q")[0], "median_value": F.col("q")[1], "q3": F.col("q")[2], "iqr": F.col("q")[2] - F.col("q")[0]}
    return out.select("column_name", *[given.get(f, F.col(f)).alias(f) for f in fields])


def percentiles(df: DataFrame, name: str, points: list[float], exact: bool = True) -> DataFrame:
    """(point, quantile) by linear interpolation; points outside 0..100 are an error."""
    if any(not 0 <= p <= 100 for p in points):
        raise ValueError("points lie between 0 and 100")
    from cairn.operators.relational import quantiles

    v, at = finite(df.schema, name), [p / 100 for p in points]
    got = quantiles(df, {name: v}, at).select("q") if exact else df.agg(F.percentile_approx(v, at, 10000).alias("q"))
    return got.select(F.posexplode("q").alias("i", "quantile")).select(F.array(*[F.lit(float(p)) for p in points])[F.col("i")].alias("point"), "quantile")


def median_deviation(df: DataFrame, name: str) -> DataFrame:
    """(median_value, mad): the median absolute deviation; two scans, the median travels as one row."""
    from cairn.operators.relational import quantiles

    v = finite(df.schema, name)
    med = quantiles(df, {name: v}, [0.5]).select(F.col("q")[0].alias("median_value"))
    off = df.select(v.alias("v")).crossJoin(F.broadcast(med)).select(F.abs(F.col("v") - F.col("median_value")).alias("d"))
    return med.crossJoin(quantiles(off, {"d": F.col("d")}, [0.5]).select(F.col("q")[0].alias("mad")))


def extended(df: DataFrame, name: str) -> DataFrame:
    """Standard error, mean without the outer tenths, mean with the outer twentieths pulled in, and Gini."""
    v = df.select(finite(df.schema, name).alias("v")).where("v IS NOT NULL")
    # value counts first: ranks come from cumulative counts of distinct values
    c = v.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    from cairn.operators.relational import running

    total = c.agg(F.sum("n").alias("t"), F.min("v").alias("least"))
    c = running(c, "v", ["n"]).withColumnRenamed("cum_n", "hi").crossJoin(F.broadcast(total)).withColumn("lo", F.col("hi") - F.col("n"))
    cut_ = F.floor(F.col("t") * 0.1)
    kept = F.greatest(F.least(F.col("hi"), F.col("t") - cut_) - F.greatest(F.col("lo"), cut_), F.lit(0))
    five = F.floor(F.col("t") * 0.05)
    low, high = F.min(F.when(F.col("hi") > five, F.col("v"))), F.max(F.when(F.col("lo") < F.col("t") - five, F.col("v")))
    base = c.agg(
        F.sum("n").alias("n"), (F.sqrt((F.sum(F.col("n") * F.col("v") * F.col("v")) - F.sum(F.col("n") * F.col("v")) ** 2 / F.sum("n")) / (F.sum("n") - 1)) / F.sqrt(F.sum("n"))).alias("sem"),
        (F.sum(kept * F.col("v")) / F.sum(kept)).alias("trimmed_mean"), low.alias("low"), high.alias("high"),
        F.when(F.min("least") >= 0, F.sum((F.col("lo") + F.col("hi") - F.col("t")) * F.col("n") * F.col("v")) / (F.sum("n") * F.sum(F.col("n") * F.col("v")))).alias("gini"),
    )
    wins = c.crossJoin(F.broadcast(base.select("low", "high"))).agg((F.sum(F.greatest(F.least("v", "high"), "low") * F.col("n")) / F.sum("n")).alias("winsorized_mean"))
    return base.crossJoin(F.broadcast(wins)).select("n", "sem", "trimmed_mean", "winsorized_mean", "gini")


def dataset_stats(df: DataFrame) -> DataFrame:
    """Rows, columns by kind, missing cells and their rate."""
    nums = numeric_columns(df.schema)
    miss = sum([F.count_if(value(df.schema, c).isNull()) for c in df.columns], F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), miss.alias("missing_total")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(len(nums)).alias("n_numeric"), F.lit(len(df.columns) - len(nums)).alias("n_categorical"), "missing_total",
        F.round(F.col("missing_total") / F.greatest(F.col("n_rows") * len(df.columns), F.lit(1)), 6).alias("missing_rate"),
    )


def shape(df: DataFrame, name: str) -> DataFrame:
    """z-scores of skewness and kurtosis, bimodality coefficient, share beyond three deviations, and a transform."""
    v = finite(df.schema, name)
    m = df.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"))
    tails = df.select(v.alias("v")).crossJoin(F.broadcast(m)).agg(F.avg((F.abs((F.col("v") - F.col("m")) / F.col("s")) > 3).cast("double")).alias("heavy_tail"))
    n = F.col("n")
    return m.crossJoin(tails).select(
        "n", "skew", "kurt", (F.col("skew") / F.sqrt(6 / n)).alias("z_skew"), (F.col("kurt") / F.sqrt(24 / n)).alias("z_kurt"),
        ((F.col("skew") ** 2 + 1) / (F.col("kurt") + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))).alias("bimodality"), "heavy_tail",
        F.when(F.abs("skew") < 0.5, "none").when(F.col("skew") > 1, "log1p").when(F.col("skew") > 0, "sqrt").otherwise("square").alias("transform"),
    )


def entropy(df: DataFrame, name: str) -> DataFrame:
    """Shannon entropy of the value shares in bits and nats, and as a share of its maximum."""
    c = df.select(value(df.schema, name).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("nl"), F.count(F.lit(1)).alias("n_unique"))
    bits = F.log2("t") - F.col("nl") / F.col("t")
    return t.select(bits.alias("entropy_bits"), (bits * F.lit(0.6931471805599453)).alias("entropy_nats"), "n_unique", F.when(F.col("n_unique") > 1, bits / F.log2("n_unique")).otherwise(0.0).alias("normalized"))


def histogram(df: DataFrame, name: str, bins: int = 20) -> DataFrame:
    """(bin, lo, hi, n): equal widths, the last bin closed; empty bins are kept."""
    v = finite(df.schema, name)
    r = df.agg(F.min(v).alias("a"), F.max(v).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    idx = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    c = df.select(v.alias("v")).where("v IS NOT NULL").crossJoin(F.broadcast(r)).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = r.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(F.broadcast(c), "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def numeric_entropy(df: DataFrame, name: str, bins: int = 10) -> DataFrame:
    """Entropy in bits over equal-width bins."""
    h = histogram(df, name, bins).where("n > 0").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("nl"))
    return h.select((F.log2("t") - F.col("nl") / F.col("t")).alias("entropy_bits"))


def class_gini(df: DataFrame, name: str) -> DataFrame:
    """Gini coefficient of the class sizes: 0 for equal sizes."""
    c = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("n", name)  # as many rows as classes
    r = c.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.agg((((F.count(F.lit(1)) + 1) - 2 * F.sum("cum") / F.sum("n")) / F.count(F.lit(1))).alias("gini"), F.count(F.lit(1)).alias("classes"))


def top_values(df: DataFrame, name: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties to the smaller."""
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, observed, expected) of every combination that occurs, expected by the margins."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("observed"))
    wa, wb, wt = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy()
    return c.withColumn("expected", F.sum("observed").over(wa) * F.sum("observed").over(wb) / F.sum("observed").over(wt))


def date_features(df: DataFrame, key: str, name: str) -> DataFrame:
    """Year, month, day, day of week (Monday 0) and weekend flag. No shuffle."""
    c = F.col(name)
    return df.select(key, F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day"), F.weekday(c).alias("dayofweek"), (F.weekday(c) >= 5).cast("int").alias("is_weekend"))


def numeric_features(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Squares, products of pairs, and log1p where every value is positive (one aggregation decides)."""
    lo = df.agg(*[F.min(finite(df.schema, c)).alias(c) for c in names]).first()
    cols = [F.log1p(c).alias(f"{c}_log") for c in names if lo[c] is not None and lo[c] > 0]
    cols += [(F.col(c) * F.col(c)).alias(f"{c}_squared") for c in names]
    cols += [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for i, a in enumerate(names[:5]) for b in names[i + 1 : 5]]
    return df.select(key, *cols)


def text_features(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, n_length, n_words): characters, and words between white space."""
    words = F.when(F.trim(F.regexp_replace(name, r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")))
    return df.select(key, F.coalesce(F.length(name), F.lit(0)).alias("n_length"), F.when(F.col(name).isNull(), 0).otherwise(words).alias("n_words"))
