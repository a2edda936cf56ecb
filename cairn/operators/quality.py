"""Quality dimensions, readiness, advice and fingerprints of a table.

Each dimension is one scan whose result is a few numbers; scores are column expressions over them.
Empty tables score zero completeness and are never an error.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.profile import cell_counts, finite, numeric_columns, text_columns, value


def completeness(df: DataFrame) -> DataFrame:
    """(cell_share, row_share, column_share, numeric_share, score): .40 cells, .25 rows, .20 columns, .15 numeric cells."""
    s, nums = df.schema, numeric_columns(df.schema)
    miss = {c: value(s, c).isNull() for c in df.columns}
    n = F.count(F.lit(1))
    anymiss = F.greatest(*miss.values(), F.lit(False))
    a = df.agg(n.alias("n"), F.count_if(~anymiss).alias("full"), *[F.count_if(m).alias(f"m_{i}") for i, m in enumerate(miss.values())])
    ms = [F.col(f"m_{i}") for i in range(len(miss))]
    num = [F.col(f"m_{i}") for i, c in enumerate(miss) if c in nums]
    total = F.greatest(F.col("n"), F.lit(1))
    x = a.select(
        (1 - sum(ms, F.lit(0)) / (total * len(ms))).alias("cell_share"), (F.col("full") / total).alias("row_share"),
        (sum([(m == 0).cast("int") for m in ms], F.lit(0)) / len(ms)).alias("column_share"), (1 - sum(num, F.lit(0)) / (total * max(len(num), 1))).alias("numeric_share"),
    )
    return x.withColumn("score", F.round(100 * (0.40 * F.col("cell_share") + 0.25 * F.col("row_share") + 0.20 * F.col("column_share") + 0.15 * F.col("numeric_share")), 4))


def uniqueness(df: DataFrame, identifier: str) -> DataFrame:
    """(distinct_share, constant_columns, near_constant_columns, identifier_repeats, score)."""
    t = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("d"), F.sum("_n").alias("n"))
    longs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("x")).select("x.*").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    top = longs.groupBy("c").agg((F.max("n") / F.sum("n")).alias("top"), F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") == 1).alias("constant_columns"), F.count_if((F.col("k") > 1) & (F.col("top") > 0.95)).alias("near_constant_columns"))
    rep = longs.where(F.col("c") == identifier).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("identifier_repeats"))
    x = t.crossJoin(top).crossJoin(rep)
    return x.select((F.col("d") / F.greatest("n", F.lit(1))).alias("distinct_share"), "constant_columns", "near_constant_columns", "identifier_repeats").withColumn(
        "score", F.greatest(F.round(100 * F.col("distinct_share") - 15 * F.col("constant_columns") - 8 * F.col("near_constant_columns") - F.when(F.col("identifier_repeats") > 0, 20).otherwise(0), 4), F.lit(0.0))
    )


def validity(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(column_name, invalid, share): values outside the range that the column's meaning allows."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if((finite(df.schema, c) < lo) | (finite(df.schema, c) > hi)).alias(c) for c, (lo, hi) in ranges.items()])
    return wide.unpivot(["_n"], list(ranges), "column_name", "invalid").select("column_name", "invalid", (F.col("invalid") / F.greatest("_n", F.lit(1))).alias("share"))


def text_hygiene(df: DataFrame) -> DataFrame:
    """(column_name, padded, cased, hidden_numbers): stray white space, values that equal another but for case, numbers kept as text."""
    s = text_columns(df.schema)
    longs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in s])).alias("x")).select("x.*").where("v IS NOT NULL").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    low = longs.groupBy("column_name", F.lower(F.trim("v")).alias("k")).agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum(F.when(F.col("v") != F.trim("v"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.trim("v").rlike(r"^[+-]?\d+(\.\d+)?$"), F.col("n")).otherwise(0)).alias("h"))
    return low.groupBy("column_name").agg(F.sum("p").alias("padded"), F.sum(F.col("n") - F.col("top")).alias("cased"), F.sum("h").alias("hidden_numbers"))


def distribution_score(df: DataFrame, name: str) -> DataFrame:
    """(skew_g1, outlier_rate, score): .3 skew, .3 outliers, .4 spread; skewness with the bias correction."""
    from cairn.operators.outliers import quartile_bounds

    v = finite(df.schema, name)
    m = df.agg(F.count(v).alias("n"), F.skewness(v).alias("g")).select("n", (F.col("g") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2)).alias("skew_g1"))
    o = df.select(v.alias("v")).where("v IS NOT NULL").crossJoin(F.broadcast(quartile_bounds(df, name))).agg(F.avg(((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).cast("double")).alias("outlier_rate"))
    floor0 = lambda c: F.greatest(c, F.lit(0.0))
    return m.crossJoin(o).select("skew_g1", "outlier_rate", F.round((0.3 * floor0(100 - 10 * F.abs("skew_g1")) + 0.3 * floor0(100 - 500 * F.col("outlier_rate"))) / 0.6, 4).alias("score"))


def readiness(df: DataFrame) -> DataFrame:
    """(n_rows, missing_rate, duplicate_rate, constant_columns, score, grade): six checks weighted 20, 25, 15, 10, 15, 15."""
    from cairn.operators.profile import dataset_stats, duplicate_rows

    st, du = dataset_stats(df), duplicate_rows(df)
    varied = cell_counts(df, df.columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("d")).agg(F.count_if(F.col("d") > 1).alias("varied"))
    x = st.crossJoin(du.select("duplicates")).crossJoin(varied.select((F.lit(len(df.columns)) - F.col("varied")).alias("constant_columns")))
    mr, dr = F.col("missing_total") / F.greatest(F.col("n_rows") * F.col("n_columns"), F.lit(1)), F.col("duplicates") / F.greatest("n_rows", F.lit(1))
    size = F.when(F.col("n_rows") >= 10000, 20).when(F.col("n_rows") >= 1000, 15).when(F.col("n_rows") >= 100, 10).otherwise(5)
    score = size + F.floor(25 * (1 - F.least(mr * 2, F.lit(1.0)))) + F.floor(15 * (1 - F.least(dr * 5, F.lit(1.0)))) + F.when(F.col("constant_columns") == 0, 10).otherwise(0) + F.when(F.col("n_numeric") >= 1, 15).otherwise(5) + F.when(F.col("n_columns") >= 3, 15).otherwise(8)
    out = x.select("n_rows", F.round(mr, 6).alias("missing_rate"), F.round(dr, 6).alias("duplicate_rate"), "constant_columns", score.cast("int").alias("score"))
    return out.withColumn("grade", grade(F.col("score"), [(90, "A"), (75, "B"), (60, "C"), (40, "D")], "F"))


def grade(c: Column, tiers: list[tuple[float, str]], rest: str) -> Column:
    out = None
    for bound, name in tiers:
        out = F.when(c >= bound, name) if out is None else out.when(c >= bound, name)
    return out.otherwise(rest)


# Weights of the quality dimensions.
WEIGHTS = {"completeness": 0.22, "uniqueness": 0.15, "validity": 0.18, "consistency": 0.15, "integrity": 0.10, "distribution": 0.10, "readiness": 0.10}


def overall(scores: dict[str, float | None]) -> tuple[float, str]:
    """(score, grade): a dimension that failed counts 50."""
    s = sum(w * (50.0 if scores.get(k) is None else scores[k]) for k, w in WEIGHTS.items())
    return round(s, 2), next((g for b, g in ((90, "A"), (75, "B"), (60, "C"), (45, "D")) if s >= b), "F")


def target_candidates(df: DataFrame) -> DataFrame:
    """(column_name, score, task): how likely each column is the target, by place, name, cardinality and gaps."""
    names = df.columns
    a = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.approx_count_distinct(value(df.schema, c)).alias("d"), F.count_if(value(df.schema, c).isNull()).alias("m")).alias(c) for c in names]).first()
    nums, out = set(numeric_columns(df.schema)), []
    for i, c in enumerate(names):
        d, m, n = a[c]["d"], a[c]["m"], max(a["n"], 1)
        s = 30 * (i == len(names) - 1) - 20 * (i == 0)
        low = c.lower()
        s += 40 if low in ("target", "label", "class", "y") else 35 if re.search(r"target|label|churn|outcome|status|flag|class|result|default", low) else 0
        s += 35 * (d == 2) + 25 * (2 < d <= 10) - 30 * (d > 0.9 * n and c not in nums) - 20 * (m > 0.1 * n) - 40 * bool(re.search(r"(^|_)id$|key$", low))
        out.append((c, float(s), "classification" if d <= 20 else "regression"))
    return df.sparkSession.createDataFrame(out, "column_name string, score double, task string")


def advise_split(n: int, ratio: float) -> tuple[float, int, bool]:
    """(test share, folds, stratify) for a table of n rows and that class ratio."""
    return (0.2 if n < 10_000 else 0.15 if n < 100_000 else 0.1), (5 if n < 10_000 else 3), ratio > 3


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """(classes, ratio, gini, entropy, effective_n, level): tiers at 1.5, 3, 10 and 100."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.count(F.lit(1)).alias("classes"), (F.max("n") / F.min("n")).alias("ratio"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * F.log2("n")).alias("nl"))
    e = F.log2("t") - F.col("nl") / F.col("t")
    level = F.when(F.col("ratio") < 1.5, "balanced").when(F.col("ratio") < 3, "mild").when(F.col("ratio") < 10, "moderate").when(F.col("ratio") < 100, "severe").otherwise("extreme")
    return t.select("classes", "ratio", (1 - F.col("sq") / (F.col("t") * F.col("t"))).alias("gini_impurity"), e.alias("entropy"), F.pow(F.lit(2.0), e).alias("effective_classes"), level.alias("level"))


def encoding_advice(df: DataFrame, target: str) -> DataFrame:
    """(column_name, distinct_count, eta2, encoding) of text columns."""
    from cairn.operators.association import correlation_ratio

    out = []
    for c in text_columns(df.schema):
        d = df.agg(F.count_distinct(c).alias("d")).first()["d"]
        e = correlation_ratio(df, c, target).first()["eta2"] if d <= 200 else None
        enc = "binary" if d == 2 else "one_hot" if d <= 10 else "label" if d <= 50 else ("target" if (e or 0) > 0.05 else "frequency") if d <= 200 else "hash"
        out.append((c, d, e, enc))
    return df.sparkSession.createDataFrame(out, "column_name string, distinct_count long, eta2 double, encoding string")


def regression_metrics(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """(rmse, mae, r2, mape)."""
    x = df.select(y.cast("double").alias("y"), p.cast("double").alias("p")).dropna()
    e = F.col("y") - F.col("p")
    return x.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"), F.avg(F.abs(e / F.when(F.col("y") != 0, F.col("y")))).alias("mape"))


def binary_metrics(df: DataFrame, y: Column, score: Column, cut: float = 0.5) -> DataFrame:
    """(accuracy, precision_, recall, f1, mcc, auc, logloss); the area comes from score counts, not from sorted rows."""
    from cairn.operators.relational import running

    x = df.select(y.cast("int").alias("y"), score.cast("double").alias("s")).dropna()
    hit = lambda a, b: F.count_if((F.col("y") == a) & ((F.col("s") >= cut) == F.lit(b))).cast("double")
    q = F.greatest(F.least(F.col("s"), F.lit(1 - 1e-15)), F.lit(1e-15))
    c = x.agg(hit(1, True).alias("tp"), hit(0, True).alias("fp"), hit(1, False).alias("fn"), hit(0, False).alias("tn"), F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))).alias("logloss"))
    g = x.groupBy("s").agg(F.sum("y").alias("p"), (F.count(F.lit(1)) - F.sum("y")).alias("n"))
    auc = running(g, "s", ["n"]).withColumn("b", F.col("cum_n") - F.col("n")).agg((F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    z = F.lit(0.0)
    div = lambda a, b: F.coalesce(a / F.nullif(b, z), z)
    return c.crossJoin(auc).select(
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), div(tp, tp + fp).alias("precision_"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), "auc", "logloss",
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """(schema_hash, content_hash, n_rows): order-independent digest of all rows, sums of 32-bit parts of row digests."""
    row = F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long") % 1000000007).alias(f"p{i}") for i in range(4)]
    schema = hashlib.sha256("|".join(f"{n}:{t}" for n, t in sorted(df.dtypes)).encode()).hexdigest()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *parts).select(F.lit(schema).alias("schema_hash"), F.md5(F.concat_ws("-", "p0", "p1", "p2", "p3", "n_rows")).alias("content_hash"), "n_rows")


def dna(df: DataFrame) -> dict:
    """The fingerprint of a table as plain numbers: moments, entropies, cardinalities, gaps."""
    nums = numeric_columns(df.schema)
    a = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.approx_count_distinct(value(df.schema, c)).alias("d"), F.count_if(value(df.schema, c).isNull()).alias("m"), *([F.avg(finite(df.schema, c)).alias("mean"), F.stddev_pop(finite(df.schema, c)).alias("std"), F.skewness(finite(df.schema, c)).alias("skew")] if c in nums else [])).alias(c) for c in df.columns]).first()
    n = max(a["n"], 1)
    return {"n": a["n"], "columns": {c: {"distinct": a[c]["d"] / n, "missing": a[c]["m"] / n, **({k: a[c][k] for k in ("mean", "std", "skew")} if c in nums else {})} for c in df.columns}}


def dna_similarity(a: dict, b: dict) -> float:
    """0..1: structure .5, statistics .5, over the columns of either."""
    ca, cb = a["columns"], b["columns"]
    both = set(ca) & set(cb)
    structure = len(both) / max(len(set(ca) | set(cb)), 1)
    stat = []
    for c in both:
        for k in set(ca[c]) & set(cb[c]):
            x, y = ca[c][k] or 0.0, cb[c][k] or 0.0
            stat.append(1 - min(1.0, abs(x - y) / (abs(x) + abs(y) + 1e-9)))
    return 0.5 * structure + 0.5 * (math.fsum(stat) / len(stat) if stat else 0.0)
