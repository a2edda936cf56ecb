"""Leakage, label quality, fairness and readiness of training data.

Measures are counts per group from one aggregation; only group tables (bounded by the number of groups)
are joined or windowed. Groups smaller than the given floor report null rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.operators.profile import corr, finite


def group_leakage(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """(test_rows, contaminated_rows, ratio): test rows whose group occurs in train."""
    g = train.select(F.col(group).alias("_g")).distinct().withColumn("_in", F.lit(1))
    x = test.join(g, F.col(group) == F.col("_g"), "left")
    return x.agg(F.count(F.lit(1)).alias("test_rows"), F.count("_in").alias("contaminated_rows")).withColumn("ratio", F.col("contaminated_rows") / F.greatest("test_rows", F.lit(1)))


def inconsistent_labels(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """(groups, rows, conflicting_groups, conflicting_rows): equal features with different labels."""
    g = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min(label).alias("_a"), F.max(label).alias("_b"))
    clash = F.col("_a") != F.col("_b")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rows"), F.count_if(clash).alias("conflicting_groups"), F.coalesce(F.sum(F.when(clash, F.col("_n"))), F.lit(0)).alias("conflicting_rows"))


def k_anonymity(df: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """(groups, small_groups, small_rows, smallest)."""
    g, small = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), F.col("_n") < k
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(small).alias("small_groups"), F.coalesce(F.sum(F.when(small, F.col("_n"))), F.lit(0)).alias("small_rows"), F.min("_n").alias("smallest"))


def preprocessing_leakage(df: DataFrame, name: str, train: Column) -> DataFrame:
    """(train_mean, full_mean, relative_gap, suspicious): statistics of train that equal those of all rows."""
    v = finite(df.schema, name)
    a = df.agg(F.avg(F.when(train, v)).alias("train_mean"), F.avg(v).alias("full_mean"))
    gap = F.abs(F.col("train_mean") - F.col("full_mean")) / F.nullif(F.abs("full_mean"), F.lit(0.0))
    return a.withColumn("relative_gap", gap).withColumn("suspicious", F.col("relative_gap") < 1e-6)


# Penalties by severity.
PENALTY = {"critical": 25.0, "high": 15.0, "medium": 8.0, "low": 3.0, "info": 1.0}


def leakage_score(findings: list[tuple[str, float, bool]]) -> tuple[float, str]:
    """(score, verdict) of (severity, confidence, confirmed) findings."""
    s = max(0.0, 100 - sum(PENALTY[k] * c * (1 if sure else 0.5) for k, c, sure in findings))
    return round(s, 2), next((g for b, g in ((90, "A"), (70, "B"), (50, "C"), (30, "D")) if s >= b), "F")


def confident_joint(df: DataFrame, label: str, probs: list[str]) -> DataFrame:
    """(given, guess, n): confident learning's joint; a row counts for the likeliest class that reaches its mean self-probability."""
    p = F.array(*[F.col(c).cast("double") for c in probs])
    x = df.select(F.col(label).cast("int").alias("given"), p.alias("p")).where("given IS NOT NULL")
    t = x.groupBy("given").agg(F.avg(F.col("p")[F.col("given")]).alias("t"))
    th = t.agg(F.map_from_entries(F.collect_list(F.struct("given", "t"))).alias("th"))  # as many entries as classes
    j = x.crossJoin(F.broadcast(th))
    ok = F.filter(F.transform(F.col("p"), lambda v, i: F.when(v >= F.col("th")[i], F.struct(v.alias("v"), (-i).alias("i")))), lambda e: e.isNotNull())
    guess = -F.array_max(ok)["i"]
    return j.select("given", guess.alias("guess")).where("guess IS NOT NULL").groupBy("given", "guess").agg(F.count(F.lit(1)).alias("n"))


def calibration(df: DataFrame, y: Column, score: Column, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, gap); bins are open below and closed above, zero belongs to the first."""
    x = df.select(y.cast("double").alias("y"), score.cast("double").alias("s")).dropna()
    b = F.greatest(F.ceil(F.col("s") * bins) - 1, F.lit(0)).cast("int")
    g = x.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("confidence"), F.avg("y").alias("accuracy"))
    return g.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def krippendorff(df: DataFrame, unit: str, label: str) -> DataFrame:
    """(alpha, units, ratings): nominal agreement from value counts per unit, linear in the ratings."""
    c = df.where(F.col(label).isNotNull()).groupBy(unit, F.col(label).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    u = c.groupBy(unit).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
    obs = u.agg(F.sum(F.col("same") / (F.col("m") - 1)).alias("agree"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("units"))
    exp = c.join(u.select(unit), unit).groupBy("v").agg(F.sum("n").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("e"))
    do = 1 - F.col("agree") / F.col("n")
    de = 1 - F.col("e") / (F.col("n") * (F.col("n") - 1))
    return obs.crossJoin(exp).select((1 - do / de).alias("alpha"), "units", F.col("n").alias("ratings"))


def class_outliers(df: DataFrame, key: str, label: str, names: list[str], limit: float = 3.0) -> DataFrame:
    """(key, label, max_z): rows whose largest z-score within their class exceeds the limit."""
    per = df.groupBy(F.col(label).alias("_l")).agg(*[F.avg(finite(df.schema, c)).alias(f"m_{c}") for c in names], *[F.stddev_samp(finite(df.schema, c)).alias(f"s_{c}") for c in names])
    zs = [F.abs(finite(df.schema, c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")) for c in names]
    top = F.array_max(F.array(*zs))
    return df.join(per, F.col(label) == F.col("_l")).select(key, label, top.alias("max_z")).where(F.col("max_z") > limit)


def sensitive_profile(df: DataFrame, name: str, small: int = 30) -> DataFrame:
    """(groups, entropy, majority_share, small_groups)."""
    c = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("t"), F.max("n").alias("top"), F.sum(F.col("n") * F.log2("n")).alias("nl"), F.count_if(F.col("n") < small).alias("small_groups"))
    return t.select("groups", (F.log2("t") - F.col("nl") / F.col("t")).alias("entropy"), (F.col("top") / F.col("t")).alias("majority_share"), "small_groups")


def group_metrics(df: DataFrame, group: str, y: Column, p: Column, floor: int = 5) -> DataFrame:
    """(grp, n, selection, tpr, fpr, ppv, ratio, fair): rates per group, the ratio to the best group (four fifths pass)."""
    x = df.select(F.col(group).cast("string").alias("grp"), y.cast("int").alias("y"), p.cast("int").alias("p")).dropna()
    hit = lambda a, b: F.count_if((F.col("y") == a) & (F.col("p") == b))
    g = x.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")).where(F.col("n") >= floor)
    d = lambda a, b: F.col(a) / F.nullif(sum([F.col(k) for k in b]), F.lit(0))
    r = g.select("grp", "n", ((F.col("tp") + F.col("fp")) / F.col("n")).alias("selection"), d("tp", ["tp", "fn"]).alias("tpr"), d("fp", ["fp", "tn"]).alias("fpr"), d("tp", ["tp", "fp"]).alias("ppv"))
    best = F.max("selection").over(Window.partitionBy())
    return r.withColumn("ratio", F.col("selection") / F.nullif(best, F.lit(0.0))).withColumn("fair", F.col("ratio") >= 0.8)


def label_rates(df: DataFrame, group: str, y: Column) -> DataFrame:
    """(grp, n, rate, gap): positive rates and their distance to the overall rate."""
    g = df.select(F.col(group).cast("string").alias("grp"), y.cast("int").alias("y")).dropna().groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    w = Window.partitionBy()
    return g.select("grp", "n", (F.col("k") / F.col("n")).alias("rate"), (F.col("k") / F.col("n") - F.sum("k").over(w) / F.sum("n").over(w)).alias("gap"))


def sampling_bias(df: DataFrame, group: str, train: Column) -> DataFrame:
    """(value, p, q, gap): group shares in train and in test."""
    from cairn.operators.drift import shares

    return shares(df, group, train).withColumn("gap", F.abs(F.col("p") - F.col("q")))


def intersections(df: DataFrame, names: list[str], y: Column, floor: int = 5) -> DataFrame:
    """Every combination of two and more attributes with its count, share and positive rate; one pass with grouping sets."""
    base = df.select(*[F.col(c).cast("string").alias(c) for c in names], y.cast("int").alias("_y"))
    n = base.count()
    c = base.cube(*names).agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate"), *[F.grouping(k).alias(f"_g{i}") for i, k in enumerate(names)])
    used = sum([1 - F.col(f"_g{i}") for i in range(len(names))])
    return c.where((used >= 2) & (F.col("n") >= floor)).select(*names, "n", (F.col("n") / n).alias("share"), "rate")


def mantel_haenszel(df: DataFrame, stratum: str, a: Column, b: Column) -> DataFrame:
    """(odds_ratio, strata): common odds ratio of two binary columns over strata."""
    x = df.select(F.col(stratum).alias("s"), a.cast("int").alias("a"), b.cast("int").alias("b")).dropna()
    hit = lambda i, j: F.count_if((F.col("a") == i) & (F.col("b") == j))
    g = x.groupBy("s").agg(F.count(F.lit(1)).alias("n"), hit(1, 1).alias("p"), hit(1, 0).alias("q"), hit(0, 1).alias("r"), hit(0, 0).alias("t"))
    return g.agg((F.sum(F.col("p") * F.col("t") / F.col("n")) / F.nullif(F.sum(F.col("q") * F.col("r") / F.col("n")), F.lit(0.0))).alias("odds_ratio"), F.count(F.lit(1)).alias("strata"))


def simpson(df: DataFrame, stratum: str, a: str, b: str, floor: int = 10) -> DataFrame:
    """(overall, strata, reversed, paradox): correlations within strata against the overall sign."""
    va, vb = finite(df.schema, a), finite(df.schema, b)
    o = df.agg(corr(va, vb).alias("overall"))
    g = df.select(F.col(stratum).alias("s"), va.alias("a"), vb.alias("b")).dropna().groupBy("s").agg(corr(F.col("a"), F.col("b")).alias("r"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= floor) & F.col("r").isNotNull())
    x = g.crossJoin(F.broadcast(o)).groupBy("overall").agg(F.count(F.lit(1)).alias("strata"), F.count_if(F.signum("r") * F.signum("overall") < 0).alias("reversed"))
    return x.withColumn("paradox", F.col("reversed") >= 0.6 * F.col("strata"))


def size_score(n: int, classes: list[int]) -> float:
    """Up to fifty points for the total, piecewise linear, and up to fifty for the smallest class."""
    steps = [(0, 0), (50, 5), (200, 15), (1000, 30), (5000, 42), (20000, 50)]
    total = 50.0
    for (a, x), (b, y) in zip(steps, steps[1:]):
        if n < b:
            total = x + (y - x) * (n - a) / (b - a)
            break
    least = min(classes or [0])
    return round(total + (50 if least >= 100 else 25 if least >= 10 else 5), 2)


def split_leakage(df: DataFrame, digest: Column, split: Column) -> DataFrame:
    """(split, shared, n): digests of a split that train has too."""
    x = df.select(digest.alias("h"), split.alias("split")).where("h IS NOT NULL AND split IS NOT NULL")
    per = x.groupBy("h").agg(F.collect_set("split").alias("s"))  # at most as many as splits
    return per.select("h", F.explode("s").alias("split"), F.array_contains("s", "train").alias("t")).where("split <> 'train'").groupBy("split").agg(F.count_if("t").alias("shared"), F.count(F.lit(1)).alias("n"))
