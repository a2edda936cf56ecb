"""Outlier detection. Bounds come from one aggregation and are broadcast as one row; rows are never collected.

Defined results: missing and infinite values are never outliers. A column without spread has none, but
for the median deviation, which falls back to the quartile rule. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cairn.operators.profile import finite
from cairn.operators.relational import quantiles
from cairn.session import cut


def quartile_bounds(df: DataFrame, name: str, k: float = 1.5) -> DataFrame:
    """(lo, hi, iqr), the quartiles from value counts."""
    q = quantiles(df, {name: finite(df.schema, name)}, [0.25, 0.75])
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select((F.col("q")[0] - k * iqr).alias("lo"), (F.col("q")[1] + k * iqr).alias("hi"), iqr.alias("iqr"))


def by_quartiles(df: DataFrame, key: str, name: str, k: float = 1.5) -> DataFrame:
    """(key, value, score): values strictly outside the fences, scored by their distance in interquartile ranges."""
    v = finite(df.schema, name)
    out = df.select(key, v.alias("value")).crossJoin(F.broadcast(quartile_bounds(df, name, k))).where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    return out.select(key, "value", (F.greatest(F.col("lo") - F.col("value"), F.col("value") - F.col("hi")) / F.nullif("iqr", F.lit(0.0))).alias("score"))


def by_zscore(df: DataFrame, key: str, name: str, limit: float = 3.0) -> DataFrame:
    """(key, value, score): more than ``limit`` sample deviations from the mean."""
    v = finite(df.schema, name)
    m = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    z = F.abs(F.col("value") - F.col("m")) / F.col("s")
    return df.select(key, v.alias("value")).crossJoin(F.broadcast(m)).where((F.col("s") > 1e-12) & (z > limit)).select(key, "value", z.alias("score"))


def by_median(df: DataFrame, key: str, name: str, limit: float = 3.5) -> DataFrame:
    """(key, value, score): modified z-score by the median deviation; without deviation the quartile rule decides."""
    from cairn.operators.profile import median_deviation

    v = finite(df.schema, name)
    bounds = median_deviation(df, name).crossJoin(quartile_bounds(df, name))
    x = df.select(key, v.alias("value")).crossJoin(F.broadcast(bounds))
    z = F.when(F.col("mad") > 1e-12, 0.6745 * F.abs(F.col("value") - F.col("median_value")) / F.col("mad"))
    hit = F.when(F.col("mad") > 1e-12, z > limit).otherwise((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    return x.where(hit).select(key, "value", z.alias("score"))


def consensus(df: DataFrame, key: str, names: list[str], share: float = 0.5) -> DataFrame:
    """(key, votes, fraction): the univariate rules together as one vote, each multivariate detector as another.

    Rows flagged by at least ``share`` of the detectors (univariate, Mahalanobis, isolation forest).
    """
    found = [vote(df, key, names).select(key), by_mahalanobis(df, key, names).select(key), isolation_forest(df, key, names).select(key)]
    hits = None
    for i, f in enumerate(found):
        f = f.distinct().withColumn("kind", F.lit(i))
        hits = f if hits is None else hits.union(f)
    v = hits.groupBy(key).agg(F.count(F.lit(1)).alias("votes")).withColumn("fraction", F.col("votes") / len(found))
    return v.where(F.col("fraction") >= share)


def vote(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, votes): how many of quartile rule, z-score and modified z-score flag any of the columns."""
    kinds = [(by_quartiles, 0), (by_zscore, 1), (by_median, 2)]
    hits = None
    for f, i in kinds:
        for c in names:
            h = f(df, key, c).select(key, F.lit(i).alias("kind"))
            hits = h if hits is None else hits.union(h)
    return hits.groupBy(key).agg(F.count_distinct("kind").alias("votes"))


def winsorize(df: DataFrame, name: str, k: float = 1.5) -> DataFrame:
    """The table with the column pulled in to its fences."""
    b = quartile_bounds(df, name, k)
    return df.crossJoin(F.broadcast(b)).select(*[F.greatest(F.least(F.col(c), F.col("hi")), F.col("lo")).alias(c) if c == name else F.col(c) for c in df.columns])


def density(df: DataFrame, names: list[str]) -> DataFrame:
    """(outlier_cells, cells, density) over columns with eight values and a spread."""
    total = None
    for c in names:
        v = finite(df.schema, c)
        x = df.select(v.alias("v")).where("v IS NOT NULL").crossJoin(F.broadcast(quartile_bounds(df, c))).where("iqr > 0").agg(F.count_if((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).alias("o"), F.count(F.lit(1)).alias("n")).where("n >= 8")
        total = x if total is None else total.union(x)
    return total.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("outlier_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("cells")).withColumn("density", F.col("outlier_cells") / F.greatest("cells", F.lit(1)))


def extremes_test(df: DataFrame, key: str, name: str, alpha: float = 0.05, most: int = 10, kind: str = "grubbs") -> DataFrame:
    """(key, value, round): Grubbs' test repeated, or the generalised test (the last significant round decides).

    Only the ``most`` lowest and highest values reach the driver; removing one updates the moments.
    """
    from cairn.functions.distributions import t_quantile

    v = finite(df.schema, name)
    x = df.select(key, v.alias("value")).where("value IS NOT NULL")
    m = x.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("s2")).first()
    low, high = x.orderBy("value", key).limit(most).collect(), x.orderBy(F.desc("value"), key).limit(most).collect()
    pool = {r[key]: float(r["value"]) for r in low + high}
    n, mean, ss = m["n"], m["m"], (m["s2"] or 0.0) * (m["n"] - 1)
    rounds = []
    while pool and len(rounds) < most and n >= 6 and ss > 1e-12:
        s = math.sqrt(ss / (n - 1))
        k = max(pool, key=lambda i: (abs(pool[i] - mean), str(i)))
        g = abs(pool[k] - mean) / s
        t = t_quantile(1 - alpha / (2 * n), n - 2)
        crit = (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))
        rounds.append((k, pool[k], g > crit))
        if kind == "grubbs" and g <= crit:
            break
        val = pool.pop(k)
        new = (n * mean - val) / (n - 1)
        ss -= (val - mean) * (val - new)
        mean, n = new, n - 1
    last = max([i for i, r in enumerate(rounds) if r[2]], default=-1)
    schema = T.StructType([*x.schema.fields, T.StructField("round", T.IntegerType())])
    return df.sparkSession.createDataFrame([(k, val, i + 1) for i, (k, val, _) in enumerate(rounds[: last + 1])], schema)


def by_mahalanobis(df: DataFrame, key: str, names: list[str], share: float = 0.975) -> DataFrame:
    """(key, distance): squared Mahalanobis distance beyond the chi-square quantile. The covariance is one small row."""
    from cairn.functions.distributions import chi2_quantile

    vs = [finite(df.schema, c) for c in names]
    full = df.select(key, *[v.alias(f"x{i}") for i, v in enumerate(vs)]).dropna()
    p = len(names)
    row = full.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    inv = np.linalg.pinv(cov)
    d = sum(((F.col(f"x{i}") - row[f"m{i}"]) * (F.col(f"x{j}") - row[f"m{j}"]) * float(inv[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))
    return full.select(key, d.alias("distance")).where(F.col("distance") > chi2_quantile(share, p))


def isolation_forest(df: DataFrame, key: str, names: list[str], trees: int = 50, sample: int = 256, contamination: float = 0.05, seed: int = 7) -> DataFrame:
    """(key, score): the highest share of isolation scores.

    The trees are grown on a bounded seeded sample (``trees`` x ``sample`` rows) and scored as plain
    column expressions of bounded depth, in one scan.
    """

    vs = [finite(df.schema, c) for c in names]
    full = df.select(key, *[v.alias(f"x{i}") for i, v in enumerate(vs)]).dropna()
    rows = full.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(trees * sample).toPandas()
    x = rows[[f"x{i}" for i in range(len(names))]].to_numpy(float)
    if len(x) < 20:
        return full.select(key, F.lit(0.0).alias("score")).limit(0)
    rng = np.random.default_rng(seed)
    size, limit = min(sample, len(x)), math.ceil(math.log2(max(min(sample, len(x)), 2)))
    c = lambda n: 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def grow(part: np.ndarray, depth: int):
        lo, hi = part.min(0), part.max(0)
        able = np.nonzero(hi > lo)[0]
        if depth >= limit or len(part) <= 1 or not len(able):
            return depth + c(len(part))
        f = int(rng.choice(able))
        s = float(rng.uniform(lo[f], hi[f]))
        return (f, s, grow(part[part[:, f] < s], depth + 1), grow(part[part[:, f] >= s], depth + 1))

    forest = [grow(x[rng.choice(len(x), size, replace=False)], 0) for _ in range(trees)]
    norm = c(size)
    cols = [f"x{i}" for i in range(len(names))]

    @F.pandas_udf("double")
    def score(part: pd.DataFrame) -> pd.Series:
        a = part.to_numpy(float)
        total = np.zeros(len(a))

        def walk(node, idx):
            if not isinstance(node, tuple):
                total[idx] += node
                return
            f, s, left, right = node
            m = a[idx, f] < s
            walk(left, idx[m])
            walk(right, idx[~m])

        for t in forest:
            walk(t, np.arange(len(a)))
        return pd.Series(2.0 ** (-(total / len(forest)) / norm))

    scored = cut(full.select(key, score(F.struct(*cols)).alias("score")))  # scored once, for the bound and the result
    bound = scored.agg(F.percentile_approx("score", 1 - contamination, 10000).alias("b"))
    return scored.crossJoin(F.broadcast(bound)).where("score >= b").select(key, "score")


def local_outlier_factor(df: DataFrame, key: str, names: list[str], k: int = 10, contamination: float = 0.05) -> DataFrame:
    """(key, score): local outlier factor over the exact nearest neighbours, columns scaled to their ranges.

    Of equal rows the first k + 1 can be neighbours; all further ones have the score of the next.
    """
    from cairn.operators.clean import nearest_rows

    lim = df.agg(*[F.struct(F.min(finite(df.schema, c)).alias("a"), F.max(finite(df.schema, c)).alias("b")).alias(f"r{i}") for i, c in enumerate(names)]).first()
    xs = [((finite(df.schema, c) - F.lit(lim[f"r{i}"]["a"])) / max((lim[f"r{i}"]["b"] or 0) - (lim[f"r{i}"]["a"] or 0), 1e-12)) for i, c in enumerate(names)]
    p = df.select(F.col(key).alias("k"), F.array(*xs).alias("x")).where(~F.exists("x", lambda e: e.isNull()))
    some = cut(p.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("k"))).where(F.col("r") <= k + 2))
    nb = cut(nearest_rows(some.select("k", "x"), some.select(F.col("k").alias("o"), F.col("x").alias("y")), k, itself=True))
    kd = nb.groupBy("k").agg(F.max("d").alias("kd"))
    reach = nb.join(kd.select(F.col("k").alias("o"), F.col("kd").alias("okd")), "o").select("k", "o", F.greatest("d", "okd").alias("rd"))
    lrd = reach.groupBy("k").agg((1 / (F.avg("rd") + 1e-12)).alias("lrd"))
    lof = nb.join(lrd.select(F.col("k").alias("o"), F.col("lrd").alias("ol")), "o").groupBy("k").agg(F.avg("ol").alias("ol")).join(lrd, "k").select("k", (F.col("ol") / F.col("lrd")).alias("score"))
    lof = cut(lof.join(some, "k"))
    further = lof.where(F.col("r") == k + 2).select("x", F.col("score").alias("as_next"))
    every = p.join(further, "x", "left").join(lof.select("k", "score"), "k", "left")
    lof = cut(every.select(F.col("k").alias(key), F.coalesce("score", "as_next").alias("score")).where("score IS NOT NULL"))
    bound = lof.agg(F.percentile_approx("score", 1 - contamination, 10000).alias("b"))
    return lof.crossJoin(F.broadcast(bound)).where("score >= b").select(key, "score")


def density_noise(df: DataFrame, key: str, names: list[str], eps: float = 0.05, min_points: int = 5) -> DataFrame:
    """(key): points that density clustering leaves out: no core point (``min_points`` within ``eps``, itself counted) in reach.

    One or two columns, scaled to their ranges, on a grid whose cells are ``eps`` across the diagonal. In
    a cell of enough points all are core, so only points of sparse cells (fewer than ``min_points`` each)
    look around; no pairs are made within a crowded cell.
    """
    if not 1 <= len(names) <= 2:
        raise ValueError("one or two columns")
    lim = df.agg(*[F.struct(F.min(finite(df.schema, c)).alias("a"), F.max(finite(df.schema, c)).alias("b")).alias(f"r{i}") for i, c in enumerate(names)]).first()
    xs = [(finite(df.schema, c) - F.lit(lim[f"r{i}"]["a"])) / max((lim[f"r{i}"]["b"] or 0) - (lim[f"r{i}"]["a"] or 0), 1e-12) for i, c in enumerate(names)]
    side = eps / math.sqrt(len(names))
    p = df.select(F.col(key).alias("k"), F.array(*xs).alias("x")).where(~F.exists("x", lambda e: e.isNull()))
    p = p.withColumn("cell", F.transform("x", lambda e: F.floor(e / side).cast("int")))
    cells = p.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    p = p.join(cells, "cell")
    sparse = p.where(F.col("n") < min_points)
    reach = [[]]
    for _ in names:
        reach = [r + [s] for r in reach for s in (-2, -1, 0, 1, 2)]
    steps = F.array(*[F.array(*[F.lit(s) for s in r]) for r in reach])
    ask = sparse.select("k", "x", F.col("cell").alias("c"), F.explode(steps).alias("s")).select("k", "x", F.zip_with("c", "s", lambda a, b: a + b).alias("cell"))
    d2 = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    near = ask.join(p.select("cell", F.col("k").alias("o"), F.col("x").alias("y"), F.col("n").alias("on")), "cell").where(d2 <= eps * eps)
    per = near.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max((F.col("on") >= min_points).cast("int")).alias("dense"))
    core = per.where(F.col("c") >= min_points).select(F.col("k").alias("o"))
    open_ = per.where((F.col("c") < min_points) & (F.col("dense") == 0)).select("k")
    saved = near.where(F.col("on") < min_points).select("k", "o").join(core, "o", "left_semi").select("k").distinct()
    return open_.join(saved, "k", "left_anti").select(F.col("k").alias(key))


def choose(n: int, columns: int, skew: float, normal: bool) -> str:
    """The detector for a table, by its size and shape."""
    if n < 30:
        return "quartiles" if n < 6 else "grubbs"
    if columns == 1:
        return "zscore" if normal else "median" if abs(skew) > 1 else "quartiles"
    if n < 100:
        return "mahalanobis"
    return "forest" if columns > 10 or n >= 1000 else "lof"
