"""Scores and verdicts that combine other operators' numbers, and small tests on the driver's side."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairn.functions import distributions as D
from cairn.operators.profile import finite
from cairn.operators.relational import running


def correlation_tests(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(a, b, r, n, p, p_adjusted, effect): two-sided p of each pair, false discoveries controlled over all pairs."""
    rows = [r for r in pairs.collect()]  # as many as pairs of columns
    ps = []
    for r in rows:
        if r["r"] is None or r["n"] < 3:
            ps.append(1.0)
        else:
            q = max(1 - r["r"] ** 2, 1e-15)
            ps.append(D.t_sf2(abs(r["r"]) * math.sqrt((r["n"] - 2) / q), r["n"] - 2))
    order, adj, best = np.argsort(ps)[::-1], [0.0] * len(ps), 1.0
    for k, i in enumerate(order):
        best = min(best, ps[i] * len(ps) / (len(ps) - k))
        adj[i] = best
    effect = lambda r: "none" if r is None or abs(r) < 0.1 else "small" if abs(r) < 0.3 else "medium" if abs(r) < 0.5 else "large"
    return pairs.sparkSession.createDataFrame([(r["a"], r["b"], r["r"], r["n"], float(p), float(q), effect(r["r"])) for r, p, q in zip(rows, ps, adj)], "a string, b string, r double, n long, p double, p_adjusted double, effect string")


def independence(table: DataFrame) -> DataFrame:
    """(chi2, dof, p) from the statistics of ``association.contingency``."""
    r = table.first()
    return table.sparkSession.createDataFrame([(r["chi2"], r["dof"], D.chi2_sf(r["chi2"], r["dof"]) if r["dof"] else 1.0)], "chi2 double, dof long, p double")


def dixon(df: DataFrame, group: str, name: str) -> DataFrame:
    """(grp, n, q_low, q_high): gap to the neighbour over the range, for groups of 3 to 30 values; larger groups are not tested."""
    v = finite(df.schema, name)
    x = df.select(F.col(group).alias("grp"), v.alias("v")).where("v IS NOT NULL")
    ok = x.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 3 AND 30")
    a = x.join(ok, "grp").groupBy("grp", "n").agg(F.array_sort(F.collect_list("v")).alias("a"))
    span = F.nullif(F.col("a")[F.col("n") - 1] - F.col("a")[0], F.lit(0.0))
    return a.select("grp", "n", ((F.col("a")[1] - F.col("a")[0]) / span).alias("q_low"), ((F.col("a")[F.col("n") - 1] - F.col("a")[F.col("n") - 2]) / span).alias("q_high"))


def transforms(df: DataFrame, name: str) -> DataFrame:
    """(transform, skew) of a column and its usual transforms, one scan; null where a transform isn't defined."""
    v = finite(df.schema, name)
    lo = F.min(v)
    t = {"none": v, "log1p": F.when(v > -1, F.log1p(v)), "sqrt": F.when(v >= 0, F.sqrt(v)), "square": v * v, "cbrt": F.cbrt(v), "reciprocal": F.when(v != 0, 1 / v)}
    wide = df.agg(lo.alias("_lo"), *[F.when(F.count(c) == F.count(v), F.skewness(c)).alias(k) for k, c in t.items()])
    return wide.unpivot(["_lo"], list(t), "transform", "skew").select("transform", "skew")


def normality(df: DataFrame, name: str) -> DataFrame:
    """(test, statistic, p, normal): skewness and kurtosis tests by their z, their joint test, and the distance to the normal distribution."""
    v = finite(df.schema, name)
    s = df.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")).first()
    n, out = s["n"], []
    if n >= 8 and s["s"]:
        z1, z2 = s["g1"] / math.sqrt(6 / n), s["g2"] / math.sqrt(24 / n)
        out += [("skewness", z1, 2 * (1 - D.normal_cdf(abs(z1)))), ("kurtosis", z2, 2 * (1 - D.normal_cdf(abs(z2)))), ("jarque_bera", z1 * z1 + z2 * z2, D.chi2_sf(z1 * z1 + z2 * z2, 2))]
        c = df.select(v.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
        # the normal distribution function by its usual rational approximation, in the JVM
        z = (F.col("v") - s["m"]) / s["s"]
        t = 1 / (1 + 0.2316419 * F.abs(z))
        tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        d = running(c, "v", ["k"]).withColumn("f", F.col("cum_k") / n).select(F.greatest(F.abs(F.col("f") - F.when(z >= 0, 1 - tail).otherwise(tail)), F.abs(F.col("f") - F.col("k") / n - F.when(z >= 0, 1 - tail).otherwise(tail))).alias("d")).agg(F.max("d").alias("d")).first()["d"]
        lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
        p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)) if lam > 0.2 else 1.0
        out.append(("kolmogorov", d, min(max(p, 0.0), 1.0)))
    return df.sparkSession.createDataFrame([(a, float(b), float(c), c >= 0.05) for a, b, c in out], "test string, statistic double, p double, normal boolean")


def partial_autocorrelation(acf: list[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations at lags 1.., by the Durbin-Levinson recursion."""
    phi, out = {}, []
    for k in range(1, len(acf) + 1):
        num = acf[k - 1] - sum(phi[k - 1, j] * acf[k - j - 1] for j in range(1, k))
        den = 1 - sum(phi[k - 1, j] * acf[j - 1] for j in range(1, k))
        phi[k, k] = num / den if den else 0.0
        for j in range(1, k):
            phi[k, j] = phi[k - 1, j] - phi[k, k] * phi[k - 1, k - j]
        out.append(phi[k, k])
    return out


def split_shift(df: DataFrame, names: list[str], side) -> DataFrame:
    """(column_name, d, w1, significant): distribution shift of each column between two splits, ranges made equal."""
    from cairn.operators.association import ks_two_sample

    out = None
    for c in names:
        v = finite(df.schema, c)
        r = df.agg(F.min(v).alias("a"), F.max(v).alias("b")).first()
        scale = (r["b"] - r["a"]) if r["a"] is not None and r["b"] > r["a"] else 1.0
        k = ks_two_sample(df, c, side)
        crit = 1.3581 * F.sqrt((F.col("n_a") + F.col("n_b")) / (F.col("n_a") * F.col("n_b")))
        row = k.select(F.lit(c).alias("column_name"), "d", (F.col("w1") / scale).alias("w1"), (F.col("d") > crit).alias("significant"))
        out = row if out is None else out.union(row)
    return out


def effective_rank(df: DataFrame, name: str) -> DataFrame:
    """(points, diversity): exponential of the entropy of the kernel's eigenvalues over all vectors.

    The kernel X X' / n has the nonzero eigenvalues of X' X / n, the second moments of the normalised
    vectors, which one aggregation gives; the driver sees columns squared numbers.
    """
    vectors = df.where(F.col(name).isNotNull()).select(F.col(name).cast("array<double>").alias("v"))
    got = vectors.mapInPandas(_moments, "i int, j int, m double, n long").groupBy("i", "j").agg(F.sum("m").alias("m"), F.sum("n").alias("n")).collect()
    if not got:
        return df.sparkSession.createDataFrame([(0, 0.0)], "points long, diversity double")
    size, n = 1 + max(r.i for r in got), max(r.n for r in got)
    a = np.zeros((size, size))
    for r in got:
        a[r.i, r.j] = a[r.j, r.i] = r.m / n
    w = np.linalg.eigvalsh(a)
    w = w[w > 1e-12]
    return df.sparkSession.createDataFrame([(n, float(np.exp(-(w * np.log(w)).sum())))], "points long, diversity double")


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second moments (upper triangle) of the normalised vectors of one partition, and their number."""
    m, n = None, 0
    for pdf in batches:
        if len(pdf):
            x = np.stack(pdf["v"].to_numpy())
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            m, n = x.T @ x if m is None else m + x.T @ x, n + len(x)
    if m is not None:
        i, j = np.triu_indices(len(m))
        yield pd.DataFrame({"i": i, "j": j, "m": m[i, j], "n": n})


def weighted(scores: dict[str, float | None], weights: dict[str, float], blocking: bool = False) -> float:
    """A weighted mean over the scores that exist; anything blocking caps it at 50."""
    have = {k: v for k, v in scores.items() if v is not None}
    total = sum(weights[k] for k in have)
    s = sum(weights[k] * v for k, v in have.items()) / total if total else 0.0
    return round(min(s, 50.0) if blocking else s, 2)


# Weights of the readiness dimensions, of label quality and of bias.
READY = {"size": 0.20, "quality": 0.18, "balance": 0.17, "labels": 0.15, "split": 0.10, "leakage": 0.08, "diversity": 0.07, "shift": 0.05}
LABELS = {"noise": 0.30, "inconsistent": 0.20, "ambiguous": 0.15, "drift": 0.15, "imbalance": 0.10, "confidence": 0.10}
BIAS = {"representation": 0.20, "outcome": 0.30, "proxy": 0.20, "historical": 0.15, "measurement": 0.15}
