"""Tests between groups, chosen by what their assumptions allow.

Everything comes from moments, ranks by value counts, or counts of a contingency table; the driver sees a
row per group. Groups without spread or with fewer than two values take no part; with fewer than two groups
left a test has null statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cairn.functions import distributions as D
from cairn.operators import association as A
from cairn.operators.profile import finite


def moments(df: DataFrame, group: str, name: str) -> DataFrame:
    """(grp, n, m, v, g1, g2): size, mean, variance, skewness and kurtosis of each group."""
    x = df.select(F.col(group).cast("string").alias("grp"), finite(df.schema, name).alias("x")).dropna()
    return x.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"))


def bartlett(df: DataFrame, group: str, name: str) -> DataFrame:
    """(k2, dof, p): equal variances of all groups, for normal groups."""
    g = moments(df, group, name).where("n > 1 AND v > 0")
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"), F.sum((F.col("n") - 1) * F.log("v")).alias("lv"), F.sum(1 / (F.col("n") - 1)).alias("inv")).first()
    if (t["k"] or 0) < 2:
        return df.sparkSession.createDataFrame([(None, None, None)], "k2 double, dof long, p double")
    free = t["n"] - t["k"]
    k2 = (free * math.log(t["within"] / free) - t["lv"]) / (1 + (t["inv"] - 1 / free) / (3 * (t["k"] - 1)))
    return df.sparkSession.createDataFrame([(k2, t["k"] - 1, D.chi2_sf(k2, t["k"] - 1))], "k2 double, dof long, p double")


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a two by two table: the tables that are no likelier than this one."""
    row, col, n = a + b, a + c, a + b + c + d
    ln = lambda k, m: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    at = lambda x: math.exp(ln(x, row) + ln(col - x, n - row) - ln(col, n))
    own = at(a)
    return min(1.0, math.fsum(p for x in range(max(0, col - (n - row)), min(row, col) + 1) if (p := at(x)) <= own * (1 + 1e-9)))


def fisher(df: DataFrame, a: str, b: str) -> DataFrame:
    """(test, odds_ratio, p) of two yes/no columns: exact where an expected count is under five, else by chi-square."""
    hit = lambda i, j: F.count_if((F.col(a).cast("int") == i) & (F.col(b).cast("int") == j))
    r = df.agg(*[hit(i, j).alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)]).first()
    t = [r["n11"], r["n10"], r["n01"], r["n00"]]
    n, rows, cols = sum(t), (t[0] + t[1], t[2] + t[3]), (t[0] + t[2], t[1] + t[3])
    odds = t[0] * t[3] / (t[1] * t[2]) if t[1] * t[2] else None
    if not n or 0 in rows or 0 in cols:
        return df.sparkSession.createDataFrame([("none", odds, None)], "test string, odds_ratio double, p double")
    expected = [x * y / n for x in rows for y in cols]
    if min(expected) < 5:
        return df.sparkSession.createDataFrame([("fisher", odds, fisher_p(*t))], "test string, odds_ratio double, p double")
    chi2 = sum((o - e) ** 2 / e for o, e in zip(t, expected))
    return df.sparkSession.createDataFrame([("chi2", odds, D.chi2_sf(chi2, 1))], "test string, odds_ratio double, p double")


def compare_groups(df: DataFrame, group: str, name: str, alpha: float = 0.05) -> DataFrame:
    """(test, statistic, p, effect, effect_size, groups): the test that fits the groups.

    Normal groups (Jarque-Bera) of equal variance (Levene) take t or the analysis of variance, two normal ones
    of unequal variance Welch's t, all others rank sums. The effect is Cohen's d, eta squared or epsilon squared.
    """
    schema = "test string, statistic double, p double, effect string, effect_size double, groups long"
    g = [r for r in moments(df, group, name).collect() if r["n"] > 1]  # a row per group
    k = len(g)
    if k < 2:
        return df.sparkSession.createDataFrame([("none", None, None, None, None, k)], schema)
    jb = [r["n"] / 6 * ((r["g1"] or 0.0) ** 2 + (r["g2"] or 0.0) ** 2 / 4) for r in g]
    normal = all(r["n"] >= 8 and math.exp(-x / 2) > alpha for r, x in zip(g, jb))
    lv = A.levene(df, group, name).first()
    equal = lv["f"] is not None and D.f_sf(lv["f"], k - 1, lv["n"] - k) > alpha
    if normal and k == 2:
        a, b = g
        pooled = math.sqrt(((a["n"] - 1) * a["v"] + (b["n"] - 1) * b["v"]) / (a["n"] + b["n"] - 2))
        d = (a["m"] - b["m"]) / pooled if pooled else 0.0
        if equal:
            t, free = d / math.sqrt(1 / a["n"] + 1 / b["n"]), a["n"] + b["n"] - 2
        else:
            sa, sb = a["v"] / a["n"], b["v"] / b["n"]
            t, free = (a["m"] - b["m"]) / math.sqrt(sa + sb), (sa + sb) ** 2 / (sa**2 / (a["n"] - 1) + sb**2 / (b["n"] - 1))
        row = ("t" if equal else "welch", t, D.t_sf2(abs(t), free), "cohen_d", abs(d), k)
    elif normal and equal:
        r = A.anova(df, group, name).first()
        row = ("anova", r["f"], r["p"], "eta2", r["eta2"], k)
    else:
        r = A.kruskal(df, group, name).first()
        row = ("mann_whitney" if k == 2 else "kruskal", r["h"], None if r["h"] is None else D.chi2_sf(r["h"], k - 1), "epsilon2", r["epsilon2"], k)
    return df.sparkSession.createDataFrame([tuple(float(x) if isinstance(x, (float, int)) and i in (1, 2, 4) else x for i, x in enumerate(row))], schema)
