"""Associations between columns and hypothesis tests.

All pairs of columns are measured in one aggregation over pairwise complete rows; statistics are returned
as columns, p-values where a closed form or the driver's distribution functions give them. Ranks come
from value counts, so no window runs over rows. Empty tables and columns without spread give null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions import distributions as D
from cairn.operators.profile import corr, finite
from cairn.operators.relational import quantiles, running


def pearson_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r, n) of every pair of numeric columns, one scan."""
    v = {c: finite(df.schema, c) for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = lambda a, b: v[a].isNotNull() & v[b].isNotNull()
    wide = df.agg(*[F.struct(corr(v[a], v[b]).alias("r"), F.count_if(both(a, b)).alias("n")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}.r").alias("r"), F.col(f"p{i}.n").alias("n")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def _ranked(df: DataFrame, name: str) -> DataFrame:
    c = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(f"_{name}")).agg(F.count(F.lit(1)).alias("_n"))
    return running(c, f"_{name}", ["_n"]).select(f"_{name}", (F.col("cum__n") - (F.col("_n") - 1) / 2).alias(f"rank_{name}"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(r, n): Pearson's correlation of average ranks over pairwise complete rows."""
    x = df.select(finite(df.schema, a).alias("a"), finite(df.schema, b).alias("b")).dropna()
    x = x.join(_ranked(x, "a"), F.col("a") == F.col("_a")).join(_ranked(x, "b"), F.col("b") == F.col("_b"))
    return x.agg(corr(F.col("rank_a"), F.col("rank_b")).alias("r"), F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, n, rows, cols, dof, v, v_corrected) of two categories. Only combinations that occur are held."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra, rb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    j = c.join(ra, "a").join(rb, "b")
    s = j.agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.sum("n").alias("n"), F.count_distinct("a").alias("rows"), F.count_distinct("b").alias("cols"))
    chi = F.col("n") * (F.col("s") - 1)
    k = F.least("rows", "cols") - 1
    phi = F.greatest(F.lit(0.0), chi / F.col("n") - (F.col("rows") - 1) * (F.col("cols") - 1) / (F.col("n") - 1))
    rc = lambda x: F.col(x) - (F.col(x) - 1) ** 2 / (F.col("n") - 1)
    return s.select(
        chi.alias("chi2"), "n", "rows", "cols", ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"),
        F.when(k > 0, F.sqrt(chi / (F.col("n") * k))).alias("v"), F.when(k > 0, F.sqrt(phi / (F.least(rc("rows"), rc("cols")) - 1))).alias("v_corrected"),
    )


def correlation_ratio(df: DataFrame, group: str, name: str) -> DataFrame:
    """(eta2, eta, groups, n): share of the variance between groups."""
    g = df.select(F.col(group).alias("g"), finite(df.schema, name).alias("v")).dropna().groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    t = g.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("m") ** 2).alias("sq"), F.sum(F.col("n") * F.col("s")).alias("within"), F.count(F.lit(1)).alias("groups"))
    between = F.col("sq") - F.col("n") * F.col("mean") ** 2
    eta2 = between / F.nullif(between + F.col("within"), F.lit(0.0))
    return t.select(eta2.alias("eta2"), F.sqrt(eta2).alias("eta"), "groups", "n")


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """(mi, nmi) in nats over equal-width bins, normalised by the smaller entropy."""
    va, vb = finite(df.schema, a), finite(df.schema, b)
    x = df.select(va.alias("a"), vb.alias("b")).dropna()
    r = x.agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    cell = lambda v: F.least(F.floor((F.col(v) - F.col(f"{v}0")) / ((F.col(f"{v}1") - F.col(f"{v}0")) / bins)), F.lit(bins - 1))
    c = x.crossJoin(F.broadcast(r)).groupBy(cell("a").alias("i"), cell("b").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    w = lambda *k: F.sum("n").over(Window.partitionBy(*k))  # noqa: E731  at most bins squared rows
    c = c.select("n", w("i").alias("ni"), w("j").alias("nj"), w().alias("t"))
    p, pi, pj = (F.col(k) / F.col("t") for k in ("n", "ni", "nj"))
    s = c.agg(F.sum(p * F.log(p / (pi * pj))).alias("mi"), (-F.sum(p * F.log(pi))).alias("ha"), (-F.sum(p * F.log(pj))).alias("hb"))
    return s.select("mi", (F.col("mi") / F.nullif(F.least("ha", "hb"), F.lit(0.0))).alias("nmi"))


def partial_correlation(df: DataFrame, a: str, b: str, control: str) -> DataFrame:
    """(r): correlation of two columns with the third held fixed."""
    x = df.select(*[finite(df.schema, c).alias(n) for c, n in ((a, "a"), (b, "b"), (control, "z"))]).dropna()
    r = x.agg(corr(F.col("a"), F.col("b")).alias("ab"), corr(F.col("a"), F.col("z")).alias("az"), corr(F.col("b"), F.col("z")).alias("bz"))
    return r.select(((F.col("ab") - F.col("az") * F.col("bz")) / F.nullif(F.sqrt((1 - F.col("az") ** 2) * (1 - F.col("bz") ** 2)), F.lit(0.0))).alias("r"))


def correlation_array(df: DataFrame, names: list[str]) -> np.ndarray:
    rows = pearson_pairs(df, names).collect()
    m = np.eye(len(names))
    for r in rows:
        i, j = names.index(r["a"]), names.index(r["b"])
        m[i, j] = m[j, i] = r["r"] if r["r"] is not None else 0.0
    return m


def inflation_factors(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, vif) from the inverse of the correlation matrix, capped at 1e9."""
    inv = np.linalg.pinv(correlation_array(df, names))
    return df.sparkSession.createDataFrame([(c, float(min(abs(inv[i, i]), 1e9))) for i, c in enumerate(names)], "column_name string, vif double")


def redundant_clusters(df: DataFrame, names: list[str], limit: float = 0.85) -> DataFrame:
    """(column_name, cluster): columns linked by correlations of at least ``limit``; as many rows as columns."""
    m = np.abs(correlation_array(df, names))
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            if m[i, j] >= limit:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return df.sparkSession.createDataFrame([(c, names[find(i)]) for i, c in enumerate(names)], "column_name string, cluster string")


def group_moments(df: DataFrame, group: str, name: str) -> DataFrame:
    """(grp, n, mean_value, var_value, median_value)."""
    v = finite(df.schema, name)
    return df.select(F.col(group).cast("string").alias("grp"), v.alias("v")).dropna().groupBy("grp").agg(F.count("v").alias("n"), F.avg("v").alias("mean_value"), F.var_samp("v").alias("var_value"), F.median("v").alias("median_value"))


def anova(df: DataFrame, group: str, name: str) -> DataFrame:
    """(f, df_between, df_within, p, eta2)."""
    r = correlation_ratio(df, group, name).first()
    k, n, e = r["groups"], r["n"], r["eta2"]
    f = (e / (k - 1)) / ((1 - e) / (n - k)) if e is not None and k > 1 and n > k and e < 1 else None
    return df.sparkSession.createDataFrame([(f, k - 1, (n or 0) - k, D.f_sf(f, k - 1, n - k) if f is not None else None, e)], "f double, df_between long, df_within long, p double, eta2 double")


def kruskal(df: DataFrame, group: str, name: str) -> DataFrame:
    """(h, groups, n, epsilon2): rank sums by group, corrected for ties."""
    x = df.select(F.col(group).alias("g"), finite(df.schema, name).alias("v")).dropna()
    c = x.groupBy("v").agg(F.count(F.lit(1)).alias("t"))
    ranks = running(c, "v", ["t"]).select(F.col("v").alias("_v"), (F.col("cum_t") - (F.col("t") - 1) / 2).alias("r"))
    t = F.col("t").cast("double")  # the cube of a count leaves the range of a long at some two million copies of a value
    ties = c.agg(F.sum(t * (t * t - 1)).alias("ties"))
    per = x.join(ranks, F.col("v") == F.col("_v")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("rs"))
    s = per.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("q"), F.count(F.lit(1)).alias("groups")).crossJoin(ties)
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return s.select(h.alias("h"), "groups", n.cast("long").alias("n"), ((h - F.col("groups") + 1) / (n - F.col("groups"))).alias("epsilon2"))


def levene(df: DataFrame, group: str, name: str) -> DataFrame:
    """(f, groups, n): the one-way test of distances from the group medians."""
    x = df.select(F.col(group).alias("g"), finite(df.schema, name).alias("v")).dropna()
    med = x.groupBy("g").agg(F.median("v").alias("m"))
    d = x.join(med, "g").select("g", F.abs(F.col("v") - F.col("m")).alias("d"))
    s = correlation_ratio(d, "g", "d")
    return s.select(((F.col("eta2") / (F.col("groups") - 1)) / ((1 - F.col("eta2")) / (F.col("n") - F.col("groups")))).alias("f"), "groups", "n")


def one_sample(df: DataFrame, name: str, mu: float) -> DataFrame:
    """(t, n)."""
    v = finite(df.schema, name)
    return df.agg(((F.avg(v) - mu) / (F.stddev_samp(v) / F.sqrt(F.count(v)))).alias("t"), F.count(v).alias("n"))


def jarque_bera(df: DataFrame, name: str) -> DataFrame:
    """(jb, p, n); p is exp(-jb / 2), zero below eight values."""
    v = finite(df.schema, name)
    s = df.agg(F.count(v).alias("n"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"))
    jb = F.col("n") / 6 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4)
    return s.select(jb.alias("jb"), F.when(F.col("n") < 8, 0.0).otherwise(F.exp(-jb / 2)).alias("p"), "n")


def ks_two_sample(df: DataFrame, name: str, side: Column) -> DataFrame:
    """(d, w1, n_a, n_b): the greatest and the integrated difference of two distribution functions.

    ``side`` tells the first sample; only distinct values with counts are ordered.
    """
    c = df.select(finite(df.schema, name).alias("v"), side.alias("s")).dropna().groupBy("v").agg(F.count_if("s").alias("a"), F.count_if(~F.col("s")).alias("b"))
    t = c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    x = running(c, "v", ["a", "b"]).crossJoin(F.broadcast(t)).select("v", "ta", "tb", F.abs(F.col("cum_a") / F.col("ta") - F.col("cum_b") / F.col("tb")).alias("d"), F.col("next_value").alias("nv"))
    return x.agg(F.max("d").alias("d"), F.sum(F.col("d") * (F.col("nv") - F.col("v"))).alias("w1"), F.max("ta").alias("n_a"), F.max("tb").alias("n_b"))


def rate_gap_p(pos: list[int], sizes: list[int], times: int = 1000, seed: int = 5) -> float:
    """Seeded permutation p of the largest gap of group rates; the group counts are all it needs."""
    rng = np.random.default_rng(seed)
    rates = [p / n for p, n in zip(pos, sizes)]
    seen, total, k = max(rates) - min(rates), sum(sizes), sum(pos)
    draws = rng.multivariate_hypergeometric(sizes, k, size=times) / np.array(sizes)
    return float(((draws.max(1) - draws.min(1)) >= seen - 1e-12).mean()) if total else 1.0


def fit_distributions(df: DataFrame, name: str) -> DataFrame:
    """(distribution, aic, p1, p2): maximum likelihood in closed form for seven families, one scan."""
    v = finite(df.schema, name)
    pos = F.when(v > 0, v)
    s = df.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.min(v).alias("a"), F.max(v).alias("b"), F.avg(F.log(pos)).alias("lm"), F.stddev_pop(F.log(pos)).alias("ls"), F.count(pos).alias("np"), F.avg(v * v).alias("m2")).first()
    n, out = s["n"], []
    if n and s["s"]:
        out.append(("normal", n * (math.log(2 * math.pi * s["s"] ** 2) + 1) + 4, s["m"], s["s"]))
        out.append(("uniform", 2 * n * math.log(s["b"] - s["a"]) + 4, s["a"], s["b"]))
        med = quantiles(df, {name: v}, [0.5]).first()["q"][0]
        dev = df.agg(F.avg(F.abs(v - med)).alias("d")).first()["d"]
        out.append(("laplace", 2 * n * (math.log(2 * dev) + 1) + 4, med, dev))
        if s["np"] == n:
            out.append(("exponential", 2 * n * (math.log(s["m"]) + 1) + 2, s["m"], None))
            if s["ls"]:
                out.append(("lognormal", n * (math.log(2 * math.pi * s["ls"] ** 2) + 1) + 2 * n * s["lm"] + 4, s["lm"], s["ls"]))
            sig2 = s["m2"] / 2
            out.append(("rayleigh", 2 * (n * math.log(sig2) - n * s["lm"] + n) + 2, math.sqrt(sig2), None))
            alpha = 1 / max(s["lm"] - math.log(s["a"]), 1e-12)
            out.append(("pareto", -2 * (n * math.log(alpha) + n * alpha * math.log(s["a"]) - (alpha + 1) * n * s["lm"]) + 4, s["a"], alpha))
    return df.sparkSession.createDataFrame(out, "distribution string, aic double, p1 double, p2 double")
