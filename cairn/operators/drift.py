"""Drift between two loads of a table, and between windows of one.

Both sides are aggregated in one scan of their union; only distributions (as many rows as categories or
bins) are joined. An empty side gives null measures; a category on one side only has share zero there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.operators.profile import finite
from cairn.operators.relational import quantiles


def numeric_drift(df: DataFrame, names: list[str], side: Column) -> DataFrame:
    """(column_name, mean_a, mean_b, mean_change, std_change, new_min, new_max, drifted) with the first sample where ``side`` holds."""
    aggs = []
    for c in names:
        v = finite(df.schema, c)
        a, b = F.when(side, v), F.when(~side, v)
        aggs.append(F.struct(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.stddev_samp(a).alias("sa"), F.stddev_samp(b).alias("sb"), F.min(a).alias("na"), F.min(b).alias("nb"), F.max(a).alias("xa"), F.max(b).alias("xb")).alias(c))
    wide = df.agg(*aggs)
    x = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}.{k}").alias(k) for k in ("ma", "mb", "sa", "sb", "na", "nb", "xa", "xb")]) for c in names])).alias("x")).select("x.*")
    rel = lambda a, b: F.abs(F.col(b) - F.col(a)) / F.nullif(F.abs(F.col(a)), F.lit(0.0))
    return x.select(
        "column_name", F.col("ma").alias("mean_a"), F.col("mb").alias("mean_b"), rel("ma", "mb").alias("mean_change"), rel("sa", "sb").alias("std_change"), (F.col("nb") < F.col("na")).alias("new_min"), (F.col("xb") > F.col("xa")).alias("new_max"),
        ((rel("ma", "mb") >= 0.10) | (rel("sa", "sb") >= 0.25)).alias("drifted"),
    )


def shares(df: DataFrame, name: str, side: Column) -> DataFrame:
    """(value, p, q): category shares on both sides."""
    c = df.select(F.col(name).alias("value"), side.alias("s")).where("value IS NOT NULL").groupBy("value").agg(F.count_if("s").alias("a"), F.count_if(~F.col("s")).alias("b"))
    t = c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return c.crossJoin(F.broadcast(t)).select("value", (F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))


def binned(df: DataFrame, name: str, side: Column, bins: int = 10) -> DataFrame:
    """(value, p, q) over equal-width bins of both samples."""
    v = finite(df.schema, name)
    r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    b = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    x = df.select(v.alias("v"), side.alias("s")).where("v IS NOT NULL").crossJoin(F.broadcast(r)).select(b.alias("bin"), "s")
    return shares(x, "bin", F.col("s"))


def divergence(dist: DataFrame) -> DataFrame:
    """(psi, jsd): population stability index (floor 1e-6, renormalised) and Jensen-Shannon divergence in bits (floor 1e-10)."""
    f = dist.select("p", "q", F.greatest("p", F.lit(1e-6)).alias("pf"), F.greatest("q", F.lit(1e-6)).alias("qf"), F.greatest("p", F.lit(1e-10)).alias("pj"), F.greatest("q", F.lit(1e-10)).alias("qj"))
    w = Window.partitionBy()  # as many rows as categories
    f = f.select((F.col("pf") / F.sum("pf").over(w)).alias("p"), (F.col("qf") / F.sum("qf").over(w)).alias("q"), (F.col("pj") / F.sum("pj").over(w)).alias("x"), (F.col("qj") / F.sum("qj").over(w)).alias("y"))
    m = (F.col("x") + F.col("y")) / 2
    return f.agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"), (F.sum(F.col("x") * F.log2(F.col("x") / m)) / 2 + F.sum(F.col("y") * F.log2(F.col("y") / m)) / 2).alias("jsd"))


def label_windows(df: DataFrame, order: str, label: str, windows: int = 5) -> DataFrame:
    """(win, label, n, share): class shares in windows of equal time quantiles, found without sorting rows."""
    q = quantiles(df, {order: F.col(order)}, [i / windows for i in range(1, windows)]).select("q")
    win = F.size(F.filter(F.col("q"), lambda x: x < F.col(order)))
    c = df.crossJoin(F.broadcast(q)).groupBy(win.alias("win"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("win")))


def range_overlap(df: DataFrame, name: str, side: Column) -> DataFrame:
    """(overlap): the common range as a share of the first sample's."""
    v = finite(df.schema, name)
    r = df.agg(F.min(F.when(side, v)).alias("a0"), F.max(F.when(side, v)).alias("a1"), F.min(F.when(~side, v)).alias("b0"), F.max(F.when(~side, v)).alias("b1"))
    return r.select((F.greatest(F.least("a1", "b1") - F.greatest("a0", "b0"), F.lit(0.0)) / F.nullif(F.col("a1") - F.col("a0"), F.lit(0.0))).alias("overlap"))


def mean_discrepancy(df: DataFrame, key: str, name: str, side: Column, gamma: float = 0.05) -> DataFrame:
    """(mmd2): squared maximum mean discrepancy with a Gaussian kernel over all rows (each also paired with itself).

    Rows are laid in blocks by hash and every pair of blocks is one task that returns sums, so work grows
    with the square of the rows. Vectors with null elements, and pairs of unequal length, don't count.
    """
    x = df.select(F.col(key).alias("k"), F.col(name).cast("array<double>").alias("v"), F.coalesce(side, F.lit(False)).cast("int").alias("s"), side.isNotNull().alias("known"))
    x = x.where("known AND v IS NOT NULL").where(F.forall("v", lambda e: e.isNotNull()))
    blocks = max(4, -(-x.count() // 16384))
    x = x.withColumn("b", F.pmod(F.xxhash64("k", "v"), F.lit(blocks)).cast("int"))
    o = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = x.select("b", "v", "s", o.alias("o")).select("b", "v", "s", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    sums = pairs.groupBy("i", "j").applyInPandas(lambda key, pdf: _kernel_sums(key, pdf, gamma), "s int, t int, total double, n double")
    mean = lambda s, t: F.sum(F.when((F.col("s") == s) & (F.col("t") == t), F.col("total"))) / F.nullif(F.sum(F.when((F.col("s") == s) & (F.col("t") == t), F.col("n"))), F.lit(0.0))
    return sums.agg((mean(1, 1) + mean(0, 0) - 2 * mean(0, 1)).alias("mmd2"))


def _kernel_sums(key: tuple, pdf: pd.DataFrame, gamma: float, rows: int = 1024) -> pd.DataFrame:
    """(s, t, total, n): kernel sum and number of pairs by side for one pair of blocks; s <= t, ordered pairs within a side."""
    import numpy as np

    i, j = int(key[0]), int(key[1])
    total, n = np.zeros((2, 2)), np.zeros((2, 2))
    for _, part in pdf.groupby(pdf["v"].map(len)):
        a, b = part[part["b"] == i], part[part["b"] == j]
        if not len(a) or not len(b):
            continue
        y, yt = np.stack(b["v"].to_numpy()), np.eye(2)[b["s"].to_numpy()]
        xa, xs = np.stack(a["v"].to_numpy()), np.eye(2)[a["s"].to_numpy()]
        yy = (y * y).sum(1)
        for at in range(0, len(xa), rows):  # bounds the kernel held at once
            x, s = xa[at : at + rows], xs[at : at + rows]
            d = np.maximum((x * x).sum(1)[:, None] + yy - 2 * (x @ y.T), 0.0)
            total += s.T @ np.exp(-gamma * d) @ yt
            n += np.outer(s.sum(0), yt.sum(0))
    both = 1 if i == j else 2  # blocks of their own are met once, not in both orders
    out = [(0, 0, both * total[0, 0], both * n[0, 0]), (1, 1, both * total[1, 1], both * n[1, 1])]
    cross = (total[0, 1], n[0, 1]) if i == j else (total[0, 1] + total[1, 0], n[0, 1] + n[1, 0])
    return pd.DataFrame([*out, (0, 1, *cross)], columns=["s", "t", "total", "n"])
