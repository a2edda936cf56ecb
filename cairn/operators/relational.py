"""Joins, set operations, sorts, samples, splits and windows over rows.

Defined results: null keys join nothing; ties in an order fall to the given key; empty inputs give empty
outputs. Window operators without a group need one order over the whole table; they take it range
partitioned where a carry is enough (``rolling`` over a group is the scalable form).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def row_digest(df: DataFrame, names: list[str]) -> Column:
    """A digest of some columns; null differs from every text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names]), 256)


def exact_overlap(test: DataFrame, train: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``test`` that occur in ``train`` over the given columns; only digests are shuffled of the training side."""
    t = train.select(row_digest(train, names).alias("_h")).distinct()
    return test.withColumn("_h", row_digest(test, names)).join(t, "_h", "left_semi").drop("_h")


def entity_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n_a, n_b, shared, ratio): distinct keys in both, as a share of the second."""
    ids = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(key, F.lit(0), F.lit(1))).where(F.col(key).isNotNull())
    per = ids.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("shared")).withColumn("ratio", F.col("shared") / F.greatest("n_b", F.lit(1)))


def hash_order(key: str, seed: int = 42) -> Column:
    """A seeded order any engine can repeat."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Exactly k rows, chosen by a seeded hash; a top-k, never a full sort."""
    return df.orderBy(hash_order(key, seed), key).limit(k)


def allocation(sizes: dict, budget: int) -> dict:
    """Equal shares capped by class size, what is left to the bigger classes; evenly spaced classes if there are too many."""
    names = sorted(sizes, key=str)
    if len(names) > budget > 0:
        names = [names[int(i * len(names) / budget)] for i in range(budget)]
    out, left = {n: 0 for n in names}, budget
    for i, n in enumerate(sorted(names, key=lambda x: (sizes[x], str(x)))):
        out[n] = min(sizes[n], left // (len(names) - i))
        left -= out[n]
    return out


def stratified_sample(df: DataFrame, key: str, label: str, budget: int, seed: int = 42) -> DataFrame:
    """At most ``budget`` rows, classes alike; the rank needs a class's rows only below a hash bound, so big classes are no big tasks."""
    sizes = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {k: v for k, v in allocation(sizes, budget).items() if v}
    spark = df.sparkSession
    plan = spark.createDataFrame([(k, v, min(1.0, 3.0 * v / sizes[k] + 1000.0 / sizes[k])) for k, v in want.items()], df.select(F.col(label).alias("_l")).schema.add("_take", "long").add("_bound", "double"))
    h = hash_order(key, seed)
    frac = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0
    near = df.join(F.broadcast(plan), F.col(label) == F.col("_l")).where(frac <= F.col("_bound"))
    r = F.row_number().over(Window.partitionBy(label).orderBy(h, key))
    return near.withColumn("_r", r).where(F.col("_r") <= F.col("_take")).drop("_r", "_l", "_take", "_bound")


def random_split(df: DataFrame, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, split) by a seeded hash: rows stay where they are, whatever the partitions."""
    u = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.select(key, F.when(u < train, "train").when(u < train + val, "val").otherwise("test").alias("split"))


def group_split(df: DataFrame, key: str, group: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """As ``random_split``, all rows of a group in one split."""
    u = F.conv(F.substring(hash_order(group, seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.select(key, group, F.when(u < train, "train").when(u < train + val, "val").otherwise("test").alias("split"))


def temporal_split(df: DataFrame, key: str, time: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(key, split): the boundaries are exact quantiles of the time, no global sort of the rows."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    b = quantiles(df, {time: F.unix_micros(F.col(time).cast("timestamp"))}, [train, train + val]).select(F.col("q").alias("b"))
    return df.crossJoin(F.broadcast(b)).select(key, F.when(t <= F.col("b")[0], "train").when(t <= F.col("b")[1], "val").otherwise("test").alias("split"))


def set_difference(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """(value, side): values in one table only."""
    x = a.select(F.col(name).alias("value")).distinct().withColumn("s", F.lit(1)).union(b.select(F.col(name)).distinct().withColumn("s", F.lit(2)))
    return x.where("value IS NOT NULL").groupBy("value").agg(F.sum("s").alias("s")).where("s < 3").select("value", F.when(F.col("s") == 1, "gone").otherwise("new").alias("side"))


def rolling(df: DataFrame, group: str, order: list[str], name: str, width: int, how: str = "mean") -> DataFrame:
    """Full windows only."""
    if width < 1:
        raise ValueError("width is positive")
    w = Window.partitionBy(group).orderBy(*order)
    f = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}[how]
    out = df.withColumn("_r", F.row_number().over(w)).withColumn("rolled", f(name).over(w.rowsBetween(-(width - 1), 0)))
    return out.where(F.col("_r") >= width).drop("_r")


def running(df: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """``df`` with ``cum_<c>`` of each summed column up to and including its row, and ``next_value`` of ``by``.

    ``by`` is unique. The rows are range partitioned and written once; the totals of the partitions (as
    many rows as partitions) give each partition its offset, so that no task orders the whole table.
    """
    from cairn.session import cut, parallelism

    x = cut(df.repartitionByRange(parallelism(df.sparkSession), by).withColumn("_pid", F.spark_partition_id()))
    w = Window.orderBy("_pid")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    total = x.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums], F.min(by).alias("_first"))
    total = total.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums], F.lead("_first").over(w).alias("_after"))
    own = Window.partitionBy("_pid").orderBy(by)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.join(F.broadcast(total), "_pid").select(*df.columns, *[(F.col(f"_o_{c}") + F.sum(c).over(upto)).alias(f"cum_{c}") for c in sums], F.coalesce(F.lead(by).over(own), "_after").alias("next_value"))


def quantiles(df: DataFrame, columns: dict[str, Column], points: list[float]) -> DataFrame:
    """(column_name, n, q): exact quantiles, interpolated between values, of several columns at once.

    Values are counted per column (map-side combined), the counts of all columns are range partitioned
    together, and a running sum finds the ranks, so no task and no buffer holds a column. Missing values are
    left out; a column without values has null quantiles.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), v.cast("double").alias("v")) for k, v in columns.items()]))
    c = df.select(cells.alias("at")).where("at.v IS NOT NULL").groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    x = running(c, "at", ["n"])
    own = x.groupBy(F.col("at.c").alias("c")).agg(F.sum("n").alias("t"), F.min(F.col("cum_n") - F.col("n")).alias("start"))
    names = df.sparkSession.createDataFrame([(k,) for k in columns], "c string")
    x = x.select(F.col("at.c").alias("c"), F.col("at.v").alias("v"), "cum_n").join(F.broadcast(own), "c")
    aggs = []
    for i, p in enumerate(points):
        at = F.lit(float(p)) * (F.col("t") - 1)
        for k, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.min(F.when(F.col("cum_n") - F.col("start") > pos, F.col("v"))).alias(f"{k}{i}"))
    got = x.groupBy("c", "t").agg(*aggs)
    frac = [F.lit(float(p)) * (F.col("t") - 1) - F.floor(F.lit(float(p)) * (F.col("t") - 1)) for p in points]
    q = F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * frac[i] for i in range(len(points))])
    nulls = F.array(*[F.lit(None).cast("double") for _ in points])
    return names.join(got.select("c", "t", q.alias("q")), "c", "left").select(F.col("c").alias("column_name"), F.coalesce("t", F.lit(0)).alias("n"), F.coalesce("q", nulls).alias("q"))


def average_ranks(df: DataFrame, name: str) -> DataFrame:
    """(value, n, average_rank): ranks from cumulative value counts, ties averaged; distinct values only are ordered."""
    c = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return running(c, "value", ["n"]).select("value", "n", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("average_rank"))


def lagged_correlation(df: DataFrame, group: str, order: list[str], a: str, b: str, lags: list[int]) -> DataFrame:
    """(lag, r, n): correlation of ``a`` now with ``b`` that many rows later in the group; one window for all lags."""
    w = Window.partitionBy(group).orderBy(*order)
    x = df.select(F.col(a).cast("double").alias("a"), *[F.lead(F.col(b).cast("double"), k).over(w).alias(f"b{k}") for k in lags])
    from cairn.operators.profile import corr

    wide = x.agg(*[F.struct(corr(F.col("a"), F.col(f"b{k}")).alias("r"), F.count(F.when(F.col("a").isNotNull() & F.col(f"b{k}").isNotNull(), 1)).alias("n")).alias(f"k{k}") for k in lags])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"k{k}.r").alias("r"), F.col(f"k{k}.n").alias("n")) for k in lags])).alias("x")).select("x.*")


def gaps(df: DataFrame, group: str, time: str) -> DataFrame:
    """(group, n_gaps, mean_gap, cv): seconds between successive rows and how uneven they are."""
    g = F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(Window.partitionBy(group).orderBy(time))
    x = df.select(group, (g / 1e6).alias("g")).where("g IS NOT NULL")
    return x.groupBy(group).agg(F.count("g").alias("n_gaps"), F.avg("g").alias("mean_gap"), (F.stddev_pop("g") / F.avg("g")).alias("cv"))
