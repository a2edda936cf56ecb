"""Filters, cleaning and imputation.

Defined results: missing is null or NaN. A statistic of a column without values is null and fills
nothing. Empty tables stay empty. Ties of the most frequent value go to the smaller one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.operators.profile import cell_counts, finite, numeric_columns, text_columns, value
from cairn.operators.relational import quantiles, running
from cairn.session import cut


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One of each distinct row."""
    return df.dropDuplicates()


def replacement(df: DataFrame, name: str, how: str, fill=None) -> Column:
    """The aggregate that replaces missing cells of a column."""
    v, text = value(df.schema, name), name in text_columns(df.schema)
    if how == "fill":
        return F.first(F.lit(fill))
    if how == "mode" or text and how in ("mean", "median"):
        return F.mode(v, deterministic=True)
    if how in ("mean", "median"):
        return F.round(F.avg(v) if how == "mean" else F.median(v), 4)
    if how in ("min", "max"):
        return F.min(v) if how == "min" else F.max(v)
    if how == "zero":
        return F.first(F.lit(0))
    raise ValueError(f"unknown strategy {how}")


def handle_missing(df: DataFrame, how: str, names: list[str] | None = None, fill=None) -> DataFrame:
    """Missing cells dropped or replaced; one aggregation finds all replacements, which are as many values as columns."""
    names = names or df.columns
    if how == "drop":
        return df.where(~F.greatest(*[value(df.schema, c).isNull() for c in names], F.lit(False)))
    middle = [c for c in names if how == "median" and c not in text_columns(df.schema)]
    rest = [replacement(df, c, how, fill).alias(f"_r_{c}") for c in names if c not in middle]
    stats = df.agg(*rest) if rest else None
    if middle:  # exact medians from value counts, so that no buffer holds a column
        q = quantiles(df, {c: value(df.schema, c) for c in middle}, [0.5]).select("column_name", F.round(F.col("q")[0], 4).alias("m"))
        wide = q.agg(*[F.max(F.when(F.col("column_name") == c, F.col("m"))).alias(f"_r_{c}") for c in middle])
        stats = wide if stats is None else stats.crossJoin(wide)
    out = df.crossJoin(F.broadcast(stats))  # one row
    cells = [F.coalesce(value(df.schema, c), F.col(f"_r_{c}").cast("double" if how in ("mean", "median") and c in numeric_columns(df.schema) else df.schema[c].dataType)).alias(c) if c in names else F.col(c) for c in df.columns]
    return out.select(*cells)


def fill_by_group(df: DataFrame, name: str, group: str, how: str = "mean") -> DataFrame:
    """Missing cells get the statistic of their group, else that of all rows.

    The groups are aggregated and joined, not windowed, so that a large group is no large task.
    """
    v = value(df.schema, name)
    agg = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}.get(how)
    stat = (lambda: agg(v)) if agg else (lambda: F.mode(v, deterministic=True))
    per = df.groupBy(F.col(group).alias("_g")).agg(stat().alias("_gv"))
    whole = df.agg(stat().alias("_av"))
    out = df.join(per, F.col(group).eqNullSafe(F.col("_g")), "left").crossJoin(F.broadcast(whole))
    return out.select(*[F.coalesce(value(df.schema, c), "_gv", "_av").alias(c) if c == name else F.col(c) for c in df.columns])


def fill_in_time(df: DataFrame, name: str, group: str, time: str, how: str = "linear") -> DataFrame:
    """``locf``, ``nocb``, ``ffill`` (forward, then backward) or ``linear`` by position, within each group by time."""
    v = value(df.schema, name)
    w = Window.partitionBy(group).orderBy(time)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    pos = F.row_number().over(w)
    base = df.withColumn("_pos", pos)
    known = F.when(v.isNotNull(), F.struct(F.col("_pos").alias("p"), v.alias("v")))
    base = base.withColumn("_b", F.last(known, True).over(before)).withColumn("_a", F.first(known, True).over(after))
    b, a = F.col("_b.v"), F.col("_a.v")
    line = F.when(F.col("_a.p") > F.col("_b.p"), b + (a - b) * (F.col("_pos") - F.col("_b.p")) / (F.col("_a.p") - F.col("_b.p"))).otherwise(F.coalesce(b, a))
    new = {"locf": b, "nocb": a, "ffill": F.coalesce(b, a), "bfill": F.coalesce(a, b), "linear": F.coalesce(v, line)}[how]
    return base.select(*[new.alias(c) if c == name else F.col(c) for c in df.columns])


def missing_flags(df: DataFrame, names: list[str]) -> DataFrame:
    """The table with an indicator per column."""
    return df.select("*", *[value(df.schema, c).isNull().cast("int").alias(f"missing_{c}") for c in names])


def missing_pattern(df: DataFrame, names: list[str]) -> DataFrame:
    """(pattern, n): how often each combination of missing columns occurs."""
    mask = F.concat_ws("", *[F.when(value(df.schema, c).isNull(), "1").otherwise("0") for c in names])
    return df.groupBy(mask.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def knn_impute(df: DataFrame, key: str, name: str, by: list[str], k: int = 5) -> DataFrame:
    """(key, imputed) for rows without ``name``: the mean over the k nearest rows that have it.

    Rows are scaled by the columns' ranges; nearest first, ties to the smaller key. Fewer than k donors
    in the whole table are all used, and without any the result is null.
    """
    lim = df.agg(*[F.min(finite(df.schema, c)).alias(f"a{i}") for i, c in enumerate(by)], *[F.max(finite(df.schema, c)).alias(f"b{i}") for i, c in enumerate(by)]).first()
    scaled = [F.coalesce((finite(df.schema, c) - (lim[f"a{i}"] or 0)) / max((lim[f"b{i}"] or 0) - (lim[f"a{i}"] or 0), 1e-12), F.lit(0.5)) for i, c in enumerate(by)]
    base = df.select(F.col(key).alias("k"), finite(df.schema, name).alias("v"), F.array(*scaled).alias("x"))
    near = nearest_rows(base.where("v IS NULL").select("k", "x"), base.where("v IS NOT NULL").select(F.col("k").alias("o"), F.col("x").alias("y"), F.col("v").alias("dv")), k)
    got = near.groupBy("k").agg(F.avg("dv").alias("v"))
    return base.where("v IS NULL").select("k").join(got, "k", "left").select(F.col("k").alias(key), F.col("v").alias("imputed"))


def nearest_rows(ask: DataFrame, donors: DataFrame, k: int, itself: bool = False) -> DataFrame:
    """(k, o, d, ...): exactly the ``k`` nearest ``donors`` (o, y, ...) of each of ``ask`` (k, x), ties to the smaller o.

    ``x`` and ``y`` are arrays scaled to 0..1; with ``itself`` a row is no neighbour of its own key. Of
    equal donors only the first can be among the nearest, and equal rows of ``ask`` are searched for once.
    The unit square of the first two columns is halved again and again; a row starts in its smallest cell
    with enough donors. The k-th distance in there bounds the true one, and a second join reads all cells
    that this radius touches.
    """
    least = k + itself
    same = Window.partitionBy("y").orderBy("o")
    donors = cut(donors.withColumn("r", F.row_number().over(same)).where(F.col("r") <= least).drop("r"))
    total = donors.count()
    depth = min(24, total.bit_length() + 4)
    extra = [c for c in donors.columns if c not in ("o", "y")]

    def place(v: Column, level: Column) -> Column:
        side = F.pow(F.lit(2.0), level)
        return F.greatest(F.least(F.floor(v * side), side.cast("long") - 1), F.lit(0).cast("long"))

    def cell(name: str) -> Column:
        return F.transform(F.slice(name, 1, 2), lambda e: place(e, F.col("l")))

    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("l")
    laid = donors.select("*", levels).withColumn("cell", cell("y"))
    full = laid.groupBy("l", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(least, total)).select("l", "cell")
    own = ask.select("x").distinct().select("x", levels).withColumn("cell", cell("x")).join(full, ["l", "cell"]).groupBy("x").agg(F.max("l").alias("l"))
    d = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("d", "o"))

    def meet(start: DataFrame) -> DataFrame:
        start = cut(start)
        used = [r.l for r in start.select("l").distinct().collect()]  # at most depth + 1
        return start.join(laid.where(F.col("l").isin(used)), ["l", "cell"]).withColumn("d", d)

    first = meet(own.withColumn("cell", cell("x"))).select("x", "l", "o", "d").withColumn("r", rank("x")).where(F.col("r") <= least)
    reach = first.groupBy("x", "l").agg(F.max("d").alias("u"))
    fits = F.when(F.col("u") > 0, F.floor(-F.log2(F.when(F.col("u") > 0, F.col("u"))))).otherwise(F.col("l"))
    reach = reach.withColumn("l", F.greatest(F.least(F.col("l"), fits), F.lit(0)).cast("int"))  # cells at least as wide as the radius
    wide = F.col("u") * (1 + 1e-9) + 1e-15  # rounding
    sides = F.transform(F.slice("x", 1, 2), lambda e: F.sequence(place(e - wide, F.col("l")), place(e + wide, F.col("l"))))
    cells = F.aggregate(sides, F.array(F.array().cast("array<bigint>")), lambda acc, s: F.flatten(F.transform(acc, lambda c: F.transform(s, lambda e: F.concat(c, F.array(e))))))
    near = meet(reach.withColumn("cell", F.explode(cells))).where(F.col("d") <= F.col("u"))
    near = near.select("x", "o", "d", *extra).withColumn("r", rank("x")).where(F.col("r") <= least).drop("r")
    per = ask.select("k", "x").join(near, "x").drop("x")
    return per.where(F.col("k") != F.col("o")).withColumn("r", rank("k")).where(F.col("r") <= k).drop("r") if itself else per


def chained_impute(df: DataFrame, names: list[str], rounds: int = 3) -> DataFrame:
    """Iterated linear regressions of each incomplete column on the others (chained equations).

    Each regression needs the covariances only, which one aggregation gives; the coefficients are solved
    on the driver and applied as an expression.
    """
    import numpy as np

    means = df.agg(*[F.avg(finite(df.schema, c)).alias(c) for c in names]).first()
    flags = {c: finite(df.schema, c).isNull() for c in names}
    cur = df.select("*", *[F.coalesce(finite(df.schema, c), F.lit(means[c] or 0.0)).alias(f"_x_{c}") for c in names], *[flags[c].alias(f"_m_{c}") for c in names])
    incomplete = [c for c in names if df.where(flags[c]).limit(1).count()]
    for _ in range(rounds):
        for c in incomplete:
            xs = [o for o in names if o != c]
            terms = ["1"] + [f"_x_{o}" for o in xs]
            pairs = [F.sum(F.expr(f"{a} * {b}")).alias(f"s{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
            rhs = [F.sum(F.expr(f"{a} * _x_{c}")).alias(f"r{i}") for i, a in enumerate(terms)]
            row = cur.where(f"NOT _m_{c}").agg(*pairs, *rhs).first()
            n = len(terms)
            a = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)], float) + np.eye(n) * 1e-9
            beta = np.linalg.solve(a, np.array([row[f"r{i}"] or 0.0 for i in range(n)], float))
            guess = F.lit(float(beta[0])) + sum((F.col(f"_x_{o}") * float(b) for o, b in zip(xs, beta[1:])), F.lit(0.0))
            cur = cur.withColumn(f"_x_{c}", F.when(F.col(f"_m_{c}"), guess).otherwise(F.col(f"_x_{c}")))
    return cur.select(*[F.col(f"_x_{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def imputation_error(df: DataFrame, key: str, name: str, group: str, share: int = 10, seed: int = 1) -> DataFrame:
    """(rmse, mae, n): known cells hidden by a seeded hash of their key, filled from their group, compared."""
    hidden = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(share)) == 0
    v = finite(df.schema, name)
    known = df.select(F.col(group).alias("g"), v.alias("v"), hidden.alias("h")).where("v IS NOT NULL")
    per = known.where("NOT h").groupBy("g").agg(F.avg("v").alias("p"))
    e = F.col("v") - F.col("p")
    return known.where("h").join(per, "g").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n"))


def choose_imputer(n: int, missing_share: float, mechanism: str, timed: bool = False) -> str:
    """The method for a column, by size, missing share and mechanism."""
    if timed:
        return "linear"
    if n > 100_000:
        return "median" if missing_share < 0.05 else "knn3"
    if mechanism == "MCAR":
        return "median" if missing_share < 0.05 else "knn5" if missing_share < 0.2 else "forest"
    return "chained" if n <= 10_000 else "forest"


def contracts(df: DataFrame) -> DataFrame:
    """(column_name, violation, severity, measure): missing share over .35, constant columns, nearly unique text, duplicates."""
    n = F.count(F.lit(1))
    texts = text_columns(df.schema)
    parts = []
    for c in df.columns:
        v = value(df.schema, c)
        parts.append(F.struct(F.lit(c).alias("c"), (F.count_if(v.isNull()) / n).alias("miss"), F.lit(c in texts).alias("t")))
    rows = df.agg(n.alias("n"), F.array(*parts).alias("p")).select("n", F.explode("p").alias("p")).select("n", "p.*")
    counted = cell_counts(df, df.columns).groupBy(F.col("column_name").alias("c")).agg(F.count(F.lit(1)).alias("d"))
    rows = rows.join(F.broadcast(counted), "c", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    v = F.array_compact(F.array(
        F.when(F.col("miss") > 0.35, F.struct(F.lit("missing").alias("violation"), F.when(F.col("miss") > 0.6, "high").otherwise("medium").alias("severity"), F.round("miss", 4).alias("measure"))),
        F.when(F.col("d") <= 1, F.struct(F.lit("constant").alias("violation"), F.lit("medium").alias("severity"), F.col("d").cast("double").alias("measure"))),
        F.when(F.col("t") & (F.col("d") / F.col("n") >= 0.95) & (F.col("d") > 25), F.struct(F.lit("identifier_like").alias("violation"), F.lit("low").alias("severity"), F.round(F.col("d") / F.col("n"), 4).alias("measure"))),
    ))
    return rows.select(F.col("c").alias("column_name"), F.explode(v).alias("v")).select("column_name", "v.*")


def prepare_for_ml(df: DataFrame, order: str) -> DataFrame:
    """Missing numbers to the mean, labels coded in alphabetical order, numbers to z-scores (six places), constants dropped."""
    d = remove_duplicates(df)
    d = handle_missing(d, "mean", [c for c in df.columns if c != order])
    nums = [c for c in numeric_columns(df.schema) if c != order]
    texts = text_columns(df.schema)
    stats = d.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in nums], *[F.approx_count_distinct(c).alias(c) for c in texts]).first()
    for c in texts:
        codes = running(d.select(F.col(c).alias("_v")).distinct().withColumn("_one", F.lit(1)), "_v", ["_one"]).select("_v", (F.col("cum__one") - 1).cast("int").alias("_code"))
        d = d.join(codes, F.col(c).eqNullSafe(F.col("_v")), "left").drop(c, "_v").withColumnRenamed("_code", c)
    keep = [order, *[c for c in nums if stats[c]["s"]], *texts]
    z = lambda c: F.round((F.col(c) - stats[c]["m"]) / stats[c]["s"], 6).alias(c)
    return d.select(*[z(c) if c in nums else F.col(c) for c in keep])


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, failures, checked): every rule a predicate, all counted in one scan; a null outcome fails."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(~F.coalesce(p, F.lit(False))).alias(k) for k, p in rules.items()])
    return wide.unpivot(["_n"], list(rules), "rule", "failures").select("rule", "failures", F.col("_n").alias("checked"))


def infer_rules(df: DataFrame) -> DataFrame:
    """(column_name, kind, required, is_unique, min_value, max_value, allowed): rules that hold in the table."""
    s, nums = df.schema, set(numeric_columns(df.schema))
    counts = cell_counts(df, df.columns)
    d = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("d"))
    few = d.where("d <= 20").select("column_name")  # only these values are gathered
    texts = [f.name for f in s if f.dataType.simpleString() == "string"]
    allowed = counts.join(F.broadcast(few), "column_name").where(F.col("column_name").isin(texts)).groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("allowed"))
    items = []
    for f in s:
        v = value(s, f.name)
        num = f.name in nums
        items.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit("numeric" if num else "date" if f.dataType.simpleString() in ("timestamp", "timestamp_ntz", "date") else "text").alias("kind"),
            (F.count_if(v.isNull()) == 0).alias("required"), F.count(F.lit(1)).alias("n"),
            (F.round(F.min(v.cast("double")), 4) if num else F.lit(None).cast("double")).alias("min_value"), (F.round(F.max(v.cast("double")), 4) if num else F.lit(None).cast("double")).alias("max_value"),
        ))
    x = df.agg(F.array(*items).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    x = x.join(F.broadcast(d), "column_name", "left").join(F.broadcast(allowed), "column_name", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    gathered = F.when((F.col("kind") != "numeric") & (F.col("d") <= 20), F.coalesce("allowed", F.lit("")))
    return x.select("column_name", "kind", "required", (F.col("d") == F.col("n")).alias("is_unique"), "min_value", "max_value", gathered.alias("allowed"))


def safe_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; signed numbers stay."""
    risky = c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(r"^[+-]?\d+(\.\d+)?$")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def clean_names(names: list[str]) -> list[str]:
    """Trimmed names; blank ones become unnamed, repeated ones get a number."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        base = re.sub(r"\s+", " ", (n or "").strip()) or "unnamed"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out
