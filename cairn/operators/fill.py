"""Problem 6: fill missing cells from records of the same entity, else of the same load.

Method: time-ordered filling per entity. Numerics are interpolated between the observed neighbours
in time, categories are carried within a gap limit; every filled cell reports method and distance.

A cell is missing if it is null, NaN or a stand-in. Besides the known stand-ins (``functions.missing``)
those of the data are learned from the neighbours in time: a number that recurs, stands alone among the
values that contradict their entity's neighbours, and contradicts them in most of its rows; a text that
recurs, is no neighbour of itself and comes with no one category. If any is learned, the windows run once
more without it. So learning costs one pass over the windows, which are written to the shared folder.

An id that stands for many entities (more than ``pooled_states`` different states of age and tenure in
one load; repeated rows are one state) is no entity: its rows never enter a per-entity window, so no hot
id can fill one task, and they are filled from their load. One shuffle on (file, id) serves the windows of
all fields.

Defined results: values in a wrong unit or sign are kept, but never donate. Rows repeated under another
key are filled each. Rows whose load is unknown are filled from the group of loads without a file. An
empty table gives an empty result. Where neither entity nor load has any value the cell stays unfilled
with method ``none``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.missing import contract_name, missing_cell

NUMERIC = ["age", "tenure_months", "monthly_charges"]
FIELDS = [*NUMERIC, "contract"]
# What a donated number must lie between.
PLAUSIBLE = {"age": (1, 130), "tenure_months": (0, 1200), "monthly_charges": (0, 1e4)}


# What is real whatever the neighbours say.
REAL = {"tenure_months": [0.0], "monthly_charges": [0.0]}
#: A value recurs if it is in this share of all rows, and in at least LEAST rows.
SHARE, LEAST = 1 / 2000, 8


def _is_missing(schema, name: str, learned: dict[str, list]) -> Column:
    more = learned.get(name)
    bad = missing_cell(schema, name)
    if not more:
        return bad
    c = F.lower(F.trim(name)) if name == "contract" else F.col(name)
    return bad | F.coalesce(c.isin(more), F.lit(False))


def _donor(schema, name: str, learned: dict[str, list]) -> Column:
    c = F.col(name)
    bad = _is_missing(schema, name, learned)
    if name in PLAUSIBLE:
        lo, hi = PLAUSIBLE[name]
        return F.when(~bad & c.between(lo, hi), c.cast("double"))
    return F.when(~bad, contract_name(c))


def _neighbours(churn: DataFrame, loads: DataFrame, pooled_states: int, learned: dict[str, list]) -> DataFrame:
    """The rows with, per field, whether the cell is missing, its raw value, what it may donate, and the observed neighbours in time."""
    at = loads.select("snapshot_id", F.col("file_hash").alias("_file"), F.col("taken_at").alias("_at")).dropDuplicates(["snapshot_id"])
    base = churn.select(
        "row_id", "snapshot_id", "customer_id",
        *[_is_missing(churn.schema, f, learned).alias(f"_m_{f}") for f in FIELDS],
        *[_donor(churn.schema, f, learned).alias(f"_v_{f}") for f in FIELDS],
        *[(F.lower(F.trim(f)) if f == "contract" else F.col(f).cast("double")).alias(f"_r_{f}") for f in FIELDS],
    )
    base = base.join(at, "snapshot_id", "left").withColumn("_day", F.unix_timestamp("_at") / 86400.0)
    state = F.struct("_v_age", "_v_tenure_months")
    pooled = (
        base.where(F.col("_v_age").isNotNull() & F.col("_v_tenure_months").isNotNull())
        .groupBy("_file", "customer_id", "snapshot_id").agg(F.count_distinct(state).alias("states")).where(F.col("states") > pooled_states)
        .select("_file", "customer_id").distinct().withColumn("_pooled", F.lit(True))
    )
    keyed = base.join(
        pooled.withColumnRenamed("_file", "_pf").withColumnRenamed("customer_id", "_pc"),
        F.col("_file").eqNullSafe(F.col("_pf")) & (F.col("customer_id") == F.col("_pc")), "left",
    ).drop("_pf", "_pc")
    alone = F.col("_pooled").isNull() & F.col("customer_id").isNotNull() & F.col("_day").isNotNull()
    # rows that are no entity get a key of their own, so that they spread instead of meeting in one task
    keyed = keyed.withColumn("_own", F.when(alone, F.lit(None)).otherwise(F.col("row_id")))
    w = Window.partitionBy("_file", "customer_id", "_own").orderBy("_day", "row_id")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    seen = lambda f: F.when(F.col(f"_v_{f}").isNotNull(), F.struct(F.col("_day").alias("d"), F.col(f"_v_{f}").alias("v")))
    return keyed.select(
        "row_id", "snapshot_id", "_day", *[f"_{k}_{f}" for k in "mvr" for f in FIELDS],
        *[F.last(seen(f), ignorenulls=True).over(back).alias(f"_p_{f}") for f in FIELDS],
        *[F.first(seen(f), ignorenulls=True).over(ahead).alias(f"_n_{f}") for f in FIELDS],
    )


def learn_stand_ins(rows: DataFrame) -> dict[str, list]:
    """Field to the stand-ins that the rows show beyond the known ones; a value is one of at most 1 / SHARE."""
    n = rows.count()
    least = max(n * SHARE, LEAST)
    out: dict[str, list] = {}
    for f in FIELDS:
        raw, p, q = F.col(f"_r_{f}"), F.col(f"_p_{f}.v"), F.col(f"_n_{f}.v")
        seen = rows.where(~F.col(f"_m_{f}") & (p.isNotNull() | q.isNotNull()))
        if f == "contract":
            near = seen.select(raw.alias("v"), F.col(f"_v_{f}").alias("own"), F.coalesce(p, q).alias("near")).groupBy("v", "own", "near").agg(F.count(F.lit(1)).alias("n"))
            per = near.groupBy("v").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum(F.when(F.col("own") == F.col("near"), F.col("n")).otherwise(0)).alias("same"))
            found = per.where((F.col("n") >= least) & (F.col("same") < 0.05 * F.col("n")) & (F.col("top") < 0.75 * F.col("n"))).select("v").collect()
            out[f] = [r["v"] for r in found]
            continue
        lo, hi = F.least(p, q), F.greatest(p, q)
        off = (raw < 0.5 * lo - 2) | (raw > 1.5 * hi + 5)
        per = seen.groupBy(raw.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off")).where("off > 0.6 * n")
        big = [(r["v"], r["n"]) for r in per.where(F.col("n") >= least).collect() if r["v"] not in REAL.get(f, [])]
        if not big:
            continue
        # what lies around a recurring value, other recurring ones left out: one row per candidate
        spikes = F.array(*[F.lit(float(v)) for v, _ in big])
        around = per.where(F.col("n") < least).select("v", "n", F.explode(spikes).alias("at")).where(F.abs(F.col("v") - F.col("at")) <= F.greatest(F.lit(3.0), 0.005 * F.abs("at")))
        crowd = {r["at"]: r["n"] for r in around.groupBy("at").agg(F.sum("n").alias("n")).collect()}
        out[f] = [v for v, k in big if k >= 8 * crowd.get(v, 0)]
    return {f: v for f, v in out.items() if v}


def found(churn: DataFrame, loads: DataFrame) -> DataFrame:
    """(row_id, field_name) of every cell that the filling marks."""
    return fill_missing(churn, loads).select("row_id", "field_name")


def fill_missing(churn: DataFrame, loads: DataFrame, gap_days: int = 100, pooled_states: int = 3) -> DataFrame:
    """One row per missing cell: row_id, field_name, value (as text), method, distance_days.

    ``method`` is ``interpolate``, ``carry``, ``group`` (median or most frequent value of the load,
    ties to the smaller) or ``none``; the distance is that of the nearer neighbour in time.
    """
    from cairn.session import cut

    keyed = cut(_neighbours(churn, loads, pooled_states, {}))
    learned = learn_stand_ins(keyed)
    if learned:
        keyed = cut(_neighbours(churn, loads, pooled_states, learned))

    def cell(f: str) -> Column:
        p, n, day = F.col(f"_p_{f}"), F.col(f"_n_{f}"), F.col("_day")
        dp, dn = day - p["d"], n["d"] - day
        near = F.least(dp, dn)
        carried = F.when(dn.isNull() | (dp <= dn), p["v"]).otherwise(n["v"])
        if f == "contract":
            v, how = F.when(near <= gap_days, carried), F.when(near <= gap_days, F.lit("carry"))
        else:
            both = p.isNotNull() & n.isNotNull()
            between = F.when(dp + dn > 0, p["v"] + (n["v"] - p["v"]) * dp / (dp + dn)).otherwise(p["v"])
            carry = carried
            if f == "tenure_months":  # one month more for each month between the loads
                carry = F.greatest(F.when(dn.isNull() | (dp <= dn), p["v"] + F.round(dp / 30.44)).otherwise(n["v"] - F.round(dn / 30.44)), F.lit(0.0))
            v = F.when(both, between).when(near <= gap_days, carry)
            how = F.when(both, F.lit("interpolate")).when(near <= gap_days, F.lit("carry"))
            v = F.round(v, 2 if f == "monthly_charges" else 0)
            v = v if f == "monthly_charges" else v.cast("long")
        return F.when(F.col(f"_m_{f}"), F.struct(F.lit(f).alias("field_name"), v.cast("string").alias("value"), how.alias("method"), F.round(near, 1).alias("distance_days")))

    cells = keyed.select("row_id", "snapshot_id", F.explode(F.array_compact(F.array(*[cell(f) for f in FIELDS]))).alias("c")).select("row_id", "snapshot_id", "c.*")

    # exact medians: the buffers hold distinct values within PLAUSIBLE, charges in cents
    group = keyed.groupBy("snapshot_id").agg(
        *[F.percentile(F.round(f"_v_{f}", 2), 0.5).alias(f) for f in NUMERIC],
        F.mode("_v_contract", deterministic=True).alias("contract"),
    )
    group = group.select("snapshot_id", *[(F.col(f) if f == "contract" else F.round(f, 2 if f == "monthly_charges" else 0).cast("double" if f == "monthly_charges" else "long")).cast("string").alias(f) for f in FIELDS])
    group = group.unpivot("snapshot_id", FIELDS, "field_name", "_group")
    out = cells.join(group, ["snapshot_id", "field_name"], "left")
    return out.select(
        "row_id", "field_name", F.coalesce("value", "_group").alias("value"),
        F.when(F.col("value").isNotNull(), F.col("method")).when(F.col("_group").isNotNull(), "group").otherwise("none").alias("method"),
        F.when(F.col("value").isNotNull(), F.col("distance_days")).alias("distance_days"),
    )
