"""Audits of a whole training table in one call: findings with severity and confidence, and a score.

Each audit runs the single measures of ``audit``, ``association``, ``drift`` and ``relational`` and turns
their few numbers into findings. A part whose input is missing is reported as skipped, never guessed: without
a test part there is no overlap. What reaches the driver are statistics per column, class or group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators import association as A, audit as T, drift as D, quality as K, relational as R, scores as S
from cairn.operators.profile import finite, numeric_columns, text_columns

FINDINGS = "detector string, subject string, measure double, severity string, confidence double"


def _tier(x: float | None, tiers: list[tuple[float, str]]) -> str | None:
    """The first tier that a measure reaches."""
    return None if x is None else next((name for bound, name in tiers if x >= bound), None)


def _run(parts: dict[str, Callable[[], list[tuple]]]) -> list[tuple]:
    """The findings of all parts; a part that fails is a finding of its own and doesn't stop the others."""
    out: list[tuple] = []
    for name, part in parts.items():
        try:
            out += part()
        except Exception as e:  # noqa: BLE001  one detector's failure is a result too
            out.append((name, f"failed: {str(e).splitlines()[0][:120]}", None, "info", 0.0))
    return out


def leakage(train: DataFrame, test: DataFrame | None, target: str, features: list[str] | None = None, entity: str | None = None, time: str | None = None) -> DataFrame:
    """Findings on leakage: target (correlation, information), overlap of train and test, entities, time order, redundant features.

    Numbers are compared with the target by rank and by binned information, all columns; test rows by digests.
    """
    schema = train.schema
    names = features or [c for c in train.columns if c not in (target, entity, time)]
    nums = [c for c in names if c in numeric_columns(schema)]

    def on_target() -> list[tuple]:
        out = []
        for c in nums if target in numeric_columns(schema) else []:
            rho = abs(A.spearman(train, c, target).first()["r"] or 0.0)
            nmi = A.mutual_information(train, c, target).first()["nmi"] or 0.0
            hits = (rho >= 0.95) + (nmi >= 0.85)
            if hits:
                out.append(("target", c, float(max(rho, nmi)), "critical" if hits == 2 else "high", 0.9 if hits == 2 else 0.6))
        return out

    def overlap() -> list[tuple]:
        if test is None:
            return [("overlap", "skipped: no test part", None, "info", 0.0)]
        n = test.count()
        share = R.exact_overlap(test, train, names + [target]).count() / max(n, 1)
        sev = _tier(share, [(0.05, "critical"), (0.01, "high"), (1e-12, "medium")])
        return [("overlap", "rows", share, sev, 1.0)] if sev else []

    def entities() -> list[tuple]:
        if test is None or entity is None:
            return [("entity", "skipped: no test part or no entity", None, "info", 0.0)]
        share = T.group_leakage(train, test, entity).first()["ratio"]
        sev = _tier(share, [(0.05, "high"), (0.01, "medium"), (1e-12, "low")])
        return [("entity", entity, float(share), sev, 0.9)] if sev else []

    def order() -> list[tuple]:
        if test is None or time is None:
            return [("time", "skipped: no test part or no time", None, "info", 0.0)]
        last = test.agg(F.min(time).alias("t")).first()["t"]
        r = train.agg(F.avg((F.col(time) >= F.lit(last)).cast("double")).alias("s")).first()["s"] or 0.0
        sev = _tier(r, [(0.2, "high"), (0.05, "medium")])
        return [("time", time, float(r), sev, 0.8)] if sev else []

    def redundant() -> list[tuple]:
        pairs = A.pearson_pairs(train, nums).where(F.abs("r") >= 0.95).collect() if len(nums) > 1 else []
        return [("redundant", f"{p['a']}~{p['b']}", float(abs(p["r"])), "medium" if abs(p["r"]) >= 0.99 else "low", 0.7) for p in pairs]

    return train.sparkSession.createDataFrame(_run({"target": on_target, "overlap": overlap, "entity": entities, "time": order, "redundant": redundant}), FINDINGS)


def leakage_score(findings: DataFrame) -> DataFrame:
    """(findings, score, grade): each finding costs its severity's penalty by its confidence, half where that is under 0.7."""
    cost = F.create_map(*[x for k, v in T.PENALTY.items() for x in (F.lit(k), F.lit(v))])[F.col("severity")]
    x = findings.where("measure IS NOT NULL").agg(F.count(F.lit(1)).alias("findings"), F.coalesce(F.sum(cost * F.col("confidence") * F.when(F.col("confidence") >= 0.7, 1.0).otherwise(0.5)), F.lit(0.0)).alias("c"))
    score = F.round(F.greatest(100 - F.col("c"), F.lit(0.0)), 2)
    return x.select("findings", score.alias("score"), K.grade(score, [(90, "A"), (70, "B"), (50, "C"), (30, "D")], "F").alias("grade"))


def label_quality(df: DataFrame, label: str, features: list[str], probs: list[str] | None = None, order: str | None = None) -> DataFrame:
    """(dimension, measure, score, weight): noise, inconsistency, ambiguity, drift, imbalance and confidence of labels, 0 to 100 each.

    ``label`` holds class numbers where ``probs`` (a column per class) are given; without them noise, ambiguity
    and confidence have no score and the overall one is taken over the others (``overall_label_quality``).
    """
    out: dict[str, tuple[float | None, float | None]] = dict.fromkeys(S.LABELS, (None, None))
    inc = T.inconsistent_labels(df, features, label).first()
    share = (inc["conflicting_rows"] or 0) / max(inc["rows"] or 0, 1)
    out["inconsistent"] = (share, max(0.0, 100 - 500 * share))
    ratio = K.imbalance(df, label).first()["ratio"]
    out["imbalance"] = (ratio, None if ratio is None else 100.0 if ratio <= 1.5 else 80.0 if ratio <= 3 else 50.0 if ratio <= 10 else 20.0)
    if order is not None:
        lo = D.label_windows(df, order, label)
        w = lo.groupBy("label").agg((F.max("share") - F.min("share")).alias("d")).agg(F.max("d").alias("d")).first()["d"] or 0.0
        out["drift"] = (w, max(0.0, 100 - 200 * w))
    if probs:
        joint = T.confident_joint(df, label, probs)
        j = joint.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("given") != F.col("guess"), F.col("n")).otherwise(0)).alias("off")).first()
        noise = (j["off"] or 0) / max(j["n"] or 0, 1)
        p = F.array_sort(F.array(*[F.col(c).cast("double") for c in probs]), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
        m = df.agg(F.avg(((p[0] - p[1]) < 0.2).cast("double")).alias("close"), F.avg(p[0]).alias("top")).first()
        out |= {"noise": (noise, max(0.0, 100 - 100 * noise)), "ambiguous": (m["close"], max(0.0, 100 - 300 * (m["close"] or 0.0))), "confidence": (m["top"], 100 * (m["top"] or 0.0))}
    rows = [(k, None if a is None else float(a), None if b is None else float(b), S.LABELS[k]) for k, (a, b) in out.items()]
    return df.sparkSession.createDataFrame(rows, "dimension string, measure double, score double, weight double")


def overall(dimensions: DataFrame, tiers: tuple[float, ...] = (90, 75, 60, 40), names: str = "ABCDF") -> DataFrame:
    """(score, grade) of rows with score and weight; rows without a score don't count."""
    x = dimensions.where("score IS NOT NULL").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 2).alias("score"))
    return x.select("score", K.grade(F.col("score"), list(zip(tiers, names)), names[-1]).alias("grade"))


def bias(df: DataFrame, groups: list[str], label: Column, train: Column | None = None) -> DataFrame:
    """Findings on bias per sensitive column: representation, outcome, proxies among the other columns, sampling.

    Every column is tried as a proxy: texts by the association of categories, numbers by their share of variance.
    """
    texts, nums = text_columns(df.schema), numeric_columns(df.schema)

    def of(g: str) -> dict[str, Callable[[], list[tuple]]]:
        def representation() -> list[tuple]:
            r = df.where(F.col(g).isNotNull()).groupBy(g).agg(F.count(F.lit(1)).alias("n")).agg((F.min("n") / F.max("n")).alias("r")).first()["r"]
            sev = None if r is None else _tier(1 - r, [(0.8, "high"), (0.5, "medium"), (0.2, "low")])
            return [("representation", g, float(r), sev, 1.0)] if sev else []

        def outcome() -> list[tuple]:
            r = T.label_rates(df, g, label).agg((F.min("rate") / F.nullif(F.max("rate"), F.lit(0.0))).alias("r")).first()["r"]
            sev = None if r is None else _tier(1 - r, [(0.5, "high"), (0.2, "medium"), (0.1, "low")])
            return [("outcome", g, float(r), sev, 0.9)] if sev else []

        def proxies() -> list[tuple]:
            out = []
            for c in texts:
                if c != g:
                    v = A.contingency(df, g, c).first()["v_corrected"]
                    if sev := _tier(v, [(0.70, "high"), (0.55, "medium"), (0.40, "low")]):
                        out.append(("proxy", f"{g}~{c}", float(v), sev, 0.7))
            for c in nums:
                v = A.correlation_ratio(df, g, c).first()["eta"]
                if c != g and (sev := _tier(v, [(0.70, "high"), (0.55, "medium"), (0.40, "low")])):
                    out.append(("proxy", f"{g}~{c}", float(v), sev, 0.7))
            return out

        def sampling() -> list[tuple]:
            if train is None:
                return [("sampling", "skipped: no parts", None, "info", 0.0)]
            gap = T.sampling_bias(df, g, train).agg(F.max("gap").alias("d")).first()["d"]
            sev = _tier(gap, [(0.20, "high"), (0.10, "medium"), (0.05, "low")])
            return [("sampling", g, float(gap), sev, 0.8)] if sev else []

        return {f"representation {g}": representation, f"outcome {g}": outcome, f"proxy {g}": proxies, f"sampling {g}": sampling}

    return df.sparkSession.createDataFrame([f for g in groups for f in _run(of(g))], FINDINGS)


# Points of a finding by its severity in the bias score, and the detectors' weights.
POINTS = {"critical": 25.0, "high": 25.0, "medium": 15.0, "low": 7.0, "info": 0.0}
BIAS = {"representation": 0.20, "outcome": 0.30, "proxy": 0.20, "sampling": 0.15}


def bias_score(findings: DataFrame) -> DataFrame:
    """(score, grade): 0 is unbiased; each detector's points by confidence, at most 100, weighted."""
    pick = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
    per = findings.where("measure IS NOT NULL").groupBy("detector").agg(F.least(F.sum(pick(POINTS)[F.col("severity")] * F.col("confidence")), F.lit(100.0)).alias("s"))
    score = F.round(F.coalesce(F.sum(F.col("s") * pick(BIAS)[F.col("detector")]), F.lit(0.0)) / sum(BIAS.values()), 2)
    return per.agg(score.alias("score")).select("score", F.when(F.col("score") < 10, "A").when(F.col("score") < 25, "B").when(F.col("score") < 50, "C").otherwise("D").alias("grade"))


def readiness(df: DataFrame, label: str, split: Column, digest: Column) -> DataFrame:
    """(dimension, measure, score, weight, blocking): size, balance, split, leakage and quality of a training table."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    n, ratio = c["n"] or 0, (c["most"] / c["least"]) if c["least"] else None
    balance = 0.0 if ratio is None or ratio >= 10 else 25.0 if ratio >= 5 else 55.0 if ratio >= 2 else 80.0 if ratio >= 1.5 else 100.0
    parts = {r["s"]: r["n"] for r in df.groupBy(split.alias("s")).agg(F.count(F.lit(1)).alias("n")).where("s IS NOT NULL").collect()}
    total = sum(parts.values())
    share = parts.get("train", 0) / total if total else 0.0
    shared = T.split_leakage(df, digest, split).where("shared > 0").count()
    full = K.completeness(df).first()["score"]
    rows = [
        ("size", float(n), T.size_score(n, [c["least"] or 0]), S.READY["size"], False), ("balance", ratio, balance, S.READY["balance"], balance == 0),
        ("split", share, 100.0 if 0.6 <= share <= 0.9 and len(parts) >= 2 else 50.0 if len(parts) >= 2 else 0.0, S.READY["split"], False),
        ("leakage", float(shared), max(0.0, 100.0 - 40 * shared), S.READY["leakage"], False), ("quality", full / 100 if full is not None else None, full, S.READY["quality"], False),
    ]
    return df.sparkSession.createDataFrame(rows, "dimension string, measure double, score double, weight double, blocking boolean")


def readiness_score(dimensions: DataFrame) -> DataFrame:
    """(score, ready): the weighted mean of the dimensions present, at most 50 with a blocking one; ready from 60 on."""
    x = dimensions.where("score IS NOT NULL").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("s"), F.max("blocking").alias("b"))
    score = F.round(F.when(F.col("b"), F.least("s", F.lit(50.0))).otherwise(F.col("s")), 2)
    return x.select(score.alias("score"), (~F.col("b") & (score >= 60)).alias("ready"))
