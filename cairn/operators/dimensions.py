"""The seven quality dimensions of any table, found from names, types and values, with an overall grade and advice.

Every dimension is one or two aggregations over all rows and columns; what reaches the driver is a number per
column. A dimension that can't be measured has no score and counts as 50. Empty tables have no scores.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators import quality as K
from cairn.operators.association import pearson_pairs
from cairn.operators.profile import cell_counts, finite, numeric_columns, text_columns
from cairn.operators.relational import quantiles

# What a column's name says about its values.
RANGES: list[tuple[str, float, float]] = [
    (r"(^|_)age($|_)", 0, 130), (r"percent|pct|(^|_)share($|_)", 0, 100), (r"(^|_)year($|_)", 1900, 2100), (r"(^|_)month($|_)", 1, 12), (r"(^|_)day($|_)", 1, 31), (r"(^|_)hour($|_)", 0, 23), (r"(^|_)minute($|_)", 0, 59),
    (r"(^|_)lat(itude)?($|_)", -90, 90), (r"(^|_)(lon|lng|longitude)($|_)", -180, 180), (r"(^|_)(prob|probability|discount|ratio)($|_)", 0, 1), (r"rating|stars", 0, 10),
    (r"price|cost|amount|quantity|charge|tenure|count|size|weight|height|width|length|duration|distance|population|salary|income", 0, float("inf")),
]
_PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "phone": r"\+[0-9]{1,3}[ .-]?[0-9]{2,4}[ .-][0-9]{3,}", "card": r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b", "ip": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"}
_IDENT = re.compile(r"(^|_)(id|key|uuid|code)$|^(id|key)(_|$)")


def hinted_ranges(df: DataFrame) -> dict[str, tuple[float, float]]:
    """Numeric columns whose name says what range their values have; the first hint counts."""
    out = {}
    for c in numeric_columns(df.schema):
        for rx, lo, hi in RANGES:
            if re.search(rx, c.lower()):
                out[c] = (lo, hi)
                break
    return out


def validity(df: DataFrame) -> float | None:
    """Share of cells within their hinted range, and of texts without stray white space; null without either."""
    ranges, texts = hinted_ranges(df), text_columns(df.schema)
    checks: list[tuple[Column, Column]] = []
    for c, (lo, hi) in ranges.items():
        v = finite(df.schema, c)
        checks.append((v.isNotNull(), (v < lo) | (v > hi)))
    for c in texts:
        checks.append((F.col(c).isNotNull(), F.col(c) != F.trim(F.col(c))))
    if not checks:
        return None
    r = df.agg(*[F.count_if(a).alias(f"n{i}") for i, (a, _) in enumerate(checks)], *[F.count_if(b).alias(f"b{i}") for i, (_, b) in enumerate(checks)]).first()
    shares = [r[f"b{i}"] / r[f"n{i}"] for i in range(len(checks)) if r[f"n{i}"]]
    return round(100 * (1 - sum(shares) / len(shares)), 4) if shares else None


def ordered_pairs(names: list[str]) -> list[tuple[str, str]]:
    """Pairs of columns of which the first may not exceed the second, by name (start and end, min and max, from and to)."""
    words = [("start", "end"), ("begin", "end"), ("min", "max"), ("low", "high"), ("from", "to"), ("birth", "death"), ("created", "updated"), ("created", "arrived"), ("order", "ship")]
    have, out = {c.lower(): c for c in names}, []
    for c in names:
        for a, b in words:
            parts = re.split(r"_", c.lower())
            if a in parts:
                other = "_".join(b if p == a else p for p in parts)
                if other in have and (c, have[other]) not in out:
                    out.append((c, have[other]))
    return out


def consistency(df: DataFrame) -> float | None:
    """Share of rows that keep the order of paired columns, less the share of text columns that hide numbers."""
    types = dict(df.dtypes)
    pairs = [(a, b) for a, b in ordered_pairs(df.columns) if types[a] == types[b] and types[a] != "string"]
    texts = text_columns(df.schema)
    if not pairs and not texts:
        return None
    cells = [F.count_if(F.col(a) > F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    seen = [F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"q{i}") for i, (a, b) in enumerate(pairs)]
    number = [F.count_if(F.trim(c).rlike(r"^[+-]?\d+(\.\d+)?$")).alias(f"t{i}") for i, c in enumerate(texts)]
    filled = [F.count(c).alias(f"u{i}") for i, c in enumerate(texts)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *cells, *seen, *number, *filled).first()
    if not r["n"]:
        return None
    wrong = max([r[f"p{i}"] / r[f"q{i}"] for i in range(len(pairs)) if r[f"q{i}"]] or [0.0])
    hidden = sum(1 for i in range(len(texts)) if r[f"u{i}"] and r[f"t{i}"] > 0.9 * r[f"u{i}"])
    return round(max(0.0, 100 * (1 - wrong) - 10 * hidden), 4)


def integrity(df: DataFrame) -> float | None:
    """100 less 15 for each kind of personal data that any cell holds, and 2 for each ill-formed column name, at most 20."""
    texts = text_columns(df.schema)
    aggs = [F.coalesce(F.max(F.greatest(*[F.coalesce(F.col(c).rlike(rx), F.lit(False)) for c in texts], F.lit(False))), F.lit(False)).alias(k) for k, rx in _PII.items()] if texts else []
    r = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    if not r["n"]:
        return None
    bad = sum(1 for c in df.columns if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", c))
    return float(max(0, 100 - 15 * sum(bool(r[k]) for k in _PII if texts) - min(20, 2 * bad)))


def distribution(df: DataFrame) -> float | None:
    """Mean over the numeric columns that are no identifiers: .3 skewness, .2 kurtosis, .3 outliers, .2 entropy of ten bins."""
    names = [c for c in numeric_columns(df.schema) if not _IDENT.search(c.lower())]
    if not names:
        return None
    v = {c: finite(df.schema, c) for c in names}
    q = {r["column_name"]: r for r in quantiles(df, v, [0.0, 0.25, 0.75, 1.0]).collect()}
    aggs = []
    for i, c in enumerate(names):
        lo, q1, q3, hi = q[c]["q"]
        if lo is None or q[c]["n"] < 3:
            continue
        width = (hi - lo) / 10 or 1.0
        bins = [F.count_if((F.least(F.floor((v[c] - lo) / width), F.lit(9))) == b).alias(f"h{i}_{b}") for b in range(10)]
        aggs += [F.count(v[c]).alias(f"n{i}"), F.skewness(v[c]).alias(f"s{i}"), F.kurtosis(v[c]).alias(f"k{i}"), F.count_if((v[c] < q1 - 1.5 * (q3 - q1)) | (v[c] > q3 + 1.5 * (q3 - q1))).alias(f"o{i}"), *bins]
    if not aggs:
        return None
    import math

    r, scores = df.agg(*aggs).first().asDict(), []
    for i in range(len(names)):
        n = r.get(f"n{i}")
        if not n:
            continue
        g1, g2 = r[f"s{i}"] or 0.0, r[f"k{i}"] or 0.0
        if n > 3:  # corrected for the sample
            g1, g2 = g1 * math.sqrt(n * (n - 1)) / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        p = [r[f"h{i}_{b}"] / n for b in range(10)]
        entropy = -sum(x * math.log2(x) for x in p if x) / math.log2(10)
        scores.append(0.3 * max(0.0, 100 - 10 * abs(g1)) + 0.2 * max(0.0, 100 - 5 * abs(g2)) + 0.3 * max(0.0, 100 - 500 * r[f"o{i}"] / n) + 0.2 * 100 * entropy)
    return round(sum(scores) / len(scores), 4) if scores else None


def training(df: DataFrame, target: str | None = None) -> float | None:
    """Fitness for training: .25 rows, .20 rows per column, .20 filled cells, .20 balance of the target, .15 independent columns."""
    base = K.completeness(df).first()
    n, cols = df.count(), len(df.columns)
    if not n:
        return None
    size = 100.0 if n >= 10_000 else 80.0 if n >= 1000 else 50.0 if n >= 100 else 20.0
    per = min(100.0, 100.0 * n / (cols * 20))
    target = target or K.target_candidates(df).orderBy(F.desc("score"), "column_name").first()["column_name"]
    ratio = K.imbalance(df, target).first()["ratio"]
    balance = 50.0 if ratio is None else 100.0 if ratio <= 1.5 else 80.0 if ratio <= 3 else 50.0 if ratio <= 10 else 20.0
    nums = [c for c in numeric_columns(df.schema) if not _IDENT.search(c.lower())]
    tied = pearson_pairs(df, nums).where(F.abs("r") > 0.9).count() if len(nums) > 1 else 0
    return round(0.25 * size + 0.20 * per + 0.20 * 100 * base["cell_share"] + 0.20 * balance + 0.15 * max(0.0, 100 - 20 * tied), 4)


def dimensions(df: DataFrame, identifier: str | None = None, target: str | None = None) -> DataFrame:
    """(dimension, score, weight) of all seven dimensions; a dimension that fails has no score."""
    identifier = identifier or next((c for c in df.columns if _IDENT.search(c.lower())), df.columns[0])
    parts: dict[str, Callable[[], float | None]] = {
        "completeness": lambda: K.completeness(df).first()["score"], "uniqueness": lambda: K.uniqueness(df, identifier).first()["score"], "validity": lambda: validity(df), "consistency": lambda: consistency(df),
        "integrity": lambda: integrity(df), "distribution": lambda: distribution(df), "readiness": lambda: training(df, target),
    }
    rows = []
    for k, f in parts.items():
        try:
            s = f()
        except Exception:  # noqa: BLE001  counts as 50, like a dimension that can't be measured
            s = None
        rows.append((k, None if s is None else float(s), K.WEIGHTS[k]))
    return df.sparkSession.createDataFrame(rows, "dimension string, score double, weight double")


def overall(dims: DataFrame) -> DataFrame:
    """(score, grade): weighted, a dimension without a score counts 50."""
    s = F.round(F.sum(F.coalesce("score", F.lit(50.0)) * F.col("weight")), 2)
    return dims.agg(s.alias("score")).select("score", K.grade(F.col("score"), [(90, "A"), (75, "B"), (60, "C"), (45, "D")], "F").alias("grade"))


# What to do about a dimension.
ADVICE = {
    "completeness": "fill or drop missing cells", "uniqueness": "remove repeated rows and constant columns", "validity": "correct values outside of their range and stray white space", "consistency": "put paired columns in order, turn hidden numbers into numbers",
    "integrity": "redact personal data, rename columns", "distribution": "transform skewed columns, treat outliers", "readiness": "add rows, balance classes, drop redundant columns",
}


def recommendations(dims: DataFrame, enough: float = 90.0) -> DataFrame:
    """(priority, dimension, gain, advice) of the dimensions below ``enough``, by what mending them would add to the overall score."""
    say = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    x = dims.withColumn("gain", F.round((100 - F.coalesce("score", F.lit(50.0))) * F.col("weight"), 4)).where(F.coalesce("score", F.lit(50.0)) < enough)
    p = F.when(F.col("gain") >= 5, "high").when(F.col("gain") >= 2, "medium").otherwise("low")
    return x.select(p.alias("priority"), "dimension", "gain", say[F.col("dimension")].alias("advice"))
