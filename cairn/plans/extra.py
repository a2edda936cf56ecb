"""Queries of the change, audit and exact-quantile operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import association as A, audits as U, change as C, dimensions as M, relational as R, scores as S, statistics as G, text_quality as X
from cairn.session import read

Q, O = {}, {}


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        O[name] = sql


# -- changes ---------------------------------------------------------------------------------------------------------
_cols = lambda t: f"(SELECT column_name FROM information_schema.columns WHERE table_name = '{t}')"
add(
    "set3_schema_changes",
    lambda s, d: C.schema_changes(read(s, d, "customer"), read(s, d, "supplier")).select("column_name", "change"),
    f"SELECT COALESCE(a.column_name, b.column_name) AS column_name, CASE WHEN b.column_name IS NULL THEN 'removed' ELSE 'added' END AS change FROM {_cols('customer')} a FULL JOIN {_cols('supplier')} b ON a.column_name = b.column_name WHERE a.column_name IS NULL OR b.column_name IS NULL",
)


def _loads(s, d):
    """Two halves of the orders, the second with dearer orders, another priority, lost statuses and a new column."""
    o = read(s, d, "orders").drop("o_orderdate")
    late = F.col("o_orderkey") % 2 == 1
    b = o.where(late).select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") * 1.3).alias("o_totalprice"), F.regexp_replace("o_orderpriority", "5-LOW", "6-NEW").alias("o_orderpriority"), F.lit(1).alias("o_extra"))
    return o.where(~late), b


def _change_sql(verdict: bool = False) -> str:
    a, b = "(SELECT * FROM orders WHERE o_orderkey % 2 <> 1)", "(SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 5 > 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice * 1.3 AS o_totalprice, replace(o_orderpriority, '5-LOW', '6-NEW') AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 1)"
    gap = lambda c: f"((SELECT AVG(({c} IS NULL)::INT) FROM {b}) - (SELECT AVG(({c} IS NULL)::INT) FROM {a}))"
    num = " UNION ALL ".join(f"SELECT '{c}' AS column_name, abs(mb - ma) / abs(ma) AS mean_change, abs(sb - sa) / abs(sa) AS std_change, nb < na AS new_min, xb > xa AS new_max, {gap(c)} AS missing_change FROM (SELECT AVG({c}) AS ma, stddev_samp({c}) AS sa, MIN({c}) AS na, MAX({c}) AS xa FROM {a}), (SELECT AVG({c}) AS mb, stddev_samp({c}) AS sb, MIN({c}) AS nb, MAX({c}) AS xb FROM {b})" for c in ("o_orderkey", "o_custkey", "o_totalprice"))
    cat = " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE na = 0) AS new_values, COUNT(*) FILTER (WHERE nb = 0) AS gone_values, arg_max(v, (na, v)) <> arg_max(v, (nb, v)) AS top_changed, {gap(c)} AS missing_change FROM (SELECT COALESCE(x.v, y.v) AS v, COALESCE(na, 0) AS na, COALESCE(nb, 0) AS nb FROM (SELECT {c} AS v, COUNT(*) AS na FROM {a} WHERE {c} IS NOT NULL GROUP BY 1) x FULL JOIN (SELECT {c} AS v, COUNT(*) AS nb FROM {b} WHERE {c} IS NOT NULL GROUP BY 1) y ON x.v = y.v)" for c in ("o_orderstatus", "o_orderpriority"))
    miss = "(abs(missing_change) >= 0.05)::INT"
    n = f"SELECT column_name, 'numeric' AS kind, mean_change, std_change, new_min, new_max, NULL::BIGINT AS new_values, NULL::BIGINT AS gone_values, NULL::BOOLEAN AS top_changed, missing_change, (mean_change >= 0.1)::INT + (std_change >= 0.25)::INT + (new_min OR new_max)::INT + {miss} AS issues FROM ({num})"
    c = f"SELECT column_name, 'categorical', NULL, NULL, NULL, NULL, new_values, gone_values, top_changed, missing_change, (new_values > 0)::INT + (gone_values > 0)::INT + top_changed::INT + {miss} FROM ({cat})"
    rows = f"SELECT *, CASE issues WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity FROM ({n} UNION ALL {c}) WHERE issues > 0 UNION ALL SELECT 'o_extra', 'schema_added', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1, 'high'"
    if not verdict:
        return rows
    k = lambda x: f"COUNT(*) FILTER (WHERE severity = '{x}')"
    return f"SELECT COUNT(*) AS changed_columns, {k('high')} AS high, {k('medium')} AS medium, {k('low')} AS low, CASE WHEN {k('high')} > 0 OR {k('medium')} >= 3 THEN 'high' WHEN {k('medium')} > 0 OR {k('low')} >= 3 THEN 'medium' WHEN {k('low')} > 0 THEN 'low' ELSE 'none' END AS verdict FROM ({rows})"


add("drf1_table_changes", lambda s, d: C.table_changes(*_loads(s, d)), _change_sql())
add("drf1_verdict", lambda s, d: C.verdict(C.table_changes(*_loads(s, d))), _change_sql(True))

# -- audits ----------------------------------------------------------------------------------------------------------
_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PLANTED = "(SELECT *, l_extendedprice * (1 - l_discount) AS target FROM lineitem)"


def _target(s, d):
    return read(s, d, "lineitem").withColumn("target", F.col("l_extendedprice") * (1 - F.col("l_discount")))


def _leak(s, d):
    x = _target(s, d).select("l_orderkey", *_LI, "target", "l_shipdate")
    return U.leakage(x.where("l_orderkey % 5 > 0"), x.where("l_orderkey % 5 = 0 OR l_orderkey % 50 = 1"), "target", _LI, "l_orderkey", "l_shipdate")


add("fcd7_leakage_audit", _leak)
add(
    "lek8_score",
    lambda s, d: U.leakage_score(A.pearson_pairs(_target(s, d), [*_LI, "target"]).where(F.abs("r") >= 0.3).select(F.lit("redundant").alias("detector"), F.concat_ws("~", "a", "b").alias("subject"), F.abs("r").alias("measure"), F.when(F.abs("r") >= 0.95, "high").otherwise("medium").alias("severity"), F.round(F.abs("r"), 6).alias("confidence"))),
    "WITH p AS (" + " UNION ALL ".join(f"SELECT abs(corr({a}, {b})) AS r FROM {_PLANTED}" for i, a in enumerate([*_LI, "target"]) for b in [*_LI, "target"][i + 1 :]) + "), f AS (SELECT COUNT(*) AS findings, round(greatest(100 - COALESCE(SUM(CASE WHEN r >= 0.95 THEN 15 ELSE 8 END * round(r, 6) * CASE WHEN round(r, 6) >= 0.7 THEN 1 ELSE 0.5 END), 0), 0), 2)::DOUBLE AS score FROM p WHERE r >= 0.3) SELECT findings, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 30 THEN 'D' ELSE 'F' END AS grade FROM f",
)
add(
    "lbl7_score",
    lambda s, d: U.overall(U.label_quality(read(s, d, "orders").withColumn("day", F.dayofyear("o_orderdate")), "o_orderstatus", ["o_orderpriority", "day"])),
    "WITH g AS (SELECT COUNT(*) AS n, MIN(o_orderstatus) <> MAX(o_orderstatus) AS clash FROM orders GROUP BY o_orderpriority, dayofyear(o_orderdate)), i AS (SELECT greatest(0, 100 - 500.0 * SUM(CASE WHEN clash THEN n ELSE 0 END) / SUM(n)) AS a FROM g), r AS (SELECT MAX(n) / MIN(n) AS r FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_orderstatus)), x AS (SELECT round((0.20 * a + 0.10 * CASE WHEN r <= 1.5 THEN 100 WHEN r <= 3 THEN 80 WHEN r <= 10 THEN 50 ELSE 20 END) / 0.30, 2)::DOUBLE AS score FROM i, r) SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM x",
)
add("lbl8_label_audit", lambda s, d: U.label_quality(read(s, d, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int")).withColumn("p1", F.when(F.col("o_custkey") % 10 == 0, 0.4).otherwise(F.col("y") * 0.6 + 0.2)).withColumn("p0", 1 - F.col("p1")).withColumn("t", F.unix_seconds(F.col("o_orderdate").cast("timestamp"))), "y", ["o_orderpriority", "o_custkey"], ["p0", "p1"], "t"))
def _biased(s, d):
    """Returned lines mostly of one status, accepted ones of the other."""
    odd = F.col("l_orderkey") % 8 > 0
    status = F.when((F.col("l_returnflag") == "R") & odd, "F").when((F.col("l_returnflag") == "A") & odd, "O").otherwise(F.col("l_linestatus"))
    return read(s, d, "lineitem").select("l_returnflag", status.alias("l_linestatus"), "l_quantity", "l_discount", "l_orderkey")


add("fcd9_bias_audit", lambda s, d: U.bias(_biased(s, d), ["l_returnflag", "l_linestatus"], F.col("l_linestatus") == "F", F.col("l_orderkey") % 5 > 0))
_cnt = "c AS (SELECT l_returnflag AS a, CASE WHEN l_returnflag = 'R' AND l_orderkey % 8 > 0 THEN 'F' WHEN l_returnflag = 'A' AND l_orderkey % 8 > 0 THEN 'O' ELSE l_linestatus END AS b, COUNT(*) AS n FROM lineitem GROUP BY 1, 2), j AS (SELECT n, SUM(n) OVER (PARTITION BY a) AS na, SUM(n) OVER (PARTITION BY b) AS nb, a, b FROM c), s AS (SELECT SUM(n * n / (na * nb)) - 1 AS phi, SUM(n) AS n, COUNT(DISTINCT a) AS r, COUNT(DISTINCT b) AS k FROM j), v AS (SELECT sqrt(greatest(0, phi - (r - 1) * (k - 1) / (n - 1)) / (least(r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)) - 1)) AS v FROM s)"
add(
    "fai15_score",
    lambda s, d: U.bias_score(U.bias(_biased(s, d), ["l_returnflag"], F.col("l_linestatus") == "F").where("detector <> 'sampling'")),
    f"WITH {_cnt}, g AS (SELECT SUM(n) AS n, SUM(CASE WHEN b = 'F' THEN n ELSE 0 END) / SUM(n) AS rate FROM c GROUP BY a), m AS (SELECT 1 - MIN(n) / MAX(n) AS rep, 1 - MIN(rate) / MAX(rate) AS outc FROM g), p AS (SELECT CASE WHEN rep >= 0.8 THEN 25 WHEN rep >= 0.5 THEN 15 WHEN rep >= 0.2 THEN 7 ELSE 0 END * 1.0 * 0.20 + CASE WHEN outc >= 0.5 THEN 25 WHEN outc >= 0.2 THEN 15 WHEN outc >= 0.1 THEN 7 ELSE 0 END * 0.9 * 0.30 + CASE WHEN v >= 0.70 THEN 25 WHEN v >= 0.55 THEN 15 WHEN v >= 0.40 THEN 7 ELSE 0 END * 0.7 * 0.20 AS x FROM m, v), z AS (SELECT round(x / 0.85, 2)::DOUBLE AS score FROM p) SELECT score, CASE WHEN score < 10 THEN 'A' WHEN score < 25 THEN 'B' WHEN score < 50 THEN 'C' ELSE 'D' END AS grade FROM z",
)


def _images(s, d):
    return read(s, d, "image_record").select("class_label", "split", "sha256", "width")


def _readiness(s, d):
    part = F.lower(F.trim("split"))
    split = F.when(part.startswith("train"), "train").when(part.startswith("val"), "val").when(part.startswith("test"), "test")
    return U.readiness(_images(s, d), "class_label", split, F.lower(F.nullif(F.trim("sha256"), F.lit(""))))


add("rdy1_dimensions", _readiness)
_sp = "CASE WHEN lower(trim(split)) LIKE 'train%' THEN 'train' WHEN lower(trim(split)) LIKE 'val%' THEN 'val' WHEN lower(trim(split)) LIKE 'test%' THEN 'test' END"
_m4 = "(class_label IS NULL)::INT + (split IS NULL)::INT + (sha256 IS NULL)::INT + (width IS NULL)::INT"
add(
    "rdy2_score",
    lambda s, d: U.readiness_score(_readiness(s, d)),
    f"""WITH c AS (SELECT COUNT(*) AS n FROM image_record WHERE class_label IS NOT NULL GROUP BY class_label), k AS (SELECT SUM(n) AS n, MIN(n) AS least, MAX(n) / MIN(n) AS ratio FROM c),
sz AS (SELECT round(CASE WHEN n < 50 THEN n / 50.0 * 5 WHEN n < 200 THEN 5 + (n - 50) / 150.0 * 10 WHEN n < 1000 THEN 15 + (n - 200) / 800.0 * 15 WHEN n < 5000 THEN 30 + (n - 1000) / 4000.0 * 12 WHEN n < 20000 THEN 42 + (n - 5000) / 15000.0 * 8 ELSE 50 END + CASE WHEN least >= 100 THEN 50 WHEN least >= 10 THEN 25 ELSE 5 END, 2) AS size, CASE WHEN ratio >= 10 THEN 0 WHEN ratio >= 5 THEN 25 WHEN ratio >= 2 THEN 55 WHEN ratio >= 1.5 THEN 80 ELSE 100 END AS balance FROM k),
x AS (SELECT {_sp} AS s, lower(nullif(trim(sha256), '')) AS h FROM image_record), sp AS (SELECT COUNT(*) FILTER (WHERE s = 'train') / COUNT(*) AS sh, COUNT(DISTINCT s) AS parts FROM x WHERE s IS NOT NULL),
lk AS (SELECT COUNT(DISTINCT a.s) AS shared FROM x a JOIN x b ON a.h = b.h WHERE b.s = 'train' AND a.s <> 'train'),
q AS (SELECT round(100 * (0.40 * (1 - SUM({_m4}) / (COUNT(*) * 4)) + 0.25 * AVG((({_m4}) = 0)::INT) + 0.20 * ((SUM((class_label IS NULL)::INT) = 0)::INT + (SUM((split IS NULL)::INT) = 0)::INT + (SUM((sha256 IS NULL)::INT) = 0)::INT + (SUM((width IS NULL)::INT) = 0)::INT) / 4.0 + 0.15 * (1 - AVG((width IS NULL)::INT))), 4) AS quality FROM image_record),
t AS (SELECT (0.20 * size + 0.17 * balance + 0.10 * CASE WHEN parts < 2 THEN 0 WHEN sh BETWEEN 0.6 AND 0.9 THEN 100 ELSE 50 END + 0.08 * greatest(0, 100 - 40 * shared) + 0.18 * quality) / 0.73 AS v, balance = 0 AS b FROM sz, sp, lk, q)
SELECT round(CASE WHEN b THEN least(v, 50) ELSE v END, 2)::DOUBLE AS score, NOT b AND round(v, 2) >= 60 AS ready FROM t""",
)

# -- quality dimensions of any table ---------------------------------------------------------------------------------
add("qlt9_dimensions", lambda s, d: M.dimensions(read(s, d, "demo_churn").drop("loaded_at"), "row_id", "churned"))
add("qlt9_overall", lambda s, d: M.overall(M.dimensions(read(s, d, "customer"), "c_custkey", "c_mktsegment")))
add("qlt10_recommendations", lambda s, d: M.recommendations(M.dimensions(read(s, d, "demo_churn").drop("loaded_at"), "row_id", "churned")))
add(
    "qlt4_hinted_ranges",
    lambda s, d: s.createDataFrame([(M.validity(read(s, d, "demo_churn").select("age", "tenure_months", "monthly_charges", "contract")),)], "score double"),
    "SELECT round(100 * (1 - ((SELECT AVG((age < 0 OR age > 130)::INT) FROM demo_churn WHERE NOT isnan(age)) + (SELECT AVG((tenure_months < 0)::INT) FROM demo_churn) + (SELECT AVG((monthly_charges < 0)::INT) FROM demo_churn WHERE NOT isnan(monthly_charges)) + (SELECT AVG((contract <> trim(contract, ' '))::INT) FROM demo_churn)) / 4), 4) AS score",
)
add(
    "qlt5_ordered_pairs",
    lambda s, d: s.createDataFrame([(M.consistency(read(s, d, "documents").select("created_at", "arrived_at")),)], "score double"),
    "SELECT round(100 * (1 - AVG((created_at > arrived_at)::INT)), 4)::DOUBLE AS score FROM documents WHERE created_at IS NOT NULL AND arrived_at IS NOT NULL",
)

# -- exact quantiles -------------------------------------------------------------------------------------------------
add(
    "agg8_quantiles_many",
    lambda s, d: R.quantiles(read(s, d, "lineitem"), {c: F.col(c) for c in _LI}, [0.05, 0.5, 0.95]).select("column_name", *[F.col("q")[i].alias(k) for i, k in enumerate(("p5", "p50", "p95"))]),
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.05) AS p5, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.95) AS p95 FROM lineitem" for c in _LI),
)

# -- tests of groups and tables --------------------------------------------------------------------------------------
_BART = "WITH g AS (SELECT o_orderpriority AS g, COUNT(*) AS n, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT SUM(n) AS n, COUNT(*) AS k, SUM((n - 1) * v) / (SUM(n) - COUNT(*)) AS sp, SUM((n - 1) * ln(v)) AS lv, SUM(1 / (n - 1)) AS inv FROM g) SELECT ((n - k) * ln(sp) - lv) / (1 + (inv - 1 / (n - k)) / (3 * (k - 1))) AS k2, (k - 1)::BIGINT AS dof FROM t"
add("hyp4_bartlett", lambda s, d: G.bartlett(read(s, d, "orders"), "o_orderpriority", "o_totalprice").select("k2", "dof"), _BART)
add("hyp1_compare_groups", lambda s, d: G.compare_groups(read(s, d, "orders"), "o_orderpriority", "o_totalprice"))
add("hyp2_fisher", lambda s, d: G.fisher(read(s, d, "supplier").withColumn("rich", F.col("s_acctbal") > 5000).withColumn("low", F.col("s_nationkey") < 5), "rich", "low"))
add("cor6_tests", lambda s, d: S.correlation_tests(A.pearson_pairs(_target(s, d), [*_LI, "target"])))

# -- text quality ----------------------------------------------------------------------------------------------------
add(
    "txt20_fix_encoding",
    lambda s, d: X.fix_encoding(read(s, d, "documents"), "doc_id", "text"),
    "SELECT doc_id, nfc_normalize(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{80}-\\x{9F}\\x{FEFF}]', '', 'g'), '[\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]', ' ', 'g'), ' ')) AS text FROM documents",
)
_w = "regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}'']+')"
add(
    "txt25_short_scores",
    lambda s, d: X.simple_scores(read(s, d, "documents"), "doc_id", "text"),
    f"WITH x AS (SELECT doc_id, COALESCE(text, '') AS t, {_w} AS w FROM documents), y AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE 100.0 * len(list_distinct(w)) / len(w) END AS dup, CASE WHEN length(t) = 0 THEN 0.0 ELSE 100.0 * length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(t) END AS noise, CASE WHEN length(t) = 0 THEN 0.0 ELSE greatest(0.0, 100 - 1000.0 * (length(t) - length(regexp_replace(t, '[\\x{{FFFD}}\\x{{80}}-\\x{{9F}}]', '', 'g'))) / length(t)) END AS enc FROM x), z AS (SELECT doc_id, round(0.4 * dup + 0.4 * noise + 0.2 * enc, 4) AS score FROM y) SELECT doc_id, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS verdict FROM z",
)
add("txt17_coherence", lambda s, d: X.coherence_scores(read(s, d, "documents"), "doc_id", "text"))
add("txt18_consistency", lambda s, d: X.consistency_scores(read(s, d, "documents"), "doc_id", "text"))

# -- SQL of queries of other modules ------------------------------------------------------------------------------------
_ranges = {"arabic": "\\x{0600}-\\x{06FF}", "cyrillic": "\\x{0400}-\\x{04FF}", "han": "\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}", "hangul": "\\x{AC00}-\\x{D7AF}", "latin": "A-Za-z\\x{00C0}-\\x{024F}"}
O["txt4_script"] = "WITH x AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS k, length(COALESCE(text, '')) - length(regexp_replace(COALESCE(text, ''), '[{rx}]', '', 'g')) AS n FROM documents" for k, rx in _ranges.items()) + ") SELECT doc_id, CASE WHEN MAX(n) > 0 THEN arg_max(k, (n, k)) ELSE 'none' END AS script FROM x GROUP BY doc_id"
_sym = "length(COALESCE(text, '')) - length(regexp_replace(COALESCE(text, ''), '[#*<>{}|\\\\^~\\[\\]]', '', 'g'))"
_quality = f"WITH x AS (SELECT doc_id, {_w} AS w, ({_sym}) / greatest(length(COALESCE(text, '')), 1) AS noise, length(trim(COALESCE(text, ''), ' ')) AS len FROM documents), y AS (SELECT doc_id, len, 40 * least(len(w) / 50, 1.0) + 30 * least(len(list_distinct(w)) / greatest(len(w), 1) / 0.5, 1.0) + 30 * greatest(1 - 10 * noise, 0.0) AS s FROM x), z AS (SELECT doc_id, round(CASE WHEN len < 10 THEN least(s, 20.0) ELSE s END, 4) AS score FROM y), v AS (SELECT doc_id, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 55 THEN 'fair' WHEN score >= 35 THEN 'poor' ELSE 'unusable' END AS verdict FROM z)"
O["txt23_quality"] = f"{_quality} SELECT * FROM v"
O["txt24_corpus"] = f"{_quality} SELECT verdict, COUNT(*) AS n, round(AVG(score), 6) AS mean_score, MIN(score) AS least, MAX(score) AS most FROM v GROUP BY verdict"
_wd = "regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}'']+')"
O["txt6_collocations"] = f"WITH x AS (SELECT {_wd} AS w FROM documents), u AS (SELECT w, COUNT(*) AS c FROM (SELECT unnest(w) AS w FROM x) GROUP BY 1), t AS (SELECT SUM(c) AS t FROM u), b AS (SELECT p[1] AS a, p[2] AS b, COUNT(*) AS n FROM (SELECT unnest(list_zip(w[1:len(w) - 1], w[2:])) AS p FROM x WHERE len(w) > 1) GROUP BY 1, 2 HAVING COUNT(*) >= 20) SELECT b.a, b.b, n, log2(n * t / (ua.c * ub.c)) AS pmi FROM b JOIN u ua ON ua.w = b.a JOIN u ub ON ub.w = b.b, t ORDER BY pmi DESC, n DESC, a, b LIMIT 50"
_part = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
O["qlt3_uniqueness"] = "WITH d AS (SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM part)) / COUNT(*) AS s FROM part), c AS (" + " UNION ALL ".join(f"SELECT COUNT(*) AS k, MAX(n) / SUM(n) AS top FROM (SELECT COUNT(*) AS n FROM part GROUP BY {c})" for c in _part) + "), g AS (SELECT COUNT(*) FILTER (WHERE k = 1) AS a, COUNT(*) FILTER (WHERE k > 1 AND top > 0.95) AS b FROM c), r AS (SELECT COUNT(*) - COUNT(DISTINCT p_partkey) AS r FROM part) SELECT s AS distinct_share, a AS constant_columns, b AS near_constant_columns, r AS identifier_repeats, greatest(round(100 * s - 15 * a - 8 * b - CASE WHEN r > 0 THEN 20 ELSE 0 END, 4), 0)::DOUBLE AS score FROM d, g, r"
_eta = lambda c: f"(SELECT SUM(n * (m - a) ** 2) / (SUM(n * (m - a) ** 2) + SUM(n * s)) FROM (SELECT COUNT(*) AS n, AVG(p_retailprice) AS m, var_pop(p_retailprice) AS s FROM part GROUP BY {c}), (SELECT AVG(p_retailprice) AS a FROM part))"
_d = lambda c: f"(SELECT COUNT(DISTINCT {c}) FROM part)"
O["adv5_encoding"] = "SELECT column_name, d AS distinct_count, CASE WHEN d <= 200 THEN e END AS eta2, CASE WHEN d = 2 THEN 'binary' WHEN d <= 10 THEN 'one_hot' WHEN d <= 50 THEN 'label' WHEN d <= 200 THEN CASE WHEN e > 0.05 THEN 'target' ELSE 'frequency' END ELSE 'hash' END AS encoding FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_d(c)} AS d, {_eta(c)} AS e" for c in ("p_name", "p_brand", "p_type")) + ")"
_g = "list_distinct([array_to_string(w[i:i + 12], ' ') for i in range(1, len(w) - 11)])"
O["lek9_containment"] = f"WITH a AS (SELECT doc_id, unnest({_g}) AS g FROM (SELECT doc_id, {_wd} AS w FROM documents) WHERE len(w) >= 13), b AS (SELECT file_id, unnest({_g}) AS g FROM (SELECT file_id, {_wd.replace('text', 'full_text')} AS w FROM document_data) WHERE len(w) >= 13), t AS (SELECT file_id, COUNT(*) AS t FROM b GROUP BY 1) SELECT doc_id, b.file_id, COUNT(*) AS shared, COUNT(*) / MAX(t) AS share FROM a JOIN b USING (g) JOIN t ON t.file_id = b.file_id GROUP BY doc_id, b.file_id"
