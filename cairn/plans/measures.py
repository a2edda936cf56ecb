"""Queries of the association, drift, quality, audit and text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import association as A, audit as T, drift as D, quality as K, text as X
from cairn.session import read

Q, O = {}, {}


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        O[name] = sql


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_pairs = [(a, b) for i, a in enumerate(LI) for b in LI[i + 1 :]]
_r6 = lambda e: f"round({e}, 9)"
add("cor1_pearson_pairs", lambda s, d: A.pearson_pairs(read(s, d, "lineitem"), LI).withColumn("r", F.round("r", 9)), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r, COUNT(*) AS n FROM lineitem" for a, b in _pairs))
add("cor2_network", lambda s, d: A.pearson_pairs(read(s, d, "lineitem").withColumn("l_tax", F.col("l_tax") + F.col("l_discount")), LI).where(F.abs("r") >= 0.3).select("a", "b", F.round("r", 4).alias("r"), F.when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.5, "moderate").otherwise("weak").alias("strength")), "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r, CASE WHEN abs(corr({a}, {b})) >= 0.7 THEN 'strong' WHEN abs(corr({a}, {b})) >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength FROM (SELECT * REPLACE (l_tax + l_discount AS l_tax) FROM lineitem)" for a, b in _pairs) + ") WHERE abs(r) >= 0.3")
add("cor4_spearman", lambda s, d: A.spearman(read(s, d, "lineitem"), "l_quantity", "l_extendedprice"), "WITH q AS (SELECT l_quantity, AVG(r) AS x FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1), p AS (SELECT l_extendedprice, AVG(r) AS y FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS r FROM lineitem) GROUP BY 1) SELECT corr(x, y) AS r, COUNT(*) AS n FROM lineitem JOIN q USING (l_quantity) JOIN p USING (l_extendedprice)")
_cont = lambda t, a, b: f"c AS (SELECT {a} AS a, {b} AS b, COUNT(*) AS n FROM {t} GROUP BY 1, 2), j AS (SELECT n, SUM(n) OVER (PARTITION BY a) AS na, SUM(n) OVER (PARTITION BY b) AS nb, a, b FROM c), s AS (SELECT SUM(n * n / (na * nb)) AS s, SUM(n)::BIGINT AS n, COUNT(DISTINCT a) AS r, COUNT(DISTINCT b) AS k FROM j)"
add("cor7_cramers_v", lambda s, d: A.contingency(read(s, d, "lineitem"), "l_returnflag", "l_linestatus"), f"WITH {_cont('lineitem', 'l_returnflag', 'l_linestatus')} SELECT n * (s - 1) AS chi2, n, r AS rows, k AS cols, ((r - 1) * (k - 1)) AS dof, sqrt((s - 1) / (least(r, k) - 1)) AS v, sqrt(greatest(0, s - 1 - (r - 1) * (k - 1) / (n - 1)) / (least(r - power(r - 1, 2) / (n - 1), k - power(k - 1, 2) / (n - 1)) - 1)) AS v_corrected FROM s")
add("cor9_correlation_ratio", lambda s, d: A.correlation_ratio(read(s, d, "orders"), "o_orderpriority", "o_totalprice"), "WITH g AS (SELECT o_orderpriority, COUNT(*) AS n, AVG(o_totalprice) AS m FROM orders GROUP BY 1), t AS (SELECT AVG(o_totalprice) AS m, var_pop(o_totalprice) * COUNT(*) AS sst, COUNT(*) AS n FROM orders) SELECT SUM(g.n * power(g.m - t.m, 2)) / any_value(sst) AS eta2, sqrt(SUM(g.n * power(g.m - t.m, 2)) / any_value(sst)) AS eta, COUNT(*) AS groups, any_value(t.n) AS n FROM g, t")
add("cor11_mutual_information", lambda s, d: A.mutual_information(read(s, d, "lineitem"), "l_quantity", "l_extendedprice"), """WITH r AS (SELECT MIN(l_quantity) AS a0, MAX(l_quantity) AS a1, MIN(l_extendedprice) AS b0, MAX(l_extendedprice) AS b1 FROM lineitem),
c AS (SELECT least(floor((l_quantity - a0) / ((a1 - a0) / 10)), 9) AS i, least(floor((l_extendedprice - b0) / ((b1 - b0) / 10)), 9) AS j, COUNT(*) AS n FROM lineitem, r GROUP BY 1, 2),
p AS (SELECT n / SUM(n) OVER () AS p, SUM(n) OVER (PARTITION BY i) / SUM(n) OVER () AS pi, SUM(n) OVER (PARTITION BY j) / SUM(n) OVER () AS pj FROM c)
SELECT SUM(p * ln(p / (pi * pj))) AS mi, SUM(p * ln(p / (pi * pj))) / least(-SUM(p * ln(pi)), -SUM(p * ln(pj))) AS nmi FROM p""")
add("cor12_partial", lambda s, d: A.partial_correlation(read(s, d, "lineitem"), "l_extendedprice", "l_tax", "l_quantity"), "WITH r AS (SELECT corr(l_extendedprice, l_tax) AS ab, corr(l_extendedprice, l_quantity) AS az, corr(l_tax, l_quantity) AS bz FROM lineitem) SELECT (ab - az * bz) / sqrt((1 - az * az) * (1 - bz * bz)) AS r FROM r")
add("cor13_vif", lambda s, d: A.inflation_factors(read(s, d, "lineitem"), LI))
add("cor14_clusters", lambda s, d: A.redundant_clusters(read(s, d, "lineitem").withColumn("gross", F.col("l_extendedprice") * 1.1 + 5), [*LI, "gross"]))
add("cor15_proxies", lambda s, d: A.pearson_pairs(read(s, d, "lineitem").withColumn("gross", F.col("l_extendedprice") * 1.1 + 5), ["l_quantity", "l_extendedprice", "gross"]).where(F.abs("r") >= 0.98).select("a", "b", "n"), "SELECT 'l_extendedprice' AS a, 'gross' AS b, COUNT(*) AS n FROM lineitem")
add("hyp1_group_moments", lambda s, d: A.group_moments(read(s, d, "orders"), "o_orderpriority", "o_totalprice"), "SELECT o_orderpriority AS grp, COUNT(*) AS n, AVG(o_totalprice) AS mean_value, var_samp(o_totalprice) AS var_value, median(o_totalprice) AS median_value FROM orders GROUP BY 1")
add("hyp1_anova", lambda s, d: A.anova(read(s, d, "orders"), "o_orderpriority", "o_totalprice"))
add("hyp1_kruskal", lambda s, d: A.kruskal(read(s, d, "lineitem"), "l_returnflag", "l_quantity"), """WITH r AS (SELECT l_quantity AS v, COUNT(*) AS t, AVG(r) AS r FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1),
g AS (SELECT l_returnflag, COUNT(*) AS n, SUM(r.r) AS rs FROM lineitem JOIN r ON l_quantity = v GROUP BY 1), x AS (SELECT SUM(n)::DOUBLE AS n, SUM(rs * rs / n) AS q, COUNT(*) AS k FROM g), y AS (SELECT SUM(t * (t * t - 1))::DOUBLE AS ties FROM r),
h AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, k, n FROM x, y) SELECT h, k AS groups, n::BIGINT AS n, (h - k + 1) / (n - k) AS epsilon2 FROM h""")
add("hyp3_one_sample", lambda s, d: A.one_sample(read(s, d, "lineitem"), "l_quantity", 25.0), "SELECT (AVG(l_quantity) - 25.0) / (stddev_samp(l_quantity) / sqrt(COUNT(*))) AS t, COUNT(*) AS n FROM lineitem")
add("hyp4_levene", lambda s, d: A.levene(read(s, d, "orders"), "o_orderpriority", "o_totalprice"), "WITH d AS (SELECT o_orderpriority AS g, abs(o_totalprice - median(o_totalprice) OVER (PARTITION BY o_orderpriority)) AS d FROM orders), g AS (SELECT g, COUNT(*) AS n, AVG(d) AS m FROM d GROUP BY 1), t AS (SELECT AVG(d) AS m, var_pop(d) * COUNT(*) AS sst, COUNT(*) AS n FROM d), e AS (SELECT SUM(g.n * power(g.m - t.m, 2)) AS b, any_value(sst) AS s, COUNT(*) AS k, any_value(t.n) AS n FROM g, t) SELECT (b / (k - 1)) / ((s - b) / (n - k)) AS f, k AS groups, n FROM e")
add("hyp6_jarque_bera", lambda s, d: A.jarque_bera(read(s, d, "events"), "value"), "WITH m AS (SELECT AVG(value) AS m, stddev_pop(value) AS s, COUNT(*) AS n FROM events), k AS (SELECT any_value(n) AS n, AVG(power((value - m) / s, 3)) AS g1, AVG(power((value - m) / s, 4)) - 3 AS g2 FROM events, m) SELECT n / 6 * (g1 * g1 + g2 * g2 / 4) AS jb, exp(-(n / 6 * (g1 * g1 + g2 * g2 / 4)) / 2) AS p, n FROM k")
add("hyp7_fit", lambda s, d: A.fit_distributions(read(s, d, "orders"), "o_totalprice"))
_ks = "c AS (SELECT l_extendedprice AS v, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS a, COUNT(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1), x AS (SELECT v, abs(SUM(a) OVER (ORDER BY v) / SUM(a) OVER () - SUM(b) OVER (ORDER BY v) / SUM(b) OVER ()) AS d, lead(v) OVER (ORDER BY v) AS nv, SUM(a) OVER () AS ta, SUM(b) OVER () AS tb FROM c)"
add("hyp9_ks", lambda s, d: A.ks_two_sample(read(s, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R"), f"WITH {_ks} SELECT MAX(d) AS d, SUM(d * (nv - v)) AS w1, MAX(ta)::BIGINT AS n_a, MAX(tb)::BIGINT AS n_b FROM x")

_ch = "demo_churn"
_m = {"age": "(age IS NULL OR isnan(age))", "tenure_months": "(tenure_months IS NULL)", "monthly_charges": "(monthly_charges IS NULL OR isnan(monthly_charges))", "contract": "(contract IS NULL)"}
_four = list(_m)
_avg = lambda c: f"AVG({c}::INT)"
add("qlt2_completeness", lambda s, d: K.completeness(read(s, d, _ch).select(*_four)), f"""WITH x AS (SELECT 1 - ({' + '.join(map(_avg, _m.values()))}) / 4 AS cell_share, AVG((NOT ({' OR '.join(_m.values())}))::INT) AS row_share, ({' + '.join(f'(SUM({c}::INT) = 0)::INT' for c in _m.values())}) / 4 AS column_share, 1 - ({' + '.join(map(_avg, list(_m.values())[:3]))}) / 3 AS numeric_share FROM demo_churn) SELECT *, round(100 * (0.40 * cell_share + 0.25 * row_share + 0.20 * column_share + 0.15 * numeric_share), 4) AS score FROM x""")
add("qlt3_uniqueness", lambda s, d: K.uniqueness(read(s, d, "part"), "p_partkey"))
add("qlt4_validity", lambda s, d: K.validity(read(s, d, _ch), {"age": (0, 120), "monthly_charges": (0, 10000)}), "SELECT 'age' AS column_name, COUNT(*) FILTER (WHERE NOT isnan(age) AND (age < 0 OR age > 120)) AS invalid, COUNT(*) FILTER (WHERE NOT isnan(age) AND (age < 0 OR age > 120)) / COUNT(*) AS share FROM demo_churn UNION ALL SELECT 'monthly_charges', COUNT(*) FILTER (WHERE NOT isnan(monthly_charges) AND (monthly_charges < 0 OR monthly_charges > 10000)), COUNT(*) FILTER (WHERE NOT isnan(monthly_charges) AND (monthly_charges < 0 OR monthly_charges > 10000)) / COUNT(*) FROM demo_churn")
add("qlt4_text_hygiene", lambda s, d: K.text_hygiene(read(s, d, _ch).select("contract")), "WITH v AS (SELECT contract AS v, COUNT(*) AS n FROM demo_churn WHERE contract IS NOT NULL GROUP BY 1), k AS (SELECT lower(trim(v)) AS k, SUM(n) AS n, MAX(n) AS top, SUM(CASE WHEN v <> trim(v) THEN n ELSE 0 END) AS p, SUM(CASE WHEN regexp_matches(trim(v), '^[+-]?\\d+(\\.\\d+)?$') THEN n ELSE 0 END) AS h FROM v GROUP BY 1) SELECT 'contract' AS column_name, SUM(p)::BIGINT AS padded, SUM(n - top)::BIGINT AS cased, SUM(h)::BIGINT AS hidden_numbers FROM k")
add("qlt5_consistency", lambda s, d: read(s, d, "image_record").selectExpr("count_if(width * height <> total_pixels) AS wrong_pixels", "count_if(total_pixels IS NULL) AS unknown", "count(*) AS n"), "SELECT COUNT(*) FILTER (WHERE width::BIGINT * height <> total_pixels) AS wrong_pixels, COUNT(*) FILTER (WHERE total_pixels IS NULL) AS unknown, COUNT(*) AS n FROM image_record")
add("qlt7_distribution", lambda s, d: K.distribution_score(read(s, d, "orders"), "o_totalprice"), "WITH m AS (SELECT AVG(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, COUNT(*)::DOUBLE AS n, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders), x AS (SELECT AVG(power((o_totalprice - m) / s, 3)) * sqrt(any_value(n) * (any_value(n) - 1)) / (any_value(n) - 2) AS skew_g1, AVG((o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1))::INT) AS outlier_rate FROM orders, m) SELECT skew_g1, outlier_rate, round((0.3 * greatest(100 - 10 * abs(skew_g1), 0) + 0.3 * greatest(100 - 500 * outlier_rate, 0)) / 0.6, 4) AS score FROM x")
add("qlt1_readiness", lambda s, d: K.readiness(read(s, d, "supplier")))
add("adv1_target", lambda s, d: K.target_candidates(read(s, d, _ch)))
add("adv3_imbalance", lambda s, d: K.imbalance(read(s, d, "events"), "event_type"), "WITH c AS (SELECT COUNT(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type), t AS (SELECT COUNT(*) AS classes, MAX(n) / MIN(n) AS ratio, SUM(n) AS t, SUM(n * n) AS sq, SUM(n * log2(n)) AS nl FROM c) SELECT classes, ratio, 1 - sq / (t * t) AS gini_impurity, log2(t) - nl / t AS entropy, power(2, log2(t) - nl / t) AS effective_classes, CASE WHEN ratio < 1.5 THEN 'balanced' WHEN ratio < 3 THEN 'mild' WHEN ratio < 10 THEN 'moderate' WHEN ratio < 100 THEN 'severe' ELSE 'extreme' END AS level FROM t")
add("adv5_encoding", lambda s, d: K.encoding_advice(read(s, d, "part"), "p_retailprice"))
add("adv9_regression_metrics", lambda s, d: K.regression_metrics(read(s, d, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1500), "WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem) SELECT sqrt(AVG(power(y - p, 2))) AS rmse, AVG(abs(y - p)) AS mae, 1 - SUM(power(y - p, 2)) / (var_pop(y) * COUNT(*)) AS r2, AVG(abs((y - p) / nullif(y, 0))) AS mape FROM x")
_bm = "x AS (SELECT (l_returnflag = 'R')::INT AS y, l_discount * 10 AS s FROM lineitem)"
add("adv9_binary_metrics", lambda s, d: K.binary_metrics(read(s, d, "lineitem"), F.col("l_returnflag") == "R", F.col("l_discount") * 10).select("accuracy", "precision_", "recall", "f1", "auc"), f"WITH {_bm}, c AS (SELECT COUNT(*) FILTER (WHERE y = 1 AND s >= 0.5) AS tp, COUNT(*) FILTER (WHERE y = 0 AND s >= 0.5) AS fp, COUNT(*) FILTER (WHERE y = 1 AND s < 0.5) AS fn, COUNT(*) FILTER (WHERE y = 0 AND s < 0.5) AS tn FROM x), g AS (SELECT s, SUM(y) AS p, COUNT(*) - SUM(y) AS n FROM x GROUP BY 1), b AS (SELECT p, n, COALESCE(SUM(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision_, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (SELECT SUM(p * (b + n / 2)) / (SUM(p) * SUM(n)) FROM b) AS auc FROM c")
add("dna1_fingerprint", lambda s, d: K.fingerprint(read(s, d, "customer")))

_half = lambda: F.col("o_orderkey") % 2 == 0
add("drf1_numeric", lambda s, d: D.numeric_drift(read(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], F.col("l_returnflag") == "R"), " UNION ALL ".join(f"SELECT '{c}' AS column_name, ma AS mean_a, mb AS mean_b, abs(mb - ma) / abs(ma) AS mean_change, abs(sb - sa) / abs(sa) AS std_change, nb < na AS new_min, xb > xa AS new_max, abs(mb - ma) / abs(ma) >= 0.10 OR abs(sb - sa) / abs(sa) >= 0.25 AS drifted FROM (SELECT AVG({c}) FILTER (WHERE f) AS ma, AVG({c}) FILTER (WHERE NOT f) AS mb, stddev_samp({c}) FILTER (WHERE f) AS sa, stddev_samp({c}) FILTER (WHERE NOT f) AS sb, MIN({c}) FILTER (WHERE f) AS na, MIN({c}) FILTER (WHERE NOT f) AS nb, MAX({c}) FILTER (WHERE f) AS xa, MAX({c}) FILTER (WHERE NOT f) AS xb FROM (SELECT *, l_returnflag = 'R' AS f FROM lineitem))" for c in ["l_quantity", "l_extendedprice"]))
_dv = "f AS (SELECT greatest(p, 1e-6) / SUM(greatest(p, 1e-6)) OVER () AS p, greatest(q, 1e-6) / SUM(greatest(q, 1e-6)) OVER () AS q, greatest(p, 1e-10) / SUM(greatest(p, 1e-10)) OVER () AS x, greatest(q, 1e-10) / SUM(greatest(q, 1e-10)) OVER () AS y FROM s) SELECT SUM((q - p) * ln(q / p)) AS psi, SUM(x * log2(x / ((x + y) / 2))) / 2 + SUM(y * log2(y / ((x + y) / 2))) / 2 AS jsd FROM f"
add("drf2_psi_numeric", lambda s, d: D.divergence(D.binned(read(s, d, "orders"), "o_totalprice", _half())), f"WITH r AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders), c AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) AS b, COUNT(*) FILTER (WHERE o_orderkey % 2 = 0) AS a, COUNT(*) FILTER (WHERE o_orderkey % 2 <> 0) AS k FROM orders, r GROUP BY 1), s AS (SELECT a / SUM(a) OVER () AS p, k / SUM(k) OVER () AS q FROM c), {_dv}")
add("drf3_jsd_category", lambda s, d: D.divergence(D.shares(read(s, d, "orders"), "o_orderpriority", _half())), f"WITH c AS (SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderkey % 2 = 0) AS a, COUNT(*) FILTER (WHERE o_orderkey % 2 <> 0) AS k FROM orders GROUP BY 1), s AS (SELECT a / SUM(a) OVER () AS p, k / SUM(k) OVER () AS q FROM c), {_dv}")
add("drf4_label_windows", lambda s, d: D.label_windows(read(s, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")).cast("double")), "t", "event_type"), "WITH e AS (SELECT epoch_us(ts)::DOUBLE AS t, event_type FROM events), q AS (SELECT quantile_cont(t, 0.2) AS a, quantile_cont(t, 0.4) AS b, quantile_cont(t, 0.6) AS c, quantile_cont(t, 0.8) AS d FROM e), w AS (SELECT (a < t)::INT + (b < t)::INT + (c < t)::INT + (d < t)::INT AS win, event_type AS label, COUNT(*) AS n FROM e, q GROUP BY 1, 2) SELECT win, label, n, n / SUM(n) OVER (PARTITION BY win) AS share FROM w")
add("drf5_range_overlap", lambda s, d: D.range_overlap(read(s, d, "orders"), "o_totalprice", _half()), "WITH r AS (SELECT MIN(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS a0, MAX(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS a1, MIN(o_totalprice) FILTER (WHERE o_orderkey % 2 <> 0) AS b0, MAX(o_totalprice) FILTER (WHERE o_orderkey % 2 <> 0) AS b1 FROM orders) SELECT greatest(least(a1, b1) - greatest(a0, b0), 0) / (a1 - a0) AS overlap FROM r")
add("drf6_mmd", lambda s, d: D.mean_discrepancy(read(s, d, "embeddings"), "vec_id", "embedding", F.col("label") % 2 == 0))

_lo = lambda s, d, k: read(s, d, "lineitem").where(F.col("l_orderkey") % 2 == k)
add("lek4_group_leakage", lambda s, d: T.group_leakage(_lo(s, d, 0), _lo(s, d, 1), "l_suppkey"), "SELECT COUNT(*) AS test_rows, COUNT(*) FILTER (WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0)) AS contaminated_rows, COUNT(*) FILTER (WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0)) / COUNT(*) AS ratio FROM lineitem WHERE l_orderkey % 2 = 1")
add("lek4_inconsistent_labels", lambda s, d: T.inconsistent_labels(read(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag"), "WITH g AS (SELECT COUNT(*) AS n, MIN(l_returnflag) AS a, MAX(l_returnflag) AS b FROM lineitem GROUP BY l_quantity, l_discount, l_tax) SELECT COUNT(*) AS groups, SUM(n)::BIGINT AS rows, COUNT(*) FILTER (WHERE a <> b) AS conflicting_groups, COALESCE(SUM(n) FILTER (WHERE a <> b), 0)::BIGINT AS conflicting_rows FROM g")
add("pii6_k_anonymity", lambda s, d: T.k_anonymity(read(s, d, "customer"), ["c_nationkey", "c_mktsegment"], 10), "WITH g AS (SELECT COUNT(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT COUNT(*) AS groups, COUNT(*) FILTER (WHERE n < 10) AS small_groups, COALESCE(SUM(n) FILTER (WHERE n < 10), 0)::BIGINT AS small_rows, MIN(n) AS smallest FROM g")
add("lek5_preprocessing", lambda s, d: T.preprocessing_leakage(read(s, d, "orders"), "o_totalprice", _half()), "WITH a AS (SELECT AVG(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS train_mean, AVG(o_totalprice) AS full_mean FROM orders) SELECT *, abs(train_mean - full_mean) / abs(full_mean) AS relative_gap, abs(train_mean - full_mean) / abs(full_mean) < 1e-6 AS suspicious FROM a")
add("lek9_containment", lambda s, d: X.containment(read(s, d, "documents"), "doc_id", "text", read(s, d, "document_data"), "file_id", "full_text", 13))
_pr = lambda s, d: read(s, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("y"), (F.col("l_discount") * 5).alias("p0"), (F.col("l_tax") * 5).alias("p1"), (1 - F.col("l_discount") * 5 - F.col("l_tax") * 5).alias("p2"))
add("lbl1_confident_joint", lambda s, d: T.confident_joint(_pr(s, d), "y", ["p0", "p1", "p2"]), """WITH x AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, l_discount * 5 AS p0, l_tax * 5 AS p1, 1 - l_discount * 5 - l_tax * 5 AS p2 FROM lineitem),
t AS (SELECT AVG(p0) FILTER (WHERE y = 0) AS t0, AVG(p1) FILTER (WHERE y = 1) AS t1, AVG(p2) FILTER (WHERE y = 2) AS t2 FROM x),
m AS (SELECT y, CASE WHEN p0 >= t0 THEN p0 END AS a, CASE WHEN p1 >= t1 THEN p1 END AS b, CASE WHEN p2 >= t2 THEN p2 END AS c FROM x, t)
SELECT y AS given, CASE WHEN a IS NOT NULL AND a >= COALESCE(b, -9) AND a >= COALESCE(c, -9) THEN 0 WHEN b IS NOT NULL AND b >= COALESCE(c, -9) THEN 1 ELSE 2 END AS guess, COUNT(*) AS n FROM m WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL GROUP BY 1, 2""")
add("lbl4_calibration", lambda s, d: T.calibration(read(s, d, "lineitem"), F.col("l_returnflag") == "R", F.col("l_quantity") / 50), "WITH x AS (SELECT (l_returnflag = 'R')::INT AS y, l_quantity / 50 AS s FROM lineitem) SELECT greatest(ceil(s * 10) - 1, 0)::INT AS bin, COUNT(*) AS n, AVG(s) AS confidence, AVG(y) AS accuracy, abs(AVG(s) - AVG(y)) AS gap FROM x GROUP BY 1")
add("lbl4_krippendorff", lambda s, d: T.krippendorff(read(s, d, "lineitem"), "l_orderkey", "l_linestatus"), "WITH c AS (SELECT l_orderkey AS u, l_linestatus AS v, COUNT(*) AS n FROM lineitem GROUP BY 1, 2), u AS (SELECT u, SUM(n) AS m, SUM(n * (n - 1)) AS same FROM c GROUP BY 1 HAVING SUM(n) > 1), o AS (SELECT SUM(same / (m - 1)) AS agree, SUM(m) AS n, COUNT(*) AS units FROM u), e AS (SELECT SUM(k * (k - 1)) AS e FROM (SELECT SUM(n) AS k FROM c WHERE u IN (SELECT u FROM u) GROUP BY v)) SELECT 1 - (1 - agree / n) / (1 - e / (n * (n - 1))) AS alpha, units, n::BIGINT AS ratings FROM o, e")
add("lbl5_class_outliers", lambda s, d: T.class_outliers(read(s, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 499 == 0, F.col("o_totalprice") * 25).otherwise(F.col("o_totalprice"))), "o_orderkey", "o_orderpriority", ["o_totalprice"], 2.0), "WITH p AS (SELECT o_orderpriority AS l, AVG(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 499 = 0 THEN o_totalprice * 25 ELSE o_totalprice END AS o_totalprice) FROM orders) AS orders GROUP BY 1) SELECT o_orderkey, o_orderpriority, abs(o_totalprice - m) / s AS max_z FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 499 = 0 THEN o_totalprice * 25 ELSE o_totalprice END AS o_totalprice) FROM orders) AS orders JOIN p ON o_orderpriority = l WHERE abs(o_totalprice - m) / s > 2.0")
add("lbl6_separability", lambda s, d: A.correlation_ratio(read(s, d, "lineitem"), "l_returnflag", "l_extendedprice").select(((F.col("eta2") / (F.col("groups") - 1)) / ((1 - F.col("eta2")) / (F.col("n") - F.col("groups")))).alias("f")), "WITH g AS (SELECT l_returnflag, COUNT(*) AS n, AVG(l_extendedprice) AS m FROM lineitem GROUP BY 1), t AS (SELECT AVG(l_extendedprice) AS m, var_pop(l_extendedprice) * COUNT(*) AS s, COUNT(*) AS n FROM lineitem), e AS (SELECT SUM(g.n * power(g.m - t.m, 2)) AS b, any_value(t.s) AS s, COUNT(*) AS k, any_value(t.n) AS n FROM g, t) SELECT (b / (k - 1)) / ((s - b) / (n - k)) AS f FROM e")
add("fai1_sensitive_profile", lambda s, d: T.sensitive_profile(read(s, d, "customer"), "c_mktsegment"), "WITH c AS (SELECT COUNT(*) AS n FROM customer GROUP BY c_mktsegment) SELECT COUNT(*) AS groups, log2(SUM(n)) - SUM(n * log2(n)) / SUM(n) AS entropy, MAX(n) / SUM(n) AS majority_share, COUNT(*) FILTER (WHERE n < 30) AS small_groups FROM c")
add("fai2_proxies", lambda s, d: A.contingency(read(s, d, "part"), "p_brand", "p_type").select("chi2", "n", "v"), f"WITH {_cont('part', 'p_brand', 'p_type')} SELECT n * (s - 1) AS chi2, n, sqrt((s - 1) / (least(r, k) - 1)) AS v FROM s")
add("fai4_group_metrics", lambda s, d: T.group_metrics(read(s, d, "lineitem"), "l_linestatus", F.col("l_returnflag") == "R", F.col("l_quantity") > 25), "WITH x AS (SELECT l_linestatus AS grp, (l_returnflag = 'R')::INT AS y, (l_quantity > 25)::INT AS p FROM lineitem), g AS (SELECT grp, COUNT(*) AS n, SUM(y * p) AS tp, SUM((1 - y) * p) AS fp, SUM(y * (1 - p)) AS fn, SUM((1 - y) * (1 - p)) AS tn FROM x GROUP BY 1), r AS (SELECT grp, n, (tp + fp) / n AS selection, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, tp / nullif(tp + fp, 0) AS ppv FROM g) SELECT *, selection / MAX(selection) OVER () AS ratio, selection / MAX(selection) OVER () >= 0.8 AS fair FROM r")
add("fai6_label_rates", lambda s, d: T.label_rates(read(s, d, "lineitem"), "l_linestatus", F.col("l_returnflag") == "R"), "WITH g AS (SELECT l_linestatus AS grp, COUNT(*) AS n, SUM((l_returnflag = 'R')::INT) AS k FROM lineitem GROUP BY 1) SELECT grp, n, k / n AS rate, k / n - SUM(k) OVER () / SUM(n) OVER () AS gap FROM g")
add("fai8_sampling", lambda s, d: T.sampling_bias(read(s, d, "customer"), "c_mktsegment", F.col("c_custkey") % 3 > 0), "WITH c AS (SELECT c_mktsegment AS value, COUNT(*) FILTER (WHERE c_custkey % 3 > 0) AS a, COUNT(*) FILTER (WHERE c_custkey % 3 = 0) AS b FROM customer GROUP BY 1), s AS (SELECT value, a / SUM(a) OVER () AS p, b / SUM(b) OVER () AS q FROM c) SELECT *, abs(p - q) AS gap FROM s")
add("fai10_intersections", lambda s, d: T.intersections(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount") > 0.05), "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(*) / (SELECT COUNT(*) FROM lineitem) AS share, AVG((l_discount > 0.05)::INT) AS rate FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) >= 5")
add("fai12_mantel_haenszel", lambda s, d: T.mantel_haenszel(read(s, d, "lineitem"), "l_linenumber", F.col("l_returnflag") == "R", F.col("l_quantity") > 25), "WITH x AS (SELECT l_linenumber AS s, l_returnflag = 'R' AS a, l_quantity > 25 AS b FROM lineitem), g AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE a AND b) AS p, COUNT(*) FILTER (WHERE a AND NOT b) AS q, COUNT(*) FILTER (WHERE NOT a AND b) AS r, COUNT(*) FILTER (WHERE NOT a AND NOT b) AS t FROM x GROUP BY s) SELECT SUM(p * t / n) / SUM(q * r / n) AS odds_ratio, COUNT(*) AS strata FROM g")
add("fai13_simpson", lambda s, d: T.simpson(read(s, d, "lineitem"), "l_linenumber", "l_quantity", "l_extendedprice"), "WITH o AS (SELECT corr(l_quantity, l_extendedprice) AS overall FROM lineitem), g AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY l_linenumber HAVING COUNT(*) >= 10) SELECT overall, COUNT(*) AS strata, COUNT(*) FILTER (WHERE sign(r) * sign(overall) < 0) AS reversed, COUNT(*) FILTER (WHERE sign(r) * sign(overall) < 0) >= 0.6 * COUNT(*) AS paradox FROM o, g GROUP BY overall")
add("rdy3_split_leakage", lambda s, d: T.split_leakage(read(s, d, "image_record"), F.lower(F.nullif(F.col("sha256"), F.lit(""))), F.lower(F.trim("split"))), "WITH x AS (SELECT DISTINCT lower(nullif(sha256, '')) AS h, lower(trim(split)) AS split FROM image_record WHERE nullif(sha256, '') IS NOT NULL AND split IS NOT NULL) SELECT split, COUNT(*) FILTER (WHERE h IN (SELECT h FROM x WHERE split = 'train')) AS shared, COUNT(*) AS n FROM x WHERE split <> 'train' GROUP BY 1")

_W = "regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}'']+')"
_S = "list_filter(regexp_split_to_array(COALESCE(text, ''), '[.!?]+(\\s+|$)'), lambda x: regexp_matches(x, '[^ \\t\\r\\n]'))"
_n = lambda rx: f"len(regexp_extract_all(t, '{rx}'))"
add("txt1_basic_stats", lambda s, d: X.basic_stats(read(s, d, "documents"), "doc_id", "text"), f"""WITH x AS (SELECT doc_id, COALESCE(text, '') AS t, {_W} AS w, len({_S})::INT AS ns FROM documents)
SELECT doc_id, length(t)::INT AS n_chars, len(w)::INT AS n_words, ns AS n_sentences, len(list_distinct(w))::INT AS n_unique, len(list_distinct(w)) / nullif(len(w), 0) AS type_token,
 list_sum(list_transform(w, lambda v: length(v))) / nullif(len(w), 0) AS word_length, {_n('[0-9]')} / nullif(length(t), 0) AS digit_ratio, {_n('[A-Z]')} / nullif(length(t), 0) AS upper_ratio, {_n('[ \\t\\r\\n]')} / nullif(length(t), 0) AS space_ratio, {_n('[?]')}::INT AS questions, {_n('[!]')}::INT AS exclamations FROM x""")
add("txt3_readability", lambda s, d: X.readability(read(s, d, "documents"), "doc_id", "text"), f"""WITH x AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[a-z]+') AS w, greatest(len({_S}), 1) AS s FROM documents), y AS (SELECT doc_id, s, len(w) AS n, list_transform(w, lambda v: greatest(len(regexp_extract_all(v, '[aeiouy]+')) - CASE WHEN v LIKE '%e' AND len(regexp_extract_all(v, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1)) AS y FROM x WHERE len(w) > 0)
SELECT doc_id, 206.835 - 1.015 * (n / s) - 84.6 * (list_sum(y) / n) AS flesch, 0.39 * (n / s) + 11.8 * (list_sum(y) / n) - 15.59 AS grade_level, 0.4 * (n / s + 100 * len(list_filter(y, lambda v: v >= 3)) / n) AS fog FROM y""")
add("txt4_script", lambda s, d: X.script(read(s, d, "documents"), "doc_id", "text"))
_in = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_lx = lambda ws: f"len(list_filter(w, lambda v: v IN {_in(ws)}))::INT"
add("txt5_lexicon", lambda s, d: X.lexicon_counts(read(s, d, "documents"), "doc_id", "text"), f"WITH x AS (SELECT doc_id, {_W} AS w FROM documents), y AS (SELECT doc_id, {_lx(X.POSITIVE)} AS positive, {_lx(X.NEGATIVE)} AS negative, {_lx(X.HEDGES)} AS hedges FROM x) SELECT *, COALESCE((positive - negative) / nullif(positive + negative, 0), 0.0)::DOUBLE AS compound FROM y")
add("txt6_keywords", lambda s, d: X.keywords(read(s, d, "documents"), "text"), f"SELECT word, COUNT(*) AS n FROM (SELECT unnest({_W}) AS word FROM documents) WHERE length(word) >= 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
add("txt6_collocations", lambda s, d: X.collocations(read(s, d, "documents"), "text"))
add("txt7_entities", lambda s, d: X.entities(read(s, d, "documents"), "doc_id", "text"), f"WITH x AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents) SELECT doc_id, {_n('[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')}::INT AS emails, {_n('https?://[^ \\n]+')}::INT AS urls, {_n('[0-9]{4}-[0-9]{2}-[0-9]{2}')}::INT AS dates, {_n('[0-9]+(?:[.,][0-9]+)? ?%')}::INT AS percents, {_n('[$€£] ?[0-9]+')}::INT AS money FROM x")
add("txt14_empty_content", lambda s, d: X.empty_content(read(s, d, "documents"), "doc_id", "text"), f"WITH x AS (SELECT doc_id, COALESCE(text, '') AS t, {_W} AS w FROM documents) SELECT doc_id, length(trim(t)) < 10 OR len(list_distinct(w)) < 3 OR {_n('[ \\t\\r\\n]')} / greatest(length(t), 1) > 0.5 AS is_empty FROM x")
add("txt14_char_entropy", lambda s, d: X.char_entropy(read(s, d, "part"), "p_partkey", "p_name"), "WITH c AS (SELECT p_partkey, ch, COUNT(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part) GROUP BY 1, 2), t AS (SELECT p_partkey, n, SUM(n) OVER (PARTITION BY p_partkey) AS t FROM c) SELECT p_partkey, -SUM(n / t * log2(n / t)) AS entropy, COUNT(*)::INT AS n_distinct FROM t GROUP BY 1")
add("txt15_noise", lambda s, d: X.noise_ratios(read(s, d, "documents"), "doc_id", "text"), f"WITH x AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents) SELECT doc_id, {_n('<[a-zA-Z/][^<>]*>')}::INT AS html, {_n('[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')} / nullif(length(t), 0) AS control, {_n('[#*<>{}|\\\\^~\\[\\]]')} / nullif(length(t), 0) AS special, {_n('[!?.,]{3,}')}::INT AS runs FROM x")
add("txt16_clean_estimate", lambda s, d: read(s, d, "documents").select("doc_id", X.clean_estimate(F.col("text")).alias("clean")), "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(COALESCE(text, ''), '<[a-zA-Z/][^<>]*>', ' ', 'g'), 'https?://[^ \\n]+', '[URL]', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS clean FROM documents")
add("txt28_line_stats", lambda s, d: X.line_stats(read(s, d, "documents"), "doc_id", "text"), f"WITH x AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS l, {_W} AS w FROM documents) SELECT doc_id, len(l)::INT AS n_lines, len(list_filter(l, lambda v: NOT regexp_matches(v, '[^ \\t\\r]')))::INT AS blank_lines, len(w) / 200 AS minutes FROM x")
add("dup1_exact", lambda s, d: X.exact_duplicates(read(s, d, "documents"), "doc_id", "text"), "WITH x AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL), f AS (SELECT t, MIN(doc_id) AS first_id FROM x GROUP BY 1) SELECT doc_id, first_id FROM x JOIN f USING (t) WHERE doc_id > first_id")
add("dup3_near", lambda s, d: X.shingle_classes(read(s, d, "documents"), "doc_id", "text"))
add("dup11_nearest", lambda s, d: X.nearest_vectors(read(s, d, "embeddings"), "vec_id", "embedding").select("query_id", "neighbour_id", "rank"), "WITH c AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT query_id, neighbour_id, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS r FROM c) WHERE r <= 5")
add("pii2_rules", lambda s, d: X.rule_pii(read(s, d, "documents"), "doc_id", "text").select("doc_id", "emails", "ips"), f"WITH x AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents) SELECT doc_id, {_n('[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')}::INT AS emails, {_n('\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b')}::INT AS ips FROM x")
add("pii2_cards", lambda s, d: X.rule_pii(read(s, d, "documents"), "doc_id", "text"))
