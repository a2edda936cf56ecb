"""Queries of the cleaning, relational, window and outlier operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import clean as C, outliers as U, relational as R
from cairn.session import read

Q, O = {}, {}


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        O[name] = sql


add("cln1_remove_duplicates", lambda s, d: C.remove_duplicates(read(s, d, "events").select("user_id", "event_type")), "SELECT DISTINCT user_id, event_type FROM events")
_c = lambda s, d: read(s, d, "demo_churn").select("row_id", "age", "tenure_months", "monthly_charges", "contract")
_nn = lambda c: f"CASE WHEN NOT isnan({c}) THEN {c} END"
_mode = lambda c: f"(SELECT {c} FROM demo_churn WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, {c} LIMIT 1)"
add("cln2_drop", lambda s, d: C.handle_missing(_c(s, d), "drop"), "SELECT row_id, age, tenure_months, monthly_charges, contract FROM demo_churn WHERE age IS NOT NULL AND NOT isnan(age) AND tenure_months IS NOT NULL AND monthly_charges IS NOT NULL AND NOT isnan(monthly_charges) AND contract IS NOT NULL")
for _h, _f in (("mean", "AVG"), ("median", "MEDIAN")):
    add(
        f"cln2_{_h}", lambda s, d, h=_h: C.handle_missing(_c(s, d), h, ["age", "tenure_months", "monthly_charges", "contract"]),
        f"""WITH r AS (SELECT round({_f}({_nn('age')}), 4) AS a, round({_f}(tenure_months), 4) AS t, round({_f}({_nn('monthly_charges')}), 4) AS m, {_mode('contract')} AS c FROM demo_churn)
SELECT row_id, COALESCE({_nn('age')}, a) AS age, COALESCE(tenure_months, t)::DOUBLE AS tenure_months, COALESCE({_nn('monthly_charges')}, m) AS monthly_charges, COALESCE(contract, c) AS contract FROM demo_churn, r""",
    )
add("cln2_mode", lambda s, d: C.handle_missing(_c(s, d).select("row_id", "contract"), "mode", ["contract"]), f"SELECT row_id, COALESCE(contract, {_mode('contract')}) AS contract FROM demo_churn")
add("cln2_fill", lambda s, d: C.handle_missing(_c(s, d).select("row_id", "contract"), "fill", ["contract"], "unknown"), "SELECT row_id, COALESCE(contract, 'unknown') AS contract FROM demo_churn")
add(
    "cln3_prepare_for_ml", lambda s, d: C.prepare_for_ml(read(s, d, "supplier"), "s_suppkey"),
    """SELECT s_suppkey, round((s_nationkey - AVG(s_nationkey) OVER ()) / stddev_samp(s_nationkey) OVER (), 6) AS s_nationkey, round((s_acctbal - AVG(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER (), 6) AS s_acctbal, (dense_rank() OVER (ORDER BY s_name) - 1)::INT AS s_name FROM supplier""",
)
add("cln4_contracts", lambda s, d: C.contracts(read(s, d, "customer")), "SELECT 'c_name' AS column_name, 'identifier_like' AS violation, 'low' AS severity, round(COUNT(DISTINCT c_name) / COUNT(*), 4) AS measure FROM customer HAVING COUNT(DISTINCT c_name) / COUNT(*) >= 0.95 AND COUNT(DISTINCT c_name) > 25")
add("cln5_safe_fixes", lambda s, d: C.handle_missing(C.remove_duplicates(_c(s, d).drop("row_id")), "mode", ["contract"]).groupBy("contract").agg(F.count(F.lit(1)).alias("n")), "WITH d AS (SELECT DISTINCT age, tenure_months, monthly_charges, contract FROM demo_churn), m AS (SELECT contract AS c FROM d WHERE contract IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) SELECT COALESCE(contract, c) AS contract, COUNT(*) AS n FROM d, m GROUP BY 1")
_q = lambda t, c: f"b AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"
_lo, _hi = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
add("cln6_winsorize", lambda s, d: U.winsorize(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice"), f"WITH {_q('lineitem', 'l_extendedprice')} SELECT l_orderkey, l_linenumber, greatest(least(l_extendedprice, {_hi}), {_lo}) AS l_extendedprice FROM lineitem, b")
_rules = lambda: {"age_range": F.col("age").between(0, 120), "contract_known": F.col("contract").isin("monthly", "yearly", "two_year", "trial"), "charges_positive": F.col("monthly_charges") >= 0, "row_id_present": F.col("row_id").isNotNull(), "contract_form": F.col("contract").rlike("^[a-z_]+$")}
add(
    "cln7_validate", lambda s, d: C.validate(read(s, d, "demo_churn"), _rules()),
    " UNION ALL ".join(f"SELECT '{k}' AS rule, COUNT(*) FILTER (WHERE NOT COALESCE({p}, FALSE)) AS failures, COUNT(*) AS checked FROM demo_churn" for k, p in {"age_range": "age BETWEEN 0 AND 120", "contract_known": "contract IN ('monthly','yearly','two_year','trial')", "charges_positive": "monthly_charges >= 0", "row_id_present": "row_id IS NOT NULL", "contract_form": "regexp_matches(contract, '^[a-z_]+$')"}.items()),
)
add(
    "cln8_infer_rules", lambda s, d: C.infer_rules(read(s, d, "orders")),
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS kind, COUNT(*) FILTER (WHERE {c} IS NULL) = 0 AS required, COUNT(DISTINCT {c}) = COUNT(*) AS is_unique, {f'round(MIN({c})::DOUBLE, 4)' if k == 'numeric' else 'NULL::DOUBLE'} AS min_value, {f'round(MAX({c})::DOUBLE, 4)' if k == 'numeric' else 'NULL::DOUBLE'} AS max_value, "
        + (f"CASE WHEN COUNT(DISTINCT {c}) <= 20 THEN string_agg(DISTINCT {c}, '|' ORDER BY {c}) END" if k == "text" else "NULL::VARCHAR") + " AS allowed FROM orders"
        for c, k in [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_totalprice", "numeric"), ("o_orderdate", "date"), ("o_orderpriority", "text")]
    ),
)
add("snk2_safe_cells", lambda s, d: read(s, d, "documents").select("doc_id", C.safe_cell(F.col("text")).alias("cell")), r"SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') AND NOT regexp_matches(text, '^[+-]?\d+(\.\d+)?$') THEN '''' || text ELSE text END AS cell FROM documents")
add("imp1_indicators", lambda s, d: C.missing_flags(_c(s, d).select("row_id", "age", "contract"), ["age", "contract"]).select("row_id", "missing_age", "missing_contract"), "SELECT row_id, (age IS NULL OR isnan(age))::INT AS missing_age, (contract IS NULL)::INT AS missing_contract FROM demo_churn")
_ts = lambda s, d: read(s, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
_ev = "e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 <> 0 THEN value END AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"
for _h, _x in (("locf", "b"), ("nocb", "a"), ("ffill", "COALESCE(b, a)"), ("linear", "COALESCE(value, CASE WHEN ap > bp THEN b + (a - b) * (pos - bp) / (ap - bp) ELSE COALESCE(b, a) END)")):
    add(
        f"imp2_{_h}", lambda s, d, h=_h: C.fill_in_time(_ts(s, d).withColumn("t", F.struct("ts", "event_id")), "value", "user_id", "t", h).select("event_id", "value"),
        f"""WITH {_ev}, w AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS b, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS bp,
  first_value(value IGNORE NULLS) OVER n AS a, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER n AS ap FROM e
  WINDOW p AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, {_x} AS value FROM w""",
    )
add("imp3_group_mean", lambda s, d: C.fill_by_group(_c(s, d).select("row_id", "contract", "age"), "age", "contract"), f"WITH g AS (SELECT contract, AVG({_nn('age')}) AS gv FROM demo_churn GROUP BY 1), a AS (SELECT AVG({_nn('age')}) AS av FROM demo_churn) SELECT row_id, d.contract, COALESCE({_nn('age')}, gv, av) AS age FROM demo_churn d LEFT JOIN g ON d.contract IS NOT DISTINCT FROM g.contract, a")
add("imp3_group_mode", lambda s, d: C.fill_by_group(read(s, d, "demo_churn").select("row_id", "snapshot_id", "contract"), "contract", "snapshot_id", "mode"), f"WITH k AS (SELECT snapshot_id, contract, row_number() OVER (PARTITION BY snapshot_id ORDER BY COUNT(*) DESC, contract) AS r FROM demo_churn WHERE contract IS NOT NULL GROUP BY 1, 2) SELECT row_id, d.snapshot_id, COALESCE(d.contract, k.contract, {_mode('contract')}) AS contract FROM demo_churn d LEFT JOIN k ON d.snapshot_id = k.snapshot_id AND r = 1")
add("imp4_knn", lambda s, d: C.knn_impute(read(s, d, "demo_churn").select("row_id", "age", "tenure_months", "support_calls"), "row_id", "age", ["tenure_months", "support_calls"]))
add("imp5_chained", lambda s, d: C.chained_impute(read(s, d, "demo_churn").select("row_id", "age", "tenure_months", "monthly_charges"), ["age", "tenure_months", "monthly_charges"]))
add("imp10_patterns", lambda s, d: C.missing_pattern(_c(s, d), ["age", "tenure_months", "monthly_charges", "contract"]), "SELECT (CASE WHEN age IS NULL OR isnan(age) THEN '1' ELSE '0' END) || (CASE WHEN tenure_months IS NULL THEN '1' ELSE '0' END) || (CASE WHEN monthly_charges IS NULL OR isnan(monthly_charges) THEN '1' ELSE '0' END) || (CASE WHEN contract IS NULL THEN '1' ELSE '0' END) AS pattern, COUNT(*) AS n FROM demo_churn GROUP BY 1")
add("imp11_error", lambda s, d: C.imputation_error(read(s, d, "demo_churn"), "row_id", "age", "snapshot_id"))
add("imp12_drop", lambda s, d: read(s, d, "demo_churn").select("row_id", "contract").na.drop(), "SELECT row_id, contract FROM demo_churn WHERE contract IS NOT NULL")

add("joi1_left_join", lambda s, d: read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment", "o_totalprice"), "SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
_half = lambda s, d, k: read(s, d, "lineitem").where(F.col("l_orderkey") % 2 == k)
_ov = ["l_partkey", "l_quantity", "l_discount"]
add("joi2_exact_overlap", lambda s, d: R.exact_overlap(_half(s, d, 0), _half(s, d, 1), _ov).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem t WHERE l_orderkey % 2 = 0 AND EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey % 2 = 1 AND r.l_partkey = t.l_partkey AND r.l_quantity = t.l_quantity AND r.l_discount = t.l_discount)")
add("joi3_entity_overlap", lambda s, d: R.entity_overlap(_half(s, d, 1), _half(s, d, 0), "l_partkey"), "WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 2 = 1), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 2 = 0), c AS (SELECT COUNT(*) AS shared FROM a JOIN b USING (l_partkey)) SELECT (SELECT COUNT(*) FROM a) AS n_a, (SELECT COUNT(*) FROM b) AS n_b, shared, shared / (SELECT COUNT(*) FROM b) AS ratio FROM c")
add("joi5_foreign_key", lambda s, d: read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), "SELECT c_mktsegment, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
add("joi6_same_file", lambda s, d: read(s, d, "image_record").where("sha256 <> ''").groupBy(F.lower("sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "SELECT lower(sha256) AS sha, COUNT(*) AS n FROM image_record WHERE sha256 <> '' GROUP BY 1 HAVING COUNT(*) > 1")
add("set1_union", lambda s, d: read(s, d, "customer").select(F.col("c_nationkey").alias("nationkey"), "c_acctbal").unionByName(read(s, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), "s_acctbal"), allowMissingColumns=True), "SELECT c_nationkey AS nationkey, c_acctbal, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier")
add("set2_category_change", lambda s, d: R.set_difference(read(s, d, "demo_churn").where("snapshot_id % 10 <= 5").select("contract"), read(s, d, "demo_churn").where("snapshot_id % 10 > 5").select("contract"), "contract"), "WITH a AS (SELECT DISTINCT contract FROM demo_churn WHERE snapshot_id % 10 <= 5), b AS (SELECT DISTINCT contract FROM demo_churn WHERE snapshot_id % 10 > 5) SELECT contract AS value, 'gone' AS side FROM a WHERE contract IS NOT NULL AND contract NOT IN (SELECT contract FROM b WHERE contract IS NOT NULL) UNION ALL SELECT contract, 'new' FROM b WHERE contract IS NOT NULL AND contract NOT IN (SELECT contract FROM a WHERE contract IS NOT NULL)")
add("srt1_top_k", lambda s, d: read(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
add("smp1_sample", lambda s, d: R.sample_rows(read(s, d, "orders"), "o_orderkey", 500).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':42'), o_orderkey LIMIT 500")
add("smp2_stratified", lambda s, d: R.stratified_sample(read(s, d, "orders"), "o_orderkey", "o_orderpriority", 1000).select("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS r FROM orders) WHERE r <= 200")
_u = "(('0x' || substr(md5({k} || ':42'), 1, 8))::BIGINT / 4294967296.0)"
_cs = "CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < 0.85 THEN 'val' ELSE 'test' END"
add("smp3_random_split", lambda s, d: R.random_split(read(s, d, "orders"), "o_orderkey"), f"SELECT o_orderkey, {_cs.format(u=_u.format(k='o_orderkey'))} AS split FROM orders")
add("smp3_group_split", lambda s, d: R.group_split(read(s, d, "orders"), "o_orderkey", "o_custkey"), f"SELECT o_orderkey, o_custkey, {_cs.format(u=_u.format(k='o_custkey'))} AS split FROM orders")
add("smp3_temporal_split", lambda s, d: R.temporal_split(read(s, d, "events"), "event_id", "ts"), "WITH b AS (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.7) AS a, quantile_cont(epoch_us(ts)::DOUBLE, 0.85) AS c FROM events) SELECT event_id, CASE WHEN epoch_us(ts) <= a THEN 'train' WHEN epoch_us(ts) <= c THEN 'val' ELSE 'test' END AS split FROM events, b")
for _n, _h, _f in (("win1_rolling_mean", "mean", "AVG"), ("win2_rolling_std", "std", "stddev_samp")):
    add(_n, lambda s, d, h=_h: R.rolling(read(s, d, "events"), "user_id", ["ts", "event_id"], "value", 3, h).select("event_id", "rolled"), f"SELECT event_id, rolled FROM (SELECT event_id, {_f}(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolled, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r >= 3")
add("win3_average_ranks", lambda s, d: R.average_ranks(read(s, d, "lineitem"), "l_quantity"), "SELECT l_quantity AS value, COUNT(*) AS n, AVG(r) AS average_rank FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1")
_lag = lambda k: f"SELECT {k}::INT AS lag, corr(value, l) AS r, COUNT(CASE WHEN l IS NOT NULL THEN 1 END) AS n FROM (SELECT value, lead(value, {k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events)"
add("win4_lookahead", lambda s, d: R.lagged_correlation(read(s, d, "events"), "user_id", ["ts", "event_id"], "value", "value", [1]), _lag(1))
add("win6_autocorrelation", lambda s, d: R.lagged_correlation(read(s, d, "events"), "user_id", ["ts", "event_id"], "value", "value", [1, 2, 3, 4, 5]), " UNION ALL ".join(map(_lag, range(1, 6))))
add("win7_time_split", lambda s, d: R.temporal_split(read(s, d, "orders"), "o_orderkey", "o_orderdate", 0.8, 0.0).groupBy("split").agg(F.count(F.lit(1)).alias("n")), "WITH b AS (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.8) AS a FROM orders) SELECT CASE WHEN epoch_us(o_orderdate) <= a THEN 'train' ELSE 'test' END AS split, COUNT(*) AS n FROM orders, b GROUP BY 1")
add("win8_event_order", lambda s, d: read(s, d, "documents").selectExpr("count_if(arrived_at < created_at) AS early", "count_if(arrived_at IS NULL OR created_at IS NULL) AS unknown", "count(*) AS n"), "SELECT COUNT(*) FILTER (WHERE arrived_at < created_at) AS early, COUNT(*) FILTER (WHERE arrived_at IS NULL OR created_at IS NULL) AS unknown, COUNT(*) AS n FROM documents")
add("win9_gaps", lambda s, d: R.gaps(read(s, d, "snapshots"), "file_hash", "taken_at"), "WITH g AS (SELECT file_hash, (epoch_us(taken_at) - lag(epoch_us(taken_at)) OVER (PARTITION BY file_hash ORDER BY taken_at)) / 1e6 AS g FROM snapshots) SELECT file_hash, COUNT(g) AS n_gaps, AVG(g) AS mean_gap, stddev_pop(g) / AVG(g) AS cv FROM g WHERE g IS NOT NULL GROUP BY 1")
add("snk4_history", lambda s, d: read(s, d, "snapshots").selectExpr("snapshot_id", "file_hash", "row_number() OVER (PARTITION BY file_hash ORDER BY taken_at DESC, snapshot_id DESC) AS r", "ml_score - lag(ml_score) OVER (PARTITION BY file_hash ORDER BY taken_at, snapshot_id) AS delta").where("r <= 2"), "SELECT * FROM (SELECT snapshot_id, file_hash, (row_number() OVER (PARTITION BY file_hash ORDER BY taken_at DESC, snapshot_id DESC))::INT AS r, ml_score - lag(ml_score) OVER (PARTITION BY file_hash ORDER BY taken_at, snapshot_id) AS delta FROM snapshots) WHERE r <= 2")

_T = "lineitem"
_li = lambda s, d: read(s, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
_k = "l_orderkey * 10 + l_linenumber AS k"
# the driver's tables hold no outliers: every 499th value is made one, in query and SQL alike
_plant = lambda t, c, by, k: f"FROM (SELECT * REPLACE (CASE WHEN {by} % 499 = 0 THEN {c} * {k} ELSE {c} END AS {c}) FROM {t}) AS {t}"
_odd_li = lambda s, d: _li(s, d).withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 499 == 0, F.col("l_extendedprice") * 30).otherwise(F.col("l_extendedprice")))
_odd_orders = lambda s, d: read(s, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 499 == 0, F.col("o_totalprice") * 25).otherwise(F.col("o_totalprice")))


def add_planted(name, table, column, by, k, fn, sql):
    add(name, fn, sql.replace(f"FROM {table}", _plant(table, column, by, k)))


add_planted("out1_quartiles", "lineitem", "l_extendedprice", "l_orderkey", 30, lambda s, d: U.by_quartiles(_odd_li(s, d), "k", "l_extendedprice"), f"WITH {_q(_T, 'l_extendedprice')} SELECT {_k}, l_extendedprice AS value, greatest({_lo} - l_extendedprice, l_extendedprice - ({_hi})) / nullif(q3 - q1, 0) AS score FROM lineitem, b WHERE l_extendedprice < {_lo} OR l_extendedprice > {_hi}")
add("out2_quartiles_k1", lambda s, d: U.by_quartiles(read(s, d, "customer"), "c_custkey", "c_acctbal", 0.4), f"WITH {_q('customer', 'c_acctbal')} SELECT c_custkey, c_acctbal AS value, greatest(q1 - 0.4 * (q3 - q1) - c_acctbal, c_acctbal - (q3 + 0.4 * (q3 - q1))) / (q3 - q1) AS score FROM customer, b WHERE c_acctbal < q1 - 0.4 * (q3 - q1) OR c_acctbal > q3 + 0.4 * (q3 - q1)")
add_planted("out3_zscore", "lineitem", "l_extendedprice", "l_orderkey", 30, lambda s, d: U.by_zscore(_odd_li(s, d), "k", "l_extendedprice", 2.0), f"SELECT {_k}, l_extendedprice AS value, abs(l_extendedprice - m) / s AS score FROM lineitem, (SELECT AVG(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) WHERE abs(l_extendedprice - m) / s > 2.0")
add_planted("out4_modified_z", "lineitem", "l_extendedprice", "l_orderkey", 30, lambda s, d: U.by_median(_odd_li(s, d), "k", "l_extendedprice", 2.0), f"SELECT {_k}, l_extendedprice AS value, 0.6745 * abs(l_extendedprice - m) / s AS score FROM lineitem, (SELECT median(l_extendedprice) AS m, mad(l_extendedprice) AS s FROM lineitem) WHERE 0.6745 * abs(l_extendedprice - m) / s > 2.0")
add("out5_mad_fallback", lambda s, d: U.by_median(_li(s, d).withColumn("x", F.when(F.col("l_orderkey") % 499 == 0, 90.0).when(F.col("l_linenumber") < 6, 1.0).otherwise(F.col("l_linenumber").cast("double"))), "k", "x").select("k", "value"), f"WITH x AS (SELECT {_k}, CASE WHEN l_orderkey % 499 = 0 THEN 90.0 WHEN l_linenumber < 6 THEN 1.0 ELSE l_linenumber END::DOUBLE AS x FROM lineitem), b AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, mad(x) AS md, median(x) AS m FROM x) SELECT k, x AS value FROM x, b WHERE CASE WHEN md > 1e-12 THEN 0.6745 * abs(x - m) / md > 3.5 ELSE x < {_lo} OR x > {_hi} END")
add("out6_grubbs", lambda s, d: U.extremes_test(_odd_orders(s, d), "o_orderkey", "o_totalprice"))
add("out8_esd", lambda s, d: U.extremes_test(read(s, d, "events"), "event_id", "value", kind="esd"))
add("out9_mahalanobis", lambda s, d: U.by_mahalanobis(_li(s, d), "k", ["l_quantity", "l_extendedprice", "l_discount"], 0.9))
add("out10_isolation_forest", lambda s, d: U.isolation_forest(_li(s, d), "k", ["l_quantity", "l_extendedprice", "l_discount"]))
add("out11_lof", lambda s, d: U.local_outlier_factor(read(s, d, "part"), "p_partkey", ["p_size", "p_retailprice"]))
add_planted("out14_vote", "orders", "o_totalprice", "o_orderkey", 25, lambda s, d: U.vote(_odd_orders(s, d), "o_orderkey", ["o_totalprice"]), f"WITH {_q('orders', 'o_totalprice')}, m AS (SELECT AVG(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, median(o_totalprice) AS md, mad(o_totalprice) AS mad FROM orders) SELECT * FROM (SELECT o_orderkey, ((o_totalprice < {_lo} OR o_totalprice > {_hi})::INT + (abs(o_totalprice - m) / s > 3)::INT + (0.6745 * abs(o_totalprice - md) / mad > 3.5)::INT)::BIGINT AS votes FROM orders, b, m) WHERE votes > 0")
add("out14_consensus", lambda s, d: U.consensus(_odd_li(s, d), "k", ["l_quantity", "l_extendedprice", "l_discount"]))
add("out16_density", lambda s, d: U.density(read(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]), f"WITH {_q(_T, 'l_quantity')}, x AS (SELECT COUNT(*) FILTER (WHERE l_quantity < {_lo} OR l_quantity > {_hi}) AS o, COUNT(*) AS n FROM lineitem, b), b2 AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem), y AS (SELECT COUNT(*) FILTER (WHERE l_extendedprice < {_lo} OR l_extendedprice > {_hi}) AS o, COUNT(*) AS n FROM lineitem, b2) SELECT (x.o + y.o) AS outlier_cells, (x.n + y.n) AS cells, (x.o + y.o) / (x.n + y.n) AS density FROM x, y")
