"""Queries of the profile operators, with their SQL."""

from __future__ import annotations

from cairn.operators import profile as P
from cairn.session import read

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
Q, O = {}, {}


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        O[name] = sql


_num = lambda c, t="lineitem": f"SELECT '{c}' AS column_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls, COUNT(DISTINCT {c}) AS distinct_count, MIN({c})::DOUBLE AS min_value, MAX({c})::DOUBLE AS max_value, AVG({c})::DOUBLE AS mean_value, NULL::VARCHAR AS top_value FROM {t}"
_txt = lambda c, t="lineitem", v=None: f"SELECT '{c}', COUNT(*), COUNT(*) FILTER (WHERE {c} IS NULL), COUNT(DISTINCT {c}), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, (SELECT {v or c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {v or c} LIMIT 1) FROM {t}"
_cust = " UNION ALL ".join([_num("c_custkey", "customer"), _txt("c_name", "customer"), _num("c_nationkey", "customer"), _num("c_acctbal", "customer"), _txt("c_mktsegment", "customer")])
add("agg1_full_profile", lambda s, d: P.full_profile(read(s, d, "lineitem").drop("l_shipdate")), " UNION ALL ".join([_num(c) for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LI]] + [_txt("l_returnflag"), _txt("l_linestatus")]))
add("agg1_customer", lambda s, d: P.full_profile(read(s, d, "customer")), _cust)
add("agg2_summarize", lambda s, d: P.quick_profile(read(s, d, "lineitem")))
_churn = ["age", "tenure_months", "monthly_charges", "contract", "support_calls", "churned"]
add("agg3_missing_values", lambda s, d: P.missing_values(read(s, d, "demo_churn").select(*_churn)), " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL{f' OR isnan({c})' if c in ('age', 'monthly_charges') else ''}) AS missing FROM demo_churn" for c in _churn))
add("agg4_duplicate_rows", lambda s, d: P.duplicate_rows(read(s, d, "documents").select("text", "lang")), "SELECT SUM(n)::BIGINT AS n, SUM(n - 1)::BIGINT AS duplicates FROM (SELECT COUNT(*) AS n FROM documents GROUP BY text, lang)")
add("agg5_hash_duplicates", lambda s, d: P.hash_duplicates(read(s, d, "documents").select("text", "lang")), "SELECT SUM(n)::BIGINT AS n, SUM(n - 1)::BIGINT AS duplicates FROM (SELECT COUNT(*) AS n FROM documents GROUP BY text, lang)")
add("agg6_basic_stats", lambda s, d: P.full_profile(read(s, d, "supplier")), " UNION ALL ".join([_num("s_suppkey", "supplier"), _txt("s_name", "supplier"), _num("s_nationkey", "supplier"), _num("s_acctbal", "supplier")]))
add(
    "agg7_descriptive", lambda s, d: P.descriptive(read(s, d, "lineitem"), LI),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT({c}) AS n, COUNT(*) - COUNT({c}) AS nan_count, AVG({c}) AS mean_value, stddev_pop({c}) AS std_pop, stddev_samp({c}) AS std_samp, var_samp({c}) AS var_samp,
  MIN({c}) AS min_value, MAX({c}) AS max_value, MAX({c}) - MIN({c}) AS range_value, SUM({c}) AS sum_value, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median_value, quantile_cont({c}, 0.75) AS q3,
  quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, AVG(power(({c} - m) / s, 3)) AS skew, AVG(power(({c} - m) / s, 4)) - 3 AS kurt, stddev_pop({c}) / abs(AVG({c})) * 100 AS cv_pct
  FROM lineitem, (SELECT AVG({c}) AS m, stddev_pop({c}) AS s FROM lineitem)""" for c in LI
    ),
)
add("agg8_percentiles", lambda s, d: P.percentiles(read(s, d, "orders"), "o_totalprice", [0, 1, 5, 25, 50, 75, 95, 99, 100]), " UNION ALL ".join(f"SELECT {p}.0::DOUBLE AS point, quantile_cont(o_totalprice, {p / 100}) AS quantile FROM orders" for p in [0, 1, 5, 25, 50, 75, 95, 99, 100]))
add("agg7_mad", lambda s, d: P.median_deviation(read(s, d, "orders"), "o_totalprice"), "SELECT median(o_totalprice) AS median_value, mad(o_totalprice) AS mad FROM orders")
add("agg9_stable_moments", lambda s, d: read(s, d, "lineitem").selectExpr("l_extendedprice + 1e9 AS x").selectExpr("count(x) AS n", "avg(x) AS mean_value", "round(var_pop(x), 2) AS var_pop"), "SELECT COUNT(*) AS n, AVG(l_extendedprice + 1e9) AS mean_value, round(var_pop(l_extendedprice + 1e9), 2) AS var_pop FROM lineitem")
add(
    "agg10_extended", lambda s, d: P.extended(read(s, d, "orders"), "o_totalprice"),
    """WITH v AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS r, COUNT(*) OVER () AS t FROM orders),
b AS (SELECT MIN(x) FILTER (WHERE r > floor(t * 0.05)) AS lo, MAX(x) FILTER (WHERE r <= t - floor(t * 0.05)) AS hi FROM v)
SELECT COUNT(*) AS n, stddev_samp(x) / sqrt(COUNT(*)) AS sem, AVG(x) FILTER (WHERE r > floor(t * 0.1) AND r <= t - floor(t * 0.1)) AS trimmed_mean,
  AVG(greatest(least(x, hi), lo)) AS winsorized_mean, SUM((2 * r - t - 1) * x) / (COUNT(*) * SUM(x)) AS gini FROM v, b""",
)
add("agg11_dataset_stats", lambda s, d: P.dataset_stats(read(s, d, "customer")), "SELECT COUNT(*) AS n_rows, 5 AS n_columns, 3 AS n_numeric, 2 AS n_categorical, SUM(CASE WHEN c_custkey IS NULL OR c_name IS NULL OR c_nationkey IS NULL OR c_acctbal IS NULL OR c_mktsegment IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_total, 0.0::DOUBLE AS missing_rate FROM customer")
add(
    "agg12_shape", lambda s, d: P.shape(read(s, d, "orders"), "o_totalprice"),
    """WITH m AS (SELECT AVG(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, COUNT(*) AS n FROM orders),
k AS (SELECT any_value(n) AS n, AVG(power((o_totalprice - m) / s, 3)) AS skew, AVG(power((o_totalprice - m) / s, 4)) - 3 AS kurt, AVG((abs((o_totalprice - m) / s) > 3)::INT::DOUBLE) AS heavy_tail FROM orders, m)
SELECT n, skew, kurt, skew / sqrt(6 / n) AS z_skew, kurt / sqrt(24 / n) AS z_kurt, (skew * skew + 1) / (kurt + 3 * (n - 1)::DOUBLE * (n - 1) / ((n - 2)::DOUBLE * (n - 3))) AS bimodality, heavy_tail,
  CASE WHEN abs(skew) < 0.5 THEN 'none' WHEN skew > 1 THEN 'log1p' WHEN skew > 0 THEN 'sqrt' ELSE 'square' END AS transform FROM k""",
)
add(
    "agg13_entropy", lambda s, d: P.entropy(read(s, d, "events"), "event_type"),
    "WITH c AS (SELECT COUNT(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type), p AS (SELECT n / SUM(n) OVER () AS p FROM c) SELECT -SUM(p * log2(p)) AS entropy_bits, -SUM(p * ln(p)) AS entropy_nats, COUNT(*) AS n_unique, -SUM(p * log2(p)) / log2(COUNT(*)) AS normalized FROM p",
)
_bins = lambda t, c, b: f"r AS (SELECT MIN({c}) AS a, MAX({c}) AS b FROM {t}), c AS (SELECT least(floor(({c} - a) / ((b - a) / {b})), {b - 1})::INT AS bin, COUNT(*) AS n FROM {t}, r WHERE {c} IS NOT NULL GROUP BY 1)"
add("agg14_numeric_entropy", lambda s, d: P.numeric_entropy(read(s, d, "events"), "value", 10), f"WITH {_bins('events', 'value', 10)} SELECT -SUM(p * log2(p)) AS entropy_bits FROM (SELECT n / SUM(n) OVER () AS p FROM c)")
add("agg15_histogram", lambda s, d: P.histogram(read(s, d, "events"), "value", 20), f"WITH {_bins('events', 'value', 20)} SELECT g.bin::INT AS bin, a + g.bin * ((b - a) / 20) AS lo, a + (g.bin + 1) * ((b - a) / 20) AS hi, COALESCE(c.n, 0)::BIGINT AS n FROM r, range(20) g(bin) LEFT JOIN c ON c.bin = g.bin")
add("agg16_class_gini", lambda s, d: P.class_gini(read(s, d, "orders"), "o_orderpriority"), "WITH c AS (SELECT COUNT(*) AS n, o_orderpriority AS k FROM orders GROUP BY 2), w AS (SELECT n, SUM(n) OVER (ORDER BY n, k) AS cum FROM c) SELECT ((COUNT(*) + 1) - 2 * SUM(cum) / SUM(n)) / COUNT(*) AS gini, COUNT(*) AS classes FROM w")
add("agg17_top_values", lambda s, d: P.top_values(read(s, d, "part"), "p_brand", 10), "SELECT p_brand AS value, COUNT(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("agg18_crosstab", lambda s, d: P.crosstab(read(s, d, "lineitem"), "l_returnflag", "l_linestatus"), "WITH c AS (SELECT l_returnflag, l_linestatus, COUNT(*) AS observed FROM lineitem GROUP BY 1, 2) SELECT *, (SUM(observed) OVER (PARTITION BY l_returnflag) * SUM(observed) OVER (PARTITION BY l_linestatus) / SUM(observed) OVER ())::DOUBLE AS expected FROM c")
add("agg19_quick_stats", lambda s, d: read(s, d, "supplier").selectExpr("round(min(s_acctbal), 4) AS min_value", "round(max(s_acctbal), 4) AS max_value", "round(avg(s_acctbal), 4) AS mean_value", "count_if(s_acctbal IS NULL) AS nulls"), "SELECT round(MIN(s_acctbal), 4) AS min_value, round(MAX(s_acctbal), 4) AS max_value, round(AVG(s_acctbal), 4) AS mean_value, COUNT(*) FILTER (WHERE s_acctbal IS NULL) AS nulls FROM supplier")
add("agg20_date_features", lambda s, d: P.date_features(read(s, d, "orders"), "o_orderkey", "o_orderdate"), "SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, (isodow(o_orderdate) - 1)::INT AS dayofweek, (isodow(o_orderdate) >= 6)::INT AS is_weekend FROM orders")
add("agg21_numeric_features", lambda s, d: P.numeric_features(read(s, d, "part"), "p_partkey", ["p_size", "p_retailprice"]), "SELECT p_partkey, ln(1 + p_size) AS p_size_log, ln(1 + p_retailprice) AS p_retailprice_log, p_size * p_size AS p_size_squared, p_retailprice * p_retailprice AS p_retailprice_squared, p_size * p_retailprice AS p_size_x_p_retailprice FROM part")
add("agg22_interactions", lambda s, d: read(s, d, "supplier").selectExpr("s_suppkey", "s_acctbal * s_nationkey AS s_acctbal_x_s_nationkey"), "SELECT s_suppkey, s_acctbal * s_nationkey AS s_acctbal_x_s_nationkey FROM supplier")
add("agg23_text_features", lambda s, d: P.text_features(read(s, d, "part"), "p_partkey", "p_name"), "SELECT p_partkey, COALESCE(length(p_name), 0)::INT AS n_length, COALESCE(len(string_split(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ' ')), 0)::INT AS n_words FROM part")
