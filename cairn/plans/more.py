"""Queries of sources, corpus, learning, streaming and the remaining audit operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import association as A, audit as T, corpus as C, learning as L, quality as K, text as X
from cairn.session import read
from cairn.sources import readers, sql
from cairn.streaming import live

Q, O = {}, {}


def add(name, fn, q=None):
    Q[name] = fn
    if q:
        O[name] = q


def _sql(s, d):
    read(s, d, "orders").createOrReplaceTempView("cairn_orders")
    return sql.run(s, "SELECT o_orderstatus AS value, count(*) AS n FROM cairn_orders GROUP BY o_orderstatus ORDER BY n DESC, value", 100)


add("src3_scan", lambda s, d: readers.load(s, f"{d}/nation.parquet"), "SELECT * FROM nation")
add("src7_guarded_sql", _sql, "SELECT o_orderstatus AS value, COUNT(*) AS n FROM orders GROUP BY 1")
add("src9_metadata", lambda s, d: s.createDataFrame(read(s, d, "customer").dtypes, "column_name string, type_name string"), "SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE 'double' END AS type_name FROM (DESCRIBE customer)")
add("src10_preview", lambda s, d: read(s, d, "region").orderBy("r_regionkey").limit(3), "SELECT * FROM region ORDER BY r_regionkey LIMIT 3")
add("src11_sections", lambda s, d: readers.sections(read(s, d, "document_data")).select("file_id", "section_index", "section_type", "text", "char_count"), "SELECT file_id, p.section_index AS section_index, p.section_type AS section_type, p.page_text AS text, length(p.page_text)::INT AS char_count FROM (SELECT file_id, unnest(pages) AS p FROM document_data)")
add("src12_html", lambda s, d: read(s, d, "document_data").where(F.col("full_text").rlike("(?i)<body")).select("file_id", readers.parse_html("full_text").alias("p")).select("file_id", "p.title", "p.text", F.size("p.links").alias("n_links"), "p.has_table"))
add("src13_markdown", lambda s, d: readers.markdown_parts(read(s, d, "document_data"), "file_id", "full_text"), "WITH x AS (SELECT file_id, COALESCE(full_text, '') AS t FROM document_data) SELECT file_id, len(regexp_extract_all(t, '(?m)^#{1,6}[ \\t]+[^ \\t\\n]'))::INT AS headings, len(regexp_extract_all(t, '\\[[^\\]\\n]+\\]\\([^)\\n]+\\)'))::INT AS links, len(regexp_extract_all(t, '`[^`\\n]+`'))::INT AS code_spans FROM x")
add("src13_strip_markdown", lambda s, d: read(s, d, "document_data").select("file_id", readers.strip_markdown(F.col("full_text")).alias("text")))
add("win_stream_windows", lambda s, d: live.windowed_profile(read(s, d, "events"), width="1 hour").select(F.unix_timestamp("window_start").alias("hour"), "event_type", "n", "mean_value", "max_value"), "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, event_type, COUNT(*) AS n, AVG(value) AS mean_value, MAX(value) AS max_value FROM events GROUP BY 1, 2")
add("win_stream_sessions", lambda s, d: live.sessions(read(s, d, "events")).select("user_id", F.unix_micros("session_start").alias("start_us"), "n"), "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(MIN(ts)) AS start_us, COUNT(*) AS n FROM k GROUP BY user_id, k.k")
add("imp6_forest", lambda s, d: L.model_impute(read(s, d, "demo_churn"), "row_id", "age", ["tenure_months", "support_calls", "monthly_charges"]))
add("imp7_boosted", lambda s, d: L.model_impute(read(s, d, "demo_churn"), "row_id", "age", ["tenure_months", "support_calls"], "boosted"))
add("adv6_importance", lambda s, d: L.importance(read(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag"))
add("adv8_leaderboard", lambda s, d: L.leaderboard(read(s, d, "demo_churn").where("churned IS NOT NULL"), "row_id", ["age", "tenure_months", "monthly_charges", "support_calls"], "churned"))
add("txt8_topics", lambda s, d: L.topics(read(s, d, "documents"), "doc_id", "text"))
add("txt11_coherence", lambda s, d: C.coherence(read(s, d, "documents"), "doc_id", "text"))
add("txt19_encoding_signals", lambda s, d: C.encoding_signals(read(s, d, "documents"), "doc_id", "text"), "WITH x AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents) SELECT doc_id, starts_with(t, chr(65279)) AS has_bom, 0 + len(regexp_extract_all(t, '\\x00'))::INT AS nul_count, len(regexp_extract_all(t, chr(65533)))::INT AS replacement_count, len(regexp_extract_all(t, '[\\x{200b}\\x{200c}\\x{200d}\\x{2060}\\x{feff}]'))::INT AS zero_width, len(regexp_extract_all(t, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]'))::INT AS control_count FROM x")
add("txt21_mtld", lambda s, d: read(s, d, "documents").select("doc_id", C.mtld("text").alias("mtld")))
add("txt23_quality", lambda s, d: C.quality(read(s, d, "documents"), "doc_id", "text"))
add("txt26_tidy", lambda s, d: read(s, d, "document_data").select("file_id", C.tidy(F.col("full_text")).alias("text")))
add("txt9_similarity", lambda s, d: read(s, d, "part").select("p_partkey", C.jaccard(X.words(F.col("p_name")), X.words(F.col("p_type"))).alias("similarity")), "WITH x AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}'']+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}'']+')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0) AS similarity FROM x")
add("dup2_simhash", lambda s, d: C.simhash_pairs(read(s, d, "documents"), "doc_id", "text"))
add("dup4_cosine", lambda s, d: C.cosine_pairs(read(s, d, "documents"), "doc_id", "text"))
add("dup5_sentences", lambda s, d: read(s, d, "documents").select("doc_id", F.explode(C.sentence_repeats("text")).alias("p")).select("doc_id", "p.*"))
add("lek1_target", lambda s, d: A.pearson_pairs(read(s, d, "lineitem").withColumn("target", F.col("l_extendedprice") * (1 - F.col("l_discount"))), ["target", "l_quantity", "l_extendedprice", "l_tax"]).where("a = 'target'").select(F.col("b").alias("column_name"), F.round("r", 9).alias("r"), (F.abs("r") >= 0.95).alias("leak")), " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(corr(l_extendedprice * (1 - l_discount), {c}), 9) AS r, abs(corr(l_extendedprice * (1 - l_discount), {c})) >= 0.95 AS leak FROM lineitem" for c in ["l_quantity", "l_extendedprice", "l_tax"]))
add("fai5_group_calibration", lambda s, d: read(s, d, "lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(F.col("l_quantity") / 50) - F.avg((F.col("l_returnflag") == "R").cast("int"))).alias("gap")), "SELECT l_linestatus, COUNT(*) AS n, abs(AVG(l_quantity / 50) - AVG((l_returnflag = 'R')::INT)) AS gap FROM lineitem GROUP BY 1")
add("fai7_measurement", lambda s, d: A.kruskal(read(s, d, "orders"), "o_orderstatus", "o_totalprice").select("groups", "n", "h"), "WITH r AS (SELECT o_totalprice AS v, COUNT(*) AS t, AVG(r) AS r FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS r FROM orders) GROUP BY 1), g AS (SELECT o_orderstatus, COUNT(*) AS n, SUM(r.r) AS rs FROM orders JOIN r ON o_totalprice = v GROUP BY 1), x AS (SELECT SUM(n)::DOUBLE AS n, SUM(rs * rs / n) AS q, COUNT(*) AS k FROM g), y AS (SELECT SUM(t * (t * t - 1))::DOUBLE AS ties FROM r) SELECT k AS groups, n::BIGINT AS n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM x, y")
add("rdy1_balance", lambda s, d: K.imbalance(read(s, d, "image_record"), "class_label").select("classes", "ratio", F.when(F.col("ratio") >= 10, 0).when(F.col("ratio") >= 5, 25).when(F.col("ratio") >= 2, 55).when(F.col("ratio") >= 1.5, 80).otherwise(100).alias("score")), "WITH c AS (SELECT COUNT(*) AS n FROM image_record WHERE class_label IS NOT NULL GROUP BY class_label), t AS (SELECT COUNT(*) AS classes, MAX(n) / MIN(n) AS ratio FROM c) SELECT classes, ratio, CASE WHEN ratio >= 10 THEN 0 WHEN ratio >= 5 THEN 25 WHEN ratio >= 2 THEN 55 WHEN ratio >= 1.5 THEN 80 ELSE 100 END AS score FROM t")
add("lbl3_ambiguity", lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_sort(F.array(F.col("l_discount") * 5, F.col("l_tax") * 5, 1 - F.col("l_discount") * 5 - F.col("l_tax") * 5)).alias("p")).select("l_orderkey", "l_linenumber", (1 - (F.col("p")[2] - F.col("p")[1])).alias("ambiguity")), "SELECT l_orderkey, l_linenumber, 1 - (p[3] - p[2]) AS ambiguity FROM (SELECT l_orderkey, l_linenumber, list_sort([l_discount * 5, l_tax * 5, 1 - l_discount * 5 - l_tax * 5]) AS p FROM lineitem)")
add("pii5_column_scan", lambda s, d: read(s, d, "documents").agg(F.count_if(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).alias("with_email"), F.count("text").alias("n")), "SELECT COUNT(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS with_email, COUNT(text) AS n FROM documents")
add("fai6_permutation", lambda s, d: _gap(s, d))


def _gap(s, d):
    r = T.label_rates(read(s, d, "lineitem"), "l_linestatus", F.col("l_returnflag") == "R").orderBy("grp").collect()
    p = A.rate_gap_p([round(x["rate"] * x["n"]) for x in r], [x["n"] for x in r])
    return s.createDataFrame([(len(r), p)], "groups int, p double")
