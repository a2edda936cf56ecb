"""Queries of scores, graphs and the remaining text, leakage, label and fairness operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import association as A, audit as T, corpus as C, graph as G, outliers as U, quality as K, relational as B, scores as S, text as X
from cairn.session import read

Q, O = {}, {}


def add(name, fn, q=None):
    Q[name] = fn
    if q:
        O[name] = q


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_R = lambda s, d: F.col("l_returnflag") == "R"
add("cor3_pearson_p", lambda s, d: S.correlation_tests(A.pearson_pairs(read(s, d, "lineitem"), LI)))
add("cor16_mutual_information_target", lambda s, d: A.mutual_information(read(s, d, "lineitem").withColumn("t", F.col("l_extendedprice") * (1 - F.col("l_discount"))), "l_extendedprice", "t"))
add("hyp2_chi2", lambda s, d: S.independence(A.contingency(read(s, d, "lineitem"), "l_returnflag", "l_linestatus")))
add("hyp5_normality", lambda s, d: S.normality(read(s, d, "orders"), "o_totalprice"))
_g1 = lambda e: f"(SELECT AVG(power((x - m) / s, 3)) FROM (SELECT {e} AS x FROM orders), (SELECT AVG({e}) AS m, stddev_pop({e}) AS s FROM orders))"
add("hyp8_transforms", lambda s, d: S.transforms(read(s, d, "orders"), "o_totalprice"), " UNION ALL ".join(f"SELECT '{k}' AS transform, {_g1(e)} AS skew" for k, e in {"none": "o_totalprice", "log1p": "ln(1 + o_totalprice)", "sqrt": "sqrt(o_totalprice)", "square": "o_totalprice * o_totalprice", "cbrt": "cbrt(o_totalprice)", "reciprocal": "1 / o_totalprice"}.items()))
add("out7_dixon", lambda s, d: S.dixon(read(s, d, "supplier"), "s_nationkey", "s_acctbal"), "WITH g AS (SELECT s_nationkey AS grp, COUNT(*) AS n, list_sort(list(s_acctbal)) AS a FROM supplier GROUP BY 1 HAVING COUNT(*) BETWEEN 3 AND 30) SELECT grp, n, (a[2] - a[1]) / nullif(a[n] - a[1], 0) AS q_low, (a[n] - a[n - 1]) / nullif(a[n] - a[1], 0) AS q_high FROM g")
add("win5_lag1", lambda s, d: B.lagged_correlation(read(s, d, "snapshots"), "file_hash", ["taken_at", "snapshot_id"], "n_rows", "n_rows", [1]), "SELECT 1::INT AS lag, corr(n_rows, l) AS r, COUNT(l) AS n FROM (SELECT n_rows, lead(n_rows) OVER (PARTITION BY file_hash ORDER BY taken_at, snapshot_id) AS l FROM snapshots)")


def _pacf(s, d):
    r = B.lagged_correlation(read(s, d, "events"), "user_id", ["ts", "event_id"], "value", "value", [1, 2, 3, 4, 5]).orderBy("lag").collect()
    return s.createDataFrame([(i + 1, float(p)) for i, p in enumerate(S.partial_autocorrelation([x["r"] or 0.0 for x in r]))], "lag int, pacf double")


add("win10_pacf", _pacf)
_ksq = lambda c: f"(SELECT '{c}' AS column_name, MAX(d) AS d, SUM(d * (nv - v)) / (MAX(v) - MIN(v)) AS w1, MAX(d) > 1.3581 * sqrt((MAX(ta) + MAX(tb)) / (MAX(ta) * MAX(tb))) AS significant FROM (SELECT v, abs(SUM(a) OVER (ORDER BY v) / SUM(a) OVER () - SUM(b) OVER (ORDER BY v) / SUM(b) OVER ()) AS d, lead(v) OVER (ORDER BY v) AS nv, SUM(a) OVER () AS ta, SUM(b) OVER () AS tb FROM (SELECT {c} AS v, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS a, COUNT(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1)))"
add("drf7_split_shift", lambda s, d: S.split_shift(read(s, d, "lineitem"), ["l_quantity", "l_discount"], F.col("l_returnflag") == "R"), f"{_ksq('l_quantity')} UNION ALL {_ksq('l_discount')}")
add("adv2_split", lambda s, d: (lambda r: s.createDataFrame([K.advise_split(r["t"], r["x"] / r["m"])], "test_share double, folds int, stratify boolean"))(read(s, d, "orders").groupBy("o_orderstatus").count().agg(F.sum("count").alias("t"), F.max("count").alias("x"), F.min("count").alias("m")).first()))
add("adv4_pairwise_imbalance", lambda s, d: (lambda c: c.select(F.col("o_orderstatus").alias("a"), F.col("count").alias("na")).join(c.select(F.col("o_orderstatus").alias("b"), F.col("count").alias("nb")), F.col("a") < F.col("b")).select("a", "b", (F.greatest("na", "nb") / F.least("na", "nb")).alias("ratio")))(read(s, d, "orders").groupBy("o_orderstatus").count()), "WITH c AS (SELECT o_orderstatus AS k, COUNT(*) AS n FROM orders GROUP BY 1) SELECT a.k AS a, b.k AS b, greatest(a.n, b.n) / least(a.n, b.n) AS ratio FROM c a JOIN c b ON a.k < b.k")
add("qlt6_integrity", lambda s, d: read(s, d, "documents").agg(*[F.count_if(F.col("text").rlike(rx)).alias(k) for k, rx in {"emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "urls": r"https?://"}.items()]), "SELECT COUNT(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails, COUNT(*) FILTER (WHERE regexp_matches(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}')) AS ssn, COUNT(*) FILTER (WHERE regexp_matches(text, 'https?://')) AS urls FROM documents")
add("dna2_similarity", lambda s, d: s.createDataFrame([(K.dna_similarity(K.dna(read(s, d, "customer")), K.dna(read(s, d, "supplier").toDF("c_custkey", "c_name", "c_nationkey", "c_acctbal"))),)], "similarity double"))
_SY = "list_sum(list_transform(regexp_extract_all(lower(p_name), '[a-z]+'), lambda v: greatest(len(regexp_extract_all(v, '[aeiouy]+')) - CASE WHEN v LIKE '%e' AND len(regexp_extract_all(v, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1)))"
add("txt2_syllables", lambda s, d: read(s, d, "part").select("p_partkey", F.aggregate(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z]+)"), 1), F.lit(0), lambda a, w: a + X.syllables(w).cast("int")).alias("syllables")), f"SELECT p_partkey, COALESCE({_SY}, 0)::INT AS syllables FROM part")
_dens = {"hedges": X.HEDGES, "intensifiers": ["very", "really", "extremely", "highly", "totally", "almost", "perfectly"], "technical": ["column", "rows", "value", "values", "median", "median", "drift", "schema", "encoding", "model"]}
_ins = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_share = lambda ws: F.size(F.filter("w", lambda v: v.isin(ws))) / F.greatest(F.size("w"), F.lit(1))
add("txt10_style", lambda s, d: read(s, d, "documents").select("doc_id", X.words(F.col("text")).alias("w")).select("doc_id", *[_share(ws).alias(k) for k, ws in _dens.items()]), "WITH x AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}'']+') AS w FROM documents) SELECT doc_id, " + ", ".join(f"len(list_filter(w, lambda v: v IN {_ins(ws)})) / greatest(len(w), 1) AS {k}" for k, ws in _dens.items()) + " FROM x")
add("txt24_corpus", lambda s, d: C.quality(read(s, d, "documents"), "doc_id", "text").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.min("score").alias("least"), F.max("score").alias("most")))
add("dup6_internal", lambda s, d: read(s, d, "documents").select("doc_id", F.transform(X.sentences(F.col("text")), lambda x: F.lower(F.trim(x))).alias("s")).select("doc_id", F.size("s").alias("sentences"), (F.size("s") - F.size(F.array_distinct("s"))).alias("repeats")))


def _clusters(s, d):
    from cairn.session import cut

    return G.components(cut(X.shingle_classes(read(s, d, "documents"), "doc_id", "text")), "id_a", "id_b")


add("dup9_clusters", _clusters)
_cells = ["l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate", "l_extendedprice"]
def _row_pairs(s, d):
    """Even orders against odd ones and every seventh even one again with another tax and date."""
    t = read(s, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    again = t.where("l_orderkey % 14 = 0").withColumns({"k": -F.col("k"), "l_tax": F.col("l_tax") + 0.01, "l_shipdate": F.date_add("l_shipdate", 1).cast("timestamp_ntz")})
    return G.row_pairs(t.where("l_orderkey % 2 = 0"), t.where("l_orderkey % 2 = 1").unionByName(again), "k", _cells, 0.6)


add("dup8_row_pairs", _row_pairs)
add("dup10_inconsistent", lambda s, d: T.inconsistent_labels(read(s, d, "lineitem").withColumn("b", F.floor(F.col("l_extendedprice") / 5000)), ["l_quantity", "b"], "l_linestatus"), "WITH g AS (SELECT COUNT(*) AS n, MIN(l_linestatus) AS a, MAX(l_linestatus) AS b FROM lineitem GROUP BY l_quantity, floor(l_extendedprice / 5000)) SELECT COUNT(*) AS groups, SUM(n)::BIGINT AS rows, COUNT(*) FILTER (WHERE a <> b) AS conflicting_groups, COALESCE(SUM(n) FILTER (WHERE a <> b), 0)::BIGINT AS conflicting_rows FROM g")
_red = [("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[EMAIL]"), ("[0-9]{3}-[0-9]{2}-[0-9]{4}", "[SSN]"), ("https?://[^ \\n]+", "[URL]")]


def _redact(c):
    for rx, to in _red:
        c = F.regexp_replace(c, rx, to)
    return c


add("pii4_redact", lambda s, d: read(s, d, "documents").select("doc_id", _redact(F.col("text")).alias("text")), "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '" + _red[0][0] + "', '[EMAIL]', 'g'), '" + _red[1][0] + "', '[SSN]', 'g'), '" + _red[2][0] + "', '[URL]', 'g') AS text FROM documents")
add("pii1_counts", lambda s, d: read(s, d, "documents").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_red[0][0])).alias("emails"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_red[1][0])).alias("ssn")).select("*", F.greatest(100 - 15 * F.col("emails") - 25 * F.col("ssn"), F.lit(0)).alias("score")), f"WITH x AS (SELECT doc_id, len(regexp_extract_all(COALESCE(text, ''), '{_red[0][0]}'))::INT AS emails, len(regexp_extract_all(COALESCE(text, ''), '{_red[1][0]}'))::INT AS ssn FROM documents) SELECT *, greatest(100 - 15 * emails - 25 * ssn, 0)::INT AS score FROM x")
add("lek3_temporal", lambda s, d: read(s, d, "orders").crossJoin(F.broadcast(B.quantiles(read(s, d, "orders"), {"t": F.unix_micros(F.col("o_orderdate").cast("timestamp"))}, [0.8]).select(F.col("q")[0].alias("b")))).agg(F.count_if(F.unix_micros(F.col("o_orderdate").cast("timestamp")) > F.col("b")).alias("after_boundary"), F.count(F.lit(1)).alias("n")), "SELECT COUNT(*) FILTER (WHERE epoch_us(o_orderdate) > b) AS after_boundary, COUNT(*) AS n FROM orders, (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.8) AS b FROM orders)")
add("fai3_representation", lambda s, d: read(s, d, "customer").groupBy("c_mktsegment").count().select("c_mktsegment", F.col("count").alias("n")).crossJoin(F.broadcast(read(s, d, "customer").groupBy("c_mktsegment").count().agg(F.max("count").alias("top")))).select("c_mktsegment", "n", (F.col("n") / F.col("top")).alias("ratio"), (F.col("n") / F.col("top") >= 0.8).alias("fair")), "WITH c AS (SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, n, n / MAX(n) OVER () AS ratio, n / MAX(n) OVER () >= 0.8 AS fair FROM c")
add("fai11_worst_intersection", lambda s, d: T.intersections(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount") > 0.05, 10).agg(F.round(F.min("rate"), 9).alias("worst"), F.round(F.max("rate"), 9).alias("best")), "SELECT round(MIN(r), 9) AS worst, round(MAX(r), 9) AS best FROM (SELECT AVG((l_discount > 0.05)::INT) AS r FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) >= 10)")
add("img2_diversity", lambda s, d: S.effective_rank(read(s, d, "embeddings"), "embedding"))
add("img4_fingerprint", lambda s, d: K.fingerprint(read(s, d, "image_record").select("image_id", "sha256")))
add("out13_density", lambda s, d: U.density_noise(read(s, d, "supplier"), "s_suppkey", ["s_nationkey", "s_acctbal"], 0.15, 4), """WITH r AS (SELECT MIN(s_nationkey) AS a0, MAX(s_nationkey) AS b0, MIN(s_acctbal) AS a1, MAX(s_acctbal) AS b1 FROM supplier),
p AS (SELECT s_suppkey AS k, (s_nationkey - a0) / (b0 - a0) AS x, (s_acctbal - a1) / (b1 - a1) AS y FROM supplier, r),
n AS (SELECT a.k AS k, b.k AS o FROM p a JOIN p b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.15 * 0.15), c AS (SELECT k FROM n GROUP BY k HAVING COUNT(*) >= 4)
SELECT k AS s_suppkey FROM p WHERE k NOT IN (SELECT n.k FROM n JOIN c ON n.o = c.k)""")
