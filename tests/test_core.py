"""Hand-computed fixtures and properties of the core operators: nulls, ties, repeated rows, empty tables."""

import datetime as dt
import json
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cairn.engine import Engine
from cairn.functions import distributions as D
from cairn.operators import association as A, audit as T, clean as C, corpus, drift as R, learning as L, outliers as U, profile as P, quality as K, relational as B, text as X
from cairn.sources import readers, sinks, sql
from cairn.streaming import live

NAN = float("nan")


def nums(spark, values, name="x"):
    return spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate(values)], f"id long, {name} double")


def people(spark):
    rows = [("Alice", 25.0, 3000.0, "Algiers"), ("Bob", None, 4500.0, "Oran"), ("Carol", 31.0, NAN, "Algiers"), ("Dave", 28.0, 3800.0, None), ("Alice", 25.0, 3000.0, "Algiers")]
    return spark.createDataFrame(rows, "name string, age double, salary double, city string")


def test_people(spark):
    df = people(spark)
    assert {r.column_name: r.missing for r in P.missing_values(df).collect()} == {"name": 0, "age": 1, "salary": 1, "city": 1}
    assert P.duplicate_rows(df).first().duplicates == 1 and P.hash_duplicates(df).first().duplicates == 1
    prof = {r.column_name: r for r in P.full_profile(df).collect()}
    assert prof["age"].mean_value == 27.25 and prof["salary"].mean_value == 3575 and prof["city"].top_value == "Algiers" and prof["city"].nulls == 1
    assert sum(r.missing for r in P.missing_values(C.handle_missing(df, "mean")).collect()) == 0
    assert C.remove_duplicates(df).count() == 4 and K.completeness(df).first().row_share == 0.4
    with pytest.raises(ValueError):
        C.handle_missing(df, "magic")


def test_kernel(spark):
    r = P.descriptive(nums(spark, [2, 4, 4, 4, 5, 5, 7, 9]), ["x"]).first()
    assert (r.mean_value, r.median_value, r.std_pop, r.q1, r.q3) == (5, 4.5, 2, 4, 5.5) and abs(r.var_samp - 32 / 7) < 1e-12
    assert [x.value for x in U.by_quartiles(nums(spark, [2, 4, 4, 4, 5, 5, 7, 9]), "id", "x").collect()] == [9]
    assert U.by_quartiles(nums(spark, [5] * 5), "id", "x").count() == 0 and U.by_zscore(nums(spark, [5] * 5), "id", "x").count() == 0
    r = P.descriptive(nums(spark, [1, 2, NAN, 4, float("inf"), 5]), ["x"]).first()
    assert (r.n, r.nan_count) == (4, 2)
    assert {x.value for x in U.by_median(nums(spark, [1, 2, 2, 3, 2, 2, 1000]), "id", "x").collect()} == {1, 1000}
    assert {x.value for x in U.by_median(nums(spark, [10, 12, 11, 13, 12, 14, 11, 500]), "id", "x").collect()} == {500}
    assert U.by_quartiles(nums(spark, [10, 12, 11, 13, 12, 14, 11, 12]), "id", "x").count() == 0
    with pytest.raises(ValueError):
        P.percentiles(nums(spark, [1]), "x", [101])


def test_empty_tables(spark):
    e = nums(spark, [])
    assert P.full_profile(e).count() == 2 and P.descriptive(e, ["x"]).first().n == 0 and P.duplicate_rows(e).first().n == 0
    assert U.by_quartiles(e, "id", "x").count() == 0 and U.by_median(e, "id", "x").count() == 0 and P.entropy(e, "x").first().n_unique == 0
    assert A.pearson_pairs(e, ["id", "x"]).first().r is None and B.rolling(e, "id", ["id"], "x", 3).count() == 0
    d = spark.createDataFrame([], "id long, t string")
    assert X.exact_duplicates(d, "id", "t").count() == 0 and X.shingle_classes(d, "id", "t").count() == 0 and corpus.simhash_pairs(d, "id", "t").count() == 0


def test_gini_and_entropy(spark):
    c = spark.createDataFrame([("a",)] * 1 + [("b",)] * 1 + [("c",)] * 8, "k string")
    assert abs(P.class_gini(c, "k").first().gini - 0.4666667) < 1e-6
    assert abs(P.entropy(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), "k").first().entropy_bits - 1) < 1e-12


def test_divergence(spark):
    d = spark.createDataFrame([("a", 0.5, 0.9), ("b", 0.5, 0.1)], "value string, p double, q double")
    assert abs(R.divergence(d).first().psi - (0.4 * math.log(1.8) - 0.4 * math.log(0.2))) < 1e-9
    same = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.5, 0.5)], "value string, p double, q double")
    assert abs(R.divergence(same).first().psi) < 1e-12


def test_time_fills(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([1.0, None, None, 4.0])], "g string, t int, v double")
    take = lambda how: [r.v for r in C.fill_in_time(df, "v", "g", "t", how).orderBy("t").collect()]
    assert take("locf") == [1, 1, 1, 4] and take("nocb") == [1, 4, 4, 4] and take("linear") == [1, 2, 3, 4]
    r = B.rolling(df.fillna(0), "g", ["t"], "v", 2).orderBy("t").collect()
    assert [x.rolled for x in r] == [0.5, 0, 2]


def test_allocation():
    assert B.allocation({"a": 100, "b": 3}, 10) == {"a": 7, "b": 3}
    assert sum(B.allocation({str(i): 5 for i in range(50)}, 10).values()) == 10
    assert B.allocation({}, 5) == {}


def test_group_metrics(spark):
    rows = [("a", 1, 1)] * 4 + [("a", 0, 0)] * 1 + [("b", 1, 1)] * 3 + [("b", 1, 0)] * 1 + [("b", 0, 0)] * 1 + [("tiny", 1, 1)]
    m = {r.grp: r for r in T.group_metrics(spark.createDataFrame(rows, "g string, y int, p int"), "g", F.col("y"), F.col("p")).collect()}
    assert set(m) == {"a", "b"} and m["a"].selection == 0.8 and m["b"].tpr == 0.75 and not m["b"].fair


def test_simpson(spark):
    rows = [("s", float(i), float(i)) for i in range(12)] + [("t", float(i + 30), float(i - 30)) for i in range(12)]
    r = T.simpson(spark.createDataFrame(rows, "s string, a double, b double"), "s", "a", "b").first()
    assert r.overall < 0 and r.reversed == 2 and r.paradox


def test_special_functions():
    assert abs(D.normal_cdf(1.96) - 0.9750021) < 1e-6 and abs(D.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(D.t_sf2(2.228139, 10) - 0.05) < 1e-6 and abs(D.f_sf(4.964603, 1, 10) - 0.05) < 1e-6
    assert abs(D.t_quantile(0.975, 10) - 2.228139) < 1e-5 and abs(D.chi2_quantile(0.95, 2) - 5.991465) < 1e-5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=2, max_size=40), st.lists(st.integers(0, 60), min_size=2, max_size=40))
def test_permutation_p_is_a_share(sizes, pos):
    k = min(len(sizes), len(pos))
    sizes, pos = sizes[:k], [min(p, n) for p, n in zip(pos, sizes)]
    assert 0 <= A.rate_gap_p(pos[:k], sizes[:k], 50) <= 1


def test_near_duplicates_are_exact(spark):
    import random

    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(60)] for _ in range(12)]
    docs = []
    for b in base:
        docs.append(b)
        c = list(b)
        c[rng.randint(0, 59)] = "zz"
        docs += [c, list(b)]
    docs += [["the", "same", "short"]] * 3 + [[]]
    rows = [(i, " ".join(d) if d else None) for i, d in enumerate(docs)]
    sh = lambda d: {tuple(d[i : i + 5]) for i in range(max(len(d) - 4, 1))}
    reps = {}
    for i, d in enumerate(docs):
        if d:
            reps.setdefault(tuple(d), i)
    want = set()
    items = [(i, sh(list(d))) for d, i in reps.items()]
    for i, a in items:
        for j, b in items:
            if i < j and len(a & b) / len(a | b) >= 0.8:
                want.add((i, j))
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r.id_a, r.id_b) for r in X.shingle_classes(df, "id", "t").collect()}
    assert got == want and len(want) >= 8
    assert {(r.id, r.first_id) for r in X.exact_duplicates(df, "id", "t").collect()} >= {(2, 0), (37, 36), (38, 36)}
    cos = {(r.id_a, r.id_b) for r in corpus.cosine_pairs(df, "id", "t").collect()}
    assert want <= cos


def test_simhash_pairs_match_brute_force(spark):
    rows = [(i, " ".join(f"t{(i // 4) * 3 + k}" for k in range(40)) + (" tail" if i % 4 == 1 else "")) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string")
    fp = {r.id: r.h & (2**64 - 1) for r in df.select("id", corpus.simhash(X.words(F.col("t"))).alias("h")).collect()}
    first = {}
    for i, h in sorted(fp.items()):
        first.setdefault(h, i)
    want = {(a, b) for ha, a in first.items() for hb, b in first.items() if a < b and bin(ha ^ hb).count("1") <= 3}
    assert {(r.id_a, r.id_b) for r in corpus.simhash_pairs(df, "id", "t").collect()} == want


def test_nearest_vectors(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None)], "id long, v array<double>")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 50, 100):
        s = n @ n[q]
        s[q] = -9
        want = np.argsort(-s)[:5].tolist()
        assert [r.neighbour_id for r in X.nearest_vectors(df, "id", "v").where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_isolation_forest_finds_the_planted(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(300)] + [(1000, 500.0, -500.0)]
    out = U.isolation_forest(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], trees=20).orderBy(F.desc("score")).first()
    assert out.id == 1000
    lof = U.local_outlier_factor(spark.createDataFrame(rows[:200], "id long, a double, b double"), "id", ["a", "b"])
    assert lof.count() >= 1


def test_extremes(spark):
    df = nums(spark, [10, 11, 12, 11, 10, 12, 11, 10, 11, 12, 90])
    assert [r.x if "x" in r else r.value for r in U.extremes_test(df, "id", "x").collect()] == [90]


def test_models(spark):
    rows = [(i, float(i), float(i % 2), None if i % 10 == 0 else 2.0 * i, str(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, c string")
    imp = L.model_impute(df, "id", "y", ["a", "b"], "linear").collect()
    assert len(imp) == 20 and all(abs(r.imputed - 2 * r.id) < 5 for r in imp)
    top = L.importance(df, ["a", "b"], "c").orderBy(F.desc("importance")).first()
    assert top.column_name == "b"


def test_sql_guard():
    assert sql.guard("SELECT 1", 5) == "SELECT 1 LIMIT 5" and sql.guard("with x as (select 1) select * from x")
    assert sql.guard("select 'update; --' as t") and sql.guard("SELECT replace(a, 'x', 'y') FROM t")
    for bad in ("DELETE FROM t", "select 1; select 2", "select 1 -- x", "", "x" * 20000, "select * from t where drop table"):
        with pytest.raises(ValueError):
            sql.guard(bad)
    assert sql.join_hints({"orders": ["o_custkey"], "customer": ["c_custkey"]}) == ["SELECT * FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey"]


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes("a;a; \ncafé;1;=2+3\n-5;2;x\ntoo;many;cells;here\n".encode("latin-1"))
    df = readers.load_resilient(spark, str(p))
    rows = df.collect()
    assert len(set(df.columns)) == 4 and len(rows) == 3 and rows[0][0] == "café"
    assert [r[readers.BAD] for r in rows] == [None, None, "too;many;cells;here"]  # kept, not dropped
    md = spark.createDataFrame([("# Head\n> quote **bold** and [x](y) ![i](z)\n---\n```\n# code\n```\n`a_b` 2 * 3",), (None,)], "t string")
    assert [r[0] for r in md.select(readers.strip_markdown("t")).collect()] == ["Head\nquote bold and x i\n\n# code\na_b 2 * 3", None]
    with pytest.raises(ValueError):
        sinks.as_json(spark.range(20), 10)
    sinks.write_csv(spark.createDataFrame([("=2+3",), ("-5",), ("ok",), (None,)], "c string"), str(tmp_path / "out"))
    got = {r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()}
    assert got - {None} == {"'=2+3", "-5", "ok"}
    with pytest.raises(ValueError):
        readers.load(spark, "x.xyz")
    (tmp_path / "n.json").write_text(json.dumps([{"a": {"b": 1}, "c": 2}]))
    assert readers.load(spark, str(tmp_path / "n.json")).columns == ["a.b", "c"]
    page = spark.createDataFrame([("<html lang='en'><head><title>T</title></head><body><p>Hi</p><script>x</script><a href='#a'>n</a><a href='/b'>m</a></body></html>",), (None,)], "h string")
    r = page.select(readers.parse_html("h").alias("p")).select("p.*").collect()
    assert r[0].title == "T" and "Hi" in r[0].text and "x" not in r[0].text and r[0].links == ["/b"] and r[1].text == ""
    s = str(tmp_path / "store")
    sinks.append(spark.createDataFrame([("f", 1)], "k string, t int"), s)
    sinks.append(spark.createDataFrame([("f", 2)], "k string, t int"), s)
    assert [x.t for x in sinks.latest(spark, s, "k", "t").collect()] == [2]
    assert "| k | t |" in sinks.report({"Store": spark.read.parquet(s)})


def test_engine(spark):
    e = Engine(spark)
    e.register("rows", lambda d: d.groupBy().count())
    out = e.run(["profile", "rows", "nothing", "deduplicate", "duplicates"], people(spark))
    assert out["rows"].first()[0] == 5 and out["duplicates"].first().n == 4 and out["errors"].first().step == "nothing"
    assert e.compare(people(spark), people(spark)).count() == 0  # nothing changed
    with pytest.raises(ValueError):
        e.run("fly", people(spark))


def test_streaming(spark, tmp_path):
    base = dt.datetime(2031, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=i), i % 3, "a" if i % 2 else "b", float(i)) for i in range(120)]
    df = spark.createDataFrame(rows + rows[:5], "event_id long, ts timestamp, user_id long, event_type string, value double")
    src = str(tmp_path / "in")
    df.repartition(3).write.parquet(src)
    live_df = live.windowed_profile(live.deduplicated(live.read(spark, src, df.schema)))
    q = live_df.writeStream.outputMode("append").format("memory").queryName("profile_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = live.windowed_profile(df.dropDuplicates(["event_id"]))
    assert batch.agg(F.sum("n")).first()[0] == 120 and spark.table("profile_out").count() <= batch.count()


def test_fingerprint_ignores_order(spark):
    df = people(spark)
    a, b = K.fingerprint(df).first(), K.fingerprint(df.orderBy(F.desc("name")).repartition(3)).first()
    assert a == b and K.fingerprint(df.limit(3)).first().content_hash != a.content_hash
    assert K.dna_similarity(K.dna(df), K.dna(df)) == 1.0


def test_components(spark):
    import random

    from cairn.operators.graph import components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)] + [(500, k) for k in range(501, 560)] + [(700, 700)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges + [(None, 1)], "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in {n for e in edges for n in e}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_row_pairs_match_brute_force(spark):
    import random

    from cairn.operators.graph import row_pairs

    rng = random.Random(6)
    cols = [f"c{i}" for i in range(6)]
    make = lambda base, n: [(base + i, *[rng.randint(0, 3) if k else 1 for k in range(6)]) for i in range(n)]
    te, tr = make(0, 40), make(1000, 60)
    schema = "id long, " + ", ".join(f"{c} int" for c in cols)
    first = lambda rows: {t: i for i, *t_ in reversed(rows) for t in [tuple(t_)]}
    need = lambda a, b: (m := sum(x == y for x, y in zip(a, b))) / (12 - m) >= 0.5
    want = {(i, j) for a, i in first(te).items() for b, j in first(tr).items() if need(a, b)}
    got = row_pairs(spark.createDataFrame(te, schema), spark.createDataFrame(tr, schema), "id", cols, 0.5)
    assert {(r.test_key, r.train_key) for r in got.collect()} == want


def test_scores(spark):
    from cairn.operators import scores as S

    assert S.weighted({"size": 80.0, "quality": None}, S.READY) == 80.0 and S.weighted({"size": 80.0}, S.READY, True) == 50.0 and S.weighted({}, S.READY) == 0.0
    n = {r.test: r for r in S.normality(nums(spark, [((i * 37) % 101) ** 3 for i in range(101)]), "x").collect()}
    assert not n["skewness"].normal and not n["kolmogorov"].normal
    assert S.normality(nums(spark, []), "x").count() == 0
    assert [round(x, 6) for x in S.partial_autocorrelation([0.5, 0.25, 0.125])] == [0.5, 0, 0]


def test_cut_and_clean(spark):
    from cairn import session

    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = session.cut(spark.range(5))
    assert df.inputFiles()[0].startswith(session.shared_dir(spark).replace("file:///", "file:///").rstrip("/"))
    assert df.count() == 5 and session.cut(spark.range(0)).count() == 0
    session.clean(spark)
    assert session.cut(spark.range(3)).count() == 3


def test_density_noise_matches_brute_force(spark):
    import random

    rng = random.Random(8)
    pts = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(150)] + [(200 + i, 3.0, 3.0) for i in range(60)] + [(500, 9.0, -9.0), (501, None, 1.0)]
    good = [p for p in pts if p[1] is not None]
    lo, hi = [min(p[j] for p in good) for j in (1, 2)], [max(p[j] for p in good) for j in (1, 2)]
    z = {p[0]: [(p[j] - lo[j - 1]) / (hi[j - 1] - lo[j - 1]) for j in (1, 2)] for p in good}
    near = {a: [b for b in z if math.dist(z[a], z[b]) <= 0.04] for a in z}
    core = {a for a in z if len(near[a]) >= 5}
    want = {a for a in z if not core & set(near[a])}
    df = spark.createDataFrame(pts, "id long, a double, b double")
    got = {r.id for r in U.density_noise(df, "id", ["a", "b"], 0.04, 5).collect()}
    assert got == want and 500 in got and 200 not in got
    assert U.density_noise(df.limit(0), "id", ["a", "b"]).count() == 0


def test_running_sums(spark):
    import random

    vals = random.Random(3).sample(range(10_000), 500)
    df = spark.createDataFrame([(v, v % 7) for v in vals], "v long, n long")
    got = {r.v: (r.cum_n, r.next_value) for r in B.running(df, "v", ["n"]).collect()}
    order, total, want = sorted(vals), 0, {}
    for i, v in enumerate(order):
        total += v % 7
        want[v] = (total, order[i + 1] if i + 1 < len(order) else None)
    assert got == want and B.running(df.limit(0), "v", ["n"]).count() == 0


def test_simhash_pairs_of_one_fingerprint(spark):
    rows = [(i, " ".join(f"w{k}" for k in (range(30) if i % 2 else reversed(range(30))))) for i in range(4)] + [(9, " ".join(f"w{k}" for k in range(40, 60)))]
    df = spark.createDataFrame(rows, "id long, t string")  # the order of words doesn't change a fingerprint
    assert [tuple(r) for r in corpus.simhash_pairs(df, "id", "t").collect()] == [(0, 1, 0)]


def test_mean_discrepancy_takes_all_rows(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(900, 3))
    x[600::2] += 2.0  # drift beyond the first 200 of a side
    df = spark.createDataFrame([(i, [float(e) for e in r]) for i, r in enumerate(x)] + [(5000, None)], "k long, v array<double>")
    a, b = x[::2], x[1::2]
    mean = lambda p, q: np.exp(-0.05 * ((p[:, None] - q[None]) ** 2).sum(2)).mean()
    got = R.mean_discrepancy(df, "k", "v", F.col("k") % 2 == 0).first().mmd2
    assert got == pytest.approx(mean(a, a) + mean(b, b) - 2 * mean(a, b), rel=1e-9)
    assert R.mean_discrepancy(df, "k", "v", F.col("k") >= 0).first().mmd2 is None


def test_effective_rank_takes_all_rows(spark):
    import numpy as np

    from cairn.operators import scores

    x = np.random.default_rng(3).normal(size=(700, 6))
    df = spark.createDataFrame([([float(e) for e in r],) for r in x] + [(None,)], "v array<double>")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = np.linalg.eigvalsh(n @ n.T / len(n))
    w = w[w > 1e-12]
    got = scores.effective_rank(df, "v").first()
    assert got.points == 700 and got.diversity == pytest.approx(float(np.exp(-(w * np.log(w)).sum())), rel=1e-9)
    assert scores.effective_rank(df.limit(0), "v").first().points == 0


def test_nearest_rows_are_exact_on_skewed_data(spark):
    import numpy as np

    g = np.random.default_rng(4)
    x = np.concatenate([g.normal(size=(150, 3)) * 1e-4, g.integers(0, 3, size=(60, 3)) * 0.01, [[1.0, 1.0, 1.0], [0.3, 0.9, 0.2]]])
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    df = spark.createDataFrame([(i, [float(e) for e in r]) for i, r in enumerate(x)], "k long, x array<double>")
    for dims in (1, 2, 3):
        p = df.select("k", F.slice("x", 1, dims).alias("x"))
        near = C.nearest_rows(p, p.select(F.col("k").alias("o"), F.col("x").alias("y")), 5, itself=True)
        got = sorted((r.k, r.d, r.o) for r in near.collect())
        want = []
        for i in range(len(x)):
            d = [(float(np.sqrt(sum((x[i, c] - x[j, c]) ** 2 for c in range(dims)))), j) for j in range(len(x)) if j != i]
            want += [(i, *e) for e in sorted(d)[:5]]
        assert [(k, o) for k, _, o in got] == [(k, o) for k, _, o in want]


def test_outlier_factor_keeps_the_isolated_point(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(100)] + [(1000, 500.0, 500.0)]
    out = U.local_outlier_factor(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"]).orderBy(F.desc("score")).first()
    assert out.id == 1000
    few = spark.createDataFrame([(1, 5.0, 0.0), (2, None, 0.9), (3, 7.0, 0.05)], "id long, a double, b double")
    assert C.knn_impute(few, "id", "a", ["b"], k=1).first().imputed == 7.0


def test_kruskal_takes_counts_whose_cubes_leave_the_range_of_a_long(spark):
    n = 6_000_000
    x = spark.range(n).select((F.col("id") % 2).alias("g"), ((F.col("id") >= n // 2) | (F.col("id") % 100 == 0)).cast("double").alias("v"))
    low, a = n // 2 - n // 200, n // 4 - n // 200  # zeros, zeros of the even rows; the odd ones have n / 4
    assert low**3 + (n - low) ** 3 > 2**63
    r0, r1 = (low + 1) / 2, low + (n - low + 1) / 2
    rs = [k * r0 + (n // 2 - k) * r1 for k in (a, n // 4)]
    h = (12 / (n * (n + 1)) * sum(r * r / (n // 2) for r in rs) - 3 * (n + 1)) / (1 - (low**3 - low + (n - low) ** 3 - (n - low)) / (n**3 - n))
    got = A.kruskal(x, "g", "v").first()
    assert got.h == pytest.approx(h, rel=1e-6) and (got.groups, got.n) == (2, n)


def test_cut_leaves_no_shuffle_files(spark):
    import time

    from cairn.session import cut

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())}

    before = shuffled()
    assert len(cut(spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count()).collect()) == 7
    for _ in range(50):
        if not (left := {f for f in shuffled() - before if f.endswith(".data")}):
            break
        time.sleep(0.1)
    assert not left


def test_cosine_pairs_match_brute_force_over_many_blocks(spark):
    import random

    rng = random.Random(11)
    docs = [[f"w{lang}x{rng.randint(0, 40)}" for _ in range(rng.randint(1, 30))] for lang in range(3) for _ in range(60)]
    docs += [[*d[1:], "once"] for d in docs[::4]] + [[f"alone{i}"] for i in range(5)] + [docs[0]]
    n = len({tuple(d) for d in docs})
    first = {}
    for i, d in enumerate(docs):
        first.setdefault(tuple(d), i)
    freq = {}
    for d in first:
        for t in set(d):
            freq[t] = freq.get(t, 0) + 1
    unit = {}
    for d, i in first.items():
        x = {t: d.count(t) * (math.log((1 + n) / (1 + freq[t])) + 1) for t in d}
        s = math.sqrt(sum(v * v for v in x.values()))
        unit[i] = {t: v / s for t, v in x.items()}
    want = {(i, j): c for i in unit for j in unit if i < j and (c := sum(v * unit[j].get(t, 0.0) for t, v in unit[i].items())) >= 0.6}
    got = corpus.cosine_pairs(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id long, t string"), "id", "t", 0.6, size=16)
    rows = {(r.id_a, r.id_b): r.cosine for r in got.collect()}
    assert len(want) > 20 and rows == pytest.approx(want)
    assert corpus.cosine_pairs(spark.createDataFrame([(1, "a"), (2, None)], "id long, t string"), "id", "t").count() == 0


def test_outlier_factor_of_copies(spark):
    """Every row's factor by brute force, where points have more copies than neighbours count; the points' searches don't grow with the copies."""
    import numpy as np

    at = [(0.0, 0.0)] * 9 + [(1.0, 1.0)] * 3 + [(2.0, 0.5), (5.0, 5.0), (10.0, 9.0)] + [(3.0, 3.0)] * 6
    x = np.array(at)
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    k, n = 3, len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    nb = [sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:k] for i in range(n)]
    kd = [d[i, nb[i]].max() for i in range(n)]
    lrd = [1 / (np.mean([max(d[i, j], kd[j]) for j in nb[i]]) + 1e-12) for i in range(n)]
    want = {i: np.mean([lrd[j] for j in nb[i]]) / lrd[i] for i in range(n)}
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(at)] + [(99, None, 1.0)], "id long, a double, b double")
    got = {r.id: r.score for r in U.local_outlier_factor(df, "id", ["a", "b"], k, contamination=1.0).collect()}
    assert got == pytest.approx(want)


def test_outlier_factor_searches_a_point_once(spark, monkeypatch):
    asked = []
    search = C.nearest_rows
    monkeypatch.setattr(C, "nearest_rows", lambda ask, *a, **k: (asked.append(ask.count()), search(ask, *a, **k))[1])
    df = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(600)], "id long, a double, b double")
    assert U.local_outlier_factor(df, "id", ["a", "b"], 4).count() == 600
    assert asked == [18]


def test_row_pairs_write_no_cells_per_prefix(spark):
    """Pairs of many kinds of cells by brute force, nulls and repeated keys among them; the plan shuffles codes, never lists of cells."""
    import random

    from cairn.operators.graph import row_pairs

    rng = random.Random(8)
    row = lambda i: (i // 2, rng.choice(["x", "y", None]), rng.randint(0, 2), float(rng.randint(0, 1)), rng.choice([None, dt.date(2020, 1, 1), dt.date(2020, 1, 2)]), rng.randint(0, 3))
    te, tr = [row(i) for i in range(80)], [row(1000 + i) for i in range(90)]
    schema, cols = "id long, a string, b int, c double, d date, e long", ["a", "b", "c", "d", "e"]
    first = {}
    for side, rows in (("a", te), ("b", tr)):
        for i, *cells in rows:
            first[side, tuple(cells)] = min(i, first.get((side, tuple(cells)), i))
    want = {(i, j, m / (10 - m)) for (s, x), i in first.items() for (z, y), j in first.items() if s == "a" and z == "b" and (m := sum(u == v for u, v in zip(x, y))) / (10 - m) >= 0.6}
    df = row_pairs(spark.createDataFrame(te, schema), spark.createDataFrame(tr, schema), "id", cols, 0.6)
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and want
    assert "array<" not in df._jdf.queryExecution().toString() and "explode" not in df._jdf.queryExecution().toString()


def test_containment_matches_brute_force_over_many_blocks(spark):
    import random

    rng = random.Random(12)
    text = lambda: " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 2, 5, 30])))
    te, tr = [(i, text()) for i in range(60)] + [(99, None)], [(f"f{i}", text()) for i in range(50)]
    grams = lambda t: {tuple(w[i : i + 3]) for w in [(t or "").split()] for i in range(len(w) - 2)}
    want = {(i, j, len(s), len(s) / len(grams(u))) for i, t in te for j, u in tr if (s := grams(t) & grams(u))}
    a, b = spark.createDataFrame(te, "id long, t string"), spark.createDataFrame(tr, "f string, u string")
    got = X.containment(a, "id", "t", b, "f", "u", 3, block=100)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 100
    assert got.columns == ["id", "f", "shared", "share"] and X.containment(a.limit(0), "id", "t", b, "f", "u", 3).count() == 0
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()  # pairs are not shuffled
