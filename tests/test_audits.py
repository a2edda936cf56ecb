"""Changes, audits, quantiles, group tests and text quality on small planted tables: nulls, empty sides, ties, clashing names."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairn import engine
from cairn.operators import audits, change, dimensions, graph, outliers, relational, statistics, text_quality


def test_schema_and_table_changes(spark):
    a = spark.createDataFrame([(i, float(i), "x" if i % 3 else "y", 1) for i in range(30)], "id long, v double, c string, gone int")
    b = spark.createDataFrame([(i, 3.0 * i, "x" if i % 2 else None, "n") for i in range(30)], "id long, v double, c string, new string")
    assert {(r.column_name, r.change) for r in change.schema_changes(a, b).collect()} == {("gone", "removed"), ("new", "added")}
    assert change.schema_changes(a, a.withColumn("v", F.col("v").cast("string"))).first().change == "retyped"
    got = {r.column_name: r for r in change.table_changes(a, b).collect()}
    assert set(got) == {"v", "c", "gone", "new"} and got["v"].issues == 3 and got["v"].severity == "high"
    assert got["c"].gone_values == 1 and got["c"].missing_change == 0.5 and got["c"].severity == "medium"
    assert change.verdict(change.table_changes(a, b)).first().verdict == "high"
    assert change.table_changes(a, a).count() == 0 and change.verdict(change.table_changes(a, a)).first().verdict == "none"
    assert change.table_changes(a, a.limit(0)).where("kind = 'numeric'").count() == 0


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.0, 2.0, rng.random()]), rng.random() if i % 5 else float("nan"), None) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, e double")
    got = {r.column_name: r for r in relational.quantiles(df, {"a": F.col("a"), "b": F.when(~F.isnan("b"), F.col("b")), "e": F.col("e")}, [0.0, 0.3, 0.5, 1.0]).collect()}
    for i, c in enumerate("ab"):
        xs = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i])
        assert got[c].n == len(xs)
        for p, q in zip([0.0, 0.3, 0.5, 1.0], got[c].q):
            at = p * (len(xs) - 1)
            lo = math.floor(at)
            assert abs(q - (xs[lo] + (xs[math.ceil(at)] - xs[lo]) * (at - lo))) < 1e-12
    assert got["e"].n == 0 and got["e"].q == [None] * 4
    assert relational.quantiles(df.limit(0), {"a": F.col("a")}, [0.5]).first().q == [None]


def test_no_plan_holds_a_column_in_one_buffer(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "k long, v double")
    for x in (outliers.quartile_bounds(df, "v"), outliers.by_median(df, "k", "v"), relational.temporal_split(df.withColumn("t", F.col("k").cast("timestamp")), "k", "t")):
        assert "percentile" not in x._jdf.queryExecution().toString() and "median(" not in x._jdf.queryExecution().toString()


def test_leakage_audit(spark):
    rng = random.Random(1)
    rows = [(i, i // 2, rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame([(*r, r[2] * 2 + 1) for r in rows], "t long, person long, good double, noise double, y double")
    train, test = df.where("t % 4 > 0"), df.where("t % 4 = 0 OR t % 40 = 1")
    got = {(r.detector, r.subject): r for r in audits.leakage(train, test, "y", ["good", "noise"], "person", "t").collect()}
    assert got["target", "good"].severity == "critical" and ("target", "noise") not in got
    assert got["overlap", "rows"].measure == pytest.approx(10 / 110) and got["entity", "person"].severity == "high" and got["time", "t"].severity == "high"
    alone = {r.detector: r.subject for r in audits.leakage(train, None, "y", ["noise"]).collect()}
    assert alone["overlap"].startswith("skipped") and "target" not in alone
    s = audits.leakage_score(audits.leakage(train, test, "y", ["good", "noise"], "person", "t")).first()
    assert s.findings == 4 and s.score == round(100 - 25 * 0.9 - 25 - 15 * 0.9 - 15 * 0.8, 2) and s.grade == "F"
    assert audits.leakage_score(audits.leakage(train, None, "y", ["noise"])).first().grade == "A"


def test_label_audit(spark):
    rows = [(i, i % 2, i % 10, 0.9 if (i % 2 == 1) != (i % 20 == 0) else 0.1) for i in range(400)]
    df = spark.createDataFrame(rows, "t long, y int, f long, p1 double").withColumn("p0", 1 - F.col("p1"))
    got = {r.dimension: r for r in audits.label_quality(df, "y", ["f"], ["p0", "p1"], "t").collect()}
    assert got["noise"].measure == pytest.approx(20 / 400) and got["imbalance"].score == 100 and got["inconsistent"].score == 100 and got["drift"].measure < 0.02
    assert audits.overall(audits.label_quality(df, "y", ["f"])).first().grade == "A"
    assert audits.overall(audits.label_quality(df.limit(0), "y", ["f"])).first().score == 100


def test_bias_audit(spark):
    rows = [("a" if i % 10 else "b", "north" if i % 10 else "south", float(i % 7), int(i % 10 > 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, area string, v double, y int")
    got = {(r.detector, r.subject): r for r in audits.bias(df, ["g"], F.col("y") == 1, F.col("v") > 2).collect()}
    assert got["representation", "g"].severity == "high" and got["outcome", "g"].severity == "high" and got["proxy", "g~area"].severity == "high"
    assert ("proxy", "g~v") not in got
    fair = spark.createDataFrame([(str(i % 2), i // 2 % 2) for i in range(400)], "g string, y int")
    assert audits.bias_score(audits.bias(fair, ["g"], F.col("y") == 1)).first().score == 0


def test_readiness_blocks_on_balance(spark):
    rows = [(i, "rare" if i % 40 == 0 else "often", "train" if i % 5 else "test") for i in range(800)]
    df = spark.createDataFrame(rows, "id long, label string, part string")
    d = audits.readiness(df, "label", F.col("part"), F.col("id").cast("string"))
    assert {r.dimension for r in d.where("blocking").collect()} == {"balance"}
    r = audits.readiness_score(d).first()
    assert r.score == 50 and not r.ready
    ok = audits.readiness_score(audits.readiness(df.where("id % 40 > 0").withColumn("label", F.when(F.col("id") % 2 == 0, "x").otherwise("z")), "label", F.col("part"), F.col("id").cast("string"))).first()
    assert ok.ready and ok.score > 80


def test_group_tests(spark):
    rng = random.Random(2)
    two = spark.createDataFrame([(i % 2, rng.gauss(i % 2, 1)) for i in range(400)], "g int, v double")
    r = statistics.compare_groups(two, "g", "v").first()
    assert r.test == "t" and r.p < 1e-6 and 0.7 < r.effect_size < 1.3
    wide = spark.createDataFrame([(i % 2, rng.gauss(0, 1 + 9 * (i % 2))) for i in range(400)], "g int, v double")
    assert statistics.compare_groups(wide, "g", "v").first().test == "welch" and statistics.bartlett(wide, "g", "v").first().p < 1e-6
    skew = spark.createDataFrame([(i % 3, rng.random() ** 6) for i in range(600)], "g int, v double")
    assert statistics.compare_groups(skew, "g", "v").first().test == "kruskal"
    assert statistics.compare_groups(two.limit(0), "g", "v").first().test == "none" and statistics.bartlett(two.limit(0), "g", "v").first().k2 is None
    assert statistics.fisher_p(3, 1, 1, 3) == pytest.approx(34 / 70) and statistics.fisher_p(0, 5, 5, 0) == pytest.approx(2 / 252)
    t = spark.createDataFrame([(True, True)] * 3 + [(True, False)] + [(False, True)] + [(False, False)] * 3, "a boolean, b boolean")
    assert tuple(statistics.fisher(t, "a", "b").first()) == ("fisher", 9.0, pytest.approx(34 / 70))


def test_consensus(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(1000, 15.0, -15.0)], "k long, x double, y double")
    got = {r.k: r.votes for r in outliers.consensus(df, "k", ["x", "y"], 1.0).collect()}
    assert got[1000] == 3


def test_text_quality(spark):
    rows = [(1, "\ufeffa\u00a0b\x00 e\u0301 "), (2, None), (3, ""), (4, "word " * 2000), (5, "The share was 10 rows. It is not known whether the share of missing cells fell. The share of missing cells fell to 90 rows.")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {r.id: r.text for r in text_quality.fix_encoding(df, "id", "text").collect()} == {1: "a b é", 2: None, 3: "", 4: ("word " * 2000).strip(), 5: rows[4][1]}
    s = {r.id: r for r in text_quality.simple_scores(df, "id", "text").collect()}
    assert s[2].score == s[3].score == 0 and s[4].verdict == "fair" and s[5].verdict == "good"
    c = {r.id: r for r in text_quality.consistency_scores(df, "id", "text").collect()}
    assert (c[5].numbers, c[5].against) == (1, 1) and c[5].consistency == 75 and c[2].consistency == 100
    h = {r.id: r.coherence for r in text_quality.coherence_scores(df, "id", "text").collect()}
    assert h[2] == h[5] == 100


def test_components_raise_when_unfinished(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(chain, "a", "b", rounds=1)


def test_engine_takes_all_columns(spark):
    df = spark.createDataFrame([tuple(float(i * (j + 1) % 17) for j in range(18)) for i in range(30)], [f"c{j}" for j in range(18)])
    assert engine.Engine(spark).step("correlations", df).count() == 18 * 17 // 2


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from cairn import session

    class Context:
        """A cluster's context without a checkpoint folder."""

        master = "spark://host:7077"
        _jsc = property(lambda self: self)
        sc = getCheckpointDir = lambda self: self
        isDefined = lambda self: False

    class Session:
        conf = {"spark.checkpoint.dir": None}
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_quality_dimensions(spark):
    rows = [(i, 20.0 + i % 50, 1.0 * (i % 7), 2.0 + i % 7, "red" if i % 2 else "blue", i % 2) for i in range(300)]
    cols = "row_id long, age double, start_at double, end_at double, colour string, label int"
    good = spark.createDataFrame(rows, cols)
    d = {r.dimension: r.score for r in dimensions.dimensions(good, target="label").collect()}
    assert set(d) == set(dimensions.K.WEIGHTS) and all(v is not None for v in d.values())
    assert d["validity"] == d["consistency"] == d["integrity"] == d["completeness"] == 100
    bad = spark.createDataFrame([(r[0] % 3, -5.0 if i % 2 else None, 9.0, 1.0, " a@b.org", 0) for i, r in enumerate(rows)], cols)
    b = {r.dimension: r.score for r in dimensions.dimensions(bad, target="label").collect()}
    assert b["validity"] == 0 + 100 * (1 - (1 + 0 + 1) / 2) and b["consistency"] == 0 and b["integrity"] == 85 and b["uniqueness"] < d["uniqueness"]
    o, p = dimensions.overall(dimensions.dimensions(good, target="label")).first(), dimensions.overall(dimensions.dimensions(bad, target="label")).first()
    assert o.grade in "AB" and p.score < o.score
    advice = dimensions.recommendations(dimensions.dimensions(bad, target="label")).collect()
    assert advice and {r.priority for r in advice} <= {"high", "medium", "low"} and "validity" in {r.dimension for r in advice}
    assert dimensions.overall(dimensions.dimensions(good.limit(0), target="label")).first().score is not None
    assert dimensions.ordered_pairs(["start_at", "end_at", "x", "min_v", "max_v"]) == [("start_at", "end_at"), ("min_v", "max_v")]
