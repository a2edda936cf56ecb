"""Problems 3 and 6 on small fixtures: nulls, NaN, stand-ins, repeated rows, hot ids, empty tables, extra columns."""

import datetime as dt

import pandas as pd
import pytest

from cairn.operators import column_profile as cp, fill

CHURN = "row_id long, snapshot_id long, customer_id long, age double, tenure_months long, monthly_charges double, contract string, support_calls long, churned int, loaded_at timestamp, value string, _file string"
LOADS = "snapshot_id long, file_hash string, taken_at timestamp, missing long, duplicates long"
STATS = "snapshot_id long, column_name string, missing_pct double, unique_count long"


def churn(spark, rows):
    full = [(*r, 1, 0, dt.datetime(2031, 1, 1), "x", "y") for r in rows]
    return spark.createDataFrame(full, CHURN)


def loads(spark, n=3):
    return spark.createDataFrame([(i, "f", dt.datetime(2031, i, 1), 0, 0) for i in range(1, n + 1)], LOADS)


def test_fill(spark):
    nan = float("nan")
    rows = [
        (1, 1, 7, 30.0, 1, 10.0, "Monthly"), (2, 2, 7, nan, None, None, "?"), (3, 3, 7, 32.0, 3, 20.0, "monthly"),
        (4, 1, 8, -1.0, -99, 99999.0, None), (5, 2, 8, 40.0, 0, 0.0, "yearly"), (6, 2, 8, 40.0, 0, 0.0, "yearly"), (7, 3, None, None, 5, -50.0, "T"),
    ]
    got = {(r.row_id, r.field_name): r for r in fill.fill_missing(churn(spark, rows), loads(spark)).collect()}
    assert got[2, "age"].value == "31" and got[2, "age"].method == "interpolate"
    assert got[2, "tenure_months"].value == "2" and got[2, "contract"].value == "monthly"
    assert got[4, "age"].value == "40" and got[4, "age"].method == "carry" and got[4, "contract"].value == "yearly"
    assert got[7, "age"].method == "group"
    assert (5, "monthly_charges") not in got and (7, "monthly_charges") not in got  # zero is real, a wrong sign is not missing
    found = {(r.row_id, r.field_name) for r in fill.found(churn(spark, rows), loads(spark)).collect()}
    assert found == set(got)


def test_pooled_id_is_no_entity(spark):
    rows = [(i, 1 + i % 3, 999, float(20 + i), i, 5.0, "monthly") for i in range(60)] + [(99, 2, 999, None, 3, 5.0, "monthly")]
    out = fill.fill_missing(churn(spark, rows), loads(spark)).collect()
    assert [(r.row_id, r.method) for r in out] == [(99, "group")]


def test_fill_empty(spark):
    assert fill.fill_missing(churn(spark, []), loads(spark)).count() == 0
    assert fill.found(churn(spark, []), loads(spark)).count() == 0


def test_repeated_rows_keep_their_history(spark):
    rows = [(i, 1 + i % 3, 7, 30.0, 5 + i % 3, 5.0, "monthly") for i in range(30)] + [(99, 2, 7, None, 6, 5.0, "monthly")]
    assert [(r.row_id, r.method, r.value) for r in fill.fill_missing(churn(spark, rows), loads(spark)).collect()] == [(99, "interpolate", "30")]


def test_stand_ins_are_learned(spark):
    """777 and "tbd" recur and contradict their neighbours; one-off wrong values and a spelling do not count as missing."""
    rows, k = [], 0
    for c in range(60):
        for load in (1, 2, 3):
            k += 1
            odd = load == 2
            age = 777.0 if odd and c % 3 == 0 else 1900.0 + c if odd and c % 3 == 1 else 40.0 + c % 9
            name = "tbd" if odd and c % 2 else "mthly" if odd and c % 4 == 0 else ["monthly", "yearly", "trial"][c // 2 % 3] if c % 4 else "monthly"
            rows.append((k, load, c, age, 10 + load, 20.0, name))
    got = {(r.row_id, r.field_name): r.value for r in fill.fill_missing(churn(spark, rows), loads(spark)).collect()}
    want = {(r[0], "age") for r in rows if r[3] == 777.0} | {(r[0], "contract") for r in rows if r[6] == "tbd"}
    assert set(got) == want
    assert got[2, "age"] == "40"


def test_profile_counts(spark, tmp_path):
    rows = [(i, 1, i, None if i == 0 else 30.0 + i % 3, i % 5, float("nan") if i == 1 else 1.0, " a" if i % 2 else "a") for i in range(20)]
    path = str(tmp_path / "demo_churn.parquet")
    churn(spark, rows).write.parquet(path)
    p = {r.column_name: r for r in cp.profile(cp.value_counts(spark, path)).collect()}
    assert (p["age"].nulls, p["age"].unique_count, p["age"].lo, p["age"].hi) == (1, 3, 30.0, 32.0)
    assert (p["monthly_charges"].nulls, p["monthly_charges"].unique_count) == (1, 1)
    assert p["contract"].unique_count == 2 and p["contract"].n == 20 and p["support_calls"].unique_count == 1


def test_duplicates_take_nan_for_null(spark):
    nan = float("nan")
    rows = [(1, 1, 7, nan, 1, 1.0, "a"), (2, 1, 7, None, 1, 1.0, "a"), (3, 1, 7, 3.0, 1, 1.0, "a")]
    r = cp.whole_rows(churn(spark, rows)).first()
    assert (r.n, r.duplicates) == (3, 1)


def test_breaks_and_misreports(spark, tmp_path):
    rows, k = [], 0
    for load in range(1, 9):
        for c in range(60):
            k += 1
            age = None if load in (5, 6) and c % 2 else float(20 + (c * 7 + load) % 40)  # a change that lasts two loads
            rows.append((k, load, c, age, c % 30 + load, 10.0 + c if load != 3 else -10.0 - c, "monthly" if c % 2 else "yearly"))
    path = str(tmp_path / "demo_churn.parquet")
    churn(spark, rows).write.parquet(path)
    stats = spark.createDataFrame([(1, "age", 0.0, 40), (2, "age", 1.0, None), (2, "age", 0.0, 40), (3, "contract", None, 3)], STATS)
    got = {tuple(r) for r in cp.findings(spark, path, loads(spark, 8), stats).collect()}
    assert {g for g in got if g[2] == "break"} == {(5, "age", "break"), (3, "monthly_charges", "break")}
    assert (2, "age", "misreport") in got and (3, "contract", "misreport") in got and (1, "age", "misreport") not in got
    assert {(5, "*", "misreport"), (6, "*", "misreport")} <= got  # 30 missing, none reported


def test_profile_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "demo_churn.parquet")
    churn(spark, []).write.parquet(path)
    assert cp.findings(spark, path, loads(spark), spark.createDataFrame([], STATS)).count() == 0


def test_history_reports_a_lasting_change_once():
    base = dict(column_name="age", n=100, n_real=100, nulls=0, unique_count=40, unique_real=40, lo=18.0, hi=80.0, q=[20.0, 30.0, 40.0, 50.0, 60.0], mean=40.0)
    rows = [dict(base, snapshot_id=i, taken_at=i) for i in range(8)]
    for i in (4, 5, 6):
        rows[i]["q"] = [60.0, 70.0, 80.0, 90.0, 99.0]
    assert cp._history(pd.DataFrame(rows)).snapshot_id.tolist() == [4]


@pytest.mark.parametrize("bad", [-1.0, 0.0, 999.0])
def test_age_stand_ins(spark, bad):
    assert fill.found(churn(spark, [(1, 1, 1, bad, 1, 1.0, "monthly")]), loads(spark)).count() == 1


def test_categories_of_one_shape_are_told_apart(spark, tmp_path):
    # "monthly" and "trial" shared one of the 32 hash buckets that were compared
    rows = [(100 * s + i, s, i, 30.0, 1, 1.0, "trial" if s == 4 else "monthly") for s in range(1, 5) for i in range(40)]
    path = str(tmp_path / "demo_churn.parquet")
    churn(spark, rows).write.parquet(path)
    got = cp.breaks(cp.profile(cp.value_counts(spark, path)), cp.whole_rows(churn(spark, rows)), loads(spark, 4)).collect()
    assert [r.snapshot_id for r in got if r.column_name == "contract"] == [4]


def test_dictionary_page_alone(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "d.parquet")
    cols = {"d": pa.array([1.5, float("nan"), 1.5] * 50), "t": pa.array(["a", "ü", None] * 50), "i": pa.array([7, 7, 9] * 50, pa.int64()), "p": pa.array([1, 2, 3] * 50, pa.int64())}
    for codec in ("snappy", "zstd", "none"):
        pq.write_table(pa.table(cols), path, compression=codec, use_dictionary=["d", "t", "i"])
        meta = pq.ParquetFile(path).metadata.row_group(0)
        with open(path, "rb") as f:
            got = {meta.column(k).path_in_schema: cp.dictionary(f, meta.column(k)) for k in range(4)}
        assert got["t"] == ["a", "ü"] and got["i"] == [7, 9] and got["p"] is None
        assert got["d"][0] == 1.5 and len(got["d"]) == 2 and got["d"][1] != got["d"][1]


def test_settled_chunks_count_like_decoded_ones(spark, tmp_path):
    """One load per file: constants and nulls come from footers and dictionaries, a NaN hidden from the footer is seen; paths with blanks."""
    nan = float("nan")
    path = str(tmp_path / "with blank %20" / "demo_churn.parquet")
    loads_ = {1: [(30.0, 1, 5.0, "m")] * 9, 2: [(30.0, 1, nan, "m")] + [(30.0, 1, 5.0, "m")] * 8, 3: [(None, 1, 5.0, None)] * 9}
    for k, rows in loads_.items():
        churn(spark, [(100 * k + i, k, i, *r) for i, r in enumerate(rows)]).coalesce(1).write.mode("append").parquet(path)
    p = {(r.snapshot_id, r.column_name): r for r in cp.profile(cp.value_counts(spark, path)).collect()}
    assert (p[1, "monthly_charges"].nulls, p[1, "monthly_charges"].unique_count, p[1, "monthly_charges"].n) == (0, 1, 9)
    assert (p[2, "monthly_charges"].nulls, p[2, "monthly_charges"].unique_count) == (1, 1)
    assert p[3, "age"].nulls == 9 and p[3, "contract"].nulls == 9 and p[1, "contract"].unique_count == 1 and p[1, "age"].lo == 30.0


def test_lasting_change_counts_once():
    load = lambda i, values: {"snapshot_id": i, "taken_at": i, "column_name": "age", "n": len(values), "nulls": 0, "n_real": len(values), "unique_count": len(set(values)), "unique_real": len(set(values)), "lo": min(values), "hi": max(values), "q": [sorted(values)[int(p * (len(values) - 1))] for p in (0.1, 0.25, 0.5, 0.75, 0.9)], "mean": sum(values) / len(values), "shapes": [], "cats": [], "counts": []}
    usual = [20.0 + i % 40 for i in range(80)]
    got = cp._history(pd.DataFrame([load(i, usual) for i in range(4)] + [load(i, [40.0] * 80) for i in range(4, 9)]))
    assert got.values.tolist() == [[4, "age"]]
    back = cp._history(pd.DataFrame([load(i, usual) for i in range(4)] + [load(4, [40.0] * 80)] + [load(i, usual) for i in range(5, 9)]))
    assert back.values.tolist() == [[4, "age"]]
    assert cp._history(pd.DataFrame([load(0, usual), load(1, [40.0] * 80)])).empty  # no history yet
