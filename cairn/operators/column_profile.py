"""Problem 3: profile every column of every load, straight from the columnar files.

Method: the footers give, per row group, exact null counts and extrema. Where they settle a column
(no null in the group; one value only, so that minimum and maximum coincide; a group of one load)
they are used. Footers of floats hide NaN and those of texts may be cut, so there the dictionary page is
read alone: a wholly dictionary-coded chunk has no other values, and one entry without nulls settles it.
Only the remaining chunks are decoded (where row groups mix loads that is all of them, as a count per
load needs the rows). Each row group gives (load, column, value, count), which Spark sums, so the shuffle
holds distinct values and no rows.

The history of a file is compared load by load on some tens of numbers per column; formats and
categories of a text column are compared value by value, with one count per distinct text and load.

Defined results: missing means null or NaN here, stand-ins count as values. Repeated stored reports
count each; null reports are no report. Loads whose file is unknown have no earlier loads. A load with
fewer than two earlier loads has no history to depart from, and a file's first two are its first usual. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions.missing import STAND_INS, TEXT_STAND_INS, folded

COLUMNS = ["age", "tenure_months", "monthly_charges", "contract", "support_calls", "churned"]
TEXT = ["contract"]
COUNTS = "snapshot_id long, column_name string, text string, num double, missing boolean, n long"


def _chunks(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path) to (path, row group)."""
    import pyarrow.parquet as pq

    for pdf in files:
        for path in pdf["path"]:
            fs, p = _open(path)
            yield pd.DataFrame([(path, i) for i in range(pq.ParquetFile(p, filesystem=fs).metadata.num_row_groups)], columns=["path", "row_group"])


def _open(path: str):
    """The file system of a path as Spark names files: local ones as encoded URIs, others by their scheme."""
    from urllib.parse import unquote

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[at] & 0x7F) << shift
        shift += 7
        at += 1
        if b[at - 1] < 0x80:
            return out, at


def _header(b: bytes, at: int = 0) -> tuple[dict, int]:
    """A page header in the compact protocol: numbers by field id, inner structures as further maps."""
    out, field = {}, 0
    while b[at]:
        step, kind = b[at] >> 4, b[at] & 15
        at += 1
        if step:
            field += step
        else:
            n, at = _varint(b, at)
            field = (n >> 1) ^ -(n & 1)
        if kind in (1, 2):
            out[field] = kind == 1
        elif kind in (4, 5, 6):
            n, at = _varint(b, at)
            out[field] = (n >> 1) ^ -(n & 1)
        elif kind == 8:  # binary, as in statistics
            n, at = _varint(b, at)
            out[field], at = b[at : at + n], at + n
        elif kind == 12:
            out[field], at = _header(b, at)
        else:
            raise ValueError(f"unexpected kind {kind} in a page header")
    return out, at + 1


def dictionary(source, chunk) -> list | None:
    """The distinct values of a column chunk by its dictionary page alone; None where that page doesn't tell all.

    ``source`` is an open file, ``chunk`` the chunk's metadata. No data page is read.
    """
    import numpy as np
    import pyarrow as pa

    at, kind = chunk.dictionary_page_offset, chunk.physical_type
    plain = {"DOUBLE": "<f8", "FLOAT": "<f4", "INT64": "<i8", "INT32": "<i4"}
    if not chunk.has_dictionary_page or at is None or (kind not in plain and kind != "BYTE_ARRAY"):
        return None
    source.seek(at)
    raw = source.read(chunk.data_page_offset - at)
    h, body = _header(raw)
    if 7 not in h:
        return None
    page = raw[body : body + h[3]]
    if chunk.compression != "UNCOMPRESSED":
        page = pa.decompress(page, decompressed_size=h[2], codec=chunk.compression.lower(), asbytes=True)
    if kind in plain:
        return np.frombuffer(page, plain[kind], count=h[7][1]).tolist()
    out, i = [], 0
    for _ in range(h[7][1]):
        n = int.from_bytes(page[i : i + 4], "little")
        out.append(page[i + 4 : i + 4 + n].decode("utf-8", "replace"))
        i += 4 + n
    return out


def _count_chunk(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    def rows(load, column, values, counts) -> pd.DataFrame:
        t = pa.table({"snapshot_id": load, "value": values, "n": counts})
        v = t["value"]
        text = pa.types.is_string(v.type) or pa.types.is_large_string(v.type)
        lost = pc.is_null(v, nan_is_null=True)
        return pd.DataFrame({
            "snapshot_id": t["snapshot_id"].to_pandas(), "column_name": column,
            "text": v.to_pandas() if text else None, "num": None if text else pc.if_else(lost, None, pc.cast(v, pa.float64(), safe=False)).to_pandas(),
            "missing": lost.to_pandas(), "n": t["n"].to_pandas(),
        })

    for pdf in chunks:
        for path, group in zip(pdf["path"], pdf["row_group"]):
            fs, p = _open(path)
            f = pq.ParquetFile(p, filesystem=fs, read_dictionary=TEXT)
            meta = f.metadata.row_group(group)
            stats = {meta.column(i).path_in_schema: meta.column(i).statistics for i in range(meta.num_columns)}
            where = {meta.column(i).path_in_schema: i for i in range(meta.num_columns)}
            full = lambda c: (s := stats.get(c)) is not None and s.has_null_count and s.null_count == 0
            one = lambda c: full(c) and (s := stats[c]).has_min_max and s.min == s.max and s.min == s.min

            def single(c: str) -> list:
                """The only value of a chunk without nulls, by footer or dictionary; empty where there are more."""
                if not one(c) or (c not in TEXT and not isinstance(stats[c].min, float)):
                    return [stats[c].min] if one(c) else []
                with fs.open_input_file(p) as source:
                    found = dictionary(source, meta.column(where[c])) or []
                return found if len(found) == 1 else []

            loads = None if one("snapshot_id") else f.read_row_group(group, columns=["snapshot_id"])["snapshot_id"]
            for c in COLUMNS:
                s = stats.get(c)
                if loads is None and s is not None and s.has_null_count and s.null_count == meta.num_rows:
                    yield pd.DataFrame([(stats["snapshot_id"].min, c, None, None, True, meta.num_rows)], columns=["snapshot_id", "column_name", "text", "num", "missing", "n"])
                    continue
                if loads is None and (known := single(c)):
                    lost = known[0] != known[0]
                    yield pd.DataFrame([(stats["snapshot_id"].min, c, known[0] if c in TEXT else None, None if c in TEXT or lost else float(known[0]), lost, meta.num_rows)], columns=["snapshot_id", "column_name", "text", "num", "missing", "n"])
                    continue
                values = f.read_row_group(group, columns=[c])[c]
                load = loads if loads is not None else pa.chunked_array([pa.array([stats["snapshot_id"].min] * meta.num_rows)])
                g = pa.table({"s": load, "v": values}).group_by(["s", "v"]).aggregate([([], "count_all")])
                v = g["v"]
                yield rows(g["s"], c, v.cast(v.type.value_type) if pa.types.is_dictionary(v.type) else v, g["count_all"])


def value_counts(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id, column_name, text, num, missing, n): how often each value occurs in each load."""
    # names are taken by the tasks (a scan without columns), so the driver holds no list of files
    names = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path")).distinct()
    chunks = names.mapInPandas(_chunks, "path string, row_group int")
    chunks = chunks.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "row_group")
    part = chunks.mapInPandas(_count_chunk, COUNTS)
    return part.groupBy("snapshot_id", "column_name", "text", "num", "missing").agg(F.sum("n").alias("n"))


def profile(counts: DataFrame) -> DataFrame:
    """One row per load and column: n, nulls, unique_count, range, quantiles of the real values; format, category and count of each real text."""
    stand = F.lit(False)
    for c, vs in STAND_INS.items():
        stand = stand | ((F.col("column_name") == c) & F.col("num").isin([float(x) for x in vs]))
    stand = F.coalesce(stand, F.lit(False)) | F.coalesce(F.lower(F.trim("text")).isin(TEXT_STAND_INS), F.lit(False))
    n = F.col("n")
    real = ~F.col("missing") & ~F.col("stand")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    x = counts.withColumn("stand", stand).withColumn("x", F.when(real, F.col("num")))
    texts = F.collect_list(F.when(real & F.col("text").isNotNull(), F.struct(shape.alias("shape"), folded(F.col("text")).alias("cat"), n.alias("n"))))
    p = x.groupBy("snapshot_id", "column_name").agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("nulls"),
        F.sum(F.when(real, n).otherwise(0)).alias("n_real"), F.sum(F.when(~F.col("missing"), 1).otherwise(0)).alias("unique_count"),
        F.sum(F.when(real, 1).otherwise(0)).alias("unique_real"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.expr("percentile(x, array(0.1, 0.25, 0.5, 0.75, 0.9), n)").alias("q"), (F.sum(F.col("x") * n) / F.sum(F.when(F.col("x").isNotNull(), n))).alias("mean"),
        texts.alias("texts"),
    )
    part = lambda key: F.transform("texts", lambda t: t[key])
    return p.withColumns({"shapes": part("shape"), "cats": part("cat"), "counts": part("n")}).drop("texts")


def whole_rows(churn: DataFrame) -> DataFrame:
    """(snapshot_id, n, duplicates): rows minus distinct rows over the customer and the six columns, NaN equal to null."""
    key = ["snapshot_id", "customer_id", *COLUMNS]
    c = churn.select(*[F.when(~F.isnan(k), F.col(k)).alias(k) if t == "double" else F.col(k) for k, t in churn.select(key).dtypes])
    return c.groupBy(key).count().groupBy("snapshot_id").agg(F.sum("count").alias("n"), (F.sum("count") - F.count("*")).alias("duplicates"))


def _departs(name: str, now: dict, base: list[dict], still: bool = False) -> bool:
    """Whether a load's numbers lie far beyond those of the loads in ``base`` (oldest first); ``still``: without growth of tenure."""
    import numpy as np

    n = max(now["n"], 1)

    def jump(k: float, total: float, ks: list[float], totals: list[float], least: float, z: float) -> bool:
        p0 = min((sum(ks) + 0.5) / (sum(totals) + 1), 1.0)
        p = k / max(total, 1)
        spread = max(np.std([a / max(b, 1) for a, b in zip(ks, totals)]), 1e-9)
        se = np.sqrt(p0 * (1 - p0) * (1 / max(total, 1) + 1 / max(sum(totals), 1)))
        return abs(p - p0) > max(least, 3 * spread) and abs(p - p0) > z * se

    if name == "*":
        return jump(now["duplicates"], n, [b["duplicates"] for b in base], [b["n"] for b in base], 0.065, 4)
    if jump(now["nulls"], n, [b["nulls"] for b in base], [b["n"] for b in base], 0.12, 4):
        return True
    m = max(now["n_real"], 1)
    if now["n_real"] < 20:
        return False
    if name in TEXT:
        for key, least in (("shapes", 0.15), ("cats", 0.25)):
            a = np.array(now[key], float) / m
            hist = np.array([b[key] for b in base], float)
            tot = hist.sum(1, keepdims=True).clip(1)
            b0 = hist.sum(0) / tot.sum()
            usual = (np.abs(hist / tot - b0).sum(1) / 2).max()
            noise = np.sqrt(b0 * (1 - b0)).sum() * np.sqrt(1 / m + 1 / tot.sum())  # 2.5 times the mean by chance
            if np.abs(a - b0).sum() / 2 > max(least, 1.8 * usual, noise):
                return True
        return False
    usual_unique = np.median([b["unique_real"] for b in base])
    if now["unique_real"] < 0.35 * usual_unique * min(1.0, m / max(np.median([b["n_real"] for b in base]), 1)) and usual_unique > 4:
        return True
    flag = all(0 <= v <= 1 for b in [now, *base] for v in (b["lo"], b["hi"]) if v is not None)
    if flag and usual_unique <= 2 and now["unique_real"] <= 2:  # its share
        return jump((now["mean"] or 0) * m, m, [(b["mean"] or 0) * b["n_real"] for b in base], [b["n_real"] for b in base], 0.15, 4.5)
    if name == "tenure_months" and not still:  # a month more at each load
        drift = lambda b: now["pos"] - b["pos"]
    else:
        drift = lambda b: 0
    q = np.array(now["q"], float)
    hist = np.array([np.array(b["q"], float) + drift(b) for b in base])
    mid = np.median(hist, axis=0)
    scale = max(mid[3] - mid[1], 0.25 * (mid[4] - mid[0]), 1e-9, 1.0 if name in ("support_calls",) else 0)
    off = np.abs(q - mid) / scale
    usual = np.abs(hist - mid).max(axis=0) / scale
    noise = 5.0 / np.sqrt(m)
    limit = np.maximum(np.array([0.9, 0.55, 0.5, 0.75, 1.2]), 2.0 * usual) + noise * np.array([0.4, 0.2, 0.2, 0.4, 0.6])
    if (off > limit).any():
        return True
    los, his = [b["lo"] for b in base], [b["hi"] for b in base]
    wide = max(his) - min(los)
    top = max(his) + (max(drift(b) for b in base) if base else 0)
    return wide > 0 and (now["hi"] > top + 4 * wide or now["lo"] < min(los) - 4 * wide)


def _aligned(loads: list[dict]) -> None:
    """Formats and categories of a text column as counts over one list of values for all loads, each value by itself."""
    import numpy as np

    for key in ("shapes", "cats"):
        place = {v: i for i, v in enumerate(dict.fromkeys(v for r in loads for v in r[key]))}
        for r in loads:
            counts = np.zeros(len(place))
            np.add.at(counts, [place[v] for v in r[key]], r["counts"])
            r[key] = counts


def _history(pdf: pd.DataFrame) -> pd.DataFrame:
    """Breaks of one file. A lasting change of a column is reported once and becomes the new usual."""
    by: dict[str, list[dict]] = {}
    for r in sorted(pdf.to_dict("records"), key=lambda r: (r["taken_at"], r["snapshot_id"])):
        by.setdefault(r["column_name"], []).append(r)
    out = []
    for name, loads in by.items():
        if name in TEXT:
            _aligned(loads)
        usual: list[dict] = []
        odd: list[dict] = []
        for pos, now in enumerate(loads):
            now["pos"] = pos
            if pos < 2:
                usual.append(now)
            elif not _departs(name, now, usual):
                usual.append(now)
                odd = []
            elif odd and not (_departs(name, now, odd) and _departs(name, now, odd, still=True)):
                odd.append(now)  # the change lasts
            else:
                out.append((now["snapshot_id"], name))
                odd = [now]
    return pd.DataFrame(out, columns=["snapshot_id", "column_name"])


def breaks(profiles: DataFrame, duplicates: DataFrame, loads: DataFrame) -> DataFrame:
    """(snapshot_id, column_name) of loads that depart from the earlier loads of their file."""
    at = loads.select("snapshot_id", "file_hash", "taken_at").dropDuplicates(["snapshot_id"])
    stars = duplicates.withColumn("column_name", F.lit("*"))
    both = profiles.unionByName(stars, allowMissingColumns=True).join(at, "snapshot_id")
    return both.groupBy("file_hash").applyInPandas(_history, "snapshot_id long, column_name string")


def misreports(profiles: DataFrame, duplicates: DataFrame, loads: DataFrame, stored: DataFrame) -> DataFrame:
    """(snapshot_id, column_name) whose stored figures differ from the rows."""
    p = profiles.select("snapshot_id", "column_name", "n", "nulls", "unique_count")
    s = stored.select("snapshot_id", "column_name", "missing_pct", F.col("unique_count").alias("_u")).where(F.col("column_name").isin(COLUMNS))
    wrong_pct = F.abs(F.col("missing_pct") - 100.0 * F.col("nulls") / F.col("n")) > 0.02
    cols = p.join(s, ["snapshot_id", "column_name"]).where(F.coalesce(wrong_pct, F.lit(False)) | F.coalesce(F.col("_u") != F.col("unique_count"), F.lit(False)))
    total = p.groupBy("snapshot_id").agg(F.sum("nulls").alias("_missing"))
    rows = loads.select("snapshot_id", "missing", F.col("duplicates").alias("_stored")).join(total, "snapshot_id").join(duplicates, "snapshot_id")
    rows = rows.where(F.coalesce(F.col("missing") != F.col("_missing"), F.lit(False)) | F.coalesce(F.col("_stored") != F.col("duplicates"), F.lit(False)))
    return cols.select("snapshot_id", "column_name").union(rows.select("snapshot_id", F.lit("*"))).distinct()


def findings(spark: SparkSession, path: str, loads: DataFrame, stored: DataFrame) -> DataFrame:
    """(snapshot_id, column_name, finding): every break and every misreport, the counts made once."""
    from cairn.session import cut

    prof = cut(profile(value_counts(spark, path)))  # as many rows as loads and columns
    dup = cut(whole_rows(spark.read.parquet(path)))
    b = breaks(prof, dup, loads).withColumn("finding", F.lit("break"))
    return b.union(misreports(prof, dup, loads, stored).withColumn("finding", F.lit("misreport")))
