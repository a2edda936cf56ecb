"""Corpus operators that need more than one expression: fingerprints, cosine pairs, diversity, coherence, cleaning.

Pairs come from shared bands or rare terms and are verified exactly; equal texts are one row of either
side. Null texts are left out of pairs and score as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cairn.operators.text import sentences, words
from cairn.session import cut


def simhash(tokens: Column) -> Column:
    """A 64-bit fingerprint: the majority of the bits of the tokens' hashes. JVM-side, one fold over the tokens."""
    zero = F.array_repeat(F.lit(0), 64)
    bits = F.sequence(F.lit(0), F.lit(63))
    vote = F.aggregate(tokens, zero, lambda acc, t: F.zip_with(acc, bits, lambda a, i: a + F.when(F.call_function("getbit", F.xxhash64(t), i) == 1, 1).otherwise(-1)))
    return F.aggregate(F.zip_with(vote, bits, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def simhash_pairs(df: DataFrame, key: str, name: str, distance: int = 3) -> DataFrame:
    """(id_a, id_b, distance) of different word sequences whose fingerprints differ in at most ``distance`` bits.

    Texts of one word sequence are one row, named by the first. Fingerprints are paired once each: with
    distance + 1 bands at least one is equal, so only equal bands meet. Every sequence of either
    fingerprint takes part in a pair, and sequences that share a fingerprint are pairs of distance 0.
    """
    w = df.where(F.col(name).isNotNull()).select(F.col(key).alias("id"), words(F.col(name)).alias("w")).where(F.size("w") > 0)
    seq = cut(w.groupBy("w").agg(F.min("id").alias("id")).select("id", simhash(F.col("w")).alias("h")))
    n = distance + 1
    step = 64 // n
    band = lambda i: F.call_function("shiftrightunsigned", F.col("h"), F.lit(i * step)).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
    x = seq.select("h").distinct().select("h", F.posexplode(F.array(*[band(i) for i in range(n)])).alias("b", "v"))
    a, b = x.select("b", "v", F.col("h").alias("ha")), x.select("b", "v", F.col("h").alias("hb"))
    d = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    near = a.join(b, ["b", "v"]).where((F.col("ha") < F.col("hb")) & (d <= distance)).select("ha", "hb", d.alias("distance")).distinct()
    ia, ib = seq.select(F.col("id").alias("ia"), F.col("h").alias("ha")), seq.select(F.col("id").alias("ib"), F.col("h").alias("hb"))
    apart = near.join(ia, "ha").join(ib, "hb").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "distance")
    same = ia.join(ib, F.col("ha") == F.col("hb")).where("ia < ib").select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"), F.lit(0).alias("distance"))
    return apart.union(same)


def cosine_pairs(df: DataFrame, key: str, name: str, limit: float = 0.85, size: int = 8192) -> DataFrame:
    """(id_a, id_b, cosine) of different texts by word tf-idf (smooth idf, unit length), at least ``limit``.

    Exact, and no candidates are shuffled: texts lie in blocks of at most ``size``, by their most frequent
    word, and every two blocks are read together. Of two blocks only their common words count, and only
    texts with enough of their weight in them. Products of the blocks' weightiest words and of the norms of
    the rest are no less than the cosine; pairs over the limit by that are computed from whole vectors. The
    words of two and more texts are broadcast.
    """
    w = df.where(F.col(name).isNotNull()).select(F.col(key).alias("id"), words(F.col(name)).alias("w")).where(F.size("w") > 0)
    reps = cut(w.groupBy("w").agg(F.min("id").alias("id")))
    n = reps.count()
    known = reps.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1").toArrow().combine_chunks()
    if not known.num_rows:
        return reps.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0.0).alias("cosine")).limit(0)
    told = df.sparkSession.sparkContext.broadcast((known["t"].combine_chunks(), known["f"].to_numpy()))
    kind = reps.schema["id"].dataType.simpleString()
    vec = cut(reps.select("id", "w").mapInArrow(lambda b: _vectors(b, told.value, n), f"id {kind}, norm double, top int, t array<int>, c array<int>"))
    per = vec.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("t")).alias("p"))
    parts = F.greatest(F.ceil(F.sum("n") / size), F.ceil(F.sum("p") / (size * 128))).cast("int").alias("parts")
    own = per.orderBy(F.desc("n"), "top").limit(256).where(F.col("n") >= size // 4).select("top")
    plan = [r.parts for r in per.join(own, "top", "left_anti").agg(parts).collect()] + [(r.top, r.parts) for r in per.join(own, "top").groupBy("top").agg(parts).orderBy("top").collect()]
    rest, first, rows = max(plan[0] or 1, 1), 0, []
    first = rest
    for top, k in plan[1:]:
        rows.append((top, first, k))
        first += k
    at = df.sparkSession.createDataFrame(rows, "top int, first int, parts int")
    place = F.coalesce("first", F.lit(0)) + F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(rest))).cast("int")
    blocks = cut(vec.join(F.broadcast(at), "top", "left").groupBy(place.alias("block")).agg(F.collect_list(F.struct("id", "norm", "t", "c")).alias("d")))
    two = blocks.select(F.col("block").alias("i"), F.col("d").alias("a")).crossJoin(blocks.select(F.col("block").alias("j"), F.col("d").alias("b"))).where("i <= j")
    got = cut(two.mapInArrow(lambda b: _block_pairs(b, told.value[1], n, limit), f"a {kind}, b {kind}, cosine double"), {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"})
    return got.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "cosine")


def _vectors(batches: Iterator[pa.RecordBatch], told: tuple[pa.Array, np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """(id, norm, top, t, c): the known words of each text and their counts, the norm of all its words, its most frequent word; texts without known words are left out."""
    terms, f = told
    for batch in batches:
        ids, ws = batch.column("id"), batch.column("w")
        at = ws.offsets.to_numpy().astype(np.int64)
        enc = ws.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        t_of = pc.fill_null(pc.index_in(enc.dictionary, value_set=terms), -1).to_numpy(zero_copy_only=False)
        many = len(t_of)
        cell, c = np.unique(np.repeat(np.arange(len(ids)), np.diff(at)) * many + enc.indices.to_numpy(), return_counts=True)
        row, t = cell // many, t_of[cell % many].astype(np.int64)
        x = c * (np.log((1 + n) / (1 + np.where(t < 0, 1, f[t]))) + 1)
        norm = np.sqrt(np.bincount(row, x * x, len(ids)))
        row, t, c = row[t >= 0], t[t >= 0], c[t >= 0]
        has, begin, length = np.unique(row, return_index=True, return_counts=True)
        if not len(has):
            continue
        top = np.maximum.reduceat(f[t] * len(f) + t, begin) % len(f)
        ptr = pa.array(np.append(0, np.cumsum(length)), pa.int32())
        lists = [pa.ListArray.from_arrays(ptr, pa.array(v.astype(np.int32))) for v in (t, c)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(has)), pa.array(norm[has]), pa.array(top.astype(np.int32)), *lists], ["id", "norm", "top", "t", "c"])


def _block_pairs(batches: Iterator[pa.RecordBatch], f: np.ndarray, n: int, limit: float, dims: int = 512, rest: int = 32, step: int = 1024) -> Iterator[pa.RecordBatch]:
    """(a, b, cosine) of the texts of two blocks, each pair of one block once."""
    idf, words_ = np.log((1 + n) / (1 + f)) + 1, len(f)

    def unpack(d: pa.StructArray):
        ids, norm, t, c = d.flatten()
        at = t.offsets.to_numpy().astype(np.int64)
        t, c = t.values.to_numpy()[at[0] : at[-1]], c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()]
        row = np.repeat(np.arange(len(ids)), np.diff(at))
        return ids, at - at[0], row, t, c * idf[t] / norm.to_numpy()[row]

    def dense(row: np.ndarray, t: np.ndarray, x: np.ndarray, use: np.ndarray, col: np.ndarray):
        """The texts with enough weight in the words that count, their weights by dimension."""
        m = use[t]
        row, t, x = row[m], t[m], x[m]
        enough = np.nonzero(np.bincount(row, x * x, row[-1] + 1 if len(row) else 0) >= limit * limit - 1e-9)[0]
        if not len(enough):
            return enough, None
        new = np.full(row[-1] + 1, -1)
        new[enough] = np.arange(len(enough))
        m = new[row] >= 0
        row, at, t, x = new[row[m]], col[t[m]], t[m], x[m]
        out = np.zeros((len(enough), dims + rest), np.float32)
        m = at >= 0
        out[row[m], at[m]] = x[m]
        out[:, dims:] = np.sqrt(np.bincount(row[~m] * rest + t[~m] % rest, x[~m] * x[~m], len(enough) * rest)).reshape(-1, rest)
        return enough, out

    for batch in batches:
        for r in range(batch.num_rows):
            same = batch.column("i")[r] == batch.column("j")[r]
            ia, pa_, ra, ta, xa = a = unpack(batch.column("a")[r].values)
            ib, pb, rb, tb, xb = a if same else unpack(batch.column("b")[r].values)
            both = np.minimum(np.bincount(ta, xa * xa, words_), np.bincount(tb, xb * xb, words_))
            use, col = both > 0, np.full(words_, -1)
            best = np.argpartition(-both, min(dims, words_) - 1)[:dims]
            col[best] = np.arange(len(best))
            na, da = dense(ra, ta, xa, use, col)
            nb, db = (na, da) if same else dense(rb, tb, xb, use, col)
            if not len(na) or not len(nb):
                continue
            whole, found = np.zeros(words_), []
            for s in range(0, len(na), step):
                i, j = np.nonzero(da[s : s + step] @ db.T >= limit - 1e-4)  # single precision
                i, j = na[i + s], nb[j]
                if same:
                    i, j = i[i < j], j[i < j]
                for k, begin, count in zip(*np.unique(i, return_index=True, return_counts=True)):
                    js = j[begin : begin + count]
                    mine = slice(pa_[k], pa_[k + 1])
                    whole[ta[mine]] = xa[mine]
                    length = pb[js + 1] - pb[js]
                    ends = np.cumsum(length)
                    flat = np.repeat(pb[js] - ends + length, length) + np.arange(ends[-1])
                    cos = np.add.reduceat(whole[tb[flat]] * xb[flat], ends - length)
                    whole[ta[mine]] = 0.0
                    hit = cos >= limit
                    found.append((np.full(hit.sum(), k), js[hit], cos[hit]))
            if found:
                k, js, cos = (np.concatenate(v) for v in zip(*found))
                yield pa.RecordBatch.from_arrays([ia.take(pa.array(k)), ib.take(pa.array(js)), pa.array(cos)], ["a", "b", "cosine"])


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0))


def coherence(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, mean_similarity, jumps, n_pairs): Jaccard of neighbouring sentences, and pairs without a common word."""
    s = F.transform(sentences(F.col(name)), words)
    x = cut(df.select(key, s.alias("s"))).where(F.size("s") > 1)
    j = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), jaccard)
    y = x.select(key, F.filter(j, lambda v: v.isNotNull()).alias("j")).where(F.size("j") > 0)
    return y.select(key, (F.aggregate("j", F.lit(0.0), lambda a, v: a + v) / F.size("j")).alias("mean_similarity"), F.size(F.filter("j", lambda v: v == 0)).alias("jumps"), F.size("j").alias("n_pairs"))


def _mtld(ws: list[str], limit: float = 0.72) -> float:
    factors, seen, n = 0.0, set(), 0
    for w in ws:
        n += 1
        seen.add(w)
        if len(seen) / n <= limit:
            factors, seen, n = factors + 1, set(), 0
    if n:
        factors += (1 - len(seen) / n) / (1 - limit)
    return len(ws) / factors if factors else float(len(ws))


@F.pandas_udf(T.DoubleType())
def mtld(texts: pd.Series) -> pd.Series:
    """Lexical diversity: the mean length of word runs that keep a type-token ratio over .72, forwards and backwards."""

    def one(t):
        ws = re.findall(r"[^\W_]+", (t or "").lower())
        return (_mtld(ws) + _mtld(ws[::-1])) / 2 if ws else 0.0

    return texts.map(one)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("f1", T.DoubleType())])))
def sentence_repeats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sentence pairs of one text whose longest common subsequence of words has F1 of .75 and more, but not 1.

    Only pairs that share enough words are compared: the number of common words bounds the subsequence.
    """

    def lcs(a: list[str], b: list[str]) -> int:
        prev = [0] * (len(b) + 1)
        for x in a:
            cur = [0]
            for j, y in enumerate(b, 1):
                cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[-1]))
            prev = cur
        return prev[-1]

    def one(t):
        ss = [w for s in re.split(r"[.!?]+(?:\s+|$)", t or "") if (w := re.findall(r"[^\W_]+", s.lower()))]
        index: dict[str, list[int]] = {}
        out = []
        for i, s in enumerate(ss):
            common: dict[int, int] = {}
            for w in set(s):
                for j in index.get(w, ()):
                    common[j] = common.get(j, 0) + 1
                index.setdefault(w, []).append(i)
            for j, c in sorted(common.items()):
                if 2 * c < 0.75 * (len(set(s)) + len(set(ss[j]))) * 0.8 or ss[j] == s:
                    continue
                f = 2 * lcs(ss[j], s) / (len(s) + len(ss[j]))
                if 0.75 <= f < 1:
                    out.append({"a": j, "b": i, "f1": f})
        return out

    for b in batches:
        yield b.map(one)


def encoding_signals(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, has_bom, nul_count, replacement_count, zero_width, control_count)."""
    c = F.coalesce(F.col(name), F.lit(""))
    n = lambda rx: F.regexp_count(c, F.lit(rx))
    return df.select(key, c.startswith("﻿").alias("has_bom"), n(r"\x00").alias("nul_count"), n("�").alias("replacement_count"), n("[​‌‍⁠﻿]").alias("zero_width"), n(r"[\x01-\x08\x0b\x0c\x0e-\x1f]").alias("control_count"))


def tidy(c: Column) -> Column:
    """Control characters dropped, line-end hyphens joined, quotes straightened, blanks and blank lines collapsed."""
    for rx, to in ((r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"([a-z])-\n([a-z])", "$1$2"), ("[“”„]", '"'), ("[‘’‚]", "'"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, rx, to)
    return F.trim(c)


def quality(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, score, verdict): length, diversity, symbols and repetition; nearly empty texts score at most 20."""
    ws = words(F.col(name))
    c = F.coalesce(F.col(name), F.lit(""))
    x = df.select(key, F.size(ws).alias("n"), (F.size(F.array_distinct(ws)) / F.greatest(F.size(ws), F.lit(1))).alias("ttr"), (F.regexp_count(c, F.lit(r"[#*<>{}|\\^~\[\]]")) / F.greatest(F.length(c), F.lit(1))).alias("noise"), F.length(F.trim(c)).alias("len"))
    s = 40 * F.least(F.col("n") / 50, F.lit(1.0)) + 30 * F.least(F.col("ttr") / 0.5, F.lit(1.0)) + 30 * F.greatest(1 - 10 * F.col("noise"), F.lit(0.0))
    s = F.round(F.when(F.col("len") < 10, F.least(s, F.lit(20.0))).otherwise(s), 4)
    return x.select(key, s.alias("score")).withColumn("verdict", F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 55, "fair").when(F.col("score") >= 35, "poor").otherwise("unusable"))
