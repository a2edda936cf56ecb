"""Text statistics, duplicates and rule-based personal data of a corpus, as column expressions.

Whole texts are used. Null texts count as empty. Words are runs of letters, digits and apostrophes.
Pairs are made from equal digests or bands, never from all rows, and copies are grouped first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.session import cut

WORD = r"[\p{L}\p{N}']+"
# Everyday English words for sentiment and hedging.
POSITIVE = ["good", "great", "excellent", "clean", "stable", "improved", "correct", "better", "best", "useful", "valid", "ready", "success", "clear", "strong", "right", "safe", "fair", "steady", "easy"]
NEGATIVE = ["bad", "wrong", "poor", "missing", "failed", "fails", "error", "broken", "worse", "worst", "gap", "gaps", "drift", "leakage", "disputed", "rejected", "misleading", "false", "constant", "duplicates"]
HEDGES = ["may", "might", "could", "perhaps", "possibly", "seems", "appears", "about", "usually", "almost"]


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), 1)


def sentences(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[.!?]+(?:\s+|$)"), lambda s: s.rlike(r"[^ \t\r\n]"))


def basic_stats(df: DataFrame, key: str, name: str) -> DataFrame:
    """Characters, words, sentences, paragraphs, vocabulary and ratios of each text. No shuffle."""
    c = F.coalesce(F.col(name), F.lit(""))
    x = df.select(key, c.alias("t"), words(F.col(name)).alias("w"), F.size(sentences(F.col(name))).alias("n_sentences"))
    n, nw = F.length("t"), F.size("w")
    count = lambda rx: F.regexp_count(F.col("t"), F.lit(rx))
    return x.select(
        key, n.alias("n_chars"), nw.alias("n_words"), "n_sentences", F.size(F.array_distinct("w")).alias("n_unique"),
        (F.size(F.array_distinct("w")) / F.nullif(nw, F.lit(0))).alias("type_token"), (F.aggregate("w", F.lit(0), lambda a, y: a + F.length(y)) / F.nullif(nw, F.lit(0))).alias("word_length"),
        (count(r"[0-9]") / F.nullif(n, F.lit(0))).alias("digit_ratio"), (count(r"[A-Z]") / F.nullif(n, F.lit(0))).alias("upper_ratio"), (count(r"[ \t\r\n]") / F.nullif(n, F.lit(0))).alias("space_ratio"), count(r"[?]").alias("questions"), count(r"[!]").alias("exclamations"),
    )


def syllables(w: Column) -> Column:
    g = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(g - F.when(w.endswith("e") & (g > 1), 1).otherwise(0), F.lit(1))


def readability(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, flesch, grade_level, fog): from words, sentences and syllables."""
    x = df.select(key, F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z]+)"), 1).alias("w"), F.greatest(F.size(sentences(F.col(name))), F.lit(1)).alias("s"))
    x = x.where(F.size("w") > 0).select(key, "s", F.size("w").alias("n"), F.aggregate("w", F.lit(0), lambda a, v: a + syllables(v).cast("int")).alias("y"), F.size(F.filter("w", lambda v: syllables(v) >= 3)).alias("c"))
    ws, sw = F.col("n") / F.col("s"), F.col("y") / F.col("n")
    return x.select(key, (206.835 - 1.015 * ws - 84.6 * sw).alias("flesch"), (0.39 * ws + 11.8 * sw - 15.59).alias("grade_level"), (0.4 * (ws + 100 * F.col("c") / F.col("n"))).alias("fog"))


def script(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, script): the script most letters belong to, ties by name."""
    ranges = {"arabic": r"[\x{0600}-\x{06FF}]", "cyrillic": r"[\x{0400}-\x{04FF}]", "han": r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]", "hangul": r"[\x{AC00}-\x{D7AF}]", "latin": r"[A-Za-z\x{00C0}-\x{024F}]"}
    c = F.coalesce(F.col(name), F.lit(""))
    best = F.array_max(F.array(*[F.struct(F.regexp_count(c, F.lit(rx)).alias("n"), F.lit(k).alias("k")) for k, rx in ranges.items()]))
    return df.select(key, best.alias("b")).select(key, F.when(F.col("b.n") > 0, F.col("b.k")).otherwise("none").alias("script"))


def lexicon_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, positive, negative, hedges, compound)."""
    x = df.select(key, words(F.col(name)).alias("w"))
    n = lambda ws: F.size(F.filter("w", lambda v: v.isin(ws)))
    p, q = n(POSITIVE), n(NEGATIVE)
    return x.select(key, p.alias("positive"), q.alias("negative"), n(HEDGES).alias("hedges"), F.coalesce((p - q) / F.nullif(p + q, F.lit(0)), F.lit(0.0)).alias("compound"))


def keywords(df: DataFrame, name: str, k: int = 50, length: int = 3) -> DataFrame:
    """(word, n, docs): the most frequent words of the corpus, ties by word; counts are combined before the shuffle."""
    w = df.select(F.explode(words(F.col(name))).alias("word"), F.monotonically_increasing_id().alias("_i")).where(F.length("word") >= length)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def collocations(df: DataFrame, name: str, least: int = 20, k: int = 50) -> DataFrame:
    """(a, b, n, pmi): neighbouring words that go together more than by chance."""
    x = df.select(words(F.col(name)).alias("w"))
    uni = x.select(F.explode("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    t = uni.agg(F.sum("c").alias("t"))
    bi = x.where(F.size("w") > 1).select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p")).select("p.*").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    j = bi.join(uni.select(F.col("w").alias("a"), F.col("c").alias("ca")), "a").join(uni.select(F.col("w").alias("b"), F.col("c").alias("cb")), "b").crossJoin(F.broadcast(t))
    return j.select("a", "b", "n", F.log2(F.col("n") * F.col("t") / (F.col("ca") * F.col("cb"))).alias("pmi")).orderBy(F.desc("pmi"), F.desc("n"), "a", "b").limit(k)


def entities(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, emails, urls, dates, percents, money): how many of each a text holds."""
    c = F.coalesce(F.col(name), F.lit(""))
    n = lambda rx: F.regexp_count(c, F.lit(rx))
    return df.select(key, n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"), n(r"https?://[^ \n]+").alias("urls"), n(r"[0-9]{4}-[0-9]{2}-[0-9]{2}").alias("dates"), n(r"[0-9]+(?:[.,][0-9]+)? ?%").alias("percents"), n(r"[$€£] ?[0-9]+").alias("money"))


def noise_ratios(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, html, control, special, runs): tags, control characters, symbols, repeated punctuation."""
    c = F.coalesce(F.col(name), F.lit(""))
    n = lambda rx: F.regexp_count(c, F.lit(rx))
    size = F.nullif(F.length(c), F.lit(0))
    return df.select(key, n(r"<[a-zA-Z/][^<>]*>").alias("html"), (n(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") / size).alias("control"), (n(r"[#*<>{}|\\^~\[\]]") / size).alias("special"), n(r"[!?.,]{3,}").alias("runs"))


def char_entropy(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, entropy, n_distinct): bits per character, within the row."""
    t = F.coalesce(F.col(name), F.lit(""))
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    x = df.select(key, chars.alias("c")).select(key, "c", F.array_distinct("c").alias("d"), F.size("c").alias("n"))
    p = lambda ch: (F.col("n") - F.size(F.array_remove(F.col("c"), ch))) / F.col("n")
    h = F.aggregate("d", F.lit(0.0), lambda a, ch: a - p(ch) * F.log2(p(ch)))
    return x.select(key, F.when(F.col("n") > 0, h).otherwise(0.0).alias("entropy"), F.size("d").alias("n_distinct"))


def empty_content(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, is_empty): under ten characters, under three different words, or mostly white space."""
    t = F.coalesce(F.col(name), F.lit(""))
    few = F.size(F.array_distinct(words(F.col(name)))) < 3
    space = F.regexp_count(t, F.lit(r"[ \t\r\n]")) / F.greatest(F.length(t), F.lit(1)) > 0.5
    return df.select(key, ((F.length(F.trim(t)) < 10) | few | space).alias("is_empty"))


def clean_estimate(c: Column) -> Column:
    """Tags dropped, addresses of pages replaced, white space collapsed."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[a-zA-Z/][^<>]*>", " ")
    s = F.regexp_replace(s, r"https?://[^ \n]+", "[URL]")
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def line_stats(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, n_lines, blank_lines, minutes): lines, blank ones, reading time at two hundred words a minute."""
    lines = F.split(F.coalesce(name, F.lit("")), "\n")
    return df.select(key, F.size(lines).alias("n_lines"), F.size(F.filter(lines, lambda s: ~s.rlike(r"[^ \t\r]"))).alias("blank_lines"), (F.size(words(F.col(name))) / 200).alias("minutes"))


def exact_duplicates(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, first_id): each later copy with the first document of the same trimmed text. Copies are grouped, not paired."""
    h = F.sha2(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""), 256)
    x = df.where(F.col(name).isNotNull()).select(key, h.alias("h"))
    first = x.groupBy("h").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return x.join(first, "h").where(F.col(key) > F.col("first_id")).select(key, "first_id")


def shingle_classes(df: DataFrame, key: str, name: str, size: int = 5, limit: float = 0.8) -> DataFrame:
    """(id_a, id_b, jaccard): pairs of different texts whose word shingles overlap by at least ``limit``.

    Exact: with the shingles ordered from rare to frequent, two sets with that overlap share one of the
    first (1 - limit) part, so only these prefixes are joined. The first document stands for its copies.
    """
    from cairn.session import cut

    norm = F.array_join(words(F.col(name)), " ")
    reps = df.select(key, norm.alias("t")).where("t <> ''").groupBy("t").agg(F.min(key).alias("id"))
    # words and shingles are written once each: every later step reads them as columns
    reps = cut(reps.select("id", F.split("t", " ").alias("w")))
    gram = lambda i: F.xxhash64(F.array_join(F.slice("w", i, size), " "))
    x = cut(reps.select("id", F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))), gram)).alias("s")))
    df_ = x.select(F.explode("s").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    items = x.select("id", F.size("s").alias("n"), F.explode("s").alias("g")).join(df_.where("f > 1"), "g")
    r = F.row_number().over(Window.partitionBy("id").orderBy("f", "g"))
    single = x.select("id", F.size("s").alias("n"), F.explode("s").alias("g")).join(df_.where("f = 1"), "g").groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    pre = items.withColumn("r", r).join(single, "id", "left").withColumn("r", F.col("r") + F.coalesce("u", F.lit(0))).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * limit) + 1)
    a, b = pre.select("g", F.col("id").alias("id_a"), F.col("n").alias("na"), F.col("r").alias("ra")), pre.select("g", F.col("id").alias("id_b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    # sizes must agree, and what is left behind the shared shingle must suffice for the overlap
    need = F.ceil((F.col("na") + F.col("nb")) * (limit / (1 + limit)) - 1e-9)
    room = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + 1
    cand = a.join(b, "g").where((F.col("id_a") < F.col("id_b")) & (F.least("na", "nb") >= limit * F.greatest("na", "nb")) & (room >= need)).groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("c")).select("id_a", "id_b")
    c = cand.join(x.select(F.col("id").alias("id_a"), F.col("s").alias("sa")), "id_a").join(x.select(F.col("id").alias("id_b"), F.col("s").alias("sb")), "id_b")
    both = F.size(F.array_intersect("sa", "sb"))
    j = both / (F.size("sa") + F.size("sb") - both)
    return c.select("id_a", "id_b", j.alias("jaccard")).where(F.col("jaccard") >= limit)


def nearest_vectors(df: DataFrame, key: str, name: str, k: int = 5, step: int = 50) -> DataFrame:
    """(query_id, neighbour_id, cosine, rank): every row whose id is divisible by ``step`` against all rows.

    The query set is joined in blocks: both sides carry a block number, so a task holds a block of queries
    and a part of the rows; the k best of each part are kept before the ranks are merged.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x = df.where(F.col(name).isNotNull()).select(F.col(key).alias("id"), F.col(name).alias("v")).withColumn("nrm", F.sqrt(dot(F.col("v"), F.col("v")))).where("nrm > 0")
    blocks = 4
    q = x.where(F.col("id") % step == 0).select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("nrm").alias("qn"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"))
    rows = x.withColumn("b", F.explode(F.array(*[F.lit(i).cast("long") for i in range(blocks)]))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    c = rows.join(q, "b").where("id <> query_id").select("query_id", F.col("id").alias("neighbour_id"), "part", (dot(F.col("v"), F.col("qv")) / (F.col("nrm") * F.col("qn"))).alias("cosine"))
    best = lambda *p: F.row_number().over(Window.partitionBy(*p).orderBy(F.desc("cosine"), "neighbour_id"))
    local = c.withColumn("r", best("query_id", "part")).where(F.col("r") <= k).drop("r")
    return local.withColumn("rank", best("query_id")).where(F.col("rank") <= k).select("query_id", "neighbour_id", "cosine", "rank")


def rule_pii(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, emails, ips, cards, score): simple patterns; card numbers pass the check digit."""
    c = F.coalesce(F.col(name), F.lit(""))
    mails = F.regexp_count(c, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))
    ips = F.regexp_count(c, F.lit(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"))
    cards = F.size(F.filter(F.regexp_extract_all(c, F.lit(r"\b([0-9](?:[ -]?[0-9]){12,18})\b"), 1), lambda n: F.call_function("luhn_check", F.regexp_replace(n, "[ -]", ""))))
    return df.select(key, mails.alias("emails"), ips.alias("ips"), cards.alias("cards"), F.greatest(100 - 15 * (mails + ips) - 25 * cards, F.lit(0)).alias("score"))


def containment(df: DataFrame, key: str, name: str, other: DataFrame, other_key: str, other_name: str, size: int = 8, block: int = 1 << 18) -> DataFrame:
    """(key, other_key, shared, share): word n-grams of ``other`` (evaluation passages) found in the corpus.

    Digests alone are shuffled to find the n-grams of both sides; of these each text keeps its list. Blocks
    of some ``block`` n-grams of either side are read two by two, so the pairs themselves, which grow with
    the square of a common passage's texts, are never shuffled.
    """
    split = lambda d, k, c: d.select(F.col(k).alias("k"), words(F.col(c)).alias("w")).where(F.size("w") >= size)
    da, db = split(df, key, name), split(other, other_key, other_name)
    digests = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, size), " "))))
    grams = lambda d: d.select("k", F.explode(digests).alias("g"))  # noqa: E731; a filter on a named list would split the text anew for each n-gram
    shared = cut(grams(da).select("g").distinct().join(grams(db).select("g").distinct(), "g"))
    if shared.count() <= 1 << 22:
        shared = F.broadcast(shared)
    total = grams(db).groupBy("k").agg(F.count(F.lit(1)).alias("t"))

    def blocks(d: DataFrame, s: str) -> DataFrame:
        """The n-grams of both sides by text, texts by block."""
        kept = grams(d).join(shared, "g", "left_semi").groupBy("k").agg(F.collect_list("g").alias("gs"))
        kept = cut(kept.withColumn("t", F.lit(0).cast("long")) if s == "a" else kept.join(total, "k"))
        many = (kept.agg(F.sum(F.size("gs")).alias("n")).first().n or 0) // block + 1
        return cut(kept.groupBy(F.pmod(F.xxhash64("k"), F.lit(many)).alias("at")).agg(F.collect_list(F.struct("k", "t", "gs")).alias(s))).select(s)

    kinds = [d.schema["k"].dataType.simpleString() for d in (da, db)]
    met = blocks(da, "a").crossJoin(blocks(db, "b")).mapInArrow(_shared_grams, f"a {kinds[0]}, b {kinds[1]}, shared long, share double")
    return met.select(F.col("a").alias(key), F.col("b").alias(other_key), "shared", "share")


def _shared_grams(batches: Iterator[pa.RecordBatch], step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(a, b, shared, share) of the texts of two blocks, some ``step`` common n-grams at a time, each text's together."""

    def unpack(d: pa.StructArray):
        k, t, gs = d.flatten()
        at = gs.offsets.to_numpy().astype(np.int64)
        return k, t.to_numpy(), gs.values.to_numpy()[at[0] : at[-1]], np.repeat(np.arange(len(k)), np.diff(at))

    for batch in batches:
        for r in range(batch.num_rows):
            ka, _, ga, ra = unpack(batch.column("a")[r].values)
            kb, tb, gb, rb = unpack(batch.column("b")[r].values)
            order = np.argsort(gb, kind="stable")
            gb, rb = gb[order], rb[order]
            begin = np.searchsorted(gb, ga, "left")
            length = np.searchsorted(gb, ga, "right") - begin
            ra, begin, length = ra[length > 0], begin[length > 0], length[length > 0]
            first = np.nonzero(np.diff(ra, prepend=-1))[0]  # the first n-gram of each text
            hits = np.cumsum(length) - length
            s = 0
            while s < len(ra):
                nxt = first[np.searchsorted(hits[first], hits[s] + step)] if hits[first[-1]] >= hits[s] + step else len(ra)
                ln = length[s:nxt]
                ends = np.cumsum(ln)
                pairs = np.repeat(ra[s:nxt] * len(kb), ln) + rb[np.repeat(begin[s:nxt] - ends + ln, ln) + np.arange(ends[-1])]
                pairs, n = np.unique(pairs, return_counts=True)
                i, j = pairs // len(kb), pairs % len(kb)
                yield pa.RecordBatch.from_arrays([ka.take(pa.array(i)), kb.take(pa.array(j)), pa.array(n.astype(np.int64)), pa.array(n / tb[j])], ["a", "b", "shared", "share"])
                s = nxt
