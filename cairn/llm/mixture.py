"""Problem 9: mixing sources to target weights.

Method: subset-sum budget fitting. Documents are counted by source and exact token length; each source
gets a budget of tokens, whole passes over the source take most of it, a proportional part of every
length most of the rest, and a bounded-knapsack dynamic programme over the remaining counts fits what is
then left. No sum can exceed the budget rounded down to the lengths' common divisor; where the programme
reaches that, the fit is the best there is. Where it doesn't, the proportional part is halved, and at last
left out, so that the programme covers all choices: the result is always the best reachable sum.
Documents are selected by length count, in the order of a seeded hash.

The driver sees counts per source and length only. To take the first n documents of a length by hash, the
hashes are first counted in buckets of some BUCKET documents, so that only the one bucket on the border is
ranked: no window holds more than that, even if one source or one length holds most rows.

The total is the largest for which every source that has documents can give its share (shares of sources
without documents are spread over the others in proportion), unless a smaller one is asked for.

Defined results: sources are compared trimmed, in lower case, with underscores for hyphens and blanks;
null or untargeted sources are not taken. Texts without tokens are never taken. Equal texts are documents
of their own. A target without documents reports an actual share of zero.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.session import cut
from cairn.llm.tokens import TOKENIZERS, token_counts

#: Documents of one length that are ranked together.
BUCKET = 4096


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def fit(counts: dict[int, int], budget: int, repeats: int) -> tuple[int, dict[int, int]]:
    """(passes, extra): how often every document is taken, and how many documents of each length once more.

    The tokens taken are at most ``budget`` and as near to it as any choice of documents gets, after as many
    whole passes as fit.
    """
    total = sum(n * c for n, c in counts.items())
    if not total or budget <= 0:
        return 0, {}
    passes = min(budget // total, repeats)
    if passes == repeats:
        return repeats, {}
    left = budget - passes * total
    step = math.gcd(*counts)
    goal = left // step * step
    best: dict[int, int] = {}
    reached, part = -1, left  # ``part``: tokens taken in proportion, before the programme
    while reached < goal:
        take = {n: min(c, int(c * part // total)) for n, c in counts.items()}
        room = left - sum(n * t for n, t in take.items())
        for n, k in _knapsack({n: counts[n] - take[n] for n in counts if counts[n] > take[n] and n <= room}, room).items():
            take[n] += k
        got = sum(n * t for n, t in take.items())
        if got > reached:
            reached, best = got, take
        if not part:
            break
        part = part // 2 if part > step else 0
    return passes, {n: t for n, t in best.items() if t}


def _knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length give the greatest sum of at most ``budget``.

    Counts are split into powers of two; the reachable sums are the bits of one integer, and the first
    part that reaches a sum is kept to trace the choice back.
    """
    mask, bits = (1 << (budget + 1)) - 1, 1
    parts: list[tuple[int, int]] = []
    first = np.full(budget + 1, -1, dtype=np.int32)
    for n in sorted(counts, reverse=True):
        rest, k = min(counts[n], budget // n), 1
        while rest > 0 and not bits >> budget & 1:
            k = min(k, rest)
            new = (bits << n * k) & mask & ~bits
            if new:
                raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), dtype=np.uint8)
                first[np.nonzero(np.unpackbits(raw, bitorder="little")[: budget + 1])[0]] = len(parts)
                parts.append((n, k))
                bits |= new
            rest -= k
            k *= 2
    at, out = bits.bit_length() - 1, {}
    while at > 0:
        n, k = parts[first[at]]
        out[n] = out.get(n, 0) + k
        at -= n * k
    return out


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(selection, report). selection: doc_id, source, n_tokens, copies. report: one row per target."""
    spark = documents.sparkSession
    sized = token_counts(documents.where(F.col("source").isNotNull()), "source", folder=folder).withColumn("source", source_name(F.col("source")))
    want = targets.select(source_name(F.col("source")).alias("source"), "target_share", F.col("max_repeats").alias("max_repeats"))
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in want.collect()}
    sized = sized.where(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0))
    sized = cut(sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    per = sized.groupBy("source", "n_tokens").agg(F.count("*").alias("docs"))
    counts: dict[str, dict[int, int]] = {}
    for r in per.collect():  # as many rows as sources and different lengths
        counts.setdefault(r["source"], {})[int(r["n_tokens"])] = int(r["docs"])
    have = {s: sum(n * c for n, c in counts.get(s, {}).items()) for s in wanted}
    share_sum = sum(w for s, (w, _) in wanted.items() if have[s])
    able = [have[s] * m / (w / share_sum) for s, (w, m) in wanted.items() if have[s] and w > 0]
    total = int(min(able)) if total is None and able else int(total or 0)
    plan, chosen = [], {}
    for s, (w, m) in sorted(wanted.items()):
        budget = min(int(round(total * w / share_sum)), have[s] * m) if have[s] else 0
        passes, extra = fit(counts.get(s, {}), budget, m)
        chosen[s] = passes * have[s] + sum(n * k for n, k in extra.items())
        plan += [(s, n, passes, extra.get(n, 0), c // BUCKET + 1) for n, c in counts.get(s, {}).items()]
    plan_df = spark.createDataFrame(plan, "source string, n_tokens long, passes int, extra long, buckets long")
    sized = sized.join(F.broadcast(plan_df.select("source", "n_tokens", "buckets")), ["source", "n_tokens"]).withColumn("bucket", F.pmod("h", "buckets")).drop("buckets")
    # whole buckets below the border are taken, the bucket on the border is ranked
    grouped = sized.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source", "n_tokens").orderBy("bucket")
    below = F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = grouped.withColumn("below", below).join(plan_df, ["source", "n_tokens"])
    border = border.select("source", "n_tokens", "bucket", "passes", F.greatest(F.least(F.col("extra") - F.col("below"), F.col("c")), F.lit(0)).alias("room"), "c")
    joined = sized.join(border, ["source", "n_tokens", "bucket"])
    sure = joined.where((F.col("room") == 0) | (F.col("room") == F.col("c"))).withColumn("copies", F.col("passes") + F.when(F.col("room") == F.col("c"), 1).otherwise(0))
    ranked = joined.where((F.col("room") > 0) & (F.col("room") < F.col("c"))).withColumn("r", F.row_number().over(Window.partitionBy("source", "n_tokens", "bucket").orderBy("h", "doc_id")))
    ranked = ranked.withColumn("copies", F.col("passes") + F.when(F.col("r") <= F.col("room"), 1).otherwise(0))
    cols = ["doc_id", "source", "n_tokens", "copies"]
    selection = sure.select(cols).union(ranked.select(cols)).where("copies > 0").withColumn("copies", F.col("copies").cast("int"))
    taken = sum(chosen.values()) or 1
    report = [(s, w, w / share_sum if have[s] and share_sum else 0.0, m, have[s], chosen[s], chosen[s] / taken) for s, (w, m) in sorted(wanted.items())]
    report_df = spark.createDataFrame(report, "source string, target_share double, reachable_share double, max_repeats int, tokens_available long, tokens_taken long, actual_share double")
    return selection, report_df

