"""Connected components of pairs, and what is built on them.

Labels travel along edges with pointer jumping, so rounds grow with the logarithm of a component's
diameter; each round is a join and an aggregation, its result written to the shared folder. Hot nodes
are pre-aggregated: a node's smallest neighbour is found with map-side combining. Nothing reaches the
driver but the number of changes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.session import cut


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id of each node's component; self-pairs give components of one.

    Raises if ``rounds`` don't suffice, as unfinished labels would be wrong.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = cut(both.union(both.select("y", "x")).distinct())
    label = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")).select(F.col("x").alias("id"), "l"))
    for _ in range(rounds):
        near = both.join(label.select(F.col("id").alias("y"), F.col("l").alias("yl")), "y").groupBy("x").agg(F.min("yl").alias("m"))
        step = label.join(near, F.col("id") == F.col("x"), "left").select("id", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = step.select(F.col("id").alias("p"), F.col("l").alias("pl"))
        new = cut(step.join(jump, F.col("l") == F.col("p"), "left").select("id", "old", F.least("l", F.coalesce("pl", "l")).alias("l")))
        changed = new.where("old <> l").limit(1).count()
        label = new.select("id", "l")
        if not changed:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return label.select("id", F.col("l").alias("component"))


def row_pairs(test: DataFrame, train: DataFrame, key: str, names: list[str], limit: float = 0.8) -> DataFrame:
    """(test_key, train_key, jaccard): rows of ``test`` and ``train`` whose cells agree in at least ``limit`` by Jaccard.

    Two rows of n cells need m equal cells, so of n - m + 1 groups of columns one agrees as a whole. The
    groups are made alike in distinct values and joined one after the other, each written before the next
    is shuffled; a pair counts at the first group that agrees. Rows travel as codes: columns of few values
    by broadcast dictionaries in the bits of one number, the others as 64 bits each. Rows of equal cells
    are grouped on either side before.
    """
    n = len(names)
    need = next(m for m in range(1, n + 1) if m / (2 * n - m) >= limit)
    both = test.select(*names).unionByName(train.select(*names))
    seen = both.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first().asDict()
    groups: list[list[str]] = [[] for _ in range(n - need + 1)]
    for c in sorted(names, key=lambda c: (-seen[c], c)):
        min(groups, key=lambda g: (sum(math.log2(max(seen[x], 1)) for x in g), len(g))).append(c)
    at, bits, books = {}, 0, {}
    for c in sorted(names, key=lambda c: (seen[c], c)):
        if seen[c] > 60_000:
            break
        book = cut(both.select(c).distinct().select(F.col(c).alias(f"_v_{c}"), (F.row_number().over(Window.orderBy(c)) - 1).cast("long").alias(f"_n_{c}")))
        width = max(book.count() - 1, 1).bit_length()
        if bits + width > 63:
            break
        at[c], books[c], bits = (bits, (1 << width) - 1), book, bits + width
    wide = [c for c in names if c not in books]

    def side(df: DataFrame, s: str) -> DataFrame:
        x = df.select(F.col(key).alias("k"), *names)
        for c, book in books.items():
            x = x.join(F.broadcast(book), F.col(c).eqNullSafe(F.col(f"_v_{c}")))
        packed = sum((F.call_function("shiftleft", F.col(f"_n_{c}"), F.lit(p)) for c, (p, _) in at.items()), F.lit(0).cast("long"))
        code = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63) + 1)) if df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(c)
        return x.select(F.col("k").alias(f"{s}_key"), packed.alias(f"{s}_p"), *[code(c).alias(f"{s}_{c}") for c in wide])

    mask = lambda g: sum(m << p for p, m in (at[c] for c in g if c in at))

    def agree(g: list[str]) -> Column:
        packed = [F.col("a_p").bitwiseXOR(F.col("b_p")).bitwiseAND(F.lit(mask(g)).cast("long")) == 0] * bool(mask(g))
        return reduce(lambda x, y: x & y, packed + [F.col(f"a_{c}") == F.col(f"b_{c}") for c in g if c in wide])

    def first_by(df: DataFrame, s: str, g: list[str]) -> DataFrame:
        """Rows of equal cells once; the group's bits are a column of their own, so one shuffle serves grouping and join."""
        p, m = F.col(f"{s}_p"), F.lit(mask(g)).cast("long")
        x = df.select(f"{s}_key", p.bitwiseAND(m).alias(f"{s}_s"), p.bitwiseAND(F.bitwise_not(m)).alias(f"{s}_r"), *[f"{s}_{c}" for c in wide])
        by = [f"{s}_s"] * bool(mask(g)) + [f"{s}_{c}" for c in g if c in wide]
        return x.repartition(*by).groupBy(*x.columns[1:]).agg(F.min(f"{s}_key").alias(f"{s}_key"))

    te, tr = side(test, "a"), side(train, "b")
    same = sum((agree([c]).cast("int") for c in names), F.lit(0))
    found = None
    for i, g in enumerate(groups):
        x, y = first_by(te, "a", g), first_by(tr, "b", g)
        on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ["s"] * bool(mask(g)) + [c for c in g if c in wide]]
        met = x.join(y, on).withColumns({f"{s}_p": F.col(f"{s}_s").bitwiseOR(F.col(f"{s}_r")) for s in "ab"})
        new = reduce(lambda a, b: a & b, [~agree(h) for h in groups[:i]], F.lit(True))
        hits = cut(met.where(new & (same >= need)).select(F.col("a_key").alias("test_key"), F.col("b_key").alias("train_key"), (same / (2 * n - same)).alias("jaccard")))
        found = hits if found is None else found.union(hits)
    return found.distinct()  # keys may repeat
