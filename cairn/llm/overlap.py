"""Problem 2: same or nearly same images across splits.

Method: an edit-distance segment join over the hexadecimal fingerprints. Training strings are indexed by
their substrings; an evaluation string is cut into k + 1 segments, of which at most k edits leave one
whole, so a pair within k edits shares a segment at one of the positions the other segments' edits allow
(i - 1 edits before the i-th, k + 1 - i after it, and half of k as both strings have one length).
Candidates are verified by Spark's banded ``levenshtein`` and by bit distances.

Hot segments (flat images give runs of one digit) are split: there are at most 4 x (k + 1) x 16^4 different
segments, whatever the data, so their counts are broadcast, and a segment of many training strings is
spread over as many salts as it holds blocks of BLOCK strings; evaluation strings visit each.

Copies are collapsed first: the join runs over distinct fingerprints, so a group of copies, however large,
is one row on either side; only the last step expands classes to the asked pairs. The remaining
candidates still grow with the square of distinct fingerprints, as segments of few digits are few.

Defined results: fingerprints and file hashes are compared in lower case, blank ones count as unknown.
Two images match if their file hashes are equal, or if at least two known fingerprints lie within
``bits`` bits, at most one known fingerprint lies further, and one of them within ``k`` hexadecimal
digits. A lone agreeing fingerprint is no match. Images without a split are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PRINTS = ["phash", "dhash", "ahash", "whash"]
LENGTH = 16
#: Training strings of one segment that one task joins at a time.
BLOCK = 20_000


def split_name(c: Column) -> Column:
    """train, val, test or null of any spelling of a split."""
    s = F.lower(F.trim(c))
    return F.when(s.startswith("train"), "train").when(s.startswith("val") | (s == "dev"), "val").when(s.startswith("test"), "test")


def _known(name: str, length: int) -> Column:
    c = F.lower(F.trim(F.col(name)))
    return F.when(c.rlike(f"^[0-9a-f]{{{length}}}$"), c)


def _number(c: Column) -> Column:
    """The 64 bits of a fingerprint as one long; null for null."""
    half = lambda at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def _text(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), LENGTH, "0")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def segments(parts: int) -> list[tuple[int, int]]:
    """(first digit, digits) of each segment; the longer ones lie inside, where more positions are allowed."""
    size, extra = divmod(LENGTH, parts)
    inner = sorted(range(parts), key=lambda i: (abs(i - (parts - 1) / 2), i))[:extra]
    out, at = [], 0
    for i in range(parts):
        n = size + (i in inner)
        out.append((at, n))
        at += n
    return out


def places(k: int, i: int, at: int, n: int) -> range:
    """Where the i-th segment (from 0) of a string may begin in another of the same length, at most k edits away."""
    reach = min(i, k - i, k // 2)
    return range(max(0, at - reach), min(LENGTH - n, at + reach) + 1)


def _piece(c: Column, kind: Column, slot: int, at: int, n: int) -> Column:
    """Kind, slot and digits of a substring in one long."""
    digits = F.shiftrightunsigned(c, 4 * (LENGTH - at - n)).bitwiseAND(F.lit((1 << 4 * n) - 1).cast("long"))
    return F.shiftleft(kind.cast("long"), 56).bitwiseOR(F.lit(slot << 40).cast("long")).bitwiseOR(digits)


def close_prints(prints: DataFrame, k: int, bits: int, block: int = BLOCK) -> DataFrame:
    """(kind, print_t, print_e): training and evaluation fingerprints of one kind within k digits and ``bits`` bits.

    ``prints`` has side (t, e), kind and print, each row once.
    """
    cuts = list(enumerate(segments(k + 1)))
    p, kind = F.col("print"), F.col("kind")
    at_e = F.array(*[_piece(p, kind, i, at, n) for i, (at, n) in cuts])
    at_t = F.array_distinct(F.array(*[_piece(p, kind, i, x, n) for i, (at, n) in cuts for x in places(k, i, at, n)]))
    t = prints.where("side = 't'").select(F.explode(at_t).alias("key"), p.alias("print_t"))
    e = prints.where("side = 'e'").select(F.explode(at_e).alias("key"), p.alias("print_e"))
    hot = t.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("salts"))
    hot = F.broadcast(hot)  # at most as many rows as there are different segments
    one = F.coalesce("salts", F.lit(1))
    t = t.join(hot, "key", "left").select("key", F.pmod(F.xxhash64("print_t"), one).cast("int").alias("salt"), "print_t")
    e = e.join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0), one - 1)).alias("salt"), "print_e")
    near = t.join(e, ["key", "salt"]).where(_distance(F.col("print_t"), F.col("print_e")) <= bits)
    near = near.select(F.shiftrightunsigned("key", 56).cast("int").alias("kind"), "print_t", "print_e").distinct()
    return near.where(F.levenshtein(_text(F.col("print_t")), _text(F.col("print_e")), k) >= 0)


def cross_split_pairs(images: DataFrame, k: int = 5, bits: int = 10) -> DataFrame:
    """(image_id_a, image_id_b): one in train, the other in val or test, both the same picture."""
    side = split_name(F.col("split"))
    if not 3 <= k < LENGTH:
        raise ValueError("k + 1 segments of at most four digits are needed")
    rows = images.select(
        "image_id", F.when(side == "train", "t").when(side.isNotNull(), "e").alias("side"),
        _known("sha256", 64).alias("sha"), *[_number(_known(p, LENGTH)).alias(p) for p in PRINTS],
    ).where(F.col("side").isNotNull())
    tuple_ = ["sha", *PRINTS]
    rows = rows.withColumn("cls", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in tuple_])))
    classes = rows.groupBy("side", "cls").agg(*[F.first(c).alias(c) for c in tuple_])

    def of(s: str, *cols: str) -> DataFrame:
        return classes.where(F.col("side") == s).select(F.col("cls").alias(f"cls_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols])

    same_file = of("t", "sha").join(of("e", "sha"), F.col("sha_t") == F.col("sha_e")).select("cls_t", "cls_e")

    prints = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(p).alias("print")) for n, p in enumerate(PRINTS)]))
    by_print = classes.select("side", "cls", prints.alias("x")).where(F.col("x.print").isNotNull()).select("side", "cls", "x.*")
    close = close_prints(by_print.select("side", "kind", "print").distinct(), k, bits)
    end = lambda s: by_print.where(F.col("side") == s).select("kind", F.col("print").alias(f"print_{s}"), F.col("cls").alias(f"cls_{s}"))
    cand = close.join(end("t"), ["kind", "print_t"]).join(end("e"), ["kind", "print_e"]).select("cls_t", "cls_e").distinct()

    both = cand.join(of("t", *PRINTS), "cls_t").join(of("e", *PRINTS), "cls_e")
    dist = [_distance(F.col(f"{p}_t"), F.col(f"{p}_e")) for p in PRINTS]
    known = sum(d.isNotNull().cast("int") for d in dist)
    near = sum(F.coalesce(d <= bits, F.lit(False)).cast("int") for d in dist)
    near_copy = both.where((near >= 2) & (known - near <= 1)).select("cls_t", "cls_e")

    pairs = same_file.union(near_copy).distinct()
    ids = lambda s: rows.where(F.col("side") == s).select(F.col("cls").alias(f"cls_{s}"), F.col("image_id").alias(f"id_{s}"))
    out = pairs.join(ids("t"), "cls_t").join(ids("e"), "cls_e")
    return out.select(F.least("id_t", "id_e").alias("image_id_a"), F.greatest("id_t", "id_e").alias("image_id_b"))


def overlap_report(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per evaluation split and source archive: images, those also in train, and pairs with equal pixel counts."""
    img = images.select("image_id", split_name(F.col("split")).alias("split"), F.coalesce("source_archive", F.lit("unknown")).alias("source_archive"), "total_pixels")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("image_id_a").alias("image_id"), F.col("image_id_b").alias("other")), F.struct(F.col("image_id_b").alias("image_id"), F.col("image_id_a").alias("other")))).alias("x")).select("x.*")
    other = img.select(F.col("image_id").alias("other"), F.col("total_pixels").alias("_px"))
    links = ends.join(other, "other").join(img, "image_id").where(F.col("split") != "train")
    per = links.groupBy("image_id").agg(F.count("*").alias("links"), F.sum((F.col("total_pixels") == F.col("_px")).cast("int")).alias("same"))
    return (
        img.where(F.col("split") != "train").join(per, "image_id", "left").groupBy("split", "source_archive")
        .agg(F.count("*").alias("images"), F.count("links").alias("overlapping"), F.coalesce(F.sum("links"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("same"), F.lit(0)).alias("pairs_same_pixels"))
        .withColumn("overlap_share", F.round(F.col("overlapping") / F.col("images"), 6))
    )
