"""Problem 4: visually identical text with different characters.

Method: the text is exploded to positioned code points, broadcast-joined with decomposition and
look-alike mappings, its combining marks are ordered by class, then recomposed and the string rebuilt.

Plan: texts are first hash-partitioned by their id, as compact rows; explode, broadcast joins and the
rebuilding aggregations keep that partitioning, so nothing else is shuffled. Long texts are cut into
segments before a character that starts a cluster, which bounds what one aggregation buffer holds. Runs
of plain ASCII need no mapping and travel as one positioned piece. Both mapping tables are built by rule
from the Unicode database (a constant size, some thousand rows), so broadcasting them is safe.

Two forms are built. The skeleton, by which texts are compared, writes every look-alike as the Latin letter:
it is equal for texts that read the same and for no others (digits, accents, capitals and words that differ
to the eye differ). The readable form keeps scripts: a word with a letter that only Greek, Cyrillic or
Armenian has is written in that script, its Latin look-alikes included; a word of letters that both scripts
have takes the script that a fifth of its text shows beyond doubt, else Latin. Which letters are a script's own can be
seen, so texts that read the same get the same readable form, but for letters a script itself has twice.

Defined results: null texts have a null form, blank texts an empty one and never form a pair. Characters
without a visible form are dropped, any single white space but the line break becomes a space. Identical
strings are no pair.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.session import cut

SEGMENT = 300

# Letters and signs of other scripts that look like Latin or ASCII ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ѵ": "v", "ѡ": "w", "ҽ": "e",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ӏ": "I", "Ү": "Y", "Ғ": "F", "Ԍ": "G", "Ѵ": "V",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "σ": "o", "ϲ": "c", "ϳ": "j", "ε": "e", "η": "n", "τ": "t", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Ϝ": "F",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ȷ": "j", "ʋ": "v", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ſ": "f", "ǃ": "!", "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Լ": "L",
    "‐": "-", "‑": "-", "−": "-", "⁃": "-", "˗": "-", "‒": "–", "ʼ": "’", "ʹ": "'", "ˈ": "'", "‚": ",", "٫": ",", "։": ":", "∶": ":", "꞉": ":", "ː": ":", "⁄": "/", "∕": "/", "․": ".", "∗": "*", "∣": "|", "ǀ": "|", "㏄": "cc", "﹘": "–", "﹣": "-",
}
# Further characters without a visible form, besides those of category Cf.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(chr(c) for c in range(0xFE00, 0xFE10))
# Decompositions by how they are tagged in the Unicode database: these keep what is seen.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>"}


# Cyrillic letters of few languages, which in a word of shared letters are disguised Latin ones.
SELDOM = "ѕјԁԛԝһӏѵѡҽЅЈԚԜҺӀҮҒԌѴ"
#: Scripts whose words keep their letters in the readable form: a name the regular expressions know, and the code points.
SCRIPTS = {"Cyrillic": (0x400, 0x530), "Greek": (0x370, 0x400), "Armenian": (0x530, 0x590)}


def _in(c: str, script: str) -> bool:
    return script != "" and SCRIPTS[script][0] <= ord(c) < SCRIPTS[script][1]


@lru_cache(maxsize=8)
def _inverse(script: str) -> dict[str, str]:
    """Latin letter to the script's look-alike, the first of the list; letters few languages have aren't put in place of Latin ones."""
    out: dict[str, str] = {}
    for c, to in LOOKALIKES.items():
        if _in(c, script) and len(to) == 1 and c not in SELDOM:
            out.setdefault(to, c)
    return out


def _map_one(c: str, script: str = "") -> str:
    """What a code point stands for in a word of the script: decomposed, its look-alikes replaced, unseen ones dropped."""
    cat = unicodedata.category(c)
    if c in UNSEEN or (cat == "Cf"):
        return ""
    if c in "  \x85":
        return "\n"
    if cat == "Zs" or c in "\t\x0b\x0c":
        return " "
    if script and c in _inverse(script):
        return _inverse(script)[c]
    if c in LOOKALIKES and not _in(c, script):
        return LOOKALIKES[c]
    d = unicodedata.decomposition(c)
    if not d:
        return c
    parts = d.split()
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK or any(unicodedata.category(chr(int(p, 16))) == "Zs" for p in parts[1:]):
            return c
        parts = parts[1:]
    if len(parts) > 1 and 0xAC00 <= ord(c) <= 0xD7A3:
        return c  # Hangul syllables are one shape
    return "".join(_map_one(chr(int(p, 16)), script) for p in parts)


@lru_cache(maxsize=8)
def mapping_rows(script: str = "") -> list[tuple[str, str]]:
    """(code point, replacement) of every code point that changes. Fewer than ten thousand rows, whatever the data."""
    return [(c, m) for c in map(chr, range(0x41 if script else 0x80, sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and (m := _map_one(c, script)) != c]


def _pieces() -> tuple[Column, Column]:
    """(pieces of ``_seg``, script of a piece ``cp``) for the readable form; ``_f`` is the text's script, if not Latin."""
    word = r"[\p{L}\p{M}\p{Cf}]"
    own = {s: rf"[\p{{Is{s}}}&&\p{{L}}&&[^{''.join(c for c in LOOKALIKES if _in(c, s))}]]" for s in SCRIPTS}
    any_own = "(?:" + "|".join(own.values()) + ")"
    foreign = rf"{word}*?{any_own}{word}*+"
    plain = rf"(?:[\x00-\x08\x0a\x0e-\x40\x5b-\x60\x7b-\x7f]|[A-Za-z]++(?!{word}))+"
    split = lambda rx: F.regexp_extract_all("_seg", F.lit(f"(?s){rx}"), F.lit(0))
    cells, script = None, None
    for s, rx in own.items():
        both = rf"[\p{{M}}\p{{Cf}}{''.join(_inverse(s))}{''.join(_inverse(s).values())}]+"
        shared = rf"(?<!{word}){both}(?!{word})"
        mine = split(rf"{foreign}|{shared}|[A-Za-z]++(?!{word})|[\x00-\x08\x0a\x0e-\x40\x5b-\x60\x7b-\x7f]+|{word}+|.")
        cells = F.when(F.col("_f") == s, mine) if cells is None else cells.when(F.col("_f") == s, mine)
        hit = F.col("cp").rlike(rx)
        script = F.when(hit, s) if script is None else script.when(hit, s)
    for s in own:
        script = script.when((F.col("_f") == s) & F.col("cp").rlike(rf"^[\p{{M}}\p{{Cf}}{''.join(_inverse(s))}{''.join(_inverse(s).values())}]+$"), s)
    return cells.otherwise(split(rf"{foreign}|{plain}|.")), script.otherwise("")


def _text_script(text: Column) -> Column:
    """The script of a fifth of a text's characters, by letters that only it has; empty for Latin."""
    out = None
    for s in SCRIPTS:
        own = F.regexp_count(text, F.lit(rf"[\p{{Is{s}}}&&\p{{L}}&&[^{''.join(c for c in LOOKALIKES if _in(c, s))}]]"))
        hit = own * 5 >= F.length(text)
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out.otherwise("")


@lru_cache(maxsize=1)
def composition_rows() -> list[tuple[str, str]]:
    """(decomposed cluster, composed character) of every primary composite of the Unicode database."""
    out = {}
    for c in map(chr, range(0xC0, 0x3100)):
        d = unicodedata.normalize("NFD", c)
        if d != c and unicodedata.normalize("NFC", d) == c:
            out["".join(LOOKALIKES.get(x, x) for x in d)] = c
            out.setdefault(d, c)
    # a look-alike base composes like the letter it looks like
    return sorted({k: unicodedata.normalize("NFC", k) if unicodedata.normalize("NFC", k) != k else v for k, v in out.items()}.items())


def _tables(spark: SparkSession, scripts: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    marks = [(chr(c), k) for c in range(0x300, 0x1E95B) if (k := unicodedata.combining(chr(c)))]
    return (
        spark.createDataFrame([(s, *r) for s in scripts for r in mapping_rows(s)], "script string, cp string, to string"),
        spark.createDataFrame(composition_rows(), "cluster string, composed string"),
        spark.createDataFrame(marks, "piece string, ccc int"),
    )


def canonical(df: DataFrame, key: str, text: str, readable: bool = True) -> DataFrame:
    """(key, canonical) of every row: the readable form, or the skeleton. ``key`` must be unique."""
    spark = df.sparkSession
    mapping, composed, marks = _tables(spark, ["", *SCRIPTS] if readable else [""])
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).repartition(F.col("_k"))
    src = src.withColumn("_f", _text_script(F.col("_t")) if readable else F.lit(""))
    # segments begin at a character that no mark can belong to
    segs = F.expr(rf"regexp_extract_all(_t, '(?s).{{1,{SEGMENT}}}(?:[^ \\n]{{0,200}}(?=[ \\n])|(?!\\p{{M}})|$)', 0)")
    seg = src.where(F.length("_t") > 0).select("_k", "_f", F.posexplode(segs).alias("_s", "_seg"))
    if readable:
        parts, script = _pieces()
        el = seg.select("_k", "_f", "_s", F.posexplode(parts).alias("_w", "cp")).withColumn("script", script)
        chars = F.when((F.col("script") == "") & F.col("cp").rlike(r"^[\x00-\x7f]+$"), F.array("cp")).otherwise(F.regexp_extract_all("cp", F.lit("(?s)."), F.lit(0)))
        el = el.select("_k", "_s", "_w", "script", F.posexplode(chars).alias("_o", "cp")).withColumn("_p", F.shiftleft(F.col("_w").cast("long"), 32).bitwiseOR(F.col("_o").cast("long")))
    else:
        parts = F.expr(r"regexp_extract_all(_seg, '(?s)[\\x00-\\x08\\x0a\\x0e-\\x7f]+|.', 0)")  # plain runs stay whole
        el = seg.select("_k", "_s", F.posexplode(parts).alias("_p", "cp")).withColumn("script", F.lit(""))
    el = el.join(F.broadcast(mapping), ["script", "cp"], "left").withColumn("x", F.coalesce("to", "cp")).where(F.length("x") > 0)
    # mapped strings may hold a base and its marks: once more to single code points
    plain = F.col("x").rlike(r"^[\x00-\x7f]+$")
    el = el.select("_k", "_s", "_p", F.posexplode(F.when(plain, F.array("x")).otherwise(F.expr("regexp_extract_all(x, '(?s).', 0)"))).alias("_q", "piece"))
    el = el.join(F.broadcast(marks), "piece", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    # a run of marks belongs to the element before it: the run's number is that of its base
    per = el.groupBy("_k", "_s").agg(F.sort_array(F.collect_list(F.struct("_p", "_q", "piece", "ccc"))).alias("a"))
    # clusters in one fold: a base opens a cluster, marks join it
    clusters = F.expr(
        """aggregate(a, cast(array() as array<struct<b:string,m:array<struct<ccc:int,p:int,piece:string>>>>),
           (acc, x) -> CASE WHEN x.ccc > 0 AND size(acc) > 0
             THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('b', element_at(acc, -1).b, 'm', concat(element_at(acc, -1).m, array(named_struct('ccc', x.ccc, 'p', size(element_at(acc, -1).m), 'piece', x.piece))))))
             ELSE concat(acc, array(named_struct('b', x.piece, 'm', cast(array() as array<struct<ccc:int,p:int,piece:string>>)))) END)"""
    )
    marked = F.exists("a", lambda x: x["ccc"] > 0)
    easy = per.where(~marked).select("_k", "_s", F.concat_ws("", F.transform("a", lambda x: x["piece"])).alias("seg"))
    hard = per.where(marked).select("_k", "_s", F.posexplode(clusters).alias("_c", "c"))
    last = F.expr("right(c.b, 1)")
    body = F.expr("left(c.b, length(c.b) - 1)")
    ordered = F.concat_ws("", F.transform(F.sort_array("c.m"), lambda m: m["piece"]))
    hard = hard.withColumn("cluster", F.when(F.size("c.m") > 0, F.concat(last, ordered)))
    hard = hard.join(F.broadcast(composed), "cluster", "left")
    out = F.when(F.size("c.m") > 0, F.concat(body, F.coalesce("composed", "cluster"))).otherwise(F.col("c.b"))
    hard = hard.groupBy("_k", "_s").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("_c", out.alias("o")))), lambda x: x["o"])).alias("seg"))
    whole = easy.union(hard).groupBy("_k").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("_s", "seg"))), lambda x: x["seg"])).alias("canonical"))
    blank = df.where(F.col(text).isNull() | (F.length(text) == 0)).select(F.col(key), F.col(text).alias("canonical"))
    return whole.select(F.col("_k").alias(key), F.trim("canonical").alias("canonical")).union(blank)


def _looks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, raw, form): digests of string and skeleton of every text that shows anything, written once."""
    raw = df.select(F.col(key).alias("k"), F.md5(F.col(text)).alias("raw")).where(F.col("raw").isNotNull())
    form = canonical(df, key, text, readable=False).where(F.length(F.regexp_replace("canonical", r"\s", "")) > 0).select(F.col(key).alias("k"), F.md5("canonical").alias("form"))
    return cut(raw.join(form, "k").select("k", "raw", "form"))


def equal_looking_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, strings, links): every text that another string looks like; copies are not expanded.

    ``class_id`` is the class's smallest key, ``strings`` its number of different strings, ``links`` how many
    rows read the same with another string.
    """
    rows = _looks(df, key, text)
    copies = rows.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least"))
    forms = copies.groupBy("form").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("strings"), F.min("least").alias("class_id")).where("strings > 1")
    per = copies.join(forms, "form").select("raw", "class_id", "strings", (F.col("total") - F.col("n")).alias("links"))
    return rows.join(per, "raw").select(F.col("k").alias(key), "class_id", "strings", "links")


def equal_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), the smaller first: both read the same, the stored strings differ.

    Texts are compared by 128-bit digests of form and string. Identical strings are grouped before the
    join, so that copies meet only where the asked pairs need them.
    """
    rows = _looks(df, key, text)
    classes = rows.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"))
    a, b = classes.select("form", F.col("raw").alias("raw_a")), classes.select("form", F.col("raw").alias("raw_b"))
    pairs = a.join(b, "form").where(F.col("raw_a") < F.col("raw_b")).select("raw_a", "raw_b")
    ids = lambda x: rows.select(F.col("raw").alias(f"raw_{x}"), F.col("k").alias(x))
    out = pairs.join(ids("a"), "raw_a").join(ids("b"), "raw_b")
    return out.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))
