"""Problem 5: noise in text from scanned and printed pages.

Method: skip-gram vectors are learned on all pages; rare words are linked to frequent words that they become
by plausible glyph edits (equal stroke skeletons) and that are neighbours of their contexts in the vector
space: a word's fit is how far it lies nearer to the context than words do on average, in deviations. A link
whose mean fit is below FIT is dropped; where several words are left, each page's own context chooses. Then
furniture (returning header and footer lines, page numbers) is removed and the text reflowed.

Plan: pages are cut into keys (words, neighbour pairs, line-end joins, spaced words) by one Arrow pass.
Keys are counted over all data with map-side combining; keys that are noise are found by equi-joins of
the counted keys, and joined back to the pages' distinct keys. The noise side is replicated over a few
salts, so that a word of every page is spread over as many tasks. Furniture is found within a document.
The VOCABULARY most frequent words get vectors, which bounds what the driver holds and what is broadcast; a
frequent word beyond them has no fit, and its link stands by glyphs and counts alone. Contexts are taken
where a rare word stands (a filter of fixed size finds the places), so no page is copied beside its tokens.

Defined results: null page texts and documents without pages have no noise. Repeated documents are
judged each, their words count each. Hard line ends, a title on one page, tables, bullets and item codes
are no noise. Single-page documents have no returning lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cairn.session import cut, parallelism

SALTS = 16
FILTER_BITS = 1 << 25
#: A word is frequent from this count on; a rare word occurs at most once for RATIO times of its neighbour.
FREQUENT, RATIO = 8, 12
#: Words with vectors, and the least mean fit of a link in deviations.
VOCABULARY, FIT = 100_000, -0.5

# Letters by their strokes, as scanners confuse them.
STROKES = {"m": "rrl", "n": "rl", "u": "ll", "h": "ll", "d": "cl", "w": "vv", "e": "c", "f": "t", "0": "o", "5": "s", "i": "l", "1": "l", "|": "l", "!": "l", "j": "l", "8": "b", "9": "g", "q": "g", "ü": "ll", "2": "z", "6": "b"}
_STROKES = str.maketrans(STROKES)
_WORD = re.compile(r"[^\W\d_](?:[\w|’'!]*[^\W_])?|[\d|!][^\W\d_][\w|]*|(?<=\s)[|1!][^\W\d_]+")
_SPACED = re.compile(r"(?<![\w])(?:[^\W\d_] ){3,}[^\W\d_](?![\w])")
_BROKEN = re.compile(r"([^\W\d_]+)([-¬\xad]) *\n([^\W\d_]+)")
_PAIR = re.compile(r"(?<![\w_|])([^\W\d_]{1,14}) ([^\W\d_]{1,14})(?![\w_|])")
_NUMBER = re.compile(r"^\W*(?:(?:page|seite|página|pág\.?|p\.|s\.|blatt|folio|copy)\W*)?(?:\d{1,4}|[ivxlc]{1,7})(?:\s*(?:/|of|von|de|sur)\s*\d{1,4})?\W*$", re.I)
_DECORATED = re.compile(r"^(?:[\[(—–\-~•|]+\s*(?:\d{1,4}|[ivxlc]{1,7})\s*[\])—–\-~•|]+|\d{1,4}\s*/\s*\d{1,4}|(?:page|seite|página|pág\.?|p\.|s\.|blatt|folio)\s*\d{1,4}(?:\s*(?:/|of|von|de|sur)\s*\d{1,4})?)$", re.I)


def strokes(word: str) -> str:
    """The stroke skeleton of a lower-case word: equal for words a scanner may confuse."""
    return word.translate(_STROKES)


def _fold(line: str) -> str:
    """A line as it returns on other pages: case, numbers, spacing and misread strokes left out."""
    s = re.sub(r"(?<![^\W\d_])[\divxlcIVXLC|]+(?![^\W\d_])|(?<=\s)\d\S*|^\d\S*", "", line)
    return strokes(re.sub(r"[^\w|]", "", s).lower())


def furniture(pages: list[str]) -> list[dict]:
    """For each page: the lines that are furniture, whether a page number is among them, and the rest."""
    split = [[x for x in p.split("\n")] for p in pages]
    shown = [[i for i, x in enumerate(ls) if x.strip()] for ls in split]
    edges = []
    seen: Counter = Counter()
    width = max([len(x) for ls in split for x in ls] or [0])

    def title_like(line: str) -> bool:  # wrapped sentences fill the line, or end one
        return len(line) < 0.8 * width and not re.search(r"[.,;:?!]$", line) and not line[:1].islower()

    for ls, idx in zip(split, shown):
        mine = list(dict.fromkeys(idx[:2] + idx[-2:]))
        edges.append(mine)
        seen.update({_fold(ls[i]) for i in mine if len(_fold(ls[i])) >= 4 and title_like(ls[i].strip())})
    # numbers that go up by one from page to page
    offsets: Counter = Counter()
    for k, (ls, mine) in enumerate(zip(split, edges)):
        offsets.update({int(m.group()) - k for i in mine if len(ls[i].strip()) < 60 for m in re.finditer(r"(?<![\w.,\-])\d{1,4}(?![\w,\-]|\.\d)", ls[i])})
    by_length: dict[int, list[str]] = {}
    for g, n in seen.items():
        if n >= 2:
            by_length.setdefault(len(g), []).append(g)

    @lru_cache(maxsize=None)
    def returns(f: str) -> bool:
        """Whether a line, or one nearly like it, stands on several pages."""
        return seen[f] >= 2 or any(g != f and _close(f, g) for n in range(len(f) - 2, len(f) + 3) for g in by_length.get(n, ()))

    out = []
    for k, (ls, mine) in enumerate(zip(split, edges)):
        drop, number = set(), False
        for seq in (mine[:2], mine[-2:][::-1]):
            for i in seq:
                line = ls[i].strip()
                f = _fold(line)
                similar = len(f) >= 4 and title_like(line) and returns(f)
                plain = bool(_NUMBER.match(line)) and not re.search(r"[.,;:%]$", line) and len(line) <= 14
                counted = plain and any(offsets[int(m.group()) - k] >= 2 for m in re.finditer(r"\d{1,4}", line))
                roman = plain and not re.search(r"\d", line) and len(line) <= 8 and line.lower() == line
                is_number = bool(_DECORATED.match(line)) or counted or roman
                if similar or is_number:
                    drop.add(i)
                    number |= is_number
                else:
                    break  # furniture lies outside of the text
        out.append({"lines": [ls[i] for i in sorted(drop)], "noise": bool(drop), "rest": "\n".join(x for i, x in enumerate(ls) if i not in drop).strip("\n")})
    return out


def _close(a: str, b: str) -> bool:
    """At most two edits apart (and eight letters at least)."""
    if min(len(a), len(b)) < 8:
        return False
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        if min(cur) > 2:
            return False
        prev = cur
    return prev[-1] <= 2


def page_keys(text: str) -> set[str]:
    """The keys of a page: w:word, b:left right, h:left-right, s:spaced."""
    keys = set()
    body = text
    for m in _BROKEN.finditer(body):
        keys.add(f"h:{m[1].lower()}-{m[3].lower()}")
    if re.search(r"[^\W\d_][-¬\xad] *['’]?$", body):
        keys.add("e:")
    body = _BROKEN.sub(" \n ", body)
    for m in _SPACED.finditer(body):
        keys.add("s:" + m.group().replace(" ", "").lower())
    body = _SPACED.sub(" \n ", body)
    for m in _WORD.finditer(body):
        before, after = body[m.start() - 1 : m.start()], body[m.end() : m.end() + 1]
        if before != "_" and after != "_" and m.group() and len(m.group()) > 1:
            keys.add("w:" + m.group().lower().strip("'’"))
    at = 0
    while m := _PAIR.search(body, at):
        keys.add(f"b:{m[1].lower()} {m[2].lower()}")
        at = m.start(2)
    return keys


_PAGE = T.ArrayType(T.StructType([
    T.StructField("section_index", T.IntegerType()), T.StructField("furniture", T.BooleanType()),
    T.StructField("rest", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType())),
]))


@F.pandas_udf(_PAGE)
def _cut_pages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(pages) -> list[dict]:
        if pages is None or not len(pages):
            return []
        ps = [p for p in pages if p is not None]
        texts = [p["page_text"] or "" for p in ps]
        return [
            {"section_index": p["section_index"], "furniture": f["noise"], "rest": f["rest"], "keys": sorted(page_keys(f["rest"]))}
            for p, f in zip(ps, furniture(texts))
        ]

    for batch in batches:
        yield batch.map(one)


@F.udf(T.StringType(), useArrow=True)
def _strokes(w: str) -> str:
    return strokes(w) if w is not None else None


def cut_pages(documents: DataFrame) -> DataFrame:
    """(file_id, section_index, furniture, rest, keys) of every page."""
    src = documents.where(F.size("pages") > 0).select("file_id", "pages")
    return src.select("file_id", F.explode(_cut_pages("pages")).alias("p")).select("file_id", "p.*")


def noise_keys(pages: DataFrame, vectors: bool = True, seed: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """(key, fix): keys that are noise and the text that replaces them; and (file_id, section_index, key, page_fix)
    of words whose page chooses another fix.

    Words: a rare word whose strokes equal those of a much more frequent word, which in addition is a
    neighbour of its contexts in the skip-gram space. Pairs, line-end joins and spaced words: their closed form is a
    frequent word (or, for joins, a word at all), and much more frequent than the open form.
    """
    counts = cut(pages.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")))
    kind = lambda k: counts.where(F.col("key").startswith(k + ":")).select(F.expr("substring(key, 3)").alias("text"), "n")
    words = kind("w").withColumn("strokes", _strokes("text"))
    frequent = words.where(F.col("n") >= FREQUENT)
    links = (
        words.alias("r").join(frequent.alias("f"), (F.col("r.strokes") == F.col("f.strokes")) & (F.col("r.text") != F.col("f.text")) & (F.col("r.n") * RATIO <= F.col("f.n")))
        .where(F.length("f.text") >= 3)
        .select(F.col("r.text").alias("rare"), F.col("r.n").alias("rare_n"), F.col("f.text").alias("word"), F.col("f.n").alias("word_n"))
    )
    links = cut(links)
    choice = None
    if vectors and not links.isEmpty():
        placed = cut(in_context(pages, links, seed))
        fits = placed.groupBy("rare", "word", "word_n").agg(F.avg("fit").alias("fit")).where(F.coalesce(F.col("fit") >= FIT, F.lit(True)))
        several = fits.groupBy("rare").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rare")
        own = placed.join(fits.select("rare", "word"), ["rare", "word"]).join(several, "rare")
        choice = own.groupBy("file_id", "section_index", "rare").agg(F.max_by("word", F.struct("fit", "word_n", "word")).alias("page_fix"))
        choice = choice.withColumn("key", F.concat(F.lit("w:"), "rare")).drop("rare")
    else:
        fits = links.withColumn("fit", F.lit(0.0))
    best = fits.groupBy("rare").agg(F.max_by("word", F.struct("fit", "word_n", "word")).alias("fix"))
    misread = best.select(F.concat(F.lit("w:"), "rare").alias("key"), "fix")

    plain = words.select("text", F.col("n").alias("word_n"))
    pair = kind("b").withColumn("joined", F.regexp_replace("text", " ", ""))
    left, right = F.split("text", " ")[0], F.split("text", " ")[1]
    pair = pair.withColumn("left", left).withColumn("right", right)
    pair = pair.join(plain.where(F.col("word_n") >= FREQUENT).select(F.col("text").alias("joined"), F.col("word_n").alias("jn")), "joined")
    pair = pair.where(F.col("n") * RATIO <= F.col("jn"))
    pair = pair.join(plain.select(F.col("text").alias("left"), F.col("word_n").alias("ln")), "left", "left").join(plain.select(F.col("text").alias("right"), F.col("word_n").alias("rn")), "right", "left")
    rare_half = F.least(F.coalesce("ln", F.lit(0)), F.coalesce("rn", F.lit(0)))
    splits = pair.where((rare_half * 4 <= F.col("jn")) | (F.col("n") * 40 <= F.col("jn"))).select(F.concat(F.lit("b:"), "text").alias("key"), F.col("joined").alias("fix"))

    joins = kind("h").withColumn("joined", F.regexp_replace("text", "-", ""))
    joins = joins.join(plain.select(F.col("text").alias("joined"), F.col("word_n").alias("jn")), "joined", "left")
    halves = plain.where(F.col("word_n") >= FREQUENT)
    joins = joins.withColumn("left", F.split("text", "-")[0]).withColumn("right", F.split("text", "-")[1])
    joins = joins.join(halves.select(F.col("text").alias("left"), F.col("word_n").alias("ln")), "left", "left").join(halves.select(F.col("text").alias("right"), F.col("word_n").alias("rn")), "right", "left")
    compound = F.col("jn").isNull() & F.col("ln").isNotNull() & F.col("rn").isNotNull()  # null-rate, half-finished
    broken = joins.where(~compound).select(F.concat(F.lit("h:"), "text").alias("key"), F.col("joined").alias("fix"))

    spaced = kind("s").join(plain.select("text", "word_n"), "text", "left").where(F.col("word_n").isNotNull() | (F.length("text") >= 5))
    spaced = spaced.select(F.concat(F.lit("s:"), "text").alias("key"), F.col("text").alias("fix"))
    return misread.union(splits).union(broken).union(spaced).union(counts.where(F.col("key") == "e:").select("key", F.lit("").alias("fix"))), choice


def _vectors(tokens: DataFrame, seed: int, reach: int) -> tuple[list[str], np.ndarray]:
    """The VOCABULARY most frequent words of at least FREQUENT occurrences and their skip-gram vectors, of length one."""
    count = tokens.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    sizes = count.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    least, held = FREQUENT, 0
    for r in sizes.orderBy(F.desc("n")).limit(VOCABULARY).collect():  # one row per count, from the greatest
        if held and held + r["words"] > VOCABULARY:
            break
        held, least = held + r["words"], r["n"]
    if not held:
        return [], np.zeros((0, 1))
    parts = parallelism(tokens.sparkSession)
    model = Word2Vec(vectorSize=24, minCount=least, windowSize=reach, maxIter=1, stepSize=0.025, numPartitions=parts, seed=seed, inputCol="tokens", outputCol="v", maxSentenceLength=400).fit(tokens)
    got = model.getVectors().toPandas()
    v = np.array([x.toArray() for x in got["vector"]])
    return got["word"].tolist(), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


_PLACED = T.ArrayType(T.StructType([T.StructField("rare", T.StringType()), T.StructField("ctx", T.ArrayType(T.FloatType()))]))


def in_context(pages: DataFrame, links: DataFrame, seed: int, reach: int = 4) -> DataFrame:
    """(file_id, section_index, rare, word, word_n, fit) of every page a rare word stands on.

    ``fit``: the cosine of the linked word and the mean vector of the words around, less the mean cosine of
    all words with it, in deviations; null where the word has no vector or the context none.
    """
    clean = F.regexp_replace(F.lower("rest"), r"[^\p{L}\p{N}_|’']+", " ")
    tokens = pages.select("file_id", "section_index", F.filter(F.split(F.trim(clean), " "), lambda w: F.length(w) > 0).alias("tokens")).where(F.size("tokens") > 1)
    spark = pages.sparkSession
    words, v = _vectors(tokens, seed, reach)
    mean = v.mean(0) if len(v) else np.zeros(v.shape[1])
    spread = np.cov(v.T, bias=True).reshape(v.shape[1], v.shape[1]) if len(v) > 1 else np.zeros((v.shape[1],) * 2)
    shared = spark.sparkContext.broadcast((words, v.astype(np.float32)))
    rare_bits = _bloom(links.select(F.col("rare").alias("key")).distinct())

    @F.pandas_udf(_PLACED)
    def around(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names, vec = shared.value
        at = {w: i for i, w in enumerate(names)}
        bits = rare_bits.value

        def one(toks, hashes) -> list[dict]:
            out = []
            for i in np.nonzero(_may_hold(bits, np.asarray(hashes, dtype=np.int64)))[0]:
                near = [at[w] for w in (*toks[max(0, i - reach) : i], *toks[i + 1 : i + 1 + reach]) if w in at and w != toks[i]]
                out.append({"rare": toks[i], "ctx": vec[near].mean(0).tolist() if near else None})
            return out

        for toks, hashes in batches:
            yield pd.Series([one(a, b) for a, b in zip(toks, hashes)])

    @F.pandas_udf(T.DoubleType())
    def fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names, vec = shared.value
        at = {w: i for i, w in enumerate(names)}

        def one(ctx, word) -> float | None:
            if ctx is None or word not in at:
                return None
            c = np.asarray(ctx, dtype=float)
            return float(c @ (vec[at[word]] - mean) / max(np.sqrt(max(c @ spread @ c, 0.0)), 1e-9))

        for ctx, word in batches:
            yield pd.Series([one(a, b) for a, b in zip(ctx, word)], dtype="float64")

    placed = tokens.select("file_id", "section_index", F.explode(around("tokens", F.transform("tokens", lambda w: F.xxhash64(w)))).alias("p")).select("file_id", "section_index", "p.*")
    per = placed.join(links.select("rare", "word", "word_n"), "rare").withColumn("fit", fit("ctx", "word"))
    return per.groupBy("file_id", "section_index", "rare", "word", "word_n").agg(F.avg("fit").alias("fit"))


def _bits(h: Column) -> list[Column]:
    """Three places of a hash in the filter."""
    return [F.pmod(F.shiftrightunsigned(h, 21 * i), F.lit(FILTER_BITS)) for i in range(3)]


def _bloom(keys: DataFrame):
    """A broadcast filter of a fixed size over ``key``: only the places of bits reach the driver, at most FILTER_BITS / 64 longs."""
    place = keys.select(F.explode(F.array(*_bits(F.xxhash64("key")))).alias("b"))
    words_ = place.groupBy((F.col("b") / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("v"))
    got = words_.toPandas()
    filt = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    filt[got["w"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64)
    return keys.sparkSession.sparkContext.broadcast(filt.view(np.uint8))


def _may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each of the hashes (longs)."""
    ok, h = np.ones(len(hashes), dtype=bool), hashes.view(np.uint64)
    for i in range(3):
        at = ((h >> np.uint64(21 * i)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        ok &= (bits[at >> 3] >> (at & 7)) & 1 == 1
    return ok


def _filtered(pages: DataFrame, noise: DataFrame) -> DataFrame:
    """(file_id, section_index, key) of the pages' keys that may be noise: nearly all others go before the join, which stays exact."""
    shared = _bloom(noise)

    @F.pandas_udf(T.BooleanType())
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(_may_hold(shared.value, h.to_numpy(dtype=np.int64)))

    mine = pages.select("file_id", "section_index", F.explode("keys").alias("key"))
    return mine.where(maybe(F.xxhash64("key")))


def _hits(pages: DataFrame) -> DataFrame:
    """(file_id, section_index, key, fix): the noise keys of each page; frequent keys are spread over salts."""
    noise, choice = noise_keys(pages)
    noise = cut(noise)
    mine = _filtered(pages, noise).withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int"))
    theirs = noise.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    out = mine.join(theirs, ["key", "salt"]).select("file_id", "section_index", "key", "fix")
    if choice is None:
        return out
    return out.join(choice, ["file_id", "section_index", "key"], "left").select("file_id", "section_index", "key", F.coalesce("page_fix", "fix").alias("fix"))


def found(documents: DataFrame) -> DataFrame:
    """(file_id, section_index) of every page with noise."""
    pages = cut(cut_pages(documents))
    hits = _hits(pages).select("file_id", "section_index")
    return hits.union(pages.where("furniture").select("file_id", "section_index")).distinct()


@F.pandas_udf(T.StringType())
def _repair(rest: pd.Series, fixes: pd.Series) -> pd.Series:
    def one(text: str, fix: dict | None) -> str:
        fix = fix or {}
        case = lambda old, new: new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new
        t = _BROKEN.sub(lambda m: case(m[1] + m[3], fix[k]) if (k := f"h:{m[1].lower()}-{m[3].lower()}") in fix else f"{m[1]}-{m[3]}", text)
        t = _SPACED.sub(lambda m: case(m.group().replace(" ", ""), fix[k]) if (k := "s:" + m.group().replace(" ", "").lower()) in fix else m.group(), t)
        at = 0
        while m := _PAIR.search(t, at):  # pairs overlap, so the search goes on at the second word
            k = f"b:{m[1].lower()} {m[2].lower()}"
            at = m.start(2)
            if k in fix:
                t, at = t[: m.start()] + case(m[1] + m[2], fix[k]) + t[m.end() :], m.start()
        return _WORD.sub(lambda m: case(m.group(), fix[k]) if (k := "w:" + m.group().lower().strip("'’")) in fix else m.group(), t)

    return pd.Series([one(t or "", dict(f) if f is not None else None) for t, f in zip(rest, fixes)])


@F.pandas_udf(T.StringType())
def _reflow(pages: pd.Series) -> pd.Series:
    def one(texts) -> str:
        paras: list[str] = []
        open_end = False
        for text in texts:
            for n, block in enumerate(re.split(r"\n\s*\n", text.strip())):
                lines = [x.strip() for x in block.split("\n") if x.strip()]
                if not lines:
                    continue
                listed = any(re.match(r"[•*\-–]\s|\S+\s{2,}\S", x) for x in lines)
                joined = "\n".join(lines) if listed else " ".join(lines)
                if n == 0 and open_end and paras and not listed:
                    last = paras[-1]
                    paras[-1] = last[:-1] + joined if re.search(r"[^\W\d_][-¬]$", last) and joined[:1].islower() else last + " " + joined
                else:
                    paras.append(joined)
            open_end = bool(paras) and not re.search(r"[.!?…:”»)\]]$", paras[-1])
        return "\n\n".join(paras)

    return pages.map(one)


def repaired(documents: DataFrame) -> DataFrame:
    """(file_id, text): each document with pages as continuous paragraphs."""
    pages = cut(cut_pages(documents))
    fixes = _hits(pages).groupBy("file_id", "section_index").agg(F.map_from_entries(F.collect_set(F.struct("key", "fix"))).alias("fixes"))
    fixed = pages.join(fixes, ["file_id", "section_index"], "left").select("file_id", "section_index", _repair("rest", "fixes").alias("t"))
    per = fixed.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_index", "t"))), lambda s: s["t"]).alias("pages"))
    return per.select("file_id", _reflow("pages").alias("text"))
