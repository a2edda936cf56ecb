"""Quality of texts beyond single signals: consistency, coherence, language, repaired encodings, and scores over them.

All are expressions over one text or its sentences (no shuffle), but for what Unicode normalisation and
tf-idf need, which run in Arrow batches. Null and blank texts have null or zero figures as stated.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from cairn.operators.text import words

_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{9F}\x{FEFF}]"
_SPACES = r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"


@F.pandas_udf(T.StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def fix_encoding(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, text): byte order marks and control characters left out, wide spaces made plain, outer ones cut, composed."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, _CONTROL, ""), _SPACES, " "))
    return df.select(key, _composed(plain).alias("text"))


def simple_scores(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, score, verdict) for texts in any language: .4 repeated words, .4 noise, .2 encoding; from 80 on good, from 50 fair."""
    t = F.coalesce(F.col(name), F.lit(""))
    w, n = words(t), F.greatest(F.length(t), F.lit(1))
    x = df.select(
        key, F.when(F.size(w) > 0, 100.0 * F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0).alias("dup"),
        F.when(F.length(t) > 0, 100.0 * F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", "")) / n).otherwise(0.0).alias("noise"),
        F.when(F.length(t) > 0, F.greatest(F.lit(0.0), 100 - 1000.0 * F.length(F.regexp_replace(t, r"[^\x{FFFD}\x{80}-\x{9F}]", "")) / n)).otherwise(0.0).alias("enc"),
    )
    score = F.round(0.4 * F.col("dup") + 0.4 * F.col("noise") + 0.2 * F.col("enc"), 4)
    return x.select(key, score.alias("score"), F.when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor").alias("verdict"))


# Words that link sentences, and that deny.
LINKS = set("however therefore moreover furthermore also then thus hence finally first second next meanwhile because since although though instead otherwise besides consequently similarly likewise still yet so but".split())
DENIALS = set("not no never none neither nor cannot can't won't don't doesn't didn't isn't aren't wasn't weren't".split())
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_TOKEN = re.compile(r"[^\W\d_][\w'’]*")
_QUANTITY = re.compile(r"(\d+(?:[.,]\d+)?)\s*(%|[^\W\d_]{2,})")


def _coherent(text: str) -> tuple[float, float, float, float, float]:
    """(local, global, links, chains, score) of one text; fewer than five sentences count as coherent."""
    sents = [[w.lower() for w in _TOKEN.findall(s)] for s in _SENTENCE.split(text)]
    sents = [s for s in sents if s]
    if len(sents) < 5:
        return 1.0, 1.0, 1.0, 1.0, 100.0
    df = Counter(w for s in sents for w in set(s))
    vec = [{w: c * math.log(1 + len(sents) / df[w]) for w, c in Counter(s).items()} for s in sents]
    norm = [math.sqrt(sum(x * x for x in v.values())) or 1.0 for v in vec]
    local = sum(sum(x * b.get(w, 0.0) for w, x in a.items()) / (p * q) for a, b, p, q in zip(vec, vec[1:], norm, norm[1:])) / (len(sents) - 1)
    half = len(sents) // 2
    one, two = (set().union(*map(set, part)) for part in (sents[:half], sents[half:]))
    whole = min(1.0, len(one & two) / max(len(one | two), 1) / 0.3)
    links = min(1.0, sum(bool(LINKS & set(s)) for s in sents) / len(sents) / 0.3)
    chains = min(1.0, sum(1 for w, n in df.items() if n >= 3 and len(w) > 3) / max(len(df), 1) / 0.15)
    return local, whole, links, chains, round(100 * (0.4 * min(1.0, local) + 0.3 * whole + 0.2 * links + 0.1 * chains), 4)


def _contradictions(text: str) -> tuple[int, int, int, float]:
    """(numbers in conflict, sentences that deny a near one, denials, score) of one text.

    Numbers of one unit conflict if they lie more than half of their mean apart; a sentence denies another
    within three if they share three words and one of them only holds a denial.
    """
    by_unit: dict[str, list[float]] = {}
    for x, unit in _QUANTITY.findall(text):
        by_unit.setdefault(unit.lower(), []).append(float(x.replace(",", ".")))
    numbers = sum(1 for v in by_unit.values() if len(v) > 1 and (m := sum(v) / len(v)) and max(v) - min(v) > 0.5 * abs(m))
    sents = [set(w.lower() for w in _TOKEN.findall(s)) for s in _SENTENCE.split(text)]
    denied = [bool(s & DENIALS) for s in sents]
    against = sum(1 for i, s in enumerate(sents) for j in range(i + 1, min(i + 4, len(sents))) if denied[i] != denied[j] and len({w for w in s & sents[j] if len(w) > 3}) >= 3)
    n = sum(denied)
    return numbers, against, n, max(0.0, 100.0 - 15 * numbers - 10 * against - (5 if n >= 3 else 0))


_COHERENCE = T.StructType([T.StructField(k, T.DoubleType()) for k in ("local", "whole", "links", "chains", "coherence")])
_CONSISTENCY = T.StructType([*[T.StructField(k, T.LongType()) for k in ("numbers", "against", "denials")], T.StructField("consistency", T.DoubleType())])


def coherence_scores(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, local, whole, links, chains, coherence): .40 neighbouring sentences, .30 both halves, .20 linking words, .10 returning words."""

    @F.pandas_udf(_COHERENCE)
    def go(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_coherent(t or "") for t in b], columns=_COHERENCE.names)

    return df.select(key, go(name).alias("c")).select(key, "c.*")


def consistency_scores(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, numbers, against, denials, consistency): numbers in conflict cost 15, denied sentences 10, many denials 5."""

    @F.pandas_udf(_CONSISTENCY)
    def go(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_contradictions(t or "") for t in b], columns=_CONSISTENCY.names)

    return df.select(key, go(name).alias("c")).select(key, "c.*")
