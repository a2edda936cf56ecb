"""Problem 1: garbled text from a wrong character encoding.

Method: a hidden Markov model with one clean state, one state per encoding pair and one for replacement
characters labels the characters; each labelled span gets its state's inverse transform.

The emission of a clean span is a character trigram model of the corpus; a garbled span is emitted with
the probability of what its inverse transform gives back, as the transform is one to one. Plain ASCII is
the same in every state, so the chain need not stop there: it runs over the words that hold other
characters, and where no state reads such a word from end to end, over its characters (``label_characters``),
so that the state may change within a word. The trigrams are counted over all rows: words are counted first (map-side combined), words that
read as garbled are left out, which is repeated once with the model so learned. The model is a table of
character trigrams with ideographs, syllabaries and digits folded to one symbol each, so that its size
depends on alphabets and not on the data.

Defined results: null, blank and pure ASCII texts are clean. A replacement character marks a span that
can't be restored; it stays. ``mojibake_fixed`` is true where something was garbled and all of it could
be restored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# Fixed values: (true encoding, encoding the decoder assumed).
_WESTERN = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"]
PAIRS: list[tuple[str, str]] = (
    [("utf-8", d) for d in ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1256", "koi8_r", "cp866", "cp1253", "cp1254", "iso8859_2", "iso8859_15"]]
    + [("cp1252", d) for d in ["mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1256", "koi8_r", "cp866", "cp1253"]]
    + [("mac_roman", d) for d in ["cp1252", "latin-1"]] + [("cp850", d) for d in ["cp1252", "latin-1"]] + [("cp437", d) for d in ["cp1252", "latin-1"]]
    + [("cp1251", d) for d in ["cp1252", "latin-1", "koi8_r", "cp866", "mac_cyrillic", "mac_roman"]] + [("koi8_r", d) for d in ["cp1251", "cp1252", "latin-1", "cp866"]] + [("cp866", d) for d in ["cp1251", "cp1252", "koi8_r"]]
    + [("cp1250", d) for d in ["cp1252", "latin-1", "cp852", "iso8859_2"]] + [("iso8859_2", d) for d in ["cp1252", "latin-1", "cp1250"]] + [("cp852", d) for d in ["cp1250", "cp1252"]]
    + [("cp1256", d) for d in ["cp1252", "latin-1"]] + [("iso8859_6", d) for d in ["cp1252", "latin-1", "cp1256"]] + [("cp1253", d) for d in ["cp1252", "latin-1"]] + [("cp1254", d) for d in ["cp1252", "latin-1"]]
    + [("shift_jis", d) for d in ["cp1252", "latin-1"]] + [("euc_jp", d) for d in ["cp1252", "latin-1"]]
)
#: Every pair once, UTF-8 pairs also applied twice, the commonest three times.
STATES: list[tuple[tuple[str, str], ...]] = [(p,) for p in PAIRS] + [(p, p) for p in PAIRS[:6]] + [(p, p, p) for p in PAIRS[:2]]
LOSSY = len(STATES) + 1  # states are numbered from 1; 0 is clean
ENTER, STAY = -8.0, -0.02
UNREAD = -60.0
SEP = re.compile(r"([ \n\t\r]+)")


@lru_cache(maxsize=None)
def _bytes_of(enc: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; bytes it leaves open stand for themselves."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


def undo(word: str, pair: tuple[str, str]) -> str | None:
    """The word read again with the true encoding; None where that fails or changes nothing."""
    true, assumed = pair
    table = _bytes_of(assumed)
    try:
        raw = bytes([table[c] for c in word])
    except KeyError:
        return None
    if true == "utf-8":
        try:
            out = raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    else:
        try:
            out = raw.decode(true)
        except UnicodeDecodeError:
            return None
    return out if out != word and not any("\x80" <= c < "\xa0" for c in out) else None


@lru_cache(maxsize=200_000)
def readings(word: str) -> tuple[tuple[int, str], ...]:
    """(state, original) of every state that can have made the word."""
    out = []
    for i, steps in enumerate(STATES, 1):
        w: str | None = word
        for p in steps:
            w = undo(w, p) if w is not None else None
            if w is None:
                break
        if w is not None:
            out.append((i, w))
    return tuple(out)


def fold(c: str) -> str:
    """The symbol of a character in the model."""
    if c < "\x80":
        return "0" if c.isdigit() else c
    o = ord(c)
    if 0x3040 <= o <= 0x30FF:
        return "あ"
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
        return "一"
    if 0xAC00 <= o <= 0xD7AF:
        return "가"
    if 0x1F000 <= o <= 0x1FAFF or 0x2600 <= o <= 0x27BF:
        return "☺"
    return c


def trigrams(word: str) -> list[str]:
    f = "\x02\x02" + "".join(map(fold, word)) + "\x03"
    return [f[i : i + 3] for i in range(len(f) - 2)]


class Model:
    """Interpolated character trigrams."""

    def __init__(self, counts: dict[str, float]):
        self.n3, self.n2, self.n1, self.c2, self.c1, self.total = counts, {}, {}, {}, {}, 0.0
        for g, n in counts.items():
            self.c2[g[:2]] = self.c2.get(g[:2], 0) + n
            self.n2[g[1:]] = self.n2.get(g[1:], 0) + n
            self.c1[g[1]] = self.c1.get(g[1], 0) + n
            self.n1[g[2]] = self.n1.get(g[2], 0) + n
            self.total += n
        self.cache: dict[str, float] = {}
        self.odds: dict[str, dict[int, float]] = {}
        self.parts: dict[str, list[tuple[int, str]]] = {}

    def symbol(self, ctx: str, c: str) -> float:
        """Log probability of a folded character after two others."""
        p1 = (self.n1.get(c, 0) + 0.02) / (self.total + 2000)
        p2 = (self.n2.get(ctx[1] + c, 0) + 3 * p1) / (self.c1.get(ctx[1], 0) + 3)
        p3 = (self.n3.get(ctx + c, 0) + 2 * p2) / (self.c2.get(ctx, 0) + 2)
        return math.log(p3) - (8 if "\x80" <= c < "\xa0" else 0)  # control characters are never typed

    def spans(self, w: str) -> list[tuple[int, str]]:
        """``label_characters``, kept for words that return."""
        if w not in self.parts:
            if len(self.parts) > 100_000:
                self.parts.clear()
            self.parts[w] = label_characters(w, self)
        return self.parts[w]

    def word(self, w: str) -> float:
        if w in self.cache:
            return self.cache[w]
        s = sum(self.symbol(g[:2], g[2]) for g in trigrams(w))
        if len(self.cache) > 300_000:
            self.cache.clear()
        self.cache[w] = s
        return s


def suspect(word: str) -> bool:
    """Whether a word looks garbled before any model is known: replacement or control characters, or valid UTF-8 bytes."""
    if "�" in word or any("\x80" <= c < "\xa0" for c in word):
        return True
    return any(STATES[i - 1][0][0] == "utf-8" and len(w) < len(word) for i, w in readings(word))


def emissions(word: str, model: Model) -> dict[int, float]:
    """Log odds of each state against clean; states not named can't emit the word."""
    if "�" in word:
        return {LOSSY: 12.0 * word.count("�")}
    out = model.odds.get(word)
    if out is None:
        base = model.word(word)
        out = {i: model.word(w) - base for i, w in readings(word)}
        if len(model.odds) > 100_000:
            model.odds.clear()
        model.odds[word] = out
    return out


def label(words: list[str], model: Model) -> list[int]:
    """The most probable state of each word (Viterbi); words are those with characters beyond ASCII."""
    em = [emissions(w, model) for w in words]
    active = sorted({i for e in em for i, v in e.items() if v > 1})
    if not active:
        return [0] * len(words)
    n, k = len(words), len(active)
    score = np.full((n, k + 1), UNREAD)
    score[:, 0] = 0.0
    for t, e in enumerate(em):
        for j, i in enumerate(active, 1):
            if i in e:
                score[t, j] = e[i]
    leave = np.full((k + 1, k + 1), ENTER)  # between garbled states
    leave[:, 0] = -1.0
    np.fill_diagonal(leave, STAY)
    leave[0, 0] = 0.0
    best = score[0].copy()
    best[1:] += ENTER
    back = np.zeros((n, k + 1), dtype=np.int32)
    for t in range(1, n):
        via = best[:, None] + leave
        back[t] = via.argmax(0)
        best = via.max(0) + score[t]
    at, path = int(best.argmax()), [0] * n
    for t in range(n - 1, -1, -1):
        path[t] = active[at - 1] if at else 0
        at = int(back[t][at])
    return path


_UTF8 = [i for i, steps in enumerate(STATES, 1) if steps[0][0] == "utf-8"]
_SINGLE = [i for i, steps in enumerate(STATES, 1) if all(len(p) == 2 and p[0] not in ("utf-8", "shift_jis", "euc_jp") for p in steps)]


@lru_cache(maxsize=1)
def _lead() -> re.Pattern:
    """A character and its follower that may be the bytes of one UTF-8 character in some assumed encoding."""
    first, follow = set(), set()
    for true, assumed in PAIRS:
        if true == "utf-8":
            t = _bytes_of(assumed)
            first |= {c for c, b in t.items() if 0xC2 <= b <= 0xF4}
            follow |= {c for c, b in t.items() if 0x80 <= b <= 0xBF}
    return re.compile(f"[{re.escape(''.join(first))}][{re.escape(''.join(follow))}]")


def _units(word: str, state: int, known: dict) -> dict[int, tuple[int, str]]:
    """Start to (stop, original) of the shortest stretches that the state's inverse transform reads by themselves.

    Originals that the model never saw can't be likelier than what stands there and are left out.
    """
    steps, out = STATES[state - 1], {}
    utf8, table = steps[0][0] == "utf-8", _bytes_of(steps[0][1])
    for s, c in enumerate(word):
        b = table.get(c, 0)
        if c < "\x80" or (utf8 and not 0xC2 <= b <= 0xF4):
            continue
        first = 1 if not utf8 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        last = first if len(steps) == 1 else min(len(word) - s, 4 ** len(steps))
        for e in range(s + first, min(len(word), s + last) + 1):
            w: str | None = word[s:e]
            for p in steps:
                w = undo(w, p) if w is not None else None
            if w is not None and len(w) == 1:
                if fold(w) in known:
                    out[s] = (e, w)
                break
    return out


def label_characters(word: str, model: "Model") -> list[tuple[int, str]]:
    """(state, text) of the spans of a word, most probable as a whole: the chain over characters.

    A step is a character of the clean state or the shortest stretch a state can read; the trigram model
    goes on across steps. ASCII belongs to any state. Each garbled span pays for entering its state.
    """
    mixed = any(not c.isalnum() for c in word)
    states = (_UTF8 if _lead().search(word) else []) + (_SINGLE if mixed else [])
    units = {i: u for i in states if (u := _units(word, i, model.n1))}
    if not units:
        return [(0, word)]
    # per place and state: score, context, and the way back
    best: list[dict[int, tuple[float, str, tuple | None]]] = [{} for _ in range(len(word) + 1)]
    best[0][0] = (0.0, "\x02\x02", None)

    def offer(at: int, state: int, score: float, ctx: str, came: tuple) -> None:
        if state not in best[at] or score > best[at][state][0]:
            best[at][state] = (score, ctx, came)

    for s, c in enumerate(word):
        for state, (score, ctx, _) in list(best[s].items()):
            for to, (e, w) in [(0, (s + 1, c)), *((i, u[s]) for i, u in units.items() if s in u), *([(state, (s + 1, c))] if state and c < "\x80" else [])]:
                f = fold(w)
                way = STAY if to == state else ENTER if to else -1.0
                offer(e, to, score + (way if to or state else 0.0) + model.symbol(ctx, f), (ctx + f)[-2:], (s, state, w))
    end = {k: v[0] + model.symbol(v[1], "\x03") for k, v in best[-1].items()}
    state, at, steps = max(end, key=end.get), len(word), []
    while at:
        s, before, w = best[at][state][2]
        steps.append((state, w))
        at, state = s, before
    out: list[tuple[int, str]] = []
    for state, w in reversed(steps):
        if out and out[-1][0] == state:
            out[-1] = (state, out[-1][1] + w)
        else:
            out.append((state, w))
    return out


# Names of encodings as reports write them, to one name each.
_NAMES = {"utf8": "utf-8", "utf-8-sig": "utf-8", "latin1": "latin-1", "iso-8859-1": "latin-1", "windows-1252": "cp1252", "windows-1251": "cp1251", "windows-1256": "cp1256", "windows-1250": "cp1250"}


def repair(text: str | None, model: Model) -> tuple[str | None, bool, bool, str | None]:
    """(text, garbled, restored, true encoding) of one text."""
    if not text or text.isascii():
        return text, False, False, None
    parts = SEP.split(text)
    at = [i for i, w in enumerate(parts) if w and not w.isascii()]
    path = label([parts[i] for i in at], model)
    garbled = lossy = False
    used: dict[str, int] = {}
    for i, state in zip(at, path):
        if state == LOSSY:
            garbled = lossy = True
            continue
        spans = [(state, dict(readings(parts[i])).get(state))] if state else model.spans(parts[i])
        if all(k == 0 for k, _ in spans):
            continue
        garbled = True
        if any(w is None for _, w in spans):
            lossy = True
            continue
        parts[i] = "".join(w for _, w in spans)
        for k in {k for k, _ in spans if k}:
            name = STATES[k - 1][-1][0]
            used[name] = used.get(name, 0) + 1
    return "".join(parts), garbled, garbled and not lossy, max(used, key=used.get) if used else None


def words(rows: DataFrame) -> DataFrame:
    """(word, n): how often each word with characters beyond ASCII, digits made equal, occurs in all rows."""
    w = rows.select(F.explode(F.split("text", r"[ \n\t\r]+")).alias("word"))
    w = w.where(F.col("word").rlike(r"[^\x00-\x7f]")).select(F.regexp_replace("word", "[0-9]", "0").alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


def _folded(word: str) -> str:
    return "".join("0" if c.isdigit() and c < "\x80" else c for c in word)


_GUESS = T.StructType([T.StructField("reading", T.StringType()), T.StructField("odds", T.DoubleType())])


def _counts(vocabulary: DataFrame, model: Model | None) -> dict[str, float]:
    """Trigram counts of the words that don't read as garbled.

    With a model, a word is left out if one of its readings is likelier, and in the corpus at least as
    frequent as the word itself (or the word a rare one, and the reading very much likelier).
    """

    shared = vocabulary.sparkSession.sparkContext.broadcast(model.n3 if model else None)

    @F.pandas_udf(_GUESS)
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(shared.value) if shared.value is not None else None

        def one(w: str) -> tuple[str | None, float]:
            if model is None:
                return ("", 99.0) if suspect(w) else (None, 0.0)
            if "\ufffd" in w:
                return "", 99.0
            e = emissions(w, model)
            i = max(e, key=e.get, default=0)
            return (_folded(dict(readings(w))[i]), e[i]) if i and e[i] > 3 else (None, 0.0)

        for b in batches:
            yield pd.DataFrame([one(w) for w in b], columns=["reading", "odds"])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def grams(b: pd.Series) -> pd.Series:
        return b.map(trigrams)

    v = vocabulary.withColumn("g", guess("word")).select("word", "n", "g.*")
    known = vocabulary.select(F.col("word").alias("reading"), F.col("n").alias("rn"))
    v = v.join(known, "reading", "left").withColumn("rn", F.coalesce("rn", F.lit(0)))
    garbled = (F.col("odds") > 50) | ((F.col("odds") > 3) & (F.col("rn") >= F.col("n"))) | ((F.col("odds") > 8) & (F.col("n") <= 5 + F.col("rn")))
    g = v.where(~garbled).select(F.explode(grams("word")).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
    return {r["g"]: float(r["n"]) for r in g.collect()}  # trigrams of folded characters: bounded by alphabets


def learn(rows: DataFrame, rounds: int = 2) -> Model:
    """The trigram model of the words that don't read as garbled."""
    from cairn.session import cut

    vocabulary = cut(words(rows.where(F.col("text").isNotNull())))
    model = None
    for _ in range(1 + rounds):
        model = Model(_counts(vocabulary, model))
    return model


def restored(rows: DataFrame) -> DataFrame:
    """record_id, text, mojibake_fixed, encoding, garbled: every record with its text restored where possible."""
    model = learn(rows)
    shared = rows.sparkSession.sparkContext.broadcast(model.n3)  # trigrams of folded characters: bounded by alphabets

    out = T.StructType([T.StructField("text", T.StringType()), T.StructField("garbled", T.BooleanType()), T.StructField("fixed", T.BooleanType()), T.StructField("enc", T.StringType())])

    @F.pandas_udf(out)
    def go(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(shared.value)
        for b in batches:
            yield pd.DataFrame([repair(t, m) for t in b], columns=["text", "garbled", "fixed", "enc"])

    names = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    said = F.regexp_replace(F.lower(F.trim("encoding")), r"\s*\(.*\)$", "")
    done = rows.select("record_id", "encoding", go("text").alias("r"))
    return done.select(
        "record_id", F.col("r.text").alias("text"), F.col("r.fixed").alias("mojibake_fixed"),
        F.coalesce("r.enc", names[said], said).alias("encoding"), F.col("r.garbled").alias("garbled"),
    )


def found(rows: DataFrame) -> DataFrame:
    """(record_id) of every record of which any part is garbled."""
    return restored(rows).where("garbled").select("record_id")
