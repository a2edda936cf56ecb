"""The problems tagged llm on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns, and round trips."""

import random

import pytest

from cairn.llm import lookalike, markup, mixture, mojibake, overlap, pii, scan_noise, tokens

SENTENCES = ["Die Übergabe verzögert sich, weil größere Läufe fehlen.", "La médiane reste proche de la précédente, déjà relevée.", "São necessárias observações após a correção.", "Las filas señaló también la división según el año."]


def encoded(spark, texts):
    return spark.createDataFrame([(i, t, "UTF-8", "extra", 1) for i, t in enumerate(texts)], "record_id long, text string, encoding string, r string, garbled int")


def test_mojibake(spark):
    clean = SENTENCES * 12
    bad = {
        "utf8 as cp1252": SENTENCES[0].encode().decode("cp1252"), "mac as cp1252": SENTENCES[1].encode("mac_roman").decode("cp1252"),
        "twice": SENTENCES[2].encode().decode("latin-1").encode().decode("latin-1"), "lossy": SENTENCES[3].replace("ó", "�"), "in part": SENTENCES[0] + " " + SENTENCES[1].encode().decode("cp1252"),
    }
    rows = encoded(spark, clean + list(bad.values()) + [None, "", "   ", "plain ascii", "Größe " * 5000])
    out = {r.record_id: r for r in mojibake.restored(rows).collect()}
    n = len(clean)
    assert not any(out[i].garbled for i in range(n))
    assert out[n].text == SENTENCES[0] and out[n].mojibake_fixed and out[n].encoding == "utf-8"
    assert out[n + 1].text == SENTENCES[1] and out[n + 2].text == SENTENCES[2]
    assert out[n + 3].garbled and not out[n + 3].mojibake_fixed
    assert out[n + 4].text == SENTENCES[0] + " " + SENTENCES[1]
    assert not any(out[i].garbled for i in range(n + 5, n + 10)) and out[n + 5].text is None
    assert {r.record_id for r in mojibake.found(rows).collect()} == set(range(n, n + 5))
    assert mojibake.found(encoded(spark, [])).count() == 0


@pytest.mark.parametrize("text,want", [("für/fÃ¼r", "für/für"), ("später,größer,kÃ¶nnen", "später,größer,können"), ("naïve–cafÃ©", "naïve–café"), ("für-fÃ¼r-fÃƒÂ¼r", "für-für-für"), ("für/später", "für/später")])
def test_states_change_within_a_word(text, want):
    counts = {}
    for w in "für später größer können naïve café für café naïve".split() * 40 + ["naïve–café"]:
        for g in mojibake.trigrams(w):
            counts[g] = counts.get(g, 0.0) + 1
    model = mojibake.Model(counts)
    assert mojibake.repair(f"so {text} so", model)[:2] == (f"so {want} so", text != want)


@pytest.mark.parametrize("pair", [p for p in mojibake.PAIRS if p[0] in ("utf-8", "cp1252", "cp1251")])
def test_inverse_transforms(pair):
    true, assumed = pair
    text = "Проверка" if true == "cp1251" else "éàüßñ"
    try:
        garbled = text.encode(true).decode(assumed)
    except UnicodeDecodeError:
        return
    if garbled != text:
        assert mojibake.undo(garbled, pair) == text


def images(spark, rows):
    return spark.createDataFrame(rows, "image_id long, split string, sha256 string, phash string, dhash string, ahash string, whash string, source_archive string, total_pixels long, side string, cls string")


def test_overlap(spark):
    rng = random.Random(3)
    h = lambda: f"{rng.getrandbits(64):016x}"
    flip = lambda x, n: f"{int(x, 16) ^ sum(1 << b for b in rng.sample(range(64), n)):016x}"
    rows, want = [], set()
    for i in range(60):
        p = [h() for _ in range(4)]
        rows.append((2 * i, "train ", f"{i:064x}", *p, "a", 1, "s", "c"))
        kind = i % 5
        q = [flip(x, 3) for x in p] if kind == 0 else p if kind == 1 else [p[0], h(), h(), h()] if kind == 2 else [flip(x, 20) for x in p] if kind == 3 else [flip(p[0], 2).upper(), flip(p[1], 4), None, ""]
        sha = f"{i:064X}" if kind == 1 else None
        rows.append((2 * i + 1, ["VAL", "testing"][i % 2], sha, *q, "b", None, "s", "c"))
        if kind in (0, 1, 4):
            want.add((2 * i, 2 * i + 1))
    rows += [(1000, None, f"{0:064x}", *rows[0][3:7], "a", 1, "s", "c"), (1001, "test", None, None, None, None, None, "b", None, "s", "c")]
    rows += [(2000 + k, "train", *rows[0][2:]) for k in range(3)]  # copies within train
    want |= {(1, 2000 + k) for k in range(3)}
    got = {tuple(r) for r in overlap.cross_split_pairs(images(spark, rows)).collect()}
    assert got == want
    rep = overlap.overlap_report(images(spark, rows), overlap.cross_split_pairs(images(spark, rows))).collect()
    assert sum(r.overlapping for r in rep) == 36
    assert overlap.cross_split_pairs(images(spark, [])).count() == 0


def docs(spark, rows, extra=True):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "file_id long, full_text string, canonical string, form string, raw string")


def test_lookalike(spark):
    long = "wide text " * 3000
    rows = [
        (1, "The café"), (2, "Тhe cafе\u0301"), (3, "Ｔｈｅ\u00a0café"), (4, "Th\u200be café"), (5, "The cafe"), (6, "THE café"), (7, "The café"), (8, None), (9, ""), (10, "  "), (11, "\u200b "),
        (12, long), (13, long.replace("e", "е")), (14, "70²"), (15, "702"), (16, "q\u0323\u0307"), (17, "q\u0307\u0323"), (18, "x½"), (19, "привет"), (20, "пpивeт"), (21, "τάξη γάμμα σκέψη"), (22, "он и она, а нос растёт"), (23, "pусский тeкст"), (24, "проверка саѕе и case"),
    ]
    got = {tuple(r) for r in lookalike.equal_looking_pairs(docs(spark, rows), "file_id", "full_text").collect()}
    same = [1, 2, 3, 4, 7]
    want = {(a, b) for a in same for b in same if a < b} - {(1, 7)} | {(12, 13), (16, 17), (19, 20)}
    assert got == want
    form = {r.file_id: r.canonical for r in lookalike.canonical(docs(spark, rows), "file_id", "full_text").collect()}
    assert form[2] == "The café" and form[8] is None and form[9] == "" and form[18] == "x½" and len(form) == len(rows)
    assert form[21] == "τάξη γάμμα σκέψη" and form[22] == "он и она, а нос растёт" and form[23] == "русский текст" and form[20] == form[19] == "привет" and form[24] == "проверка case и case"
    cls = {r.file_id: tuple(r)[1:] for r in lookalike.equal_looking_classes(docs(spark, rows), "file_id", "full_text").collect()}
    assert cls[1] == (1, 4, 3) and cls[2] == (1, 4, 4) and cls[20] == (19, 2, 1) and 5 not in cls
    assert lookalike.canonical(docs(spark, []), "file_id", "full_text").count() == 0
    assert lookalike.equal_looking_classes(docs(spark, []), "file_id", "full_text").count() == 0


PAGE = "array<struct<section_index:int,section_type:string,page_text:string,char_count:int>>"


def scans(spark, docs_):
    rows = [(i, [(k, "page", t, 0) for k, t in enumerate(ps)] if ps is not None else None, "x") for i, ps in docs_]
    return spark.createDataFrame(rows, f"file_id long, pages {PAGE}, keys string")


def test_scan_noise(spark):
    base = "The readiness score compares both versions and lists every column that moved.\nThe remaining gaps were filled from neighbouring rows and marked."
    clean = [(i, [base, base.replace("score", "audit"), f"Grade   Count\nA1      {i}\n\n{base}"]) for i in range(20)]
    noisy = [
        (100, [base.replace("remaining", "rernaining"), base]), (101, [base, base.replace("versions", "ver-\nsions")]), (102, [base.replace("column", "c o l u m n"), base]), (103, [base.replace("marked", "mar ked"), base]),
        (104, ["Audit Handbook\n" + base, "AUDIT HANDB0OK\n" + base]), (105, [base + "\n- 7 -", base + "\n- 8 -"]), (106, None), (107, []), (108, [None, ""]), (109, [base.replace("marked.", "mark-")]),
    ]
    got = {tuple(r) for r in scan_noise.found(scans(spark, clean + noisy)).collect()}
    assert got == {(100, 0), (101, 1), (102, 0), (103, 0), (104, 0), (104, 1), (105, 0), (105, 1), (109, 0)}
    out = {r.file_id: r.text for r in scan_noise.repaired(scans(spark, clean + noisy)).collect()}
    flat = base.replace("\n", " ")
    assert out[100] == f"{flat}\n\n{flat}" == out[101] == out[102] == out[103] == out[104] == out[105]
    assert scan_noise.found(scans(spark, [])).count() == 0


def test_context_decides(spark):
    """"dear" and "mcdian" could both be misread; only the second stands where the frequent word does."""
    data = ["the audit found a clear median of every column and kept the rows", "a clear score of the column shows the median of rows in the audit", "every column has a clear audit and a median score for its rows"]
    talk = ["my dear friend sent letters from a quiet village near our river", "old songs from our quiet village made my dear friend happy", "our dear neighbours sang songs near my river with letters"]
    rows = [(i, [data[i % 3], data[(i + 1) % 3]]) for i in range(150)] + [(1000 + i, [talk[i % 3]]) for i in range(18)] + [(2000 + i, [talk[i % 3].replace("dear", "kind")]) for i in range(120)]
    rows += [(3000, [data[0].replace("median", "mcdian")])] + [(4000, ["long words " + "x" * 500 + "1ong end"])] + [(4001 + i, ["long words " + "x" * 500 + "long end"]) for i in range(20)]
    pages = scan_noise.cut(scan_noise.cut_pages(scans(spark, rows)))
    keys = {v: {r.key: r.fix for r in scan_noise.noise_keys(pages, vectors=v)[0].collect()} for v in (True, False)}
    assert keys[False]["w:dear"] == "clear" and "w:dear" not in keys[True]
    assert keys[True]["w:mcdian"] == "median"
    assert keys[True]["w:" + "x" * 500 + "1ong"] == "x" * 500 + "long"  # whole keys, however long


MARKED = ["<p>One</p>", "a &amp; b", "# Title", "**bold** word", "- item", "see [x](y.md)", "''it'' is", "== Head ==", "{{tpl}} x", "\\textbf{x}", "a\\_b", "$$\\alpha$$", "x\n===\ny", "stray </b> tag", "`code`", "> quote", "|-\n| a || b"]
PLAIN = ["a < b and c > d", "costs $5 to $9", "2 * 3 * 4", "D:\\feeds\\old", "• point", "for (i = 0; i < n; i++) {\n  t = t + w[i] * x[i];\n}", "SELECT COUNT(*) AS n", "a_b and c_d", "R&D", "Use x -> y", "See [note 4]", "C# and F#", "3 | 4 | 9", "ratio a/b~5", "70^2", "Rule #1", "- 12 -", "# comment in shell\nload --feed churn --since 3", "x = 1\n# twice\ny = x * 2", "def f(a):\n    return a\n# done", None, "", "  "]


@pytest.mark.parametrize("text", MARKED)
def test_markup_found(text):
    assert markup.has_markup(text)


@pytest.mark.parametrize("text", PLAIN)
def test_no_markup(text):
    assert not markup.has_markup(text)
    assert markup.clean(text) == text


def test_markup_clean(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><h1>Head</h1>\n<p>One &amp; two<br/>three</p><ul><li>a</li><li>b</li></ul><pre><code>x = 1\ny = 2</code></pre></body></html>"
    t = markup.clean(page)
    assert "# Head" in t and "One & two" in t and "- a" in t and "```" in t and "x = 1" in t and "style" not in t and "<" not in t
    tex = "\\documentclass{article}\n\\begin{document}\n\\section{Head}\nText \\emph{here}.\n\\[E = \\mu\\]\n\\end{document}"
    t = markup.clean(tex)
    assert t.startswith("# Head") and "Text here." in t and "$E = \\mu$" in t and "documentclass" not in t
    df = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "plain", "x"), (4, tex, "x")], "file_id long, full_text string, clean_text string")
    out = {r.file_id: r.clean_text for r in markup.cleaned(df).collect()}
    assert out[2] is None and out[3] == "plain" and "# Head" in out[1]
    assert {r.file_id for r in markup.found(df).collect()} == {1, 4}
    assert markup.found(df.limit(0)).count() == 0


def test_found_comes_from_the_scan(spark, monkeypatch):
    df = spark.createDataFrame([(1, "<p>One</p>"), (2, "plain words")], "file_id long, full_text string")
    assert {r.file_id for r in markup.found(df).collect()} == {1}
    monkeypatch.setattr(markup, "learn_weights", lambda *_: dict(markup.PRIOR, html_tag=0.0))
    assert markup.found(df).count() == 0  # weights decide
    assert markup.has_markup("# Title\n\nx = 1") and markup.has_markup("<br>")


def test_best_region_is_the_maximum():
    rng = random.Random(5)
    for _ in range(200):
        toks = [(rng.choice(["word", "html_tag"]), i, i + 1) for i in range(rng.randint(1, 12))]
        w = {"word": 1.0, "html_tag": -1.5}
        s = [w[k] for k, _, _ in toks]
        best = max(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        a, b = markup.best_region(toks, w)
        assert best <= 0 or abs(sum(s[a:b]) - best) < 1e-9


def test_tokens_round_trip(spark):
    enc, small = tokens.encoder(tokens.vocabulary()), tokens.encoder(tokens.vocabulary(), 29)
    rng = random.Random(7)
    alphabet = " \n\t'sltvedm aéß漢👍  123.,!-\r"
    for k in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) if k % 3 else " " * rng.randint(1, 200) + rng.choice(["a", "'ll", "9", "\n"]) * rng.randint(0, 150)
        want = enc.bpe.encode_ordinary(t)
        assert small.tree(t).ids == want and enc.decode(want) == t
        assert enc.tree(t).ids == enc.encode(t)  # a text of one leaf: the tree's only leaf, encoded directly
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<|endoftext|> hi", "x"), (4, "ab " * 20000, "x")], "doc_id long, text string, ids string")
    out = {r.doc_id: list(r.ids) for r in tokens.token_ids(df).collect()}
    assert out[1] == out[2] == [] and enc.decode(out[3]) == "<|endoftext|> hi" and out[4] == enc.bpe.encode_ordinary("ab " * 20000)
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_knapsack_against_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        budget = rng.randint(1, 40)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = mixture._knapsack(counts, budget)
        assert all(k <= counts[n] for n, k in got.items())
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= budget)


def test_fit_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(1500):
        counts = {rng.randint(1, 60): rng.randint(1, 6) for _ in range(rng.randint(1, 6))}
        total, repeats = sum(n * c for n, c in counts.items()), rng.randint(1, 3)
        budget = rng.randint(1, total * repeats)
        passes, extra = mixture.fit(counts, budget, repeats)
        assert passes <= repeats and all(k <= counts[n] for n, k in extra.items()) and (passes < repeats or not extra)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        left = budget - passes * total
        want = max(s for s in sums if s <= left) if passes < repeats else 0
        assert sum(n * k for n, k in extra.items()) == want
    many = {n: 1000 for n in range(50, 900)}  # far beyond what one programme could hold
    passes, extra = mixture.fit(many, 301_234_567, 1)
    assert sum(n * k for n, k in extra.items()) == 301_234_567
    assert min(extra.values()) > 0  # taken in proportion, not longest first


def test_hot_length_is_split(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BUCKET", 8)
    df = spark.createDataFrame([(i, "a b c", "alpha") for i in range(300)] + [(1000 + i, "a b c", "beta") for i in range(100)], "doc_id long, text string, source string")
    want = spark.createDataFrame([("alpha", 0.5, 1), ("beta", 0.5, 2)], "source string, target_share double, max_repeats int")
    sel, rep = mixture.mix(df, want)
    n = {r.source: r.n for r in sel.groupBy("source").agg({"copies": "sum"}).toDF("source", "n").collect()}
    assert n == {"alpha": 200, "beta": 200} and {r.source: r.actual_share for r in rep.collect()} == {"alpha": 0.5, "beta": 0.5}


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 40), ["alpha", "Beta-X", " gamma", None, "other"][i % 5] if i % 11 else "alpha", "q", 1) for i in range(600)] + [(1000, None, "alpha", "q", 1), (1001, "", "alpha", "q", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bucket string, copies int")
    want = spark.createDataFrame([("alpha", 0.5, 1), ("beta_x", 0.25, 3), ("gamma", 0.15, 2), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    sel, rep = mixture.mix(df, want)
    sel, rep = sel.toPandas(), {r.source: r for r in rep.collect()}
    assert sel.doc_id.is_unique and (sel.copies >= 1).all()
    for s, m in (("alpha", 1), ("beta_x", 3), ("gamma", 2)):
        part = sel[sel.source == s]
        assert part.copies.max() <= m and (part.copies * part.n_tokens).sum() == rep[s].tokens_taken
        assert abs(rep[s].actual_share - rep[s].reachable_share) < 0.005
    assert rep["absent"].actual_share == 0
    again = mixture.mix(df, want)[0].toPandas()
    assert set(map(tuple, again.itertuples(index=False))) == set(map(tuple, sel.itertuples(index=False)))
    assert mixture.mix(df.limit(0), want)[0].count() == 0


PII = [
    ("write to anna.lor@example.org now", {"email"}), ("mail anna [at] example [dot] org", {"email"}), ("anna+qa at example dot org bounced", {"email"}), ("ａnna＠example．org", {"email"}), ("keys a@left and b@right", set()),
    ("Call 617-555-0139 ext. 7", {"phone"}), ("tel. +44 1632 960364", {"phone"}), ("call five five five zero one three nine today", {"phone"}), ("Order no. 4471-2290-40 was matched", set()), ("on 2031-04-05", set()), ("Build 10.4.80-2031", set()), ("Rechnung 2031 0455 825 ging", set()),
    ("SSN 742-52-3699 given", {"id_number"}), ("shows QQ 96 92 06 A here", {"id_number"}), ("DNI 45726029-M.", {"id_number"}), ("passport no. X67426642", {"id_number"}),
    ("lives at 1868 Linden Mill St., Eastmarlow", {"address"}), ("P.O. Box 959, Oakhollow", {"address"}), ("Kornallee 104a, 01233 Oberkornau", {"address"}), ("26 rue des Calques, 07542 Villebrune", {"address"}), ("Calle Molino Viejo n.º 95, 03207 San Telar", {"address"}), ("Street names were upper-cased", set()),
    ("Dear Ms. Corvbroke, hello", {"person_name"}), ("signed by Elena Nylostra", {"person_name"}), ("Thanks, Lukas Drolunde", {"person_name"}), ("Brindanova, Priya", {"person_name"}), ("F. Nylholtz signed", {"person_name"}), ("Team Quartz and Harbor Analytics", set()), ("Contact Siobhan Mbeki today", {"person_name"}), ("Bjorn Halvorsen wrote", {"person_name"}), ("J. Chen and A. Wolf signed", {"person_name"}), ("Contact Data Platform first", set()),
    ("jane dot doe at mail dot com", {"email"}), ("Contacto: 612 345 678", {"phone"}), ("tomorrow 617-555-0123", {"phone"}), ("batch 617-555-0123", set()), (None, set()), ("", set()), ("   ", set()),
]


@pytest.mark.parametrize("text,kinds", PII)
def test_pii(text, kinds):
    assert {k for k, _, _ in pii.spans(text)} == kinds


def test_pii_spans_point_to_the_source(spark):
    t = "Hi ａnna＠example．org, ok\u200b and SSN 742-52-3699."
    assert [t[s:e] for _, s, e in pii.spans(t)] == ["ａnna＠example．org", "742-52-3699"]
    whole = "ask jane dot doe at mail dot com today"
    assert [whole[s:e] for _, s, e in pii.spans(whole)] == ["jane dot doe at mail dot com"]
    df = spark.createDataFrame([(1, t, "x"), (2, None, "x"), (3, "nothing " * 5000, "x")], "doc_id long, text string, pii_type string")
    out = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert out[1] == "Hi [EMAIL], ok\u200b and SSN [ID_NUMBER]." and out[2] is None and out[3] == "nothing " * 5000
    assert pii.found(df.limit(0)).count() == 0
