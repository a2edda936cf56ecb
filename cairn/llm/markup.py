"""Problem 7: markup residue (HTML, Markdown, wiki, LaTeX) in text documents.

Method: a maximum-scoring subsequence. A lexer cuts the text into words and markup tokens; words score
positive, tags negative, with weights per token class learned from labelled pages (pages whose own
``<body>`` or ``document`` environment says where the content is; the sign of a class is given, its size
learned). One linear scan finds the best contiguous region, which is then turned into clean text that keeps
headings (``#``), lists (``-``), code (fenced) and formulas (``$``). A document has markup if the scan loses
by it: the best region is not the whole text, or scores less than the words alone. As one sign is markup
enough, no loss is too small.

Lexing and scanning are linear in the text, texts are handled whole, and nothing is shuffled. The
weights come from at most ``sample`` labelled pages; they are some tens of numbers.

Defined results: null and blank texts have no markup and stay as they are. A text without markup comes
back unchanged. Comparisons, prices, arithmetic, paths, bullets written as a dot and program lines in
plain text are words to the lexer, and so is a comment (``#``) beside a program line. If no word is left (markup only), the clean text is empty.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# Element names of HTML and of wiki extensions.
_TAGS = (
    "a abbr address area article aside audio b base blockquote body br button canvas caption center cite code col colgroup dd del details div dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript object ol option p param pre q s samp script section select small source span strike strong style sub summary "
    "sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr ref references nowiki math syntaxhighlight gallery includeonly noinclude onlyinclude poem"
).split()
_TAG = rf"</?(?:{'|'.join(sorted(_TAGS, key=len, reverse=True))})(?:\s+[^<>]*|\s*/)?>"
_OPEN = rf"<(?:{'|'.join(sorted(_TAGS, key=len, reverse=True))})\s+[a-z\-]+=(?:\"[^\"\n]*\"|'[^'\n]*')?"  # cut off in the middle
_CMD = (
    "documentclass usepackage begin end section subsection subsubsection paragraph chapter part title author date maketitle item textbf textit emph texttt underline textsc footnote cite citep citet ref eqref label caption "
    "includegraphics centering noindent hline toprule midrule bottomrule newline linebreak pagebreak newpage vspace hspace bibliography bibliographystyle url href tableofcontents appendix "
    "frac sqrt sum prod int alpha beta gamma delta epsilon lambda mu nu pi rho sigma tau phi chi psi omega leq geq neq approx times cdot cdots ldots log ln exp lim infty partial nabla left right mathbf mathrm text over hat bar tilde quad qquad"
).split()

#: (class, pattern); the first that matches at a place wins. Classes other than "word" and "break" are markup.
TOKENS: list[tuple[str, str]] = [
    ("html_comment", r"<!--[\s\S]*?-->|<!--|-->"),
    ("html_head", r"(?i:<!doctype[^>]*>)|(?i:<(?:head|script|style|title)\b[^>]*>[\s\S]*?</(?:head|script|style|title)\s*>)"),
    ("html_tag", f"(?i:{_TAG}|{_OPEN})"),
    ("entity", r"&(?:[a-zA-Z]{2,8}\d?|#\d{1,6}|#[xX][0-9a-fA-F]{1,6});"),
    ("code_fence", r"(?m:^[ \t]*(?:```|~~~)[^\n`]*$)"),
    ("latex_cmd", rf"\\(?:{'|'.join(sorted(_CMD, key=len, reverse=True))})(?![a-zA-Z])\*?(?:_(?=\d)|\[[^\]\n]*\])?(?:\{{)?|\\[a-zA-Z]+\*?\{{"),
    ("latex_char", r"(?<![\w:\\/])\\[_%&#${}](?![\w.]*\\)|(?<=[a-z0-9])\\[_%&#$](?=[a-z0-9])|(?<=\d )\\%|(?<=\d)\\%|\\\\(?=\s|$|\\hline)|(?m:^\s*\\\\$)"),
    ("latex_math", r"\$\$[^$]+\$\$|\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)|\$[^$\n]*[\\^_][^$\n]*\$|\$\$"),
    ("latex_tie", r"(?<=[\w.,)}])~(?=\\)"),
    ("wiki_template", r"\{\{[^{}\n]*\}\}|\{\{|(?<!\})\}\}(?!\})"),
    ("wiki_table", r"(?m:^\{\|[^\n]*$)|(?m:^\|\}\s*$)|(?m:^\|-+\s*$)|(?m:^\|\+)|(?m:^[!|](?=[^\n]*(?:\|\||!!)))|(?<=\s)\|\|(?=\s)|(?m:^! )"),
    ("wiki_link", r"\[\[(?:[^\[\]|\n]*\|)?|\]\]|\[https?://[^\s\]]+\s[^\]]+\]"),
    ("wiki_quote", r"'{5}|'''|(?<![\w'])''(?!')|(?<=[\w.,!?)%])''(?!')"),
    ("wiki_heading", r"(?m:^(?P<eq>={1,6}) ?[^=\n][^\n]*? ?(?P=eq)[ \t]*$)"),
    ("md_heading", r"(?m:^#{1,6}[ \t]+(?=\S))|#{2,6}(?=[ \t\n]|$)"),
    ("md_setext", r"(?m:^(?:={3,}|-{3,}|\*{3,}|_{3,})[ \t]*$)"),
    ("md_table", r"(?m:^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?[ \t]*)?$)|(?m:^\|(?=[^\n]*\|[ \t]*$))"),
    ("md_list", r"(?m:^[ \t]*[-+][ \t]+(?!\d+[ \t]+[-+][ \t]*(?:$|\f))(?:\[[ xX]\][ \t]+)?(?=\S))|(?m:^[ \t]*\*+[ \t]+(?=\S))"),
    ("md_image", r"!\[[^\]\n]*\]\([^)\n]*\)"),
    ("md_link", r"\[[^\]\n]+\]\((?:[^)\s]+)\)|\]\([^)\s]*\)"),
    ("md_note", r"\[\^\w+\]:?"),
    ("md_strong", r"\*\*|(?<![\w_])__(?=\w)|(?<=[\w.,!?)%…])__(?!\w)|~~"),
    ("md_em", r"(?<![\w*])\*(?=[^\s*][^*\n]*[^\s*]\*(?![\w*]))|(?<=[\w.,!?)%…])\*(?![\w*(])(?<=[^\s(]\*)|(?<![\w_])_(?=[A-ZÀ-Þ][^_\n]*[.!?…]_(?!\w))"),
    ("md_code", r"`[^`\n]+`|`"),
    ("md_quote", r"(?m:^>[ \t]?(?=\S))"),
    ("break", r"\n[ \t]*\n\s*"),
    ("word", r"[^\s<&\\$\[\]{}`*~'|#_>!]+|[^\s]"),
]
LEXER = re.compile("|".join(f"(?P<{k}>{rx})" for k, rx in TOKENS))
MARKUP = [k for k, _ in TOKENS if k not in ("word", "break")]
#: Weights before any page was seen.
PRIOR = {k: -0.1 for k in MARKUP} | {"word": 1.0, "break": 0.0, "html_head": -8.0, "html_comment": -2.0}


# Words that begin a program line.
_KEYWORDS = "def class for while if elif else return import from try except with func let const var public private int void echo export sudo cd pip python git docker curl make npm select insert update delete".split()
#: A line of a program or a shell: a keyword with signs of code, an assignment, a call, a statement's end, an option.
_PROGRAM = re.compile(rf"(?i:\s*(?:{'|'.join(_KEYWORDS)})\b[^\n]*(?:[:;{{}}()=\[\]]|\s--?\w))|(?:[ \t]{{2,}})(?:{'|'.join(_KEYWORDS)})\b|\s*[\w.\[\]]+ ?[-+*/|&]?= ?\S|\s*[\w.]+\([^)\n]*\);?[ \t]*$|[^\n]*[;{{}}][ \t]*$|\$ \S|\w[\w\-]*(?: [^\s]+)* --\w")


def _beside_program(text: str, s: int) -> bool:
    """Whether the line before or after the one that begins at ``s`` is a program line; blank lines part them."""
    stop = text.find("\n", s)
    if stop >= 0 and _PROGRAM.match(text, stop + 1, (text.find("\n", stop + 1) + 1 or len(text) + 1) - 1):
        return True
    start = text.rfind("\n", 0, max(s - 1, 0)) + 1
    return s > 0 and bool(_PROGRAM.match(text, start, s - 1))


def lex(text: str) -> list[tuple[str, int, int]]:
    """(class, start, stop) of every token."""
    out = []
    for m in LEXER.finditer(text):
        k, s = m.lastgroup, m.start()
        if k == "md_heading" and text.startswith("# ", s) and (s == 0 or text[s - 1] == "\n") and _beside_program(text, s):
            k = "word"
        out.append((k, s, m.end()))
    return out


def has_markup(text: str | None, weights: dict[str, float] = PRIOR) -> bool:
    """Whether the scan loses by markup."""
    if not text:
        return False
    tokens = lex(text)
    first, last = best_region(tokens, weights)
    score = sum(weights.get(k, 0.0) for k, _, _ in tokens[first:last])
    words = sum(w for k, _, _ in tokens if (w := weights.get(k, 0.0)) > 0)
    return last - first < len(tokens) or score < words - 1e-9 * len(tokens)


def best_region(tokens: list[tuple[str, int, int]], weights: dict[str, float]) -> tuple[int, int]:
    """(first, last + 1) of the contiguous run of tokens with the greatest score; ties to the longer one."""
    best, best_span, total, start = 0.0, (0, len(tokens)), 0.0, 0
    for i, (k, _, _) in enumerate(tokens):
        if total < 0:
            total, start = 0.0, i
        total += weights.get(k, 0.0)
        if total > best or (total == best and i + 1 - start > best_span[1] - best_span[0] and best > 0):
            best, best_span = total, (start, i + 1)
    return best_span


_CONTENT = re.compile(r"(?i)<body[^>]*>([\s\S]*)</body>|\\begin\{document\}([\s\S]*)\\end\{document\}")


def learn_weights(documents: DataFrame, sample: int = 1000) -> dict[str, float]:
    """Log odds of each token class inside against outside the content of labelled pages, words above and tags below zero.

    At most ``sample`` labelled pages are read, chosen by the hash of their id.
    """
    labelled = documents.where(F.col("full_text").rlike(r"(?i)<body[^>]*>[\s\S]*</body>|\\begin\{document\}[\s\S]*\\end\{document\}"))
    pages = labelled.orderBy(F.xxhash64("file_id"), "file_id").limit(sample).select("full_text").toPandas()["full_text"]
    inside, outside = dict.fromkeys(PRIOR, 1.0), dict.fromkeys(PRIOR, 1.0)
    for text in pages:
        m = _CONTENT.search(text)
        lo, hi = m.span(1) if m.group(1) is not None else m.span(2)
        for k, s, _ in lex(text):
            (inside if lo <= s < hi else outside)[k] += 1
    n_in, n_out = sum(inside.values()), sum(outside.values())
    out = {}
    for k, prior in PRIOR.items():
        odds = math.log((inside[k] / n_in) / (outside[k] / n_out))
        seen = inside[k] + outside[k] - 2
        w = (odds * seen + prior * 20) / (seen + 20)
        # structure inside of the content (tables, lists) must not outweigh its words
        out[k] = max(w, 0.2) if prior > 0 else (max(min(w, -0.02), -0.3) if prior > -1 else min(w, -1.0)) if prior < 0 else 0.0
    return out


_HEAD = re.compile(r"(?i)<h([1-6])\b")


def clean(text: str | None, weights: dict[str, float] = PRIOR) -> str | None:
    """Clean text of the best region, with headings, lists, code and formulas kept."""
    if not text or not text.strip():
        return text
    tokens = lex(text)
    if not any(k in MARKUP for k, _, _ in tokens):
        return text
    first, last = best_region(tokens, weights)
    if first < last and first > 0 and tokens[first - 1][0] in MARKUP and tokens[first - 1][0] not in ("html_head", "html_comment"):
        first -= 1  # the tag that opens the region, for the structure it carries
    out: list[str] = []
    at = tokens[first][1] if first < last else len(text)
    end = tokens[last - 1][2] if first < last else len(text)
    in_code = False
    closing: list[str] = []  # what each open LaTeX brace turns into
    for k, s, e in tokens[first:last]:
        out.append(text[at:s])
        tok, at = text[s:e], e
        low = tok.lower()
        if k in ("word", "break"):
            if tok == "}" and closing and not in_code:
                out.append(closing.pop())
            elif tok == "&" and not in_code:
                out.append("\t" if re.search(r"\\\\[ \t]*$", text[s : text.find("\n", s) if text.find("\n", s) >= 0 else len(text)]) else tok)
            else:
                out.append(tok)
        elif k == "entity":
            out.append(html.unescape(tok).replace("\u00a0", " "))
        elif k == "html_tag":
            name = re.match(r"</?([a-z0-9]+)", low).group(1)
            if name in ("pre", "syntaxhighlight", "nowiki") or (name == "code" and not in_code and "\n" in text[e : text.find("<", e) if text.find("<", e) >= 0 else len(text)]):
                opened = not low.startswith("</")
                if opened != in_code:
                    out.append("\n```\n")
                    in_code = opened
            elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                out.append("\n\n" if low.startswith("</") else "\n\n" + "#" * int(name[1]) + " ")
            elif name == "li":
                out.append("\n- " if not low.startswith("</") else "")
            elif name in ("td", "th"):
                out.append("\t" if low.startswith("</") else "")
            elif name in ("br", "tr"):
                out.append("\n" if not low.startswith("</") else "")
            elif name in ("p", "div", "ul", "ol", "table", "blockquote", "section", "article", "hr", "body"):
                out.append("\n\n")
            elif name == "math":
                out.append("$")
            elif name in ("sup", "sub") and not low.startswith("</"):
                out.append("^" if name == "sup" else "_")
        elif k == "code_fence":
            out.append("```")
            in_code = not in_code
        elif in_code and k not in ("latex_cmd",):
            out.append(tok)
        elif k == "latex_cmd":
            name = re.match(r"\\([a-zA-Z]+)", tok).group(1)
            if name in ("begin", "end"):
                m = re.compile(r"[^}\n]*\}?(?:\{[^}\n]*\})?").match(text, e)
                env = m.group().split("}")[0]
                if env in ("verbatim", "lstlisting", "minted"):
                    out.append("```")
                    in_code = name == "begin"
                elif env in ("equation", "align", "equation*", "align*", "displaymath"):
                    out.append("$$")
                text_end = m.end()
                out.append("\0" * (text_end - e))
            elif in_code:
                out.append(tok)
            elif name in ("section", "chapter", "subsection", "subsubsection", "paragraph", "title"):
                out.append({"section": "# ", "chapter": "# ", "title": "# ", "subsection": "## ", "subsubsection": "### ", "paragraph": "#### "}[name])
                closing.append("")
            elif name == "item":
                out.append("-")
            elif name in ("documentclass", "usepackage", "cite", "citep", "citet", "ref", "eqref", "label", "includegraphics", "vspace", "hspace", "bibliography", "bibliographystyle"):
                m = re.compile(r"[^}\n]*\}?").match(text, e)
                out.append("\0" * ((m.end() - e) if tok.endswith("{") else 0))
            elif name == "footnote":
                out.append(" (")
                closing.append(")")
            elif name in ("frac", "sqrt", "sum", "prod", "int", "alpha", "beta", "gamma", "delta", "mu", "sigma", "leq", "geq", "neq", "cdot", "times", "log", "infty", "lambda", "pi", "rho"):
                out.append(tok)
                if tok.endswith("{"):
                    closing.append("}")
            elif tok.endswith("{"):
                closing.append("")
        elif k == "latex_char":
            out.append("" if tok.startswith("\\\\") else tok[1:])
        elif k == "latex_math":
            out.append("$" + re.sub(r"^(\$\$|\$|\\\[|\\\()|(\$\$|\$|\\\]|\\\))$", "", tok) + "$" if len(tok) > 2 else "")
        elif k == "latex_tie":
            out.append(" ")
        elif k == "wiki_heading":
            n = len(re.match(r"=+", tok).group())
            out.append("#" * n + " " + tok.strip().strip("=").strip())
        elif k == "md_heading":
            out.append(tok if s == 0 or text[s - 1] == "\n" else "")
        elif k == "md_setext":
            prev = "".join(out).rstrip("\n").rsplit("\n", 1)
            if tok[0] in "=-" and prev[-1].strip():
                out = [(prev[0] + "\n" if len(prev) == 2 else "") + ("# " if tok[0] == "=" else "## ") + prev[-1] + "\n"]
        elif k == "md_list":
            out.append("- ")
        elif k == "md_link":
            out.append(m.group(1) if (m := re.match(r"\[([^\]]*)\]", tok)) else "")
        elif k == "md_code":
            out.append(tok if len(tok) > 1 else "")
        elif k == "wiki_link" and tok.startswith("[http"):
            out.append(tok[1:-1].split(None, 1)[1])
        elif k in ("wiki_table", "md_table"):
            out.append("\t" if tok == "||" else "")
        # anything else is dropped
    out.append(text[at:end])
    # the null characters stand for that many characters of an argument which is dropped
    joined = "".join(out)
    res, i = [], 0
    while i < len(joined):
        j = joined.find("\0", i)
        if j < 0:
            res.append(joined[i:])
            break
        res.append(joined[i:j])
        n = j
        while n < len(joined) and joined[n] == "\0":
            n += 1
        i = n + (n - j)
    t = "".join(res)
    t = re.sub(r"[ \t]+\n", "\n", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def found(documents: DataFrame, sample: int = 1000) -> DataFrame:
    """(file_id) of every document of which the scan loses something to markup."""
    weights = learn_weights(documents, sample)

    @F.pandas_udf(T.BooleanType())
    def go(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: has_markup(t, weights)).astype(bool)

    return documents.where(go("full_text")).select("file_id")


def cleaned(documents: DataFrame, sample: int = 1000) -> DataFrame:
    """(file_id, clean_text)."""
    weights = learn_weights(documents, sample)

    @F.pandas_udf(T.StringType())
    def go(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: clean(t, weights))

    return documents.select("file_id", go("full_text").alias("clean_text"))
