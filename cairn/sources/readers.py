"""Readers for tables and documents.

Tables are read lazily and whole; nothing is sampled. Malformed CSV lines go to a column of their own or
are dropped, as asked. Defined results: an unknown extension is an error; an empty file gives an empty
table with a warning column list of what the header says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cairn.operators.clean import clean_names

FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "orc": "orc"}


def load(spark: SparkSession, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """The table at ``path`` by its extension; column names are made unique and NaN-free types kept."""
    ext = re.sub(r".*\.", "", path.rstrip("/")).lower()
    if ext not in FORMATS:
        raise ValueError(f"unknown format {ext!r}; known: {', '.join(sorted(FORMATS))}")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if FORMATS[ext] == "csv":
        df = r.options(**({"header": True, "sep": "\t" if ext == "tsv" else ",", "inferSchema": schema is None, "mode": "PERMISSIVE"} | options)).csv(path)
    elif FORMATS[ext] == "json":
        df = flatten(r.options(**({"multiLine": ext == "json"} | options)).json(path))
    else:
        df = r.format(FORMATS[ext]).options(**options).load(path)
    return df.toDF(*clean_names(df.columns))


def sniff(head: bytes) -> tuple[str, str]:
    """(encoding, delimiter) of the first bytes of a CSV file."""
    enc = "UTF-16" if head[:2] in (b"\xff\xfe", b"\xfe\xff") else "UTF-8"
    try:
        text = head.decode("utf-16" if enc == "UTF-16" else "utf-8-sig")
    except UnicodeDecodeError as e:
        if e.start >= len(head) - 4:  # cut in the middle of a character
            text = head[: e.start].decode("utf-8")
        else:
            enc, text = "ISO-8859-1", head.decode("latin-1")
    lines = [x for x in text.splitlines()[:20] if x.strip()]
    best = max(",;\t|", key=lambda d: (min([x.count(d) for x in lines] or [0]), -",;\t|".index(d)))
    return enc, best


def _head(spark: SparkSession, path: str, size: int = 65536) -> bytes:
    """The first bytes of a file, or of the first file with content below a folder, through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        found = sorted((x.getPath().toString() for x in fs.listStatus(p) if x.isFile() and x.getLen() and not x.getPath().getName().startswith(("_", "."))))
        if not found:
            return b""
        p = spark._jvm.org.apache.hadoop.fs.Path(found[0])
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


#: The column of lines that fit no row.
BAD = "_bad_line"


def load_resilient(spark: SparkSession, path: str, keep_bad: bool = True) -> DataFrame:
    """A CSV of unknown encoding and delimiter; ``_bad_line`` holds the lines that don't fit the header, null for the others.

    The driver sees the first 64 kilobytes only. Bytes that aren't UTF-8 further on come back as replacement
    characters, which ``has_damage`` counts; the caller may then load with another encoding.
    """
    enc, sep = sniff(_head(spark, path))
    how = dict(header=True, encoding=enc, sep=sep, mode="PERMISSIVE")
    schema = spark.read.options(**how, inferSchema=True).csv(path).schema
    if keep_bad:
        schema = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    df = spark.read.options(**how, columnNameOfCorruptRecord=BAD, enforceSchema=True).schema(schema).csv(path)
    names = clean_names([c.lstrip("\ufeff") for c in df.columns if c != BAD])
    return df.toDF(*names, *([BAD] if keep_bad else []))


def has_damage(df: DataFrame) -> DataFrame:
    """(column_name, damaged): cells with replacement characters, by column."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").contains("\ufffd")).alias(c) for c in names], F.lit(0).alias("_"))
    return wide.unpivot(["_"], names, "column_name", "damaged").select("column_name", "damaged")


def flatten(df: DataFrame) -> DataFrame:
    """Nested structures as columns with dotted names."""

    def walk(prefix: str, schema: T.StructType) -> list[Column]:
        out = []
        for f in schema:
            p = f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                out += walk(p, f.dataType)
            else:
                out.append(F.col(p).alias(p.replace("`", "")))
        return out

    return df.select(*walk("", df.schema))


class _Page(HTMLParser):
    SKIP = {"script", "style", "noscript", "iframe", "head", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.text, self.title, self.links, self.in_title, self.lang, self.flags = 0, [], [], {}, False, None, set()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title":
            self.in_title = True
        elif tag in self.SKIP:
            self.depth += 1
        elif tag == "a" and a.get("href") and not a["href"].startswith("#"):
            self.links.setdefault(a["href"])
        elif tag == "html":
            self.lang = a.get("lang")
        if tag in ("table", "img"):
            self.flags.add(tag)
        if tag in ("p", "br", "li", "tr", "div", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.SKIP and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.depth:
            self.text.append(data)


_PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType())), T.StructField("lang", T.StringType()), T.StructField("has_table", T.BooleanType()), T.StructField("has_image", T.BooleanType())])


@F.pandas_udf(_PAGE)
def parse_html(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Title, visible text, links, language and flags of an HTML page; null for null."""

    def one(t):
        p = _Page()
        if t:
            p.feed(t)
        text = re.sub(r"\n\s*\n+", "\n", "".join(p.text)).strip()
        return ("".join(p.title).strip() or None, text, list(p.links), p.lang, "table" in p.flags, "img" in p.flags)

    for b in batches:
        yield pd.DataFrame([one(t) for t in b], columns=["title", "text", "links", "lang", "has_table", "has_image"])


def _plain_line(line: str) -> str:
    """The words of one Markdown line: read from left to right, a mark at a time."""
    indent = len(line) - len(line.lstrip(" \t"))
    body = line[indent:]
    if len(body) >= 3 and body.rstrip() and len(set(body.rstrip())) == 1 and body[0] in "-*_":
        return ""
    level = len(body) - len(body.lstrip("#"))
    if 0 < level <= 6 and body[level : level + 1] in (" ", "\t"):
        indent, body = 0, body[level:].lstrip(" \t")
    elif body.startswith(">"):
        indent, body = 0, body[1:].removeprefix(" ")
    out, i = [" " * indent], 0
    while i < len(body):
        c, two = body[i], body[i : i + 2]
        if c == "`" and (end := body.find("`", i + 1)) > i + 1:
            out.append(body[i + 1 : end])
            i = end + 1
        elif two in ("**", "__", "~~"):
            i += 2
        elif (c == "[" or two == "![") and (mid := body.find("](", i)) > 0 and (end := body.find(")", mid)) > 0 and "[" not in body[i + len(two.rstrip("[")) + 1 : mid]:
            out.append(body[body.index("[", i) + 1 : mid])
            i = end + 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


@F.pandas_udf(T.StringType())
def strip_markdown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text without the marks of Markdown; lines between fences stay as they are; null for null."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out, fenced = [], False
        for line in text.split("\n"):
            if line.startswith(("```", "~~~")):
                fenced = not fenced
            else:
                out.append(line if fenced else _plain_line(line))
        return "\n".join(out)

    for b in batches:
        yield b.map(one)


def markdown_parts(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, headings, links, code_spans): how many of each."""
    n = lambda rx: F.regexp_count(F.coalesce(F.col(name), F.lit("")), F.lit(rx))
    return df.select(key, n(r"(?m)^#{1,6}[ \t]+[^ \t\n]").alias("headings"), n(r"\[[^\]\n]+\]\([^)\n]+\)").alias("links"), n(r"`[^`\n]+`").alias("code_spans"))


def load_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, fmt, text) of every text document below a folder, one per row."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(path)
    return t.select(F.col("_metadata.file_path").alias("path"), F.lower(F.regexp_extract("_metadata.file_path", r"\.([A-Za-z0-9]+)$", 1)).alias("fmt"), F.col("value").alias("text"))


def sections(documents: DataFrame) -> DataFrame:
    """(file_id, section_index, section_type, text, word_count, char_count) of documents with pages."""
    x = documents.select("file_id", F.explode("pages").alias("p"))
    words = F.size(F.filter(F.split(F.coalesce("p.page_text", F.lit("")), r"[ \t\r\n]+"), lambda w: w != ""))
    return x.select("file_id", "p.section_index", "p.section_type", F.col("p.page_text").alias("text"), words.alias("word_count"), F.length("p.page_text").alias("char_count"))


def jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """A database query, after the guard of ``sql``; the driver jar comes with the session."""
    from cairn.sources.sql import guard

    return spark.read.format("jdbc").options(url=url, query=guard(query), **options).load()
