"""The SQL surface: read-only queries over registered tables, with a guard and a few templates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MOST = 10_000
# Statements that change something.
DENIED = "insert update delete drop alter create truncate merge grant revoke exec execute call copy attach detach replace".split()


def guard(query: str, limit: int | None = None) -> str:
    """The query if it only reads: one SELECT or WITH statement, no comment, nothing that changes data outside of literals."""
    q = (query or "").strip().rstrip(";").strip()
    if not q or len(q) > MOST:
        raise ValueError("a query of 1 to 10,000 characters is needed")
    bare = re.sub(r"'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\"", "''", q)
    if not re.match(r"(?is)\s*(select|with)\b", bare):
        raise ValueError("only SELECT is allowed")
    if ";" in bare or "--" in bare or "/*" in bare:
        raise ValueError("one statement without comments is allowed")
    if m := re.search(rf"(?i)\b({'|'.join(DENIED)})\b(?!\s*\()", bare):
        raise ValueError(f"{m[1].upper()} is not allowed")
    return f"{q} LIMIT {limit}" if limit is not None and not re.search(r"(?is)\blimit\s+\d+\s*$", bare) else q


def advice(query: str) -> list[str]:
    """Hints on a query's text."""
    out = []
    if re.search(r"(?i)select\s+\*", query):
        out.append("name the columns you need, so that only these are read")
    if not re.search(r"(?i)\bwhere\b", query):
        out.append("a filter lets files and row groups be skipped")
    if re.search(r"(?i)like\s+'%", query):
        out.append("a pattern that begins with % can't be pushed to the scan")
    return out


TEMPLATES = {
    "preview": "SELECT * FROM {table} LIMIT {n}", "count": "SELECT count(*) AS n FROM {table}", "columns": "SELECT {columns} FROM {table}",
    "nulls": "SELECT count_if({column} IS NULL) AS nulls, count(*) AS n FROM {table}", "distinct": "SELECT {column} AS value, count(*) AS n FROM {table} GROUP BY {column} ORDER BY n DESC, value",
    "numeric": "SELECT min({column}) AS lo, max({column}) AS hi, avg({column}) AS mean_value FROM {table}",
}


def run(spark: SparkSession, query: str, limit: int | None = None) -> DataFrame:
    return spark.sql(guard(query, limit))


def join_hints(tables: dict[str, list[str]]) -> list[str]:
    """JOIN statements for columns that two tables name alike but for a prefix."""
    out = []
    bare = lambda c: re.sub(r"^[a-z]{1,2}_", "", c)
    names = sorted(tables)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            out += [f"SELECT * FROM {a} JOIN {b} ON {a}.{x} = {b}.{y}" for x in tables[a] for y in tables[b] if bare(x) == bare(y) and bare(x).endswith(("key", "id"))]
    return out
