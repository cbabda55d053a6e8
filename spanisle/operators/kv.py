"""Sorted key-value tables: DataFrames of (row, cf, cq, value), all text, in the order of row, family and qualifier."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tokens import QuerySyntaxError
from ..session import wide

KEYS = ["row", "cf", "cq"]


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"' r"|'(?:[^'\\]|\\.)*'", re.S)


def _double_quoted(m: re.Match) -> str:
    """A quoted string as JSON has it; in one between double quotes an apostrophe is a letter as any."""
    if m[0][0] == '"':
        return m[0]
    return '"' + re.sub(r"\\(.)|(\")", lambda x: "'" if x[1] == "'" else '\\"' if x[2] or x[1] == '"' else x[0], m[0][1:-1], flags=re.S) + '"'


def parse_scan(text: str) -> dict:
    """`{'op': 'scan', 'table': t, 'range': {'start': [row, cf, cq], 'end': [...]}}`; single quotes are allowed."""
    try:
        q = json.loads(text)
    except json.JSONDecodeError:
        try:
            q = json.loads(_STRING.sub(_double_quoted, text))
        except json.JSONDecodeError as e:
            raise QuerySyntaxError(f"not a JSON query: {e}") from None
    if not isinstance(q, dict) or "op" not in q or "table" not in q:
        raise QuerySyntaxError("a query names an op and a table")
    return q


def _key(parts: list) -> Column:
    parts = [*parts, None, None, None][:3]
    return F.struct(*(F.lit("" if p is None else str(p)).alias(k) for k, p in zip(KEYS, parts, strict=True)))


def scan(df: DataFrame, start: list | None = None, end: list | None = None, end_inclusive: bool = False) -> DataFrame:
    """Entries from start on and before end, in order.  Bounds on the row alone are kept apart so that they reach the files."""
    key = F.struct(*(F.coalesce(F.col(k), F.lit("")).alias(k) for k in KEYS))
    if start:
        df = df.where(F.col("row") >= F.lit("" if start[0] is None else str(start[0]))).where(key >= _key(start))
    if end:
        df = df.where(F.col("row") <= F.lit("" if end[0] is None else str(end[0]))).where(key <= _key(end) if end_inclusive else key < _key(end))
    return df.orderBy(*KEYS)


def rendered(df: DataFrame) -> DataFrame:
    """(row, column, value) as results show entries: the column is cf:cq, or null where both are empty."""
    cf, cq = (F.coalesce(F.col(c), F.lit("")) for c in ("cf", "cq"))
    return df.select("row", F.when((cf != "") | (cq != ""), F.concat(cf, F.lit(":"), cq)).alias("column"), "value")


def to_kv(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """An entry for each value that is not null: row from the key columns, family the column's number, qualifier its name."""
    cols = df.columns
    if keys:
        row = F.concat_ws("|", *(F.col(f"`{k}`").cast("string") for k in keys))
    else:
        from .array import numbered

        df, row = numbered(df, "_row", []), F.lpad(F.col("_row").cast("string"), 12, "0")
    cells = F.array(*(F.struct(F.lit(str(i + 1)).alias("cf"), F.lit(c).alias("cq"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(cols)))
    return df.select(row.alias("row"), F.explode(cells).alias("c")).select("row", "c.*").where("value IS NOT NULL")


def from_kv(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """A row for each row key; qualifiers, in lower case, are columns.  Names and types are given, so no job looks for them."""
    if columns is None:
        names = [r[0] for r in df.select(F.lower("cq")).distinct().orderBy(F.lower("cq")).limit(1001).collect()]  # column names
        if len(names) > 1000:
            raise ValueError("more than 1000 qualifiers; name the columns")
        columns = dict.fromkeys(names, "string")
    known = [c.lower() for c in columns]
    low = F.lower("cq")
    bad = F.max(F.when(~low.isin(known), low))
    cols = [F.max_by(F.when(low == c.lower(), F.col("value")), F.when(low == c.lower(), F.col("cf"))).cast(t).alias(c) for c, t in columns.items()]
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("no column for "), bad))).otherwise(F.first("row"))
    return df.groupBy("row").agg(checked.alias("_row"), *cols).select(F.col("_row").alias("row"), *columns) if "row" not in known else df.groupBy(F.col("row").alias("_k")).agg(*cols).drop("_k")


def aggregate(df: DataFrame, fn: str, by: list[str]) -> DataFrame:
    """count, sum, min, max or avg of values as numbers, by parts of the key."""
    v = F.col("value") if fn in ("count", "min", "max") else F.expr("try_cast(value AS DOUBLE)")
    return df.groupBy(*by).agg({"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[fn](v).alias("value"))


def terms(df: DataFrame, key: str, text: str, prefix: str = "word") -> dict[str, DataFrame]:
    """The four tables of a text corpus: edges (document to term), their transpose, term degrees, and the raw text."""
    df = wide(df.select(key, text))
    words = F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9]+"), lambda w: w != "")
    row = F.col(key).cast("string").alias("row")
    each = df.select(row, F.explode(words).alias("w"))
    once = df.select(row, F.explode(F.array_distinct(words)).alias("w")).distinct()  # rows may share a key
    n = each.groupBy("row", "w").agg(F.count("*").alias("n"))
    term = F.concat(F.lit(f"{prefix}|"), F.col("w"))
    edge = n.select("row", F.lit("").alias("cf"), term.alias("cq"), F.col("n").cast("string").alias("value"))
    return {
        "edge": edge,
        "transpose": edge.select(F.col("cq").alias("row"), "cf", F.col("row").alias("cq"), "value"),
        "degree": once.groupBy("w").agg(F.count("*").alias("d")).select(term.alias("row"), F.lit("").alias("cf"), F.lit("degree").alias("cq"), F.col("d").cast("string").alias("value")),
        "text": df.select(F.col(key).cast("string").alias("row"), F.lit("").alias("cf"), F.lit("text").alias("cq"), F.col(text).alias("value")).where("value IS NOT NULL"),
    }


def moved(new: DataFrame, old: DataFrame, updated: DataFrame, deleted: DataFrame) -> DataFrame:
    """What a table holds during an online move: the new rows and the old ones that were neither updated nor deleted."""
    return new.unionByName(old.exceptAll(updated.unionByName(deleted)))


def latest(df: DataFrame, version: str) -> DataFrame:
    """The entry of the greatest version for each key."""
    w = Window.partitionBy(*KEYS).orderBy(F.col(version).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
