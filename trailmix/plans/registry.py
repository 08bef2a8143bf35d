"""Registration of queries, and the SQL parts that several statements share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_RAW: dict[str, str] = {}
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    """A named common table expression; statements that mention it get it prepended."""
    PARTS[name] = sql


def statement(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in PARTS:
            if word not in needed and re.search(rf"\b{word}\b", text):
                visit(PARTS[word])
                if word not in needed:
                    needed.append(word)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in needed)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    return f"WITH {ctes},\n{body[len('WITH '):]}" if body.startswith("WITH ") else f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            _RAW[name] = sql
        return fn

    return register


def oracles() -> dict[str, str]:
    """SQL of every query that has one, with the shared parts prepended."""
    return {name: statement(sql) for name, sql in _RAW.items()}


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round result columns; adding 0.0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in cols})


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})
