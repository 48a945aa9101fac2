"""Register of the checked queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stringwright.catalog.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its equivalent over the raw tables, where there is one."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return query

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def md5_32(expression: str) -> str:
    return f"('0x' || substr(md5({expression}), 1, 8))::BIGINT"


def md5_60(expression: str) -> str:
    return f"('0x' || substr(md5({expression}), 1, 15))::BIGINT"


def grams(value: str, n: int = 3, distinct: bool = True) -> str:
    """Character n-grams of a text as a list."""
    listed = f"[substr({value}, g::INT, {n}) FOR g IN range(1, greatest(length({value}) - {n} + 2, 1))]"
    return f"list_distinct({listed})" if distinct else listed


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) + len({b}) > 0 THEN {both}::DOUBLE / (len({a}) + len({b}) - {both}) ELSE 0.0 END"
    )
