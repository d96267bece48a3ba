"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Six places, nudged so that exact halves round the same way in both engines."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 10.0 ** -(digits + 3), digits)


def keep(df: DataFrame, *columns: str, rnd: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Plain columns followed by rounded ones."""
    return df.select(*columns, *[rounded(c, digits).alias(c) for c in rnd])


def R(expr: str, alias: str, digits: int = 6) -> str:
    """SQL of ``rounded``."""
    return f"round(({expr}) + 1e-{digits + 3}, {digits}) + 0.0 AS {alias}"


def with_ctes(body: str) -> str:
    """Prefix a statement with the named views it uses, in definition order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{n} AS ({CTES[n].strip()})" for n in CTES if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(use_utc(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return add
