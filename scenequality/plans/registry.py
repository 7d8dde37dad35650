"""Registration of queries next to their SQL oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scenequality.operators.running import PRIME
from scenequality.plans.bindings import oracle_with, sharing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), oracle: str | None = None, ctes: str = ""):
    """Register ``fn(spark, sf_dir)``; ``oracle`` is a SELECT over ``views`` and extra ``ctes``."""

    def add(fn):
        @functools.wraps(fn)
        def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
            with sharing():
                return fn(spark, sf_dir)

        QUERIES[name] = shared
        if oracle is not None:
            head = oracle_with(*views) if views else ""
            parts = [p for p in (head, ctes) if p]
            text = ",\n".join(parts)
            if ctes and not views:
                text = "WITH " + text
            ORACLES[name] = _expand_half_even(f"{text}\n{oracle}")
        return fn

    return add


def _expand_half_even(sql: str) -> str:
    """Write ``half_even(expression, digits)`` out as exact decimal printing of the snapped value."""
    word = "half_even("
    while word in sql:
        start = sql.rindex(word)
        at, depth, comma = start + len(word), 1, None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            if sql[at] == "," and depth == 1:
                comma = at
            at += 1
        inner, digits = sql[start + len(word):comma], sql[comma + 1:at - 1].strip()
        sql = f"{sql[:start]}(CAST(printf('%.{digits}f', CAST(round({inner}, 9) AS DOUBLE)) AS DOUBLE) + 0.0e0){sql[at:]}"
    return sql


def r6(column: Column, name: str) -> Column:
    """Six decimals, without a negative zero."""
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def sql6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0e0 AS {name}"


def mix_items(out: str, parts: list[str], seed: int) -> str:
    """Select items (using earlier aliases) that end in ``out``: the oracle's copy of running.mix."""
    items, state = [], f"CAST({seed} AS BIGINT)"
    for i, part in enumerate(parts):
        a, b, c = (f"{out}_{i}{s}" for s in "abc")
        last = out if i == len(parts) - 1 else f"{out}_{i}"
        items += [f"({state} * 48271 + CAST({part} AS BIGINT) % {PRIME} + 12345) % {PRIME} AS {a}",
                  f"({a} * {a} + 104729) % {PRIME} AS {b}", f"({b} * 69621 + 7919) % {PRIME} AS {c}",
                  f"({c} * {c} + 104729) % {PRIME} AS {last}"]
        state = last
    return ", ".join(items)
