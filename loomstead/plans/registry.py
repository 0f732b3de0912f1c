"""Where queries are registered, and the tables that they read.

An input is a view over the given tables, written once in SQL that Spark and DuckDB both run. A query is a function of
Tables; the SQL registered with it names the tables and inputs that it reads, and gets their definitions in front.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
INPUTS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _names(sql: str, of: list[str] | dict) -> list[str]:
    read = {m.lower() for m in re.findall(r"\b(?:FROM|JOIN|,)\s+([A-Za-z_]\w*)", sql, re.I)}
    return [n for n in of if n in read]


class Tables:
    """The given tables and the inputs over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in INPUTS:
            sql = INPUTS[name]
            used = _names(sql, [*BASE, *INPUTS])
            return self.spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", r"\1 {\2}", sql), **{n: getattr(self, n) for n in used})
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables, with the SQL for its rows if there is one."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_inputs(sql)
        return f

    return register


def with_inputs(sql: str) -> str:
    used, todo = [], _names(sql, INPUTS)
    while todo:
        n = todo.pop()
        used = [n, *(x for x in used if x != n)]
        todo += _names(INPUTS[n], INPUTS)
    head = ", ".join(f"{n} AS ({INPUTS[n]})" for n in used)
    body = sql.strip()
    if not head:
        return body
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    return f"WITH {m[1] or ''}{head}, {body[m.end():]}" if m else f"WITH {head} {body}"
