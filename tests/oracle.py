"""Runs a registered query and its SQL, and compares rows whatever their order."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def text_of(v) -> str:
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(text_of, v)) + "]"
    if isinstance(v, dict):
        return text_of(list(v.values()))
    if hasattr(v, "asDict"):
        return text_of(list(v))
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "-"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if v == int(v) else f"{v:.7g}"
    return str(v)


def rows_of(pdf) -> list[str]:
    return sorted("|".join(text_of(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def compare(spark, sf_dir: str, query, sql: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), database(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def leftovers(folder: str) -> list[str]:
    return glob.glob(f"{folder}/**", recursive=True)
