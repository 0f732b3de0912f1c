from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from loomstead import plans
from tests.oracle import compare


def test_entry(spark):
    suppliers = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    got = entry.entry(spark)
    assert got.count() == suppliers and got.columns == entry.entry(spark).columns


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """With both llm folders and the pipeline gone, or the folders alone, the other queries are still listed."""
    root = Path(entry.__file__).parent
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 180 and set(s) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']"
    for gone in (("loomstead/llm", "tests/llm", "corpus_pipeline.py"), ("loomstead/llm", "tests/llm")):
        copy = tmp_path / str(len(gone))
        shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or str((Path(folder) / n).relative_to(root)) in gone])
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_every_sql_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, plans.queries()[name], plans.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    df = plans.queries()[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() >= 0
