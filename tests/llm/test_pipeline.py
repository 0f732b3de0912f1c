"""The pipeline's stages, one by one and together, against slow versions and on awkward tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from loomstead.llm import mixing
from tests.llm.test_operators import ROWS, SCHEMA, brute_items, components_of, pairs, prose, slow_targets

STAGES = dict(pipeline.STAGES)
ITEMS = [(i, prose(20, 600 + i)) for i in range(6)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows():
    """Prose of several sources, near copies, benchmark passages, junk, nulls, repeated rows."""
    r, out = random.Random(21), list(ROWS)
    for i in range(60):
        w = prose(80, 2000 + i % 40).split()
        if i % 40 < 20:
            w[r.randrange(80)] = "changed"
        if i % 9 == 0:
            w[40:40] = ITEMS[i % 6][1].split()
        out.append((100 + i, " ".join(w), "en", r.choice("abc"), 1))
    return out + [(300, "spam " * 40, "en", "a", 1), (None, None, None, None, None)]


def rows_of(df):
    return pairs(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_takes_empty_tables_and_clashing_columns(spark, folder, name):
    none = spark.createDataFrame([], SCHEMA)
    assert STAGES[name](spark, none, folder).count() == 0
    clash = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(7) for c in ("kept", "row", "copies_", "k1_", "k2_", "d_", "n_", "items", "size_", "g_", "C", "slot_")})
    out = STAGES[name](spark, clash, folder)
    assert set(clash.columns) <= set(out.columns) and (name == "sharding" or out.columns == clash.columns)
    assert out.count() > 0


def test_quality_keeps_the_clean_rows(spark, folder, rows):
    got = {r.doc_id for r in STAGES["quality_rules"](spark, spark.createDataFrame(rows, SCHEMA), folder).collect()}
    assert {100 + i for i in range(60)} <= got and not got & {5, 6, 7, 8, 9, 10, 12, 300}


def test_near_duplicates_equal_brute_force(spark, folder, rows):
    got = rows_of(STAGES["near_duplicates"](spark, spark.createDataFrame(rows, SCHEMA), folder))
    low = {}
    for (doc_id, text, *_), (_, n, component) in zip(sorted(rows, key=repr), sorted_components(rows), strict=True):
        if n:
            key = component if component is not None else (doc_id, text)
            low.setdefault(key, []).append((doc_id is None, doc_id, text))
    want = [x for x in rows if not (x[1] or "").split()] + [min(x, key=repr) for x in low.values()]
    assert len(got) == len(want)
    assert {x[0] for x in got} == {x[0] if len(x) == 5 else x[1] for x in want}


def sorted_components(rows):
    """Components of the rows, in the order of their representation."""
    by_row = {}
    for row, found in zip(rows, unsorted_components(rows), strict=True):
        by_row.setdefault(repr(row), []).append(found)
    return [by_row[repr(r)].pop(0) for r in sorted(rows, key=repr)]


def unsorted_components(rows):
    ids = {}
    for k, row in enumerate(rows):  # unique stand-ins for ids, so that each row finds its own component
        ids[k] = row
    found = {f[0]: f for f in components_of([(k, *row[1:]) for k, row in ids.items()], 5, 4, 5)}
    groups = {}
    for k in ids:
        groups.setdefault(found[k][2], []).append(ids[k][0])
    return [(ids[k][0], found[k][1], min((i for i in groups[found[k][2]] if i is not None), default=None)) for k in ids]


def test_decontamination_equals_brute_force(spark, folder, rows):
    got = rows_of(STAGES["decontamination"](spark, spark.createDataFrame(rows, SCHEMA), folder))
    assert got == pairs(x for x in rows if not brute_items(x[1], ITEMS)) and len(got) < len(rows)


def test_mixing_comes_near_the_targets(spark, folder, rows):
    got = STAGES["mixing"](spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    n = lambda t: len((t or "").split())
    sizes, taken, times, there = {}, {}, {}, {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + n(text)
        there[text] = there.get(text, 0) + 1
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + n(r.text)
        times[r.text] = times.get(r.text, 0) + 1
    assert all(times[t] <= mixing.MOST_COPIES * there[t] for t in times if t)
    largest = {s: max(n(x[1]) for x in rows if x[3] == s) for s in sizes}
    for s, goal in slow_targets(sizes).items():
        assert abs(taken.get(s, 0) - goal) <= largest[s], s


def test_sharding_keeps_groups_and_is_near_equal(spark, folder, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = STAGES["sharding"](spark, docs, folder).collect()
    assert pairs(tuple(r)[:5] for r in got) == pairs(rows)
    shards, slots = {}, {}
    for r in got:
        shards.setdefault(r.text or "", set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in shards.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_applies_every_stage(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema if name != "sharding" else None) if name != "sharding" else stage(spark, docs, folder)
    got = pipeline.run(spark, folder)
    assert sorted(got.columns) == sorted([*(c.split()[0] for c in SCHEMA.split(", ")), "shard", "slot"])
    order = ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    assert rows_of(got.select(*order)) == rows_of(docs.select(*order))
