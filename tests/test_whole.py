from __future__ import annotations

import random

import pytest

from loomstead import plans, streaming
from loomstead.plans.registry import Tables
from tests.oracle import TABLES, compare

REL = {"A": "is_part_of", "N": "depends_on"}


def test_topic_edges_take_every_lineitem_row(spark, sf):
    plans.queries()  # registers the inputs
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_returnflag").collect()
    want = {(r.l_suppkey, 1_000_000 + r.l_partkey, REL.get(r.l_returnflag, "references")) for r in rows}
    assert {tuple(r) for r in Tables(spark, sf).topic_edges.select("source_id", "target_id", "rel").collect()} == want


@pytest.mark.parametrize("name", ["S02_tumbling_totals", "S03_bursts"])
def test_replays_of_several_files_count_all_rows(spark, sf, tmp_path, name):
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(4):  # each file spans the whole time
        events.filter(f"event_id % 4 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) == 4
    compare(spark, str(tmp_path), plans.queries()[name], plans.oracle_sql()[name])


def test_throttle_runs_through_a_hot_key_in_small_batches(spark):
    r = random.Random(3)
    rows = [(i, None if i % 10 == 9 else 1 if i % 3 else r.randint(2, 9), None if i % 90 == 7 else r.randint(0, 4000)) for i in range(900)]
    want, state = {}, {}
    for i, user, at in sorted(rows, key=lambda x: (str(x[1]), x[2] is None, x[2] or 0, x[0])):
        opened, used = state.get(user, (None, 0))
        if opened is None or at is not None and at >= opened + 60:
            opened, used = at, 0
        state[user] = (opened, used + 1)
        want[i] = (user, used < 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame(rows, "id long, user long, s long").selectExpr("id", "user", "timestamp_seconds(s) AS created_at")
        out = streaming.throttle(df, "user", 2, 60.0)
        assert {x.id: (x.user, x.allowed) for x in out.collect()} == want
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # which holds a key in one frame
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
