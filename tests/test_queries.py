"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracles import ORACLES, TABLES
from tools.check import rows_of

SMALL = entry.SMALL
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables not present")
def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(
        columns, cursor.fetchall())


def test_route_keeps_every_message_once(spark):
    rows = entry.entry(spark).collect()
    ids = [r["message_id"] for r in rows]
    assert ids and len(ids) == len(set(ids))
    for row in rows:
        assert row["reason"] and 0 <= row["confidence"] <= 1
        if row["message_type"] in ("scam", "spam"):
            assert row["action"] == "mute"


def test_route_repeats_itself(spark):
    """The same decisions again, from other partitions in another order."""
    from beckon.operators import evidence as ev
    from beckon.plans import routing, traffic

    t = traffic.tables(spark, SMALL)
    runs = []
    for order in ("message_id", "text_order"):
        messages = t.incoming.withColumn("text_order", traffic.F.xxhash64("message_text")).repartition(
            3, order).sortWithinPartitions(order).drop("text_order")
        routed = routing.route(messages, t.accounts, t.history_tables, ev.TfIdf.fit(t.history),
                               traffic.scored(t.incoming))
        runs.append(sorted(map(tuple, routed.collect())))
    assert runs[0] == runs[1] and runs[0]
