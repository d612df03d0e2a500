"""Streams over several micro-batches against the batch result."""

import pytest
from pyspark.sql import functions as F

from beckon.operators import point_in_time as pit
from beckon.operators.history import HistoryTables
from beckon.plans import queries, routing, traffic
from beckon.streaming import live, streams

START = "2024-01-11"


@pytest.fixture
def batches(monkeypatch):
    """Numbers of micro-batches that read rows."""
    seen, drain = [], streams.drain
    monkeypatch.setattr(streams, "drain", lambda *a, **k: seen.append(drain(*a, **k)))
    return seen


@pytest.fixture(scope="module")
def tables(spark):
    import os

    import __spark_entry__ as entry

    if not os.path.isdir(entry.SMALL):
        pytest.skip("tables not present")
    return entry.SMALL, traffic.tables(spark, entry.SMALL)


def everything(t):
    """All messages as history, as a stream sees them."""
    return HistoryTables(t.messages, t.reactions, t.daily, t.relations, t.members)


def test_live_features_equal_the_batch(spark, tables, batches):
    folder, t = tables
    got = {r.message_id: r for r in queries.QUERIES["stream_live_features"](spark, folder).collect()}
    assert batches[0] >= 4
    late = t.messages.where(F.col("created_at") >= F.lit(START).cast("timestamp"))
    want = pit.history_features_as_of(late, everything(t)).collect()
    assert len(got) == len(want)
    for r in want:
        assert all(abs(got[r.message_id][c] - r[c]) < 1e-5 for c in live.FEATURES), r.message_id
    assert any(r.user_total_opens > 0 for r in want)


def test_live_routing_equals_the_batch(spark, tables, batches):
    folder, t = tables
    got = {r.message_id: tuple(r) for r in queries.QUERIES["stream_route_live"](spark, folder).collect()}
    assert batches[0] >= 4
    late = t.messages.where(F.col("created_at") >= F.lit(START).cast("timestamp"))
    features = pit.history_features_as_of(late, everything(t)).select(
        "message_id", *[c for b in routing.HISTORY_NEEDED for c in queries.hist.FEATURE_BLOCKS[b]])
    decided = routing.decide(late, t.accounts, t.history_tables, features=features)
    want = routing.finish(decided.withColumn("evidence_message_ids", F.lit("none"))).select(*queries.OUT)
    assert got == {r.message_id: tuple(r) for r in want.collect()}


def test_reactions_before_their_message_and_timers(spark, tmp_path):
    """A reaction that is read first waits for its message; forgotten messages take no reaction."""
    schema = f"{live.EVENT}, created_at timestamp"
    none = [None] * 4
    slices = [
        [("u", "m1", "reaction", "2024-01-01 10:05:00", None, None, 1, 0, 0, 0)],
        [("u", "m1", "message", "2024-01-01 10:00:00", "s", "personal", *none),
         ("u", "m2", "message", "2024-01-01 11:00:00", "s", "personal", *none)],
        [("u", "m3", "message", "2024-03-15 00:00:00", "s", "personal", *none)],
        [("u", "m4", "message", "2024-03-16 00:00:00", "s", "personal", *none)],
        [("u", "m2", "reaction", "2024-03-16 01:00:00", None, None, 1, 1, 0, 0),
         ("u", "m5", "message", "2024-03-16 02:00:00", "s", "personal", *none)]]
    for rows in slices:
        df = spark.createDataFrame([(*r, r[3]) for r in rows], schema.replace("at timestamp", "at string"))
        df.withColumns({c: F.to_timestamp(c) for c in ("at", "created_at")}).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    with live.rocksdb(spark):
        assert streams.drain(live.live_features(stream), str(tmp_path / "c"), str(tmp_path / "out")) == 5
    got = {r.message_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["m1"].sender_message_count == 0 and got["m2"].sender_message_count == 1 and got["m2"].sender_open_rate == 1
    # m2's reaction came after its message was forgotten: it counts for the user, not for the sender
    assert got["m5"].sender_message_count == 1 and got["m5"].user_total_replies == 1


def test_copies_in_different_batches_agree(spark, tables, batches):
    folder, _ = tables
    queries.QUERIES["stream_route_batches"](spark, folder).count()
    queries.QUERIES["stream_sender_stats"](spark, folder).count()
    assert all(n >= 2 for n in batches)


class Calls:
    """State of a recipient in memory that counts the calls."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, [], 0

    def _called(self, value=None):
        self.calls += 1
        return value

    def getMapState(self, name, *_):
        return State(self, name)

    getValueState = getMapState

    def registerTimer(self, at):
        self._called(self.timers.append(at))


class State:
    def __init__(self, owner, name):
        self.owner, self.own = owner, owner.values.setdefault(name, {})

    def exists(self):
        return self.owner._called(bool(self.own))

    def getValue(self, key):
        return self.owner._called(self.own.get(key))

    def updateValue(self, key, value):
        self.owner._called(self.own.__setitem__(key, value))

    def removeKey(self, key):
        self.owner._called(self.own.pop(key, None))

    def iterator(self):
        return self.owner._called(iter(self.own.items()))

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)


def test_a_call_reads_and_writes_state_once():
    """State calls follow senders, types and open messages, not all events; one timer covers the open ones."""
    from datetime import datetime, timedelta, timezone
    from types import SimpleNamespace

    from pyspark.sql import Row

    start, events = datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for i in range(100):
        at = start + timedelta(minutes=10 * i)
        common = dict(message_id=f"m{i}", **{c: None for c in live.FLAGS})
        events.append(Row(kind="message", at=at, sender_key="s", conversation_type="personal", **common))
        if i < 95:  # the last five wait
            common.update(message_opened=1)
            events.append(Row(kind="reaction", at=at + timedelta(minutes=5), sender_key=None, conversation_type=None, **common))
    handle, recipient = Calls(), live.Recipient([])
    recipient.init(handle)
    out = list(recipient.handleInputRows(("u",), iter(events), None))
    assert [r.sender_message_count for r in out] == [min(i, 95) for i in range(100)]
    assert handle.values["senders"][("s",)][:2] == (95, 95) and handle.values["types"][("personal",)] == (100, 0)
    assert set(handle.values["open"]) == {(f"m{i}",) for i in range(95, 100)} and not handle.values["early"]
    assert handle.calls < 30 and len(handle.timers) == 1
    # m95 to m97 are over; the next timer is that of m98
    passed = int((start + timedelta(minutes=975)).timestamp() * 1000) + live.WAIT_MS
    recipient.handleExpiredTimer(("u",), SimpleNamespace(getCurrentWatermarkInMs=lambda: passed),
                                 SimpleNamespace(getExpiryTimeInMs=lambda: handle.timers[0]))
    assert set(handle.values["open"]) == {("m98",), ("m99",)}
    assert handle.timers[1:] == [int((start + timedelta(minutes=980)).timestamp() * 1000) + live.WAIT_MS]


def test_messages_are_dealt_before_they_have_a_text(spark, monkeypatch):
    dealt, spread = [], traffic.spread
    monkeypatch.setattr(traffic, "spread", lambda df, *keys: dealt.append(df.columns) or spread(df, *keys))
    events = spark.sql("SELECT id AS event_id, timestamp'2024-01-01' AS ts, id % 7 AS user_id, 'view' AS event_type, "
                       "1.0D AS value, '{\"k\": 3}' AS props FROM range(250)")
    turns = spark.sql("SELECT id DIV 3 AS conv_id, id % 3 AS turn, 'user' AS role, concat('turn ', id) AS text FROM range(6)")
    made = traffic.messages_from_events(events, turns, {"supplier": 3, "part": 3, "customer": 3, "nation": 3})
    got = {r.message_id: r.tail for r in made.collect()}
    assert got == {f"message_{i}": f"turn {i // 100 * 3 + i % 3}" if i < 200 else None for i in range(250)}
    assert dealt and not any({"text", "tail", "message_text"} & set(columns) for columns in dealt)
