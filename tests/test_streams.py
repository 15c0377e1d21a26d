"""Streams in many triggers give what one pass over the rows in order gives."""

import os
import random
import shutil
import uuid
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridmill.plans.streaming_queries import _rocks
from gridmill.streaming import jobs

SCHEMA = "entrance long, event_id long, ts timestamp, arr_s double, service double, patience double"


def arrivals():
    rng = random.Random(5)
    rows = []
    for k in range(400):
        at = rng.randrange(0, 6 * 3600)
        rows.append((k % 3, k, datetime(2024, 3, 1, tzinfo=UTC) + timedelta(seconds=at), float(at), float(rng.randrange(60, 400)), float(rng.randrange(100, 900))))
    return sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(0, 500)))  # somewhat out of order


def in_triggers(spark, rows, schema, make, mode, path, parts=8):
    """Drain make(stream) with one file a trigger; every emitted row with its trigger."""
    at = f"{path}/{uuid.uuid4().hex}"
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(f"{at}/w{i}")
        part = next(f for f in os.listdir(f"{at}/w{i}") if f.endswith(".parquet"))
        os.makedirs(f"{at}/in", exist_ok=True)
        shutil.move(f"{at}/w{i}/{part}", f"{at}/in/{i:03}.parquet")
        os.utime(f"{at}/in/{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    got = []
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"))
    q = stream.writeStream.foreachBatch(lambda df, i: got.extend((i, r) for r in df.collect())).option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return got


def test_curb_queue_in_many_triggers(spark, tmp_path):
    rows = arrivals()
    with _rocks(spark):
        out = in_triggers(spark, rows, SCHEMA, lambda s: jobs.curb_queue(s, stretch_s=1800), "append", tmp_path)
    mark = max(r[2] for r in rows) - timedelta(minutes=10)
    want, free = {}, {}
    for entrance, event, ts, at, service, patience in sorted(rows, key=lambda r: (r[2], r[1])):
        if ts <= mark:
            wait = max(free.get(entrance, float("-inf")) - at, 0.0)
            if wait <= patience:
                free[entrance] = at + wait + service
            want[event] = (entrance, wait if wait <= patience else None, wait > patience)
    assert len({i for i, _ in out}) > 3
    assert {r.event_id: (r.entrance, r.wait, r.balked) for _, r in out} == want and len(out) == len(want)
    assert any(w[2] for w in want.values())


class FakeState:
    def __init__(self):
        self.rows, self.read = None, 0

    def exists(self):
        return self.rows is not None

    def get(self):
        if isinstance(self.rows, list):
            self.read += len(self.rows)
            return iter(self.rows)
        return self.rows

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows = (self.rows or []) + list(rows)

    def update(self, value):
        self.rows = value

    def clear(self):
        self.rows = None


class FakeHandle:
    def __init__(self):
        self.timers, self.list, self.value = set(), FakeState(), FakeState()

    def getListState(self, *_):
        return self.list

    def getValueState(self, *_):
        return self.value

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_rows_are_not_read_until_they_are_due():
    p, handle = jobs.Waiting(), FakeHandle()
    p.init(handle)
    for lo in range(100, 0, -10):  # ten triggers, each with earlier rows
        frame = pd.DataFrame({"ms": range(lo, lo + 10), "event_id": range(lo, lo + 10), "arr_s": 0.0, "service": 1.0, "patience": 1.0})
        assert list(p.handleInputRows((7, 0), iter([frame]), Mark(0))) == []
    assert handle.list.read == 0 and handle.timers == {9}
    (out,) = p.handleExpiredTimer((7, 0), Mark(54), None)
    assert handle.list.read == 100 and sorted(out.ms) == list(range(10, 55))
    (out,) = p.handleExpiredTimer((7, 0), Mark(500), None)
    assert sorted(out.ms) == list(range(55, 110)) and not handle.list.exists()


@pytest.mark.parametrize("most", [2, 10])
def test_chat_history_in_many_triggers(spark, tmp_path, most):
    rng = random.Random(most)
    rows = []
    for k in range(300):
        ts = datetime(2024, 3, 1, tzinfo=UTC) + timedelta(minutes=2 * k + rng.randrange(0, 5))
        if not (k % 3 == 0 and 40 < k < 180):  # persona 0 is silent for hours
            rows.append((k % 2, k % 3, k, f"m{k}", ts))
    with _rocks(spark):
        out = in_triggers(spark, rows, "player_id long, persona_id long, event_id long, text string, ts timestamp", lambda s: jobs.chat_history(s, most, 3600), "update", tmp_path)
    last = {}
    for i, r in out:
        last[r.player_id, r.persona_id] = r.messages
    want = {}
    for player, persona, event, text, ts in sorted(rows, key=lambda r: (r[4], r[2])):
        want.setdefault((player, persona), []).append((ts, text))
    want = {k: [t for ts, t in v if ts > v[-1][0] - timedelta(hours=1)][-most:] for k, v in want.items()}
    assert last == want
    assert max(len(r.messages) for _, r in out) <= most
