"""Structured Streaming versions of the binned counts, vote totals, queues and sessions.

Each takes a streaming DataFrame with an event time `ts` (timestamp) and
returns one; late rows past the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def bin_volume(entries: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Entries per tumbling window and edge."""
    return entries.withWatermark("ts", delay).groupBy(F.window("ts", width), "edge_idx").agg(F.sum("w").alias("n")).select(F.col("window.start").alias("start"), "edge_idx", "n")


def peak_hour(entries: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Total of each hour, sliding by five minutes."""
    return entries.withWatermark("ts", delay).groupBy(F.window("ts", "60 minutes", "5 minutes")).agg(F.sum("w").alias("n")).select(F.col("window.start").alias("start"), "n")


def trip_sessions(points: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Points of a vehicle into trips that end after a gap."""
    s = points.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "vehicle").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("points"))
    return s.select("vehicle", "first", "last", "points")


class VoteTotals(StatefulProcessor):
    """The last vote of each player by (ts, event_id), and the running total of a plan."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.votes = handle.getMapState("votes", "player_id long", "ts timestamp, event_id long, value int")
        self.total = handle.getValueState("total", "total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = self.total.get()[0] if self.total.exists() else 0
        for batch in rows:
            for player, ts, event, value in zip(batch.player_id, batch.ts, batch.event_id, batch.value):
                player = (int(player),)
                old = self.votes.getValue(player) if self.votes.containsKey(player) else None
                if old is None or (pd.Timestamp(old[0]), old[1]) < (pd.Timestamp(ts).tz_localize(pd.Timestamp(old[0]).tz) if pd.Timestamp(ts).tz is None else pd.Timestamp(ts), event):
                    total += int(value) - (old[2] if old is not None else 0)
                    self.votes.updateValue(player, (ts, int(event), int(value)))
        self.total.update((total,))
        yield pd.DataFrame({"plan_id": [key[0]], "votes": [total]})

    def close(self) -> None:
        pass


def vote_totals(votes: DataFrame) -> DataFrame:
    """A changelog of plan totals. votes: plan_id, player_id, value, ts, event_id. Needs the RocksDB state store."""
    return votes.groupBy("plan_id").transformWithStateInPandas(VoteTotals(), "plan_id long, votes long", "Update", "None")


class Waiting(StatefulProcessor):
    """Rows of one stretch of time, handed on when the watermark has passed them: appended unread, read by a timer for the earliest of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "ms long, event_id long, arr_s double, service double, patience double")
        self.first = handle.getValueState("first", "ms long")

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(ms - 1)  # timers go off once the watermark is past them
        self.first.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(m), int(e), float(a), float(s), float(p)) for b in rows for m, e, a, s, p in zip(b.ms, b.event_id, b.arr_s, b.service, b.patience)]
        self.rows.appendList(new)
        first, known = min(r[0] for r in new), self.first.get()[0] if self.first.exists() else None
        if known is None or first < known:
            if known is not None:
                self.handle.deleteTimer(known - 1)
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.rows.get()]
        ready, rest = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        if rest:
            self.rows.put(rest)
            self._wake(min(r[0] for r in rest))
        else:
            self.rows.clear()
            self.first.clear()
        if ready:
            yield pd.DataFrame([(key[0], *r) for r in ready], columns=["entrance", "ms", "event_id", "arr_s", "service", "patience"])

    def close(self) -> None:
        pass


class Line(StatefulProcessor):
    """A queue with patience: one number of state, when the curb is free again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.free = handle.getValueState("free", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        free = self.free.get()[0] if self.free.exists() else float("-inf")
        out = []
        for _, event, at, service, patience in sorted(r for b in rows for r in zip(b.ms, b.event_id, b.arr_s, b.service, b.patience)):
            wait = max(free - at, 0.0)
            stays = wait <= patience
            free = at + wait + service if stays else free
            out.append((key[0], event, wait if stays else None, not stays))
        self.free.update((float(free),))
        yield pd.DataFrame(out, columns=["entrance", "event_id", "wait", "balked"])

    def close(self) -> None:
        pass


def curb_queue(arrivals: DataFrame, delay: str = "10 minutes", stretch_s: int = 3600) -> DataFrame:
    """Waits at a queue with patience. Rows wait until the watermark has passed them, then are served in order.

    arrivals: entrance, event_id, arr_s, service, patience, ts. Rows wait in one
    list for each entrance and stretch of time, so a trigger reads the lists it
    serves from, not all that waits; what it serves is sorted. Needs the RocksDB
    state store.
    """
    ms = F.unix_millis("ts")
    waiting = arrivals.withWatermark("ts", delay).withColumn("ms", ms).withColumn("stretch", F.floor(ms / F.lit(stretch_s * 1000)))
    ready = waiting.groupBy("entrance", "stretch").transformWithStateInPandas(Waiting(), "entrance long, ms long, event_id long, arr_s double, service double, patience double", "Append", "EventTime")
    return ready.groupBy("entrance").transformWithStateInPandas(Line(), "entrance long, event_id long, wait double, balked boolean", "Append", "None")


class History(StatefulProcessor):
    """The last messages of a conversation, the state bounded by their number; a timer drops it when nothing has come for long."""

    def __init__(self, most: int, keep_ms: int):
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "ms long, event_id long, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        new = [(int(m), int(e), t) for b in rows for m, e, t in zip(b.ms, b.event_id, b.text)]
        kept = sorted(set(old + new), key=lambda r: r[:2])
        last = kept[-1][0]
        kept = [r for r in kept if r[0] > last - self.keep_ms][-self.most :]
        if old:
            self.handle.deleteTimer(old[-1][0] + self.keep_ms)
        self.handle.registerTimer(last + self.keep_ms)
        self.rows.put(kept)
        yield pd.DataFrame({"player_id": [key[0]], "persona_id": [key[1]], "messages": [[t for _, _, t in kept]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        yield from ()

    def close(self) -> None:
        pass


def chat_history(messages: DataFrame, most: int = 10, keep_s: int = 30 * 86400, delay: str = "10 minutes") -> DataFrame:
    """A changelog of each player's last `most` messages with a persona, oldest first, by (ts, event_id); those `keep_s` older than the last are left out.

    messages: player_id, persona_id, event_id, text, ts. Messages that come late
    but before the watermark take their place. Needs the RocksDB state store.
    """
    rows = messages.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("player_id", "persona_id").transformWithStateInPandas(History(most, keep_s * 1000), "player_id long, persona_id long, messages array<string>", "Update", "EventTime")


def text_guard(messages: DataFrame, allowed: list[float], longest: int = 280) -> DataFrame:
    """Messages whose numbers are all allowed, white space squeezed, cut at a word's end. Stateless."""
    from gridmill.functions.scalars import numbers_ok

    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    cut = F.when(F.length(text) <= longest, text).otherwise(F.regexp_extract(F.substring(text, 1, longest + 1), r"^(.*)\s", 1))
    return messages.where(numbers_ok(F.col("text"), F.array(*[F.lit(float(a)) for a in allowed]))).withColumn("text", cut)
