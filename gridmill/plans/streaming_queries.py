"""Streaming jobs over the events table, run until the input is used up; each result equals its batch counterpart."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from gridmill.operators.network import shared_folder
from gridmill.registry import query
from gridmill.streaming import jobs


def _events(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads folders: the table's file is picked from its folder by name
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def _rocks(spark):
    """The state store that processors with several states need, while a stream is made and runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _drained(stream, mode: str, more: str = ""):
    """All rows a streaming query emits for the input there is now, from a table in the checkpoint folder."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{at}/out/{i}")).option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + more
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/out")


@query("""
WITH e AS (SELECT CAST(FLOOR(EPOCH(ts) / 300) AS BIGINT) * 300 AS start, user_id % 9 AS edge_idx, COUNT(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT EPOCH(MAX(ts)) - 600 AS mark FROM events)
SELECT start, edge_idx, n FROM e, m WHERE start + 300 <= mark""")
def streaming_bin_volume(spark, sf_dir):
    """Windows that the watermark has closed."""
    rows = _events(spark, sf_dir).select("ts", (F.col("user_id") % 9).alias("edge_idx"), F.lit(1).cast("long").alias("w"))
    return _drained(jobs.bin_volume(rows), "append").withColumn("start", F.unix_timestamp("start"))


@query("""
WITH e AS (SELECT CAST(FLOOR(EPOCH(ts) / 300) AS BIGINT) * 300 - k.k * 300 AS start, COUNT(*) AS n FROM events CROSS JOIN (SELECT UNNEST(RANGE(12)) AS k) k GROUP BY 1), m AS (SELECT EPOCH(MAX(ts)) - 600 AS mark FROM events)
SELECT start, n FROM e, m WHERE start + 3600 <= mark""")
def streaming_peak_hour(spark, sf_dir):
    rows = _events(spark, sf_dir).select("ts", F.lit(1).cast("long").alias("w"))
    return _drained(jobs.peak_hour(rows), "append").withColumn("start", F.unix_timestamp("start"))


@query("""
WITH e AS (SELECT user_id % 20 AS vehicle, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id % 20 ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY vehicle ORDER BY ts) AS trip FROM e), g AS (SELECT vehicle, trip, MIN(ts) AS a, MAX(ts) AS b, COUNT(*) AS points FROM s GROUP BY 1, 2)
SELECT vehicle, CAST(FLOOR(EPOCH(a)) AS BIGINT) AS first, CAST(FLOOR(EPOCH(b)) AS BIGINT) AS last, points FROM g WHERE b + INTERVAL 30 MINUTE <= (SELECT MAX(ts) - INTERVAL 10 MINUTE FROM events)""")
def streaming_trip_sessions(spark, sf_dir):
    rows = _events(spark, sf_dir).select("ts", (F.col("user_id") % 20).alias("vehicle"))
    return _drained(jobs.trip_sessions(rows), "append").withColumn("first", F.unix_timestamp("first")).withColumn("last", F.unix_timestamp("last"))


@query("""
WITH RECURSIVE m AS (SELECT EPOCH_MS(MAX(ts)) - 600000 AS mark FROM events),
a AS (SELECT event_id, user_id % 7 AS entrance, EPOCH_US(ts) / 1e6 AS arr, 1.2e3 + event_id % 4 * 600 AS s, 9e2 + event_id % 3 * 1800 AS p, ROW_NUMBER() OVER (PARTITION BY user_id % 7 ORDER BY EPOCH_MS(ts), event_id) AS r FROM events, m WHERE EPOCH_MS(ts) <= mark),
q(entrance, r, event_id, wait, free) AS (SELECT entrance, r, event_id, 0e0, arr + s FROM a WHERE r = 1
 UNION ALL SELECT a.entrance, a.r, a.event_id, GREATEST(q.free - a.arr, 0), CASE WHEN GREATEST(q.free - a.arr, 0) <= a.p THEN GREATEST(q.free, a.arr) + a.s ELSE q.free END FROM q JOIN a ON a.entrance = q.entrance AND a.r = q.r + 1)
SELECT q.event_id, q.entrance, CASE WHEN q.wait <= a.p THEN ROUND(q.wait, 3) END AS wait, q.wait > a.p AS balked FROM q JOIN a ON a.event_id = q.event_id""")
def streaming_curb_queue(spark, sf_dir):
    """Twenty minutes and more a car, so that queues form and some leave; rows up to the watermark are served."""
    rows = _events(spark, sf_dir).select((F.col("user_id") % 7).cast("long").alias("entrance"), "event_id", F.unix_micros("ts").alias("us"), (1200.0 + F.col("event_id") % 4 * 600).alias("service"), (900.0 + F.col("event_id") % 3 * 1800).alias("patience"), "ts")
    with _rocks(spark):  # a day's rows wait in a list: events are sparse
        return _drained(jobs.curb_queue(rows.withColumn("arr_s", F.col("us") / 1e6).drop("us"), stretch_s=86400), "append").withColumn("wait", F.round("wait", 3))


@query("SELECT event_id, 'took ' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) || ' min' AS text FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 2, 3)")
def streaming_text_guard(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", F.concat(F.lit("took  "), F.from_json("props", "k long")["k"].cast("string"), F.lit(" \n min")).alias("text"))
    return _drained(jobs.text_guard(rows, [1.0, 2.0, 3.0]), "append")


@query("""
WITH l AS (SELECT user_id % 20 AS plan_id, event_id % 40 AS player_id, ARG_MAX(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END, ROW(ts, event_id)) AS value FROM events GROUP BY 1, 2)
SELECT plan_id, SUM(value) AS votes FROM l GROUP BY plan_id""")
def streaming_vote_totals(spark, sf_dir):
    """The last total of each plan in the changelog."""
    value = F.when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    rows = _events(spark, sf_dir).select((F.col("user_id") % 20).cast("long").alias("plan_id"), (F.col("event_id") % 40).alias("player_id"), value.alias("value"), "ts", "event_id")
    with _rocks(spark):
        log = _drained(jobs.vote_totals(rows), "update", ", batch long")
    return log.groupBy("plan_id").agg(F.max_by("votes", "batch").alias("votes"))


@query("""
WITH m AS (SELECT user_id % 40 AS player_id, event_id % 5 AS persona_id, event_type || ' ' || CAST(event_id AS VARCHAR) AS text, EPOCH_MS(ts) AS ms, event_id FROM events),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id, persona_id ORDER BY ms DESC, event_id DESC) AS k, MAX(ms) OVER (PARTITION BY player_id, persona_id) AS last FROM m)
SELECT player_id, persona_id, STRING_AGG(text, '|' ORDER BY ms, event_id) AS messages FROM r WHERE k <= 10 AND ms > last - 1296000000 GROUP BY 1, 2""")
def streaming_chat_history(spark, sf_dir):
    """The last ten messages of every player with every persona, within fifteen days: the last state in the changelog."""
    rows = _events(spark, sf_dir).select((F.col("user_id") % 40).alias("player_id"), (F.col("event_id") % 5).alias("persona_id"), "event_id", F.concat_ws(" ", "event_type", "event_id").alias("text"), "ts")
    with _rocks(spark):
        log = _drained(jobs.chat_history(rows, 10, 15 * 86400), "update", ", batch long")
    return log.groupBy("player_id", "persona_id").agg(F.array_join(F.max_by("messages", "batch"), "|").alias("messages"))
