"""Runtime events: windows, reconciliation, sessions, latest values."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlode.lineage import table
from graphlode.operators import resolve, temporal
from graphlode.plans import query


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_hours(spark, sf_dir):
    agg = events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return agg.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


@query(
    """WITH s AS (SELECT unnest([0, 1, 2]) AS k), b AS (SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) - k * 3600 AS start, value FROM events, s)
SELECT start, count(*) AS n, round(max(value), 4) AS peak FROM b GROUP BY 1"""
)
def sliding_windows(spark, sf_dir):
    agg = events(spark, sf_dir).groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("peak"))
    return agg.select(F.unix_timestamp("w.start").alias("start"), "n", "peak")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, session"""
)
def session_windows(spark, sf_dir):
    agg = events(spark, sf_dir).groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return agg.select("user_id", F.unix_micros("w.start").alias("start"), "n")


@query(
    """SELECT user_id, event_id, event_type, round(value, 2) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS t FROM events WHERE ts < TIMESTAMP '2024-01-15') WHERE t = 1"""
)
def event_latest(spark, sf_dir):
    """The last event of each user strictly before a time."""
    rows = temporal.latest_before(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.lit("2024-01-15").cast("timestamp"), "ts")
    return rows.select("user_id", "event_id", "event_type", F.round("value", 2).alias("value"))


@query(
    """WITH s AS (SELECT DISTINCT user_id % 50 AS source, 't' || (user_id % 7) AS target FROM events WHERE event_type IN ('view', 'click') AND user_id % 3 <> 0),
 r AS (SELECT DISTINCT user_id % 50 AS source, 't' || (user_id % 7) AS target FROM events WHERE event_type = 'error')
SELECT coalesce(s.source, r.source) AS source, coalesce(s.target, r.target) AS target, CASE WHEN s.source IS NOT NULL AND r.source IS NOT NULL THEN 'confirmed' WHEN s.source IS NOT NULL THEN 'unobserved' ELSE 'undeclared' END AS status
FROM s FULL JOIN r ON s.source = r.source AND s.target = r.target"""
)
def runtime_reconcile(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 50).alias("source"), F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("target"), "event_type", "user_id")
    return resolve.reconcile(e.filter("event_type IN ('view', 'click') AND user_id % 3 != 0"), e.filter("event_type = 'error'"), ["source", "target"])


@query(
    """WITH f AS (SELECT 'src/' || user_id || '/part' || CAST(json_extract_string(props, '$.k') AS BIGINT) || '.vb' AS frame FROM events WHERE event_type = 'error'),
 b AS (SELECT 'part' || (p_partkey % 100) || '.vb' AS base, 'app/m' || (p_partkey % 13) || '/Part' || (p_partkey % 100) || '.vb' AS path, p_size / 50.0 AS centrality FROM part),
 h AS (SELECT string_split(frame, '/')[-1] AS base, count(*) AS frames FROM f GROUP BY 1)
SELECT path, frames, round(0.3 * frames + 0.1 * max(centrality), 6) AS score FROM b JOIN h ON b.base = h.base GROUP BY path, frames"""
)
def error_triage(spark, sf_dir):
    """Files behind stack frames, by base name and centrality."""
    k = F.get_json_object("props", "$.k").cast("long").cast("string")
    frames = events(spark, sf_dir).filter("event_type = 'error'").select(F.concat(F.lit("src/"), F.col("user_id").cast("string"), F.lit("/part"), k, F.lit(".vb")).alias("frame_file"))
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("app/m"), (F.col("p_partkey") % 13).cast("string"), F.lit("/Part"), (F.col("p_partkey") % 100).cast("string"), F.lit(".vb"))
    files = p.groupBy(path.alias("path")).agg(F.max(F.col("p_size") / 50.0).alias("centrality"))
    return resolve.triage(frames, files, 1_000_000).select("path", "frames", F.round("score", 6).alias("score"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count("*").alias("n"))


@query(
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM events GROUP BY 1"""
)
def metrics_percentiles(spark, sf_dir):
    p = lambda x: F.round(F.percentile("value", x), 6)
    return events(spark, sf_dir).groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.count("*").alias("n"))


@query("SELECT least(greatest(CAST(floor(value / 10) AS BIGINT), 0), 20) AS bucket, count(*) AS n FROM events GROUP BY 1")
def latency_histogram(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.least(F.greatest(F.floor(F.col("value") / 10), F.lit(0)), F.lit(20)).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT user_id, event_id, 1.0 / (60 + row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1) + 0.0006 * pow(0.5, (epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400.0 / 30.0) AS score FROM events)
SELECT user_id, event_id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 8) DESC, event_id) AS t FROM s) WHERE t <= 5"""
)
def recency_rerank(spark, sf_dir):
    from graphlode.operators import retrieval

    w = Window.partitionBy("user_id")
    age = (F.lit(1706745600.0) - F.unix_micros("ts") / 1e6) / 86400.0
    rank = F.row_number().over(w.orderBy(F.desc("value"), "event_id"))
    scored = events(spark, sf_dir).withColumn("score", F.round(retrieval.recency(1.0 / (60 + rank - 1), age), 8))
    return retrieval.diversity_slots(scored, "user_id", "score", "event_id", 5).select("user_id", "event_id", "score")


@query(
    """WITH d AS (SELECT user_id, count(DISTINCT event_type) AS kinds, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY 1)
SELECT user_id, kinds, first_event, last_event FROM d WHERE kinds >= 2"""
)
def evidence_by_subject(spark, sf_dir):
    agg = events(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    return agg.filter("kinds >= 2")


@query(
    """WITH a AS (SELECT event_id AS path, user_id AS size, event_type AS mark FROM events WHERE event_id % 10 <> 0), b AS (SELECT event_id AS path, CASE WHEN event_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS size, event_type AS mark FROM events WHERE event_id % 11 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.size <> b.size OR a.mark <> b.mark THEN 'modified' ELSE 'same' END AS status FROM a FULL JOIN b ON a.path = b.path"""
)
def index_freshness(spark, sf_dir):
    """What changed between two fingerprint tables."""
    e = events(spark, sf_dir)
    old = e.filter("event_id % 10 != 0").select(F.col("event_id").alias("path"), F.col("user_id").alias("size"), F.col("event_type").alias("mark"))
    new = e.filter("event_id % 11 != 0").select(F.col("event_id").alias("path"), F.when(F.col("event_id") % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("size"), F.col("event_type").alias("mark"))
    return resolve.changed(old, new, "path", ["size", "mark"])


@query(
    """WITH s AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'write' ELSE 'read' END AS access, 'k' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS state FROM events)
SELECT state, sum((access = 'write')::INT)::BIGINT AS writes, sum((access = 'read')::INT)::BIGINT AS reads, count(DISTINCT user_id) AS files FROM s GROUP BY 1"""
)
def state_usage(spark, sf_dir):
    """Readers and writers of each state key."""
    state = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("long") % 20).cast("string"))
    rows = events(spark, sf_dir).select(state.alias("state"), "user_id", "event_type")
    return rows.groupBy("state").agg(F.count_if(F.col("event_type") == "signup").alias("writes"), F.count_if(F.col("event_type") != "signup").alias("reads"), F.count_distinct("user_id").alias("files"))


@query("SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def half_open_period(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-20'")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """The hourly windows as a stream over the file, complete mode."""
    from graphlode.streaming import incremental

    stream = incremental.events(spark, f"{sf_dir}/events.parquet*")
    agg = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    rows = incremental.run_once(agg, "stream_tumbling_out", "complete")
    return rows.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n")
