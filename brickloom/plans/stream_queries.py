"""Queue, cadence, history and streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickloom.plans.bindings import table
from brickloom.plans.registry import query
from brickloom.streaming import events as e
from brickloom.streaming.jobs import fold_stream, run_to_table

ACTION = """CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'error' THEN 'failure' ELSE 'success' END"""
ERROR = """CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'File is Encrypted!' ELSE 'timeout ' || (event_id % 9) END END"""
EV = f"ev AS (SELECT user_id, ts, event_id, {ACTION} AS action, {ERROR} AS error, value FROM events)"


def _attempts(df):
    return df.select(
        F.col("user_id").alias("model_id"), F.col("user_id").alias("crawler"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.expr(ACTION).alias("action"), F.expr(ERROR).alias("error"), F.col("value").alias("elapsed_seconds"),
    )


def attempts(spark, sf):
    return _attempts(table(spark, sf, "events"))


def attempts_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return _attempts(spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*"))


QUEUE = f"""WITH {EV}, bn AS (SELECT user_id, min((ts, event_id)) AS born FROM ev WHERE action = 'enqueue' GROUP BY user_id),
lv AS (SELECT ev.*, row_number() OVER (PARTITION BY ev.user_id ORDER BY ts DESC, event_id DESC) AS last_no FROM ev JOIN bn ON bn.user_id = ev.user_id WHERE action <> 'enqueue' AND (ts, event_id) > born),
lf AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM lv WHERE action <> 'claim'),
ag AS (SELECT user_id, count(*) FILTER (action = 'claim') AS claims, count(*) FILTER (action <> 'success') AS updates FROM lv GROUP BY user_id)
SELECT bn.user_id AS model_id, coalesce(CASE l.action WHEN 'claim' THEN 'downloading' WHEN 'success' THEN 'completed' WHEN 'failure' THEN CASE WHEN l.error ILIKE '%encrypted%' THEN 'not_possible' ELSE 'failed' END END, 'pending') AS status,
  coalesce({{count}}, 0) AS attempts, CASE WHEN s.action = 'failure' THEN CASE WHEN s.error ILIKE '%encrypted%' THEN 'Encrypted - not possible' ELSE s.error END END AS error_msg
FROM bn LEFT JOIN lv l ON l.user_id = bn.user_id AND last_no = 1 LEFT JOIN lf s ON s.user_id = bn.user_id AND s.n = 1 LEFT JOIN ag ON ag.user_id = bn.user_id"""


@query("queue_state", QUEUE.replace("{count}", "claims"))
def queue_state(spark, sf):
    return e.queue_state(attempts(spark, sf)).drop("last_attempt_time", "settled")


ADAPTIVE_QUEUE = f"""WITH {EV}, bn AS (SELECT user_id, min((ts, event_id)) AS born FROM ev WHERE action = 'enqueue' GROUP BY user_id),
lv AS (SELECT ev.*, row_number() OVER (PARTITION BY ev.user_id ORDER BY ts DESC, event_id DESC) AS n FROM ev JOIN bn ON bn.user_id = ev.user_id WHERE action <> 'enqueue' AND (ts, event_id) > born),
ag AS (SELECT user_id, count(*) FILTER (action <> 'success') AS updates FROM lv GROUP BY user_id)
SELECT bn.user_id AS model_id, CASE l.action WHEN 'claim' THEN 'downloading' WHEN 'success' THEN 'completed' WHEN 'failure' THEN 'failed' ELSE 'pending' END AS status,
  coalesce(updates, 0) AS attempts, CASE WHEN l.action = 'failure' THEN l.error END AS error_msg
FROM bn LEFT JOIN lv l ON l.user_id = bn.user_id AND n = 1 LEFT JOIN ag ON ag.user_id = bn.user_id"""


@query("queue_state_adaptive", ADAPTIVE_QUEUE)
def queue_state_adaptive(spark, sf):
    return e.queue_state(attempts(spark, sf), adaptive=True).drop("last_attempt_time", "settled")


@query("queue_stream", QUEUE.replace("{count}", "claims"))
def queue_stream(spark, sf):
    """The models' rows after the last micro-batch."""
    stream = attempts_stream(spark, sf)
    key = stream.schema["model_id"].dataType.simpleString()
    return fold_stream(stream, e.queue_fold, e.QUEUE_STATE.format(key=key), "model_id").drop("last_attempt_time")


def _cadence_sql(start, floor, cap, n, step):
    return f"""WITH RECURSIVE {EV}, oc AS (SELECT user_id AS crawler, event_id AS seq, action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev WHERE action IN ('success', 'failure')),
r AS (SELECT DISTINCT crawler, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, {start}::DOUBLE AS delay, 0 AS streak FROM oc
UNION ALL SELECT r.crawler, oc.i, oc.seq, CASE WHEN action = 'failure' THEN least({cap}, delay * 2) WHEN streak + 1 >= {n} THEN greatest({floor}, delay - {step}) ELSE delay END::DOUBLE,
  CASE WHEN action = 'failure' OR streak + 1 >= {n} THEN 0 ELSE streak + 1 END FROM r JOIN oc ON oc.crawler = r.crawler AND oc.i = r.i + 1)
SELECT crawler, seq, delay, streak FROM r WHERE i > 0"""


@query("cadence_state", _cadence_sql(3, 1, 60, 3, 1))
def cadence_state(spark, sf):
    return e.cadence_state(attempts(spark, sf))


@query("cadence_state_profiler", _cadence_sql(8, 2, 30, 5, 1))
def cadence_state_profiler(spark, sf):
    return e.cadence_state(attempts(spark, sf), e.PROFILER)


@query("cadence_stream", _cadence_sql(3, 1, 60, 5, 0.5).replace("SELECT crawler, seq, delay, streak FROM r WHERE i > 0",
       "SELECT crawler, arg_max(delay, i) AS delay, arg_max(streak, i) AS streak FROM r GROUP BY crawler"))
def cadence_stream(spark, sf):
    stream = attempts_stream(spark, sf)
    key = stream.schema["crawler"].dataType.simpleString()
    return fold_stream(stream, lambda batch, state: e.cadence_fold(batch, state, e.SHARED), e.CADENCE_STATE.format(key=key), "crawler")


@query("attempt_history", _cadence_sql(8, 2, 30, 5, 1).replace("SELECT crawler, seq, delay, streak FROM r WHERE i > 0", """SELECT oc.crawler, oc.seq, ev.user_id AS model_id, epoch_us(ts) AS micros,
  CASE WHEN ev.action = 'success' THEN 'success' ELSE 'failed' END AS status, value AS elapsed_seconds, error, delay AS delay_used
FROM r JOIN oc ON oc.crawler = r.crawler AND oc.i = r.i + 1 JOIN ev ON ev.user_id = oc.crawler AND ev.event_id = oc.seq"""))
def attempt_history(spark, sf):
    """Every attempt with the delay that was in use."""
    return e.attempt_history(attempts(spark, sf), e.PROFILER).withColumn("micros", F.unix_micros("ts")).drop("ts")


@query("attempt_success_rate", f"""WITH {EV} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS attempts, count(*) FILTER (action = 'success') AS successes
FROM ev WHERE action IN ('success', 'failure') GROUP BY ALL""")
def attempt_success_rate(spark, sf):
    rate = e.success_rate(e.attempt_history(attempts(spark, sf)))
    return rate.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "attempts", "successes")


@query("attempt_history_stream", f"""WITH {EV} SELECT user_id AS model_id, CASE WHEN action = 'success' THEN 'success' ELSE 'failed' END AS status, value AS elapsed_seconds, error FROM ev WHERE action IN ('success', 'failure')""")
def attempt_history_stream(spark, sf):
    return run_to_table(e.attempt_history(attempts_stream(spark, sf)), "history").drop("ts", "batch_id")


@query("stream_dedupe", "SELECT DISTINCT user_id AS model_id FROM events")
def stream_dedupe(spark, sf):
    return run_to_table(e.stream_dedupe(attempts_stream(spark, sf), "model_id", "3650 days"), "seen").select("model_id")
