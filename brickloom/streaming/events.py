"""Work-queue and cadence state, as batch folds and as streams.

Attempt events: model_id, ts, seq (order of equal times), action ('enqueue', 'claim', 'success',
'failure'), error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickloom.operators.scans import as_of, fits, scan
from brickloom.session import max_group_rows

ENCRYPTED = "Encrypted - not possible"


def _status(action: Column, error: Column) -> tuple[Column, Column]:
    locked = F.coalesce(F.lower(error).contains("encrypted"), F.lit(False))
    status = (
        F.when(action == "claim", "downloading")
        .when(action == "success", "completed")
        .when(locked, "not_possible")
        .otherwise("failed")
    )
    return status, F.when(action == "success", None).when(locked, ENCRYPTED).otherwise(error)


def queue_state(events: DataFrame, adaptive: bool = False) -> DataFrame:
    """Current row per model; ``settled`` says whether a success or failure (adaptive: any update) is among its events. Events before the first enqueue have no effect, nor do later enqueues.

    Attempts count claims. With ``adaptive`` every update that is not a success counts, an error is stored as it is, and a
    claim clears it.
    """
    at = F.struct("ts", "seq")
    born = events.filter("action = 'enqueue'").groupBy("model_id").agg(F.min(at).alias("born"))
    live = events.filter("action <> 'enqueue'").join(born, "model_id").filter(at > F.col("born"))
    action = F.col("action")
    status, error = _status(action, F.col("error"))
    counted, settles = action == "claim", action != "claim"
    if adaptive:
        status = F.when(action == "failure", "failed").otherwise(status)
        error = F.when(action == "failure", F.col("error"))
        counted, settles = action != "success", F.lit(True)
    folded = live.groupBy("model_id").agg(
        F.max_by(status, at).alias("status"),
        F.count_if(counted).alias("attempts"),
        F.max("ts").alias("last_attempt_time"),
        F.max_by(F.struct(error.alias("e")), F.when(settles, at)).alias("last"),
    )
    return born.join(folded, "model_id", "left").select(
        "model_id", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"),
        "last_attempt_time", F.col("last.e").alias("error_msg"), F.col("last").isNotNull().alias("settled"),
    )


QUEUE_STATE = "model_id {key}, status string, attempts long, last_attempt_time timestamp, error_msg string"


def queue_fold(batch: DataFrame, state: DataFrame, adaptive: bool = False) -> DataFrame:
    """New rows of the models that a micro-batch touches, for ``jobs.fold_stream``.

    A model's part of the batch is reduced by combinable aggregates, so a hot one is reduced in many tasks, and then laid over
    its row. A model without a row is born at its first enqueue, and only what comes after that counts.
    """
    known = state.select("model_id", F.col("status").alias("_status"), F.col("attempts").alias("_attempts"),
                         F.col("last_attempt_time").alias("_time"), F.col("error_msg").alias("_error"), F.lit(True).alias("_known"))
    # an old model counts as enqueued before everything in the batch
    marker = state.join(batch.select("model_id").distinct(), "model_id", "left_semi").select(
        "model_id", F.timestamp_seconds(F.lit(-62135596800)).alias("ts"), F.lit(-1).cast("long").alias("seq"),
        F.lit("enqueue").alias("action"), F.lit(None).cast("string").alias("error"),
    )
    new = queue_state(batch.select(*marker.columns).unionByName(marker), adaptive).join(known, "model_id", "left")
    moved = F.col("last_attempt_time").isNotNull()
    # an error stays as long as only claims follow; the adaptive rule clears it with every update
    settled = moved if adaptive else F.col("settled")
    return new.select(
        "model_id",
        F.when(moved | F.col("_known").isNull(), F.col("status")).otherwise(F.col("_status")).alias("status"),
        (F.col("attempts") + F.coalesce("_attempts", F.lit(0))).alias("attempts"),
        F.coalesce("last_attempt_time", "_time").alias("last_attempt_time"),
        F.when(settled, F.col("error_msg")).otherwise(F.col("_error")).alias("error_msg"),
    )


# --- cadence --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cadence:
    """Delay rule: after ``streak`` successes in a row less ``step`` (not below floor), doubled on failure."""

    start: float = 3.0
    floor: float = 1.0
    cap: float = 60.0
    streak: int = 3
    step: float = 1.0


ADAPTIVE = Cadence()
SHARED = Cadence(3.0, 1.0, 60.0, 5, 0.5)
PROFILER = Cadence(8.0, 2.0, 30.0, 5, 1.0)


#: Outcomes of one key that are reduced together; a task holds those of several keys.
PIECE_ROWS = 10_000


def _piece_rows(spark: SparkSession) -> int:
    return min(max_group_rows(spark), PIECE_ROWS)


# A run of outcomes changes a delay d to min(high, max(low, factor * d + shift)), and two such changes make one of the same kind.
_NONE = (1.0, 0.0, -np.inf, np.inf)


def _then(first: tuple, second: tuple) -> tuple:
    """The change of ``first`` followed by that of ``second``."""
    (a, b, low, high), (c, d, least, most) = first, second
    clamp = lambda v: min(most, max(least, c * v + d))
    low, high = clamp(low), clamp(high)
    # every delay leads to one: the line between the limits no longer matters, and its factor must not grow for ever
    return (0.0, low, low, high) if low == high else (c * a, c * b + d, low, high)


def _reduced(effects, rule: Cadence) -> tuple:
    doubled, shortened = (2.0, 0.0, -np.inf, rule.cap), (1.0, -rule.step, rule.floor, np.inf)
    change = _NONE
    for effect in effects:
        if effect:
            change = _then(change, doubled if effect == 1 else shortened)
    return change


def _bent(change: Column, effect: Column, rule: Cadence) -> Column:
    """``_then`` as columns: the change [factor, shift, low, high] followed by that of one outcome."""
    doubles = effect == 1
    bent = lambda v: F.when(doubles, F.least(F.lit(rule.cap), v * 2.0)).otherwise(F.greatest(F.lit(rule.floor), v - rule.step))
    factor, shift, low, high = change[0], change[1], bent(change[2]), bent(change[3])
    line = F.when(doubles, F.array(factor * 2.0, shift * 2.0, low, high)).otherwise(F.array(factor, shift - rule.step, low, high))
    # every delay leads to one: the line between the limits no longer matters, and its factor must not grow for ever
    return F.when(low == high, F.array(F.lit(0.0), low, low, high)).otherwise(line)


def _changed(change, delay: float) -> float:
    factor, shift, low, high = change
    return float(min(high, max(low, factor * delay + shift)))


def _ops(events: DataFrame, rule: Cadence, keys: list[str], before: Column | None = None) -> DataFrame:
    """Position, streak and effect (-1 shorten, 1 double, 0 none) of every outcome; ``before``: the streak before the first."""
    small = fits(events, keys)
    df = scan(events, keys, ["ts", "seq"], rank="pos", bounded=small)
    df = scan(df, keys, ["ts", "seq"], lasts={"last_fail": F.when(F.col("action") == "failure", F.col("pos"))}, bounded=small)
    good = F.col("pos") - F.coalesce("last_fail", F.lit(-1) - (F.lit(0) if before is None else before))
    return df.withColumns(
        {
            "streak": F.when(F.col("action") == "failure", 0).otherwise(good % rule.streak).cast("int"),
            "effect": F.when(F.col("action") == "failure", 1).when(good % rule.streak == 0, -1).otherwise(0),
        }
    ).drop("last_fail")


def cadence_state(events: DataFrame, rule: Cadence = ADAPTIVE, keys: tuple[str, ...] = ("crawler",)) -> DataFrame:
    """Delay and streak after every outcome (success / failure) of a crawler, in time order.

    What a run of outcomes does to a delay is a line between two limits, whatever its length. So a long history is cut into
    pieces: each piece is first reduced to its line and limits, the pieces of a crawler are chained, and then every piece is walked
    from its own starting delay.
    """
    return _cadence(events, rule, list(keys)).select(*keys, "seq", "streak", "delay")


def _cadence(events: DataFrame, rule: Cadence, keys: list[str]) -> DataFrame:
    """``cadence_state`` with the time of every outcome."""
    spark = events.sparkSession
    piece_rows = _piece_rows(spark)
    ops = _ops(events.filter(F.col("action").isin("success", "failure")), rule, keys)
    ops = ops.withColumn("piece", F.floor(F.col("pos") / piece_rows))
    key_ddl = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, delay, starts = pdf.sort_values("piece"), rule.start, []
        for change in pdf["change"]:
            starts.append(delay)
            delay = _changed(change, delay)
        return pdf[[*keys, "piece"]].assign(start=starts)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        delay, out = pdf["start"].iloc[0], []
        for effect in pdf["effect"]:
            if effect == 1:
                delay = min(rule.cap, delay * 2)
            elif effect == -1:
                delay = max(rule.floor, delay - rule.step)
            out.append(delay)
        return pdf[[*keys, "ts", "seq", "streak"]].assign(delay=out)

    needed = ops.select(*keys, "ts", "seq", "pos", "streak", "effect", "piece")
    if needed.filter("piece > 0").isEmpty():
        started = needed.withColumn("start", F.lit(rule.start))
    else:
        maps = _pieces(needed, keys, rule)
        starts = maps.groupBy(*keys).applyInPandas(chain, f"{key_ddl}, piece long, start double")
        started = needed.join(starts, [*keys, "piece"])
    return started.groupBy(*keys, "piece").applyInPandas(walk, f"{key_ddl}, ts timestamp, seq long, streak int, delay double")


def _pieces(ops: DataFrame, keys: list[str], rule: Cadence, *more: Column) -> DataFrame:
    """The change that every piece of outcomes makes: keys, piece, change, and ``more`` aggregates of the piece."""
    none = F.array(F.lit(1.0), F.lit(0.0), F.lit(float("-inf")), F.lit(float("inf")))
    felt = F.sort_array(F.collect_list(F.when(F.col("effect") != 0, F.struct("pos", "effect"))))
    change = F.aggregate(felt, none, lambda change, o: _bent(change, o["effect"], rule))
    return ops.groupBy(*keys, "piece").agg(change.alias("change"), *more)


CADENCE_STATE = "crawler {key}, delay double, streak int"


def cadence_fold(batch: DataFrame, state: DataFrame, rule: Cadence = ADAPTIVE) -> DataFrame:
    """New delay and streak of the crawlers of a micro-batch, for ``jobs.fold_stream``.

    A crawler's outcomes are reduced piece by piece to the change that they make, so a hot one is reduced in many tasks; only the
    changes of its pieces meet.
    """
    known = state.select("crawler", F.col("delay").alias("_delay"), F.col("streak").alias("_streak"))
    outcomes = batch.filter(F.col("action").isin("success", "failure") & F.col("crawler").isNotNull()).select("crawler", "ts", "seq", "action")
    ops = _ops(outcomes.join(known, "crawler", "left"), rule, ["crawler"], F.coalesce("_streak", F.lit(0)))
    ops = ops.withColumn("piece", F.floor(F.col("pos") / _piece_rows(batch.sparkSession)))
    pieces = _pieces(ops, ["crawler"], rule, F.max_by("streak", "pos").alias("streak"), F.first("_delay").alias("_delay"))

    def chained(delay: Column, piece: Column) -> Column:
        factor, shift, low, high = (piece["change"][i] for i in range(4))
        return F.least(high, F.greatest(low, factor * delay + shift))

    # one row per piece
    changes = F.sort_array(F.collect_list(F.struct("piece", "change")))
    return pieces.groupBy("crawler").agg(
        F.aggregate(changes, F.coalesce(F.first("_delay"), F.lit(rule.start)), chained).alias("delay"), F.max_by("streak", "piece").alias("streak")
    )


# --- history and dedupe ---------------------------------------------------------------------------


def attempt_history(events: DataFrame, rule: Cadence | None = None) -> DataFrame:
    """Append-only history rows; works on batch and stream input.

    With ``rule`` (batch input only) every attempt also has its crawler, seq and delay_used: the delay that its crawler's earlier outcomes
    had led to, the rule's first delay before any. seq is unique within a crawler.
    """
    ok = F.col("action") == "success"
    outcomes = events.filter(F.col("action").isin("success", "failure"))
    columns = ["ts", "model_id", F.when(ok, "success").otherwise("failed").alias("status"), "elapsed_seconds", F.when(~ok, F.col("error")).alias("error")]
    if rule is None:
        return outcomes.select(*columns)
    history = outcomes.select("crawler", "seq", *columns)
    led = as_of(history, _cadence(events, rule, ["crawler"]), ["crawler"], ["ts", "seq"], ["delay"])
    return led.withColumn("delay_used", F.coalesce("delay", F.lit(rule.start))).drop("delay")


def success_rate(history: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Outcomes per tumbling window."""
    if history.isStreaming:
        history = history.withWatermark("ts", late)
    return history.groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "success").alias("successes")
    ).select(F.col("w.start").alias("window_start"), "attempts", "successes")


def stream_dedupe(cards: DataFrame, key: str, late: str = "30 days") -> DataFrame:
    """Every id once; the stream forgets an id after ``late``."""
    return cards.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
