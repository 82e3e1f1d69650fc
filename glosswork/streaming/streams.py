"""Streaming forms: the same column expressions on arriving files and events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glosswork.functions.replies import agent_message, may_be_message
from glosswork.operators.comments import extract_reviews, filter_reviewable
from glosswork.operators.steps import compute_once
from glosswork.session import accept_repeated_keys, ship


def stream_extract_reviews(files: DataFrame) -> DataFrame:
    """Reviews of arriving files; stateless, append mode."""
    return extract_reviews(filter_reviewable(files)).filter(F.col("review").isNotNull())


def stream_first_agent_message(
    run_events: DataFrame, gap: str | None = None, delay: str | None = "10 minutes"
) -> DataFrame:
    """First agent message of each run on a live event log.

    With ``gap``, a run ends when it pauses that long; results are final (append mode), and
    events later than ``delay`` are dropped. Choose ``gap`` no shorter than the longest pause:
    a longer one splits the run. With ``gap`` and no ``delay``, no event is dropped, and open sessions come out too
    (complete mode, with all sessions in the state). Without ``gap``, results are updated as events arrive (update
    or complete mode), with one row of state per run.
    """
    accept_repeated_keys(run_events.sparkSession)
    messages = compute_once(
        run_events.filter(may_be_message(F.col("line"))), text=agent_message(F.col("line"))
    )
    messages = messages.filter(F.col("text").isNotNull())
    first = F.min_by("text", "seq").alias("text")
    if gap is None:
        return messages.groupBy("request_id").agg(first)
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay is not None:
        timed = timed.withWatermark("ts", delay)
    return (
        timed.groupBy("request_id", F.session_window("ts", gap).alias("_session"))
        .agg(first)
        .select("request_id", F.col("_session.start").alias("started"), "text")
    )


def _keep_first(idle_ms: int):
    """Keeps the earliest message of a run, gives it out when it changes, and lets go of it when the run ends."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, text = state.get if state.exists else (None, None)
        latest, ended, better = 0, False, False
        for rows in parts:
            latest, ended = max(latest, int(rows["ms"].max())), ended or bool(rows["ended"].any())
            told = rows[rows["text"].notna()]
            if len(told):
                first = told.loc[told["seq"].idxmin()]
                if seq is None or first["seq"] < seq:
                    seq, text, better = int(first["seq"]), first["text"], True
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((seq, text))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1 + idle_ms)
        if better:
            yield pd.DataFrame({"request_id": [key[0]], "seq": [seq], "text": [text]})

    return step


def stream_messages_until_end(
    run_events: DataFrame, end_types: tuple[str, ...], idle_ms: int = 86_400_000, delay: str = "10 minutes"
) -> DataFrame:
    """First agent message of each run on a live log, in update mode, with state for open runs only.

    Every earlier message that arrives gives a new row (``request_id, seq, text``); the one with the
    smallest ``seq`` counts. A run's state is let go of at an event whose type is one of ``end_types``,
    or when the log has moved ``idle_ms`` past its last event. Messages that come after that
    start anew, so ``last_versions`` takes the smallest ``seq`` over all rows.
    """
    spark = run_events.sparkSession
    accept_repeated_keys(spark)
    ship(spark)
    line = F.col("line")
    ends = F.rlike(line, F.lit('"type"\\s*:\\s*"(?:' + "|".join(end_types) + ')"'))
    read = compute_once(
        run_events.filter(may_be_message(line) | ends), text=F.when(may_be_message(line), agent_message(line)), ended=ends
    )
    rows = read.filter(F.col("text").isNotNull() | F.col("ended")).select(
        "request_id", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "text", "ended",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    ).withWatermark("ts", delay)
    return rows.groupBy("request_id").applyInPandasWithState(
        _keep_first(idle_ms), "request_id string, seq long, text string", "seq long, text string", "update", GroupStateTimeout.EventTimeTimeout
    )


def write_versions(df: DataFrame, path: str, state: str, mode: str = "update") -> StreamingQuery:
    """Write every batch of a stream to a folder of its own; a repeated batch replaces its folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return df.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()


def last_batch(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The rows of the last batch: the complete result of a complete-mode stream so far."""
    rows = spark.read.schema(f"{schema}, version long").parquet(path)
    newest = rows.agg(F.max("version").alias("_newest"))
    return rows.join(F.broadcast(newest), F.col("version") == F.col("_newest")).drop("version", "_newest")


def last_versions(spark: SparkSession, schema: str, path: str, key: str, order: str = "version") -> DataFrame:
    """The row of each key with the largest ``order``: the complete result of an update-mode stream so far."""
    rows = spark.read.schema(f"{schema}, version long").parquet(path)
    value = F.struct(*[c for c in rows.columns if c not in (key, "version")])
    best = rows.groupBy(key).agg(F.max_by(value, F.expr(order)).alias("_value"))
    return best.select(key, "_value.*")
