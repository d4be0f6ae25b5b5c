"""Crawl-job polling: state machine, failure rules, progress, expiry; batch and stream.

A poll is ``(job_id, seq, status, http_ok, pages_fetched, pages_total)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweir import params
from docweir.session import with_state_store

# Fixed values.
STATUSES = ("pending", "in_progress", "completed", "failed")
TIMED_OUT = "Polling timed out after 10 minutes."
UNREACHABLE = "Microservice unreachable after multiple attempts"
JOB_FAILED = "Job failed in microservice."

STATE = "job_id string, status string, error_message string, pages_fetched bigint, pages_total bigint, polls bigint"


def job_states(polls: DataFrame) -> DataFrame:
    """Final state of every job from all its polls.

    A job ends by its first terminal event: the poll behind the limit, too many
    failures in a row, a completed or failed answer. The limit also bounds the
    polls that matter, so a job brings at most that many rows to its windows.
    """
    order = Window.partitionBy("job_id").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = polls.withColumn("n", F.row_number().over(order)).where(F.col("n") <= params.MAX_POLLS + 1)
    runs = bounded.withColumn("_island", F.sum(F.when(F.col("http_ok"), 1).otherwise(0)).over(upto))
    failures = Window.partitionBy("job_id", "_island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum(F.when(F.col("http_ok"), 0).otherwise(1)).over(failures)
    marked = runs.withColumn("_streak", streak).withColumn(
        "_end",
        F.when(F.col("n") > params.MAX_POLLS, F.struct(F.lit("failed").alias("s"), F.lit(TIMED_OUT).alias("e")))
        .when(
            F.col("_streak") >= params.MAX_FAILURES_IN_A_ROW,
            F.struct(F.lit("failed").alias("s"), F.lit(UNREACHABLE).alias("e")),
        )
        .when(
            F.col("http_ok") & (F.col("status") == "failed"),
            F.struct(F.lit("failed").alias("s"), F.lit(JOB_FAILED).alias("e")),
        )
        .when(
            F.col("http_ok") & (F.col("status") == "completed"),
            F.struct(F.lit("completed").alias("s"), F.lit(None).cast("string").alias("e")),
        ),
    )
    ended = F.col("_end").isNotNull()
    first_end = marked.groupBy("job_id").agg(
        F.min(F.when(ended, F.col("n"))).alias("_stop"),
        F.min_by("_end", F.when(ended, F.col("n"))).alias("_final"),
    )
    lived = marked.join(first_end, "job_id").where(F.col("_stop").isNull() | (F.col("n") <= F.col("_stop")))
    # an answer changes the record unless it ends the job by failure
    answered = F.col("http_ok") & (~ended | (F.col("_end.s") == "completed"))
    known = answered & F.col("status").isin(*STATUSES)
    progress = F.struct("pages_fetched", "pages_total")
    return lived.groupBy("job_id").agg(
        F.coalesce(
            F.first("_final")["s"],
            F.max_by(F.when(known, F.col("status")), F.when(known, F.col("n"))),
            F.lit("pending"),
        ).alias("status"),
        F.first("_final")["e"].alias("error_message"),
        F.max_by(F.when(answered, progress), F.when(answered, F.col("n"))).alias("_p"),
        F.max("n").alias("polls"),
    ).select("job_id", "status", "error_message", "_p.pages_fetched", "_p.pages_total", F.col("polls").cast("bigint").alias("polls"))


def failure_runs(polls: DataFrame) -> DataFrame:
    """Longest run of failed polls per job within the polling limit."""
    order = Window.partitionBy("job_id").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = polls.withColumn("n", F.row_number().over(order)).where(F.col("n") <= params.MAX_POLLS)
    runs = bounded.withColumn("_island", F.sum(F.when(F.col("http_ok"), 1).otherwise(0)).over(upto))
    return (
        runs.groupBy("job_id", "_island").agg(F.count_if(~F.col("http_ok")).alias("run"))
        .groupBy("job_id").agg(F.max("run").alias("longest_run"))
        .withColumn("gives_up", F.col("longest_run") >= params.MAX_FAILURES_IN_A_ROW)
    )


def progress(polls: DataFrame) -> DataFrame:
    """Last reported (fetched, total) of each job."""
    return polls.where("http_ok").groupBy("job_id").agg(
        F.max_by(F.struct("pages_fetched", "pages_total"), "seq").alias("_p")
    ).select("job_id", "_p.*")


def expire(states: DataFrame, as_of) -> DataFrame:
    """Blank out jobs whose record has outlived its keeping time at ``as_of``.

    ``states`` is ``(job_id, status, updated_at)``; running records live shorter
    than finished ones, and an expired job is unknown.
    """
    ttl = keeping_seconds(F.col("status"))
    age = F.unix_micros(as_of) - F.unix_micros("updated_at")
    gone = age >= ttl.cast("bigint") * 1_000_000
    return states.withColumn("status", F.when(gone, F.lit(None)).otherwise(F.col("status")))


def _advance(state: tuple, polls: pd.DataFrame) -> tuple:
    """Feed polls in order into (status, error, fetched, total, polls, streak)."""
    status, error, fetched, total, count, streak = state
    for p in polls.sort_values("seq").itertuples(index=False):
        if status in ("completed", "failed"):
            break
        count += 1
        if count > params.MAX_POLLS:
            status, error = "failed", TIMED_OUT
        elif not p.http_ok:
            streak += 1
            if streak >= params.MAX_FAILURES_IN_A_ROW:
                status, error = "failed", UNREACHABLE
        else:
            streak = 0
            if p.status == "failed":
                status, error = "failed", JOB_FAILED
            else:
                status = p.status if p.status in STATUSES else status
                fetched = None if pd.isna(p.pages_fetched) else int(p.pages_fetched)
                total = None if pd.isna(p.pages_total) else int(p.pages_total)
    return status, error, fetched, total, count, streak


def job_state_stream(polls: DataFrame) -> DataFrame:
    """Streaming twin of :func:`job_states`: emits a job's record whenever it changes."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else ("pending", None, None, None, 0, 0)
        after = _advance(tuple(before), pd.concat(list(batches)))
        state.update(after)
        yield pd.DataFrame(
            [(key[0], *after[:5])],
            columns=["job_id", "status", "error_message", "pages_fetched", "pages_total", "polls"],
        ).astype({"pages_fetched": "Int64", "pages_total": "Int64"})

    return polls.groupBy("job_id").applyInPandasWithState(
        step,
        STATE,
        "status string, error string, fetched bigint, total bigint, polls bigint, streak bigint",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def keeping_seconds(status: Column) -> Column:
    return F.when(status.isin("completed", "failed"), params.FINISHED_TTL_SECONDS).otherwise(params.RUNNING_TTL_SECONDS)


def forgotten(updates: DataFrame, as_of: Column) -> DataFrame:
    """Records that outlived their keeping time: ``(job_id, status, forgotten_at)``.

    Every row of ``updates`` ``(job_id, status, at)`` writes the job's record and starts its
    time anew; a record is forgotten if nothing was written for as long, up to ``as_of``.
    """
    order = Window.partitionBy("job_id").orderBy("at", "status")
    kept = keeping_seconds(F.col("status"))
    until = F.timestamp_micros(F.unix_micros("at") + kept.cast("bigint") * 1_000_000)
    rows = updates.select("job_id", "status", "at", F.lead("at").over(order).alias("_next")).withColumn("forgotten_at", until)
    return rows.where(F.col("forgotten_at") <= F.coalesce("_next", as_of)).select("job_id", "status", "forgotten_at")


class _Record(StatefulProcessor):
    """A job's record in a store with expiry; the timer of its last write gives out the record it ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "status string, until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.record.get()
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "status"], kind="stable").itertuples(index=False):
            at = int(r.at.value) // 1000
            if held and held[1] <= at:
                out.append(held)
            kept = params.FINISHED_TTL_SECONDS if r.status in ("completed", "failed") else params.RUNNING_TTL_SECONDS
            held = (r.status, at + kept * 1_000_000)
        self.record.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # timers count milliseconds; one that is due too early finds the record's own time
        self.handle.registerTimer(-(-held[1] // 1000))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.record.get()
        if held:
            yield self._rows(key, [held])
            self.record.clear()

    def _rows(self, key, ended: list[tuple]) -> pd.DataFrame:
        statuses, until = zip(*ended, strict=True)
        return pd.DataFrame({"job_id": [key[0]] * len(ended), "status": statuses, "forgotten_at": pd.to_datetime(list(until), unit="us")})

    def close(self) -> None:
        pass


def forgotten_stream(updates: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Streaming twin of :func:`forgotten`: emits each record when the watermark passes the end of its keeping time."""
    with_state_store(updates.sparkSession)
    kind = dict(updates.dtypes)["job_id"]
    timed = updates.select("job_id", "status", "at").withWatermark("at", delay)
    return timed.groupBy("job_id").transformWithStateInPandas(_Record(), f"job_id {kind}, status string, forgotten_at timestamp", "append", "EventTime")
