"""Answer streams: event lines, text assembly, stopped answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docweir.session import with_state_store

from docweir.operators.history import STOPPED

EVENT = "type string, content string, variant string, message string"
# Event kinds a client acts on.
EVENT_TYPES = ("token", "done", "compaction_done", "error")
BLOCK = 4096


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``data: {json}`` lines -> event columns; other lines and broken JSON are left out."""
    bare = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    return (
        lines.where(F.startswith(bare, F.lit("data: ")))
        .withColumn("_e", F.from_json(F.substring(bare, 7, 1 << 30), EVENT, {"mode": "PERMISSIVE"}))
        .where(F.col("_e.type").isin(*EVENT_TYPES))
        .select(
            *[c for c in lines.columns if c != line],
            F.col("_e.type").alias("type"),
            F.when(F.col("_e.type") == "token", F.coalesce("_e.content", F.lit("")))
            .when(F.col("_e.type") == "error", F.coalesce("_e.message", F.lit("Unknown streaming error")))
            .alias("content"),
            F.col("_e.variant").alias("variant"),
        )
    )


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(parts), lambda p: p["content"]), "")


def assemble(events: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each answer from its token events, with its closing event and last usage.

    Tokens are joined in blocks of their sequence number first and then block by
    block, so one long answer spreads over many tasks until its pieces meet. An
    error appends its message; an answer without any closing event was stopped
    and, without text, says so.
    """
    tokens = events.where(F.col("type") == "token")
    pieces = (
        tokens.groupBy(*keys, F.floor(F.col("seq") / BLOCK).alias("_b"))
        .agg(_joined(F.collect_list(F.struct("seq", "content"))).alias("content"))
    )
    texts = pieces.groupBy(*keys).agg(_joined(F.collect_list(F.struct("_b", "content"))).alias("_text"))
    closing = events.groupBy(*keys).agg(
        F.max(F.when(F.col("type").isin("done", "error"), F.struct("seq", "type", "content"))).alias("_end"),
        F.max_by(
            F.when(F.col("total_tokens").isNotNull(), F.col("total_tokens")),
            F.when(F.col("total_tokens").isNotNull(), F.col("seq")),
        ).alias("total_tokens"),
    )
    text = F.coalesce("_text", F.lit(""))
    failed = F.concat(F.lit("*Error: "), F.col("_end.content"), F.lit("*"))
    return closing.join(texts, keys, "left").select(
        *keys,
        F.when(F.col("_end.type") == "error", F.when(text == "", failed).otherwise(F.concat(text, F.lit("\n\n"), failed)))
        .when(F.col("_end").isNull() & (text == ""), F.lit(STOPPED))
        .otherwise(text).alias("content"),
        F.coalesce("_end.type", F.lit("stopped")).alias("ended_by"),
        F.coalesce("total_tokens", F.lit(0).cast("bigint")).alias("total_tokens"),
    )


ANSWER = "content string, ended_by string, total_tokens bigint"
#: Seconds without an event after which an answer counts as stopped.
STOP_AFTER = 600


class _Answer(StatefulProcessor):
    """Text of one answer as its events arrive in any order.

    The text up to the first missing token lies in a list of pieces, one per micro-batch, so that a long
    answer is never rewritten; tokens ahead of it wait in a list of packs, one per micro-batch that brings
    no token to go on with, and are read when one comes. So a micro-batch costs an answer a
    few calls of the store, however many tokens it brings. The closing event carries the number of tokens in front of it, which tells when all are there.
    """

    def __init__(self, keys: list[str], stop_after: int) -> None:
        self.keys, self.stop_after = keys, stop_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "expected bigint, closed_at bigint, ended_by string, message string, usage_at bigint, total_tokens bigint, done boolean")
        self.pieces = handle.getListState("pieces", "content string")
        self.ahead = handle.getListState("ahead", "pack string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        # ticks stay in the stream up to here: a filter would run before the watermark sees them
        events, latest = events[events["type"] != "tick"].sort_values("seq", kind="stable"), 0
        if not len(events):
            return
        expected, closed_at, ended_by, message, usage_at, usage, done = self.head.get() or (0, None, None, None, None, None, False)
        new, ahead = [], {}
        for e in events.itertuples(index=False):
            latest = max(latest, int(e.at.timestamp() * 1000))
            if done:
                continue
            if not pd.isna(e.total_tokens) and (usage_at is None or e.seq >= usage_at):
                usage_at, usage = int(e.seq), int(e.total_tokens)
            if e.type in ("done", "error"):
                closed_at, ended_by, message = int(e.seq), e.type, e.content
            elif e.type == "token" and e.seq >= expected:
                ahead[int(e.seq)] = e.content
            # smaller numbers are tokens that were delivered before
        if expected in ahead:
            ahead = self._waiting() | ahead
            while expected in ahead:
                new.append(ahead.pop(expected))
                expected += 1
            self.pieces.appendValue(("".join(new),))
            self.ahead.clear()
        if ahead:
            self.ahead.appendValue((json.dumps(list(ahead.items())),))
        if not done and closed_at is not None and expected >= closed_at:
            yield self._row(key, ended_by, message, usage)
            # what is delivered again finds the answer done
            self.pieces.clear()
            self.ahead.clear()
            done = True
        self.head.update((expected, closed_at, ended_by, message, usage_at, usage, done))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + 1000 * self.stop_after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head = self.head.get()
        if head:
            _, _, ended_by, message, _, usage, done = head
            if not done:
                yield self._row(key, ended_by, message, usage)
        self.head.clear()
        self.pieces.clear()
        self.ahead.clear()

    def _waiting(self) -> dict[int, str]:
        return {seq: content for pack in self.ahead.get() for seq, content in json.loads(pack[0])}

    def _row(self, key, ended_by, message, usage) -> pd.DataFrame:
        text = "".join(p[0] for p in self.pieces.get())
        # tokens are missing only if the answer has been given up
        text += "".join(c for _, c in sorted(self._waiting().items()))
        if ended_by == "error":
            text = f"{text}\n\n*Error: {message}*" if text else f"*Error: {message}*"
        elif ended_by is None and not text:
            text = STOPPED
        values = {**dict(zip(self.keys, key, strict=True)), "content": text, "ended_by": ended_by or "stopped", "total_tokens": usage or 0}
        return pd.DataFrame({name: [value] for name, value in values.items()})

    def close(self) -> None:
        pass


def assemble_stream(events: DataFrame, keys: list[str], stop_after: int = STOP_AFTER, delay: str = "10 minutes") -> DataFrame:
    """Streaming twin of :func:`assemble`: one row per answer, when its last event is there.

    ``events`` has the keys, ``seq``, ``type``, ``content``, ``total_tokens`` and the event time ``at``.
    Tokens are numbered from 0 and the closing event by their count. Events may come in any order and
    more than once within ``delay``. An answer without an event for ``stop_after`` seconds of event time
    is given out as it is and forgotten; events of type ``tick`` only move the clock on.
    """
    with_state_store(events.sparkSession)
    kinds = dict(events.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + ANSWER
    timed = events.withWatermark("at", delay).select(*keys, "seq", "type", "content", "total_tokens", "at")
    return timed.groupBy(*keys).transformWithStateInPandas(_Answer(keys, stop_after), schema, "append", "EventTime")
