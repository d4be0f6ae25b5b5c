"""Stateful streams: answers from shuffled, repeated and missing events; records that expire by event time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docweir.streaming import jobs, tokens

START = datetime(2024, 1, 1)


def feed(spark, folder, make, schema, batches):
    """Runs one micro-batch per list of rows and returns what each gave out."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        got = []
        run = (
            make(stream).writeStream.option("checkpointLocation", f"{folder}/state").outputMode("append")
            .foreachBatch(lambda df, _, got=got: got.extend(df.collect())).trigger(availableNow=True).start()
        )
        run.awaitTermination()
        out.append(sorted(map(tuple, got), key=str))
    return out


EVENTS = "answer string, seq long, type string, content string, total_tokens long, at timestamp"


def answer(name, words, end="done", message=None, at=START):
    rows = [(name, i, "token", w, None, at) for i, w in enumerate(words)]
    return rows + ([(name, len(words), end, message, 10 * len(words), at)] if end else [])


def test_answers_from_shuffled_batches(spark, tmp_path):
    draw = random.Random(7)
    rows = answer("a", ["one ", "two ", "three"]) + answer("b", [], "error", "boom") + answer("c", ["x"] * 300, "error", "late")
    rows += answer("d", ["cut ", "off"], None) + [("e", 0, "start", None, None, START)]
    # delivered twice, in any order
    rows = rows + draw.sample(rows, 200)
    draw.shuffle(rows)
    tick = [("a", 0, "tick", None, None, START + timedelta(days=1))]
    batches = [rows[i::4] for i in range(4)] + [tick]
    got = feed(spark, str(tmp_path), lambda s: tokens.assemble_stream(s, ["answer"]), EVENTS, batches)
    want = {
        ("a", "one two three", "done", 30), ("b", "*Error: boom*", "error", 0), ("c", "x" * 300 + "\n\n*Error: late*", "error", 3000),
        ("d", "cut off", "stopped", 0), ("e", tokens.STOPPED, "stopped", 0),
    }
    assert sorted(r for batch in got for r in batch) == sorted(want)
    # the open ones wait for the clock
    assert {r[0] for r in got[4]} == {"d", "e"}
    events = spark.createDataFrame(rows, EVENTS).dropDuplicates().withColumn("seq", F.when(F.col("type").isin("done", "error"), 1 << 62).otherwise(F.col("seq")))
    assert sorted(map(tuple, tokens.assemble(events.drop("at"), ["answer"]).collect())) == sorted(want)


def test_answer_is_given_out_once_and_only_whole(spark, tmp_path):
    rows = answer("a", ["1", "2", "3"])
    batches = [[rows[3], rows[0]], [rows[2]], [rows[1]], rows, [("a", 0, "tick", None, None, START + timedelta(days=1))], [("z", 0, "tick", None, None, START + timedelta(days=2))]]
    got = feed(spark, str(tmp_path), lambda s: tokens.assemble_stream(s, ["answer"]), EVENTS, batches)
    assert got == [[], [], [("a", "123", "done", 30)], [], [], []]


def test_missing_token_ends_with_the_clock(spark, tmp_path):
    rows = answer("a", ["1", "2", "3"])
    got = feed(spark, str(tmp_path), lambda s: tokens.assemble_stream(s, ["answer"]), EVENTS, [[rows[3], rows[0], rows[2]], [("z", 0, "tick", None, None, START + timedelta(days=1))]])
    assert got == [[], [("a", "13", "done", 30)]]


UPDATES = "job_id string, status string, at timestamp"


@pytest.mark.parametrize("parts", [1, 4])
def test_records_expire_by_event_time(spark, tmp_path, parts):
    def at(seconds):
        return START + timedelta(seconds=seconds)

    rows = [
        ("run", "in_progress", at(0)), ("run", "in_progress", at(599)), ("run", "in_progress", at(1300)), ("end", "completed", at(5)), ("end", "failed", at(3000)),
        ("kept", "in_progress", at(6500)), ("edge", "in_progress", at(100)), ("edge", "in_progress", at(700)), ("clock", "pending", at(6604.5)),
    ]
    rows.sort(key=lambda r: r[2])
    size = -(-len(rows) // parts)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    got = feed(spark, str(tmp_path), jobs.forgotten_stream, UPDATES, batches)
    batch = jobs.forgotten(spark.createDataFrame(rows, UPDATES), F.lit(at(6604.5)))
    want = sorted(map(tuple, batch.collect()), key=str)
    assert sorted((r for b in got for r in b), key=str) == want
    assert want == sorted([("run", "in_progress", at(1199)), ("run", "in_progress", at(1900)), ("end", "failed", at(6600)), ("edge", "in_progress", at(700)), ("edge", "in_progress", at(1300))], key=str)


def test_expiry_waits_for_the_watermark(spark, tmp_path):
    rows = [[("a", "in_progress", START)], [("b", "completed", START + timedelta(seconds=600))], [("c", "pending", START + timedelta(seconds=4199))], [("c", "pending", START + timedelta(seconds=4201))]]
    got = feed(spark, str(tmp_path), jobs.forgotten_stream, UPDATES, rows)
    # 600 s for a running job, 3600 s for a finished one
    assert got == [[], [("a", "in_progress", START + timedelta(seconds=600))], [], [("b", "completed", START + timedelta(seconds=4200))]]
