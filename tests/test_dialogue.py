import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from docweir.operators import history
from docweir.operators.blocks import with_neighbour
from docweir.streaming import jobs, tokens


def test_neighbours_in_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", t) for t in rng.sample(range(20000), 3000)] + [(f"c{i % 40}", i * 7) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, t bigint").repartition(6)
    w = Window.partitionBy("k").orderBy("t")
    plain = df.select("k", "t", F.lag("t").over(w).alias("p"), F.lead("t").over(w).alias("n"))
    out = with_neighbour(with_neighbour(df, "k", "t", "p", F.col("t"), -1, block=64), "k", "t", "n", F.col("t"), 1, block=64)
    assert sorted(map(tuple, out.select("k", "t", "p", "n").collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


MESSAGE = "message_id bigint, conv_id bigint, turn bigint, role string, variant string, content string, raw_question string, compacted boolean, truncated boolean"


def messages(spark, rows):
    return spark.createDataFrame([(i, 1, i, *r, False, False) for i, r in enumerate(rows)], MESSAGE)


def test_variants_and_raw_question(spark):
    rows = messages(spark, [("user", None, "wrapped", "typed"), ("ai", "rag_on", "on", None), ("ai", "rag_off", "off", None)])
    on = history.history(rows, variant="rag_on").orderBy("turn").collect()
    off = history.history(rows, variant="rag_off").orderBy("turn").collect()
    assert [r.content for r in on] == ["wrapped", "on"] and [r.content for r in off] == ["typed", "off"]
    assert on[1].role == "assistant"


def test_truncate_and_compact(spark):
    rows = messages(spark, [("user", None, c, None) for c in "abc"])
    counts = spark.createDataFrame([(1, 2)], "conv_id bigint, count int")
    assert [r.truncated for r in history.mark_truncated(rows, counts).orderBy("turn").collect()] == [True, True, False]
    summary = spark.createDataFrame([(1, 99, 99, "sum")], "conv_id bigint, message_id bigint, turn bigint, summary string")
    got = history.apply_compaction(rows, summary).orderBy("turn").collect()
    assert [(r.compacted, r.is_summary) for r in got] == [(True, False)] * 3 + [(False, True)]


def test_halving_matches_the_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(60):
        toks = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 40))]
        limit = rng.randrange(20, 500)
        kept = list(toks)
        while len(kept) > 1 and sum(kept) + 5 > limit:
            kept = kept[len(kept) // 2 :]
        want[conv] = (len(toks), len(kept), limit)
        rows += [(conv, len(toks) - i, t) for i, t in enumerate(toks)]
    frame = spark.createDataFrame(rows, "conv_id bigint, recency int, tokens bigint")
    budgets = spark.createDataFrame([(c, 5, w[2]) for c, w in want.items()], "conv_id bigint, fixed_tokens int, threshold int")
    got = {r.conv_id: (r.before, r.kept) for r in history.halving_truncate(frame, budgets).collect()}
    assert got == {c: w[:2] for c, w in want.items()}


def polls(seed):
    rng = random.Random(seed)
    rows = []
    for job in range(30):
        bad = rng.choice([0.05, 0.6, 0.0])
        for n in range(rng.choice([3, 40, 230])):
            ok = rng.random() >= bad
            status = rng.choice(["in_progress"] * 30 + ["pending", "odd", None, "completed" if job % 3 else "in_progress", "failed" if job % 5 == 0 else "in_progress"])
            rows.append((f"j{job}", n, status, ok, n, n + 1))
    return rows


def test_job_states_agree_with_the_state_machine(spark):
    rows = polls(5)
    frame = spark.createDataFrame(rows, "job_id string, seq bigint, status string, http_ok boolean, pages_fetched bigint, pages_total bigint")
    got = {r.job_id: tuple(r)[1:] for r in jobs.job_states(frame.repartition(5)).collect()}
    pdf = pd.DataFrame(rows, columns=frame.columns)
    for job, part in pdf.groupby("job_id"):
        state = ("pending", None, None, None, 0, 0)
        for cut in (part.iloc[:50], part.iloc[50:]):
            state = jobs._advance(state, cut)
        assert got[job] == state[:5], job
    assert {g[0] for g in got.values()} == {"in_progress", "completed", "failed"}


def test_expiry_edges(spark):
    rows = spark.createDataFrame(
        [("a", "in_progress", "2024-01-01 00:00:00"), ("b", "completed", "2024-01-01 00:00:00"), ("c", "in_progress", "2024-01-01 00:00:01")],
        "job_id string, status string, at string",
    ).withColumn("updated_at", F.to_timestamp("at"))
    got = {r.job_id: r.status for r in jobs.expire(rows, F.to_timestamp(F.lit("2024-01-01 00:10:00"))).collect()}
    assert got == {"a": None, "b": "completed", "c": "in_progress"}


def test_tokens_join_across_blocks(spark):
    n = 10000
    rows = [("c", i, "token", f"{i} ", None) for i in range(n)] + [("c", n, "done", "", 7), ("d", 0, "start", "", None)]
    frame = spark.createDataFrame(rows, "conv string, seq bigint, type string, content string, total_tokens bigint").repartition(7)
    got = {r.conv: r for r in tokens.assemble(frame, ["conv"]).collect()}
    assert got["c"].content == "".join(f"{i} " for i in range(n)) and got["c"].total_tokens == 7
    assert got["d"].content == "*Generation stopped.*" and got["d"].ended_by == "stopped"
