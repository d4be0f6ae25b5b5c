"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

A source's demand over training time t in [0, 1] is its target times
``(1 - ramp) t + ramp t^2``, the integral of a weight schedule that runs linearly from
``1 - ramp`` to ``1 + ramp`` times its mean. A document stands where its source's
demand reaches the words before it: the schedule is inverted in closed form, and the
integral of all demands at that time is its position in training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir.llm.common import WHITE_SPACE, row_of, stored

SLICE_ROWS = 4096


def word_count(text: Column) -> Column:
    """White-space separated words of a text; 0 for null."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")
    return F.size(words).cast("long")


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """One stored row per document: its id, size, source key and fixed random order."""
    return stored(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), row_of(row), F.col(source).cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("-")).alias("source_key"),
            word_count(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("draw"),
        )
    )


def targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Per source: words, weight, target and schedule ramp; one row each, ranked as a whole.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Targets share all
    words by weight, none above ``max_repeats`` times its source: with sources in order of
    cap per weight, the level to which the others rise is the largest of the levels that
    follow when all before are full. Weight 1 fades over time, 3 grows, 2 stays.
    """
    facts = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    facts = facts.withColumn("weight", F.pmod(rank, F.lit(3)) + 1).withColumn("cap", F.col("source_size") * max_repeats)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    facts = facts.withColumn("level", rest.cast("double") / open_weight)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(every))
    facts = facts.withColumn("target", target).withColumn("ramp", (F.col("weight") - 2) * 0.5)
    return facts.select(
        "source_key", "source_size", "rows", "weight", "target", "ramp",
        F.sum(F.col("target") * (1 - F.col("ramp"))).over(every).alias("even"), F.sum(F.col("target") * F.col("ramp")).over(every).alias("bent"),
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", max_repeats: int = 3, row: str | None = None) -> DataFrame:
    """Every document with the words that the mix takes of it and its place in training.

    A source is read in a fixed random order as often as its target asks for; the last
    pass ends with the target, in the middle of a document if need be, so a source's
    taken words are its target, rounded. ``copies`` counts whole passes, ``part`` is what the
    last one takes, ``position`` is where the first pass meets the document (null if none
    does). Reruns agree. Sources without words, null texts and null ids take part with
    size 0 or in the order of their row. A source of any size is summed in slices of
    about SLICE_ROWS documents. ``row`` names a column that numbers the rows, if there is one.
    """
    sizes = sized(docs, text, source, doc_id, row)
    facts = targets(sizes, max_repeats)
    slices = F.ceil(F.col("rows") / SLICE_ROWS)
    first_bits = F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / float(2**32)
    # dealt by slice: after a join on the source alone, its largest one would be summed in one task
    rows = sizes.join(facts, "source_key").withColumn("slice", F.floor(first_bits * slices)).repartition("source_key", "slice")
    before_slice = (
        rows.groupBy("source_key", "slice").agg(F.sum("size").alias("slice_size"))
        .withColumn("slice_start", F.sum("slice_size").over(Window.partitionBy("source_key").orderBy("slice")) - F.col("slice_size"))
        .drop("slice_size")
    )
    up_to = Window.partitionBy("source_key", "slice").orderBy("draw", F.asc_nulls_first("doc_id"), "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("until", F.sum("size").over(up_to)).join(before_slice, ["source_key", "slice"])
    rows = rows.withColumn("before", F.col("slice_start") + F.col("until") - F.col("size"))
    wanted = F.round("target").cast("long")
    rows = rows.withColumn("copies", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long")))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), wanted - F.col("copies") * F.col("source_size") - F.col("before")))
    rows = rows.withColumn("part", part).withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    position = F.when(F.col("taken") > 0, position_at(F.col("before")))
    return rows.select("doc_id", "row", "size", "source_size", "target", "taken", "copies", "part", position.alias("position"), "draw", "before", "ramp", "even", "bent")


def position_at(words: Column) -> Column:
    """Training position, in words of all sources, at which a source's demand has reached ``words`` of its own."""
    share, ramp = words / F.round("target"), F.col("ramp")
    time = F.when(ramp == 0, share).otherwise((ramp - 1 + F.sqrt(F.pow(1 - ramp, 2) + 4 * ramp * share)) / (2 * ramp))
    return F.col("even") * time + F.col("bent") * time * time


def passes(mixed: DataFrame) -> DataFrame:
    """One row per time that a document is read, with the position of that pass; at most ``max_repeats`` a document.

    A last pass that takes less than half of a document is left out, so that texts stay whole.
    """
    times = F.col("copies") + (F.col("part") * 2 >= F.col("size")).cast("long")
    rows = mixed.filter((F.col("taken") > 0) & (times > 0)).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    return rows.select("row", "pass", position_at(F.col("pass") * F.col("source_size") + F.col("before")).alias("position"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position; documents that the mix leaves out come first, in their random order."""
    return mixed.repartitionByRange("position", "draw", "row").sortWithinPartitions("position", "draw", "row")
