"""Merkle manifest of a dataset: content-addressed tree segments, and proofs by descent from the root.

The leaves of a group are ranked by id. Every SEGMENT levels of a group's binary tree are cut
into records that map the digest at their top to the digests at their bottom (its children,
2**SEGMENT at most); the roots of all groups are the leaves of one more tree of the same kind. A
proof starts at the root: each record hands its descendants on by the next digit of their rank
and adds the children that a path leaves aside. Requests that share a path travel as one row
until they part, and the leaves' own requests are met in the last record only. A path so
collected runs downwards and is reversed in the end.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir.llm.common import stored

SEGMENT = 8
#: Columns that a leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<sibling: string, right: boolean>>"


class Forest(NamedTuple):
    """Trees over ranked nodes: their roots (tree, digest, levels) and, from the bottom up, the records of each segment."""

    roots: DataFrame
    records: list[DataFrame]


class Manifest(NamedTuple):
    root: str | None
    leaves: DataFrame
    groups: Forest
    top: Forest


def written(column: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(written, columns)), 256)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parents(nodes: Column) -> Column:
    """The next level: digests of two neighbours each, or of the last one alone."""
    firsts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(firsts, lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256))


def _levels(children: Column, height: Column) -> Column:
    """All levels of a record from its children to its top."""
    return F.aggregate(F.sequence(F.lit(1), height), F.array(children), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))


def _aside(levels: Column, digit: Column, height: Column) -> Column:
    """What the path to the child of that digit leaves aside, from the top down."""

    def step(level: Column) -> Column:
        place = F.call_function("shiftright", digit, level)
        return F.struct(F.get(F.get(levels, level), place.bitwiseXOR(F.lit(1))).alias("sibling"), (place % 2 == 0).alias("right"))

    return F.transform(F.sequence(height - 1, F.lit(0), F.lit(-1)), step)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with their rank in their tree from 0 and the tree's size, ordered by range partitions, whatever a tree's size."""
    keys = [F.asc_nulls_first(c) for c in (tree, *order)]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(sorted_.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    # one row per tree and partition
    runs = placed.groupBy(tree, "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    own = Window.partitionBy(tree)
    runs = runs.withColumn("before", F.sum("n").over(own.orderBy("part")) - F.col("n")).withColumn("total", F.sum("n").over(own))
    return placed.join(runs.drop("n"), [tree, "part"]).withColumn("rank", F.col("before") + F.col("place") - F.col("first")).drop("part", "place", "before", "first")


def forest(nodes: DataFrame, segment: int = SEGMENT) -> Forest:
    """Builds the trees over ``nodes`` (tree, rank, total, digest), a segment of levels at a time."""
    nodes = nodes.select("tree", "rank", "digest", F.when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0).alias("levels"))
    height, records, tops = nodes.agg(F.max("levels")).first()[0] or 0, [], [nodes.filter("levels = 0")]
    for base in range(0, height, segment):
        pairs = F.array_sort(F.collect_list(F.struct("rank", "digest")))
        grouped = nodes.filter(F.col("levels") > base).groupBy("tree", F.shiftright("rank", segment).alias("rank"), "levels").agg(pairs.alias("pairs"))
        rows = grouped.select("tree", "rank", "levels", F.transform("pairs", lambda p: p["digest"]).alias("children"), F.least(F.lit(segment), F.col("levels") - base).alias("height"))
        digest = _let(F.aggregate(F.sequence(F.lit(1), F.col("height")), F.col("children"), lambda level, _: _parents(level)), lambda top: F.get(top, F.lit(0)))
        records.append(stored(rows.withColumn("digest", digest)))
        nodes = records[-1].select("tree", "rank", "digest", "levels")
        tops.append(nodes.filter(F.col("levels") <= base + segment))
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.union(more)
    return Forest(stored(roots.select("tree", "digest", "levels")), records)


def manifest(docs: DataFrame, covered: tuple[str, ...] = COVERED, group: str = "lang", doc_id: str = "doc_id", carry: dict[str, Column] | None = None, segment: int = SEGMENT) -> Manifest:
    """The manifest of a table: one leaf per row, one tree per value of ``group``, one tree over those.

    Rows ascend by ``doc_id``, null first, then by leaf digest; rows repeated in full are leaves of
    their own. Groups ascend by their UTF-8 bytes, null first. Any column may be null. ``carry`` names more
    columns for the leaves, computed in the same scan. An empty table has no root.
    """
    more = [c.alias(name) for name, c in (carry or {}).items()]
    # null sorts before every value, and values by their bytes
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), tree.alias("tree"), leaf_digest(*[F.col(c) for c in covered]).alias("digest"), *more)
    # ranges are sampled before they are dealt; stored, the texts are read once
    leaves = stored(ranked(stored(rows), "tree", ["doc_id", "digest"]))
    groups = forest(leaves, segment)
    # the group's key serves as the order of its root in the one tree above
    upper = ranked(groups.roots.select(F.lit("").alias("all"), F.col("tree").alias("member"), "digest"), "all", ["member"])
    upper = stored(upper.withColumnRenamed("all", "tree"))
    top = forest(upper, segment)
    first = top.roots.first()
    return Manifest(first and first["digest"], leaves, Forest(groups.roots.join(upper.select(F.col("member").alias("tree"), "rank"), "tree"), groups.records), top)


def _handed_down(paths: DataFrame, records: DataFrame, base: int, segment: int) -> DataFrame:
    """One digit down: from the tops of records whose lowest level is ``base`` to each of their children."""
    store = records.select("digest", "height", "children").dropDuplicates(["digest", "height"])
    joined = paths.withColumn("height", F.least(F.lit(segment), F.col("levels") - base)).join(store, ["digest", "height"])
    steps = _let(
        _levels(F.col("children"), F.col("height")),
        lambda levels: F.transform(
            "children", lambda child, i: F.struct(i.cast("long").alias("digit"), child.alias("below"), F.concat(F.col("path"), _aside(levels, i, F.col("height"))).alias("path"))
        ),
    )
    below = joined.select(*[c for c in paths.columns if c not in ("digest", "path")], F.inline(steps))
    return below.withColumn("rank", F.col("rank") * (1 << segment) + F.col("digit")).withColumnRenamed("below", "digest").drop("digit")


def _to_last_records(tops: DataFrame, records: list[DataFrame], segment: int) -> DataFrame:
    """Paths from the tops of trees (tree, rank, digest, levels, path) to their lowest records; a tree of one leaf has arrived."""
    paths = tops.filter("levels = 0")
    for at in reversed(range(len(records))):
        joining = tops.filter(F.floor((F.col("levels") - 1) / segment) == at)
        higher = joining if at == len(records) - 1 else joining.unionByName(higher)
        if not at:
            return paths.unionByName(higher)
        higher = _handed_down(higher, records[at], at * segment, segment)
    return paths


def proofs(made: Manifest, requests: DataFrame | None = None, shown: str = "shown", segment: int = SEGMENT) -> DataFrame:
    """Per requested leaf: its digest, its group's root, the root, its path and what the digest ``shown`` folds to.

    ``requests`` are rows of the manifest's leaves, all of them by default; ``shown`` is the column of the digest
    that the holder of the row presents. ``path`` lists from the leaf up, per level, the
    sibling's digest (null for a node that stands alone) and whether it stands to the right.
    """
    empty = F.array().cast(STEP)
    asked = made.leaves if requests is None else requests
    starts = made.top.roots.select("tree", F.lit(0).cast("long").alias("rank"), "digest", "levels", empty.alias("path"))
    upper = _to_last_records(starts, made.top.records, segment)
    upper = upper.filter("levels = 0").unionByName(_handed_down(upper.filter("levels > 0"), made.top.records[0], 0, segment)) if made.top.records else upper
    tops = made.groups.roots.join(upper.select("rank", "path"), "rank").withColumn("rank", F.lit(0).cast("long")).withColumn("subroot", F.col("digest"))
    paths = _to_last_records(tops, made.groups.records, segment)

    # the leaves below one record ask together
    digit = F.col("rank").bitwiseAND(F.lit((1 << segment) - 1)).cast("int").alias("digit")
    batches = asked.groupBy("tree", F.shiftright("rank", segment).alias("rank")).agg(F.collect_list(F.struct(digit, "doc_id", F.col("digest").alias("leaf"), F.col(shown).alias("shown"))).alias("asked"))
    met = paths.join(batches, ["tree", "rank"]).withColumn("height", F.least(F.lit(segment), "levels"))
    if made.groups.records:
        met = met.join(made.groups.records[0].select("digest", "height", "children").dropDuplicates(["digest", "height"]), ["digest", "height"], "left")
    else:
        met = met.withColumn("children", F.lit(None).cast("array<string>"))
    levels = F.when(F.col("height") > 0, _levels(F.col("children"), F.col("height"))).otherwise(F.array().cast("array<array<string>>"))

    def answer(levels: Column, a: Column) -> Column:
        lowest = F.when(F.col("height") > 0, _aside(levels, a["digit"], F.col("height"))).otherwise(empty)
        return F.struct(a["doc_id"].alias("doc_id"), a["leaf"].alias("leaf"), a["shown"].alias("shown"), F.reverse(F.concat("path", lowest)).alias("path"))

    rows = met.select("subroot", F.inline(_let(levels, lambda x: F.transform("asked", lambda a: answer(x, a)))))
    return rows.select("doc_id", "leaf", "subroot", F.lit(made.root).alias("root"), "path", folded(F.col("shown"), F.col("path")).alias("folded_root"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(
        path, leaf,
        lambda node, step: F.sha2(F.when(step["sibling"].isNull(), node).when(step["right"], F.concat(node, step["sibling"])).otherwise(F.concat(step["sibling"], node)), 256),
    )


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings' digests, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda step: step["sibling"]), ""), 256)


def verified(made: Manifest, requests: DataFrame | None = None, shown: str = "shown", segment: int = SEGMENT) -> DataFrame:
    """The digest columns of ``proofs`` and whether what is shown leads to the root."""
    return proofs(made, requests, shown, segment).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
