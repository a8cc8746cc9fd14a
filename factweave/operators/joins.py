"""Joins whose meaning is more than equality: exactly one match or none, intervals, containment, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calls import cut


def exactly_one(left: DataFrame, right: DataFrame, on: list[str], none: str, many: str, payload: list[str]) -> DataFrame:
    """Left rows with the one match of right; without a match, or with several, the payload is withheld and a code says why.

    Right is reduced to one row per key before the join, so a frequent key multiplies nothing.
    """
    only = right.groupBy(*on).agg(F.count("*").alias("matches"), *[F.min(c).alias(c) for c in payload])
    out = left.join(only, on, "left")
    n = F.coalesce("matches", F.lit(0))
    return out.select(*left.columns, *[F.when(n == 1, F.col(c)).alias(c) for c in payload], F.when(n == 0, none).when(n > 1, many).alias("code"))


def paired(arms: DataFrame, key: list[str], id_column: str) -> DataFrame:
    """Keys with exactly one true and one false arm, and the ids of both; arms(is_true) may repeat or lack a side."""
    side = lambda t: F.col("is_true") == t
    both = arms.groupBy(*key).agg(F.count_if(side(True)).alias("t"), F.count_if(side(False)).alias("f"), F.min(F.when(side(True), F.col(id_column))).alias("true_arm"), F.min(F.when(side(False), F.col(id_column))).alias("false_arm"))
    return both.where("t = 1 and f = 1").drop("t", "f")


def marks(sets: DataFrame, group: list[str], member: list[str]) -> DataFrame:
    """(*group, size, hash1, hash2) of each group's set of members, of which sets has no repeats: equal sets share all three.

    The hashes are two 64-bit hashes of the members, joined by exclusive or, so sets stay rows and no group is ever gathered.
    """
    # Nulls are hashed as flags, as xxhash64 passes over them.
    parts = [x for c in member for x in (F.col(c).isNull(), F.col(c))]
    hashes = [F.bit_xor(F.xxhash64(F.lit(k), *parts)).alias(f"hash{k}") for k in (1, 2)]
    return sets.groupBy(*group).agg(F.count("*").alias("size"), *hashes)


MARK = ["size", "hash1", "hash2"]


def equal_sets(sets: DataFrame, group: str, member: str) -> DataFrame:
    """(first, other, members) of groups with the same set of members, each with the first of its equals.

    Sets are compared as rows, by size and hashes; only those of a first and its equals are told, as members in order with commas between.
    """
    rows = sets.select(group, member).distinct()
    whole = marks(rows, [group], [member])
    first = whole.groupBy(*MARK).agg(F.min(group).alias("first"))
    pairs = whole.join(first, MARK).where(F.col(group) > F.col("first")).select("first", F.col(group).alias("other"))
    # An equal of the first holds the same members, so each first's are put together once.
    told = rows.withColumnRenamed(group, "first").join(pairs.select("first").distinct(), "first", "left_semi")
    told = told.groupBy("first").agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"))
    return pairs.join(told, "first").select("first", "other", "members")


def _proper(pairs: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """The pairs (child, parent, n, size) of which the parent holds all n members of the child."""
    held = pairs.join(children.withColumnRenamed("g", "child"), "child").join(parents.withColumnRenamed("g", "parent"), ["parent", "m"], "left_semi")
    return held.groupBy("child", "n", "parent", "size").agg(F.count("*").alias("shared")).where("shared = n").select("child", "parent", "size")


def proper_supersets(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, parent, size): the parents' sets that hold all of a child's members and more; both are rows (g, m) without repeats.

    A superset holds the child's rarest member, so only the parents of that member are candidates, however frequent the others
    are; a candidate is a superset if it holds as many of the child's members as the child has.
    """
    held_by = parents.groupBy("m").agg(F.count("*").alias("held_by"))
    rare = children.join(held_by, "m", "left").withColumn("held_by", F.coalesce("held_by", F.lit(0)))
    child = rare.groupBy(F.col("g").alias("child")).agg(F.count("*").alias("n"), F.min_by("m", F.struct("held_by", "m")).alias("m"))
    size = parents.groupBy(F.col("g").alias("parent")).agg(F.count("*").alias("size"))
    pairs = child.join(parents.withColumnRenamed("g", "parent"), "m").join(size, "parent").where("n < size").select("child", "parent", "n", "size")
    return _proper(pairs, children, parents)


def minimal_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, parent): the one minimal proper superset of each child among the parents, null if there is none or there are several.

    Only distinct sets are compared, however many groups share one; a set that several parents share is no one parent. Minimal is by
    inclusion. If just one superset is minimal, it lies within all the others: so it is the smallest, no other
    is as small, and all others are proper supersets of it.
    """
    of_child, of_parent = (cut(marks(rows, ["g"], ["m"])) for rows in (children, parents))
    child_sets = of_child.groupBy(*MARK).agg(F.min("g").alias("rep"))
    parent_sets = of_parent.groupBy(*MARK).agg(F.min("g").alias("rep"), F.count("*").alias("copies"))
    only = lambda rows, sets: rows.join(sets.select(F.col("rep").alias("g")), "g", "left_semi")
    children, parents = cut(only(children, child_sets)), cut(only(parents, parent_sets))
    over = cut(proper_supersets(children, parents))
    best = over.groupBy("child").agg(F.count("*").alias("k"), F.min("size").alias("size"), F.min_by("parent", F.struct("size", "parent")).alias("best"))
    rest = over.join(best.select("child", "best", F.col("size").alias("n")), "child").where("parent <> best and size > n")
    pairs = rest.select(F.col("best").alias("child"), "parent", "n", "size").distinct()
    inside = _proper(pairs, parents, parents).select(F.col("child").alias("best"), "parent")
    held = rest.join(inside, ["best", "parent"], "left_semi").groupBy("child").agg(F.count("*").alias("held"))
    found = best.join(held, "child", "left").where(F.col("k") == F.coalesce("held", F.lit(0)) + 1)
    single = parent_sets.where("copies = 1").select(F.col("rep").alias("best"))
    found = found.join(single, "best").select(F.col("child").alias("rep"), F.col("best").alias("parent"))
    named = of_child.join(child_sets, MARK).select("g", "rep").join(found, "rep", "left")
    return named.select(F.col("g").alias("child"), "parent")


def minimal_supersets(sets: DataFrame, group: str, member: str) -> DataFrame:
    """(child, parent): minimal_parents() of sets among themselves."""
    rows = cut(sets.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct())
    return minimal_parents(rows, rows)


def contained_files(files: DataFrame, directories: DataFrame, path: str, directory: str) -> DataFrame:
    """Every pair of a file and a directory above it, paths parted by slashes; the empty directory holds every file.

    Each path is spread over the directories above it and met by equality, so no prefix is compared with every file.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    spread = files.where(F.col(path).isNotNull()).withColumn(directory, F.explode(above))
    return spread.join(directories.where(F.col(directory).isNotNull()).distinct(), directory)


def in_intervals(points: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, finish: str) -> DataFrame:
    """Every pair of a point and an interval (ends included) that holds it, within the equal columns."""
    return points.join(intervals, on).where(F.col(point).between(F.col(start), F.col(finish)))


def innermost(points: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, finish: str, tie: Column) -> DataFrame:
    """Each point with the interval that holds it and starts last; none if no interval does. An aggregate, not a window."""
    best = F.max_by(F.struct(*[c for c in intervals.columns if c not in on]), F.struct(F.col(start), tie)).alias("i")
    held = in_intervals(points, intervals, on, point, start, finish).groupBy(*on, point).agg(best).select(*on, point, "i.*")
    return points.join(held, [*on, point], "left")


# Rows of which a task may hold sets in memory, whatever the size of the input and the session's number of partitions.
ROWS_A_TASK = 500_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as leave each about ROWS_A_TASK: a plain shuffle deals out by cores, and tasks grow with the input."""
    return rows.repartition(max(rows.count() // ROWS_A_TASK + 1, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def agreement(rows: DataFrame, owner: str, anchor: str, value: list[str]) -> DataFrame:
    """(owner, agrees): whether all anchors of an owner carry the same set of values.

    An anchor's values are told apart and marked where they are dealt to; only one row an anchor goes on to its owner.
    """
    sets = marks(dealt(rows.select(owner, anchor, *value), owner, anchor).distinct(), [owner, anchor], value)
    same = [F.min(c) == F.max(c) for c in MARK]
    return sets.groupBy(owner).agg((same[0] & same[1] & same[2]).alias("agrees"))


def with_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """Parents with their children in order, a row for each with its ordinal from 0; a parent without children has one row of nulls."""
    place = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long")
    return parents.join(children.where(F.col(key).isNotNull()).select(key, place.alias("ordinal"), *payload), key, "left")
