"""Callback contracts: how often, and when, a method calls a delegate that it was given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flow, joins


def callback_contracts(callbacks: DataFrame, uses: DataFrame, spans: DataFrame, tree: DataFrame, exits: DataFrame) -> DataFrame:
    """(method, parameter, cardinality, trigger, invoke, condition) of callbacks(method, parameter).

    uses(method, parameter, op, kind, loop, unsupported, access, conditions, condition, statement) are what a method does with the parameter:
    kind invoke, or escape for anything else; what encloses an invocation is a loop, control flow that is not supported (a
    switch, try, using, lock or catch), a conditional access, or so many conditions, of which `condition` is the one and
    `statement` says whether it is an if statement. spans(method, op, block) are the blocks that hold an invocation by its place in the
    source; tree and exits are those of flow.on_every_way().

    The first rule that holds: Unbounded if the callback escapes or is not invoked; Unknown behind unsupported control flow;
    RepeatedOrUnknown for several invocations or one in a loop; ExactlyOnce if nothing encloses the invocation and its one block lies on
    every way to the exit; ZeroOrOne under one if statement whose condition is known; else Unknown. invoke is the first
    invocation, null for Unbounded.
    """
    invoked = F.col("kind") == "invoke"
    flag = lambda c: F.bool_or(invoked & F.coalesce(F.col(c), F.lit(False))).alias(c)
    per = uses.groupBy("method", "parameter").agg(
        F.bool_or(F.col("kind") == "escape").alias("escapes"), F.count_if(invoked).alias("n"), F.min(F.when(invoked, F.col("op"))).alias("op"),
        flag("loop"), flag("unsupported"), flag("access"), F.max(F.when(invoked, F.coalesce("conditions", F.lit(0)))).alias("conditions"),
        *[F.min_by(F.when(invoked, F.col(c)), F.when(invoked, F.col("op"))).alias(c) for c in ("condition", "statement")],
    )
    per = callbacks.distinct().join(per, ["method", "parameter"], "left")
    # A callback's one block, and whether ways to the exit go around it.
    placed = joins.exactly_one(per, spans, ["method", "op"], "None", "Several", ["block"]).withColumnRenamed("block", "node").drop("code")
    placed = flow.on_every_way(placed, tree, exits)
    free = (F.col("conditions") == 0) & ~F.col("access")
    single = (F.col("conditions") == 1) & ~F.col("access") & F.coalesce(F.col("statement"), F.lit(False)) & F.col("condition").isNotNull()
    kind = (
        F.when(F.coalesce(F.col("escapes"), F.lit(True)) | (F.col("n") == 0), "Unbounded")
        .when(F.col("unsupported"), "Unknown")
        .when((F.col("n") > 1) | F.col("loop"), "RepeatedOrUnknown")
        .when(free & F.col("on_every_way"), "ExactlyOnce")
        .when(single, "ZeroOrOne")
        .otherwise("Unknown")
    )
    out = placed.withColumn("cardinality", kind)
    trigger = F.when(F.col("cardinality") == "ExactlyOnce", "Unconditional").when(F.col("cardinality") == "ZeroOrOne", "Conditional").when(F.col("cardinality") != "Unbounded", "Unknown")
    return out.select("method", "parameter", "cardinality", trigger.alias("trigger"), F.when(F.col("cardinality") != "Unbounded", F.col("op")).alias("invoke"), F.when(F.col("cardinality") == "ZeroOrOne", F.col("condition")).alias("condition"))


def callback_regions(boundaries: DataFrame, members: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((entry, boundary, cardinality, trigger), (entry, boundary, node)): regions of entries that hold nodes of callback bodies.

    boundaries(boundary, method, cardinality, trigger) count for an entry that has a node of their method; members(boundary,
    operation) meet nodes(entry, node, method, operation) by their operation, whatever they say or are. A boundary without a
    member among the entry's nodes is no region.
    """
    callers = nodes.select("entry", "method").distinct().join(boundaries, "method")
    held = callers.select("entry", "boundary").join(members.distinct(), "boundary").join(nodes.select("entry", "operation", "node"), ["entry", "operation"])
    held = held.select("entry", "boundary", "node").distinct()
    regions = callers.join(held.select("entry", "boundary").distinct(), ["entry", "boundary"], "left_semi")
    return regions.select("entry", "boundary", "cardinality", "trigger").distinct(), held
