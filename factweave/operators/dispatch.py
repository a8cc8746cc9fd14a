"""What a dispatched handler does: its direct calls with one further level, the loop that holds them, and what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import admission, calls

#: Codes that leave the rest of an expansion standing.
HARMLESS = ("SC-DISPATCH-CALL-WITHHELD", "SC-DISPATCH-RETURN-MISMATCH")


def complete_loops(loops: DataFrame, exits: DataFrame) -> DataFrame:
    """(method, header, whole) of methods with loops(method, latch, header, node): their one complete loop, or whole false.

    Complete is a single loop with one way back (a latch other than its header), a body and an exit(method, latch, header, node).
    """
    per = loops.groupBy("method", "latch", "header").agg(F.count_if(F.col("node") != F.col("header")).alias("body"))
    left = exits.select("method", "latch", "header").distinct().withColumn("left", F.lit(True))
    per = per.join(left, ["method", "latch", "header"], "left")
    whole = (F.count("*") == 1) & F.bool_and((F.col("body") > 0) & F.coalesce(F.col("left"), F.lit(False)))
    return per.groupBy("method").agg(F.min("header").alias("header"), whole.alias("whole"))


def expand_handlers(dispatches: DataFrame, methods: DataFrame, invocations: DataFrame, sites: DataFrame, loops: DataFrame, exits: DataFrame, returns: DataFrame) -> dict[str, DataFrame]:
    """Steps, returns and diagnostics of dispatches(dispatch, boundary, cardinality, resolution, handler, body_available, response_type).

    methods(method_id, return_type, flows); invocations and sites as admission takes them, invocations with block and evaluation; loops and
    exits as flow gives them; returns(method, operation) are returns of a value. Every table is cut to the handlers and, for the
    further level, to what they call.

    steps(dispatch, ordinal, depth, caller, target, operation, parent, header): in pre-order, calls in the order of (block, evaluation,
    node) and each followed by the admitted calls of its target; header is that of the handler's one complete loop if it holds the
    call's block. A handler's call that is not admitted is withheld with a code, its targets' calls without. returned(dispatch, operation, type_name):
    the handler's one return if its type, out of a task, is the response's. diagnostics(dispatch, code, detail); a dispatch
    with a code about itself or its handler has no steps.
    """
    known = methods.select(F.col("method_id").alias("handler"), "return_type", F.col("flows").alias("handler_flows"))
    rows = dispatches.join(known, "handler", "left")
    exact = (F.col("boundary") == "RequestResponse") & (F.col("cardinality") == "ExactlyOne")
    code = (
        F.when(~F.coalesce(exact, F.lit(False)), "SC-DISPATCH-UNRESOLVED").when(F.col("resolution") == "Ambiguous", "SC-DISPATCH-AMBIGUOUS")
        .when((F.col("resolution") == "GeneratedBodyUnavailable") | (F.col("handler").isNotNull() & ~F.coalesce("body_available", F.lit(False))), "SC-DISPATCH-BODY-UNAVAILABLE")
        .when(F.coalesce(F.col("resolution") != "ExactSingle", F.lit(True)), "SC-DISPATCH-UNRESOLVED")
    )
    missing = F.col("handler").isNotNull() & (F.coalesce("handler_flows", F.lit(0)) != 1)
    rows = calls.cut(rows.withColumn("code", code).withColumn("missing", missing))
    told = [rows.where("code is not null").select("dispatch", "code", F.col("handler").cast("string").alias("detail")), rows.where("missing").select("dispatch", F.lit("SC-DISPATCH-HANDLER-FLOW-MISSING"), F.col("handler").cast("string"))]
    sound = rows.where("code is null and not missing and handler is not null").select("dispatch", "handler", "response_type", "return_type")

    order = Window.partitionBy("caller").orderBy("block", "evaluation", "node")
    placed = invocations.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    judged = admission.admit(invocations, sites, "leaf").select("caller", "op", "node", "withheld")
    placed = placed.join(judged, ["caller", "op", "node"]).select("caller", "op", "node", "block", "place", "target", "withheld", (F.coalesce("source_backed", F.lit(False)) & ~F.coalesce("nested", F.lit(False)) & ~F.coalesce("platform", F.lit(False))).alias("eligible"))
    own = placed.join(sound.select(F.col("handler").alias("caller")).distinct(), "caller", "left_semi").where("eligible")
    selected = complete_loops(loops, exits).withColumnRenamed("method", "caller")
    inside = loops.where("node <> header").select(F.col("method").alias("caller"), "header", F.col("node").alias("block")).join(selected.where("whole").select("caller", "header"), ["caller", "header"], "left_semi").distinct()
    own = calls.cut(own.join(inside, ["caller", "block"], "left"))
    first = sound.select("dispatch", F.col("handler").alias("caller")).join(own, "caller")
    told.append(first.where("withheld is not null").select("dispatch", F.lit(HARMLESS[0]), F.col("op").cast("string")))
    broken = selected.where("not whole").select(F.col("caller").alias("handler"))
    told.append(sound.join(broken, "handler", "left_semi").select("dispatch", F.lit("SC-DISPATCH-LOOP-INCOMPLETE"), F.col("handler").cast("string")))

    steps = first.where("withheld is null").select("dispatch", "caller", "target", F.col("op").alias("operation"), F.lit(None).cast("long").alias("parent"), "header", F.array("place", F.lit(-1).cast("long"), "node").alias("key"), F.lit(0).alias("depth"))
    walked = methods.where("flows = 1").select(F.col("method_id").alias("caller"))
    below = placed.where("withheld is null").join(walked, "caller", "left_semi").join(own.where("withheld is null").select(F.col("target").alias("caller")).distinct(), "caller", "left_semi")
    below = below.select("caller", "op", "node", "place", "target")
    up = first.where("withheld is null").select("dispatch", F.col("target").alias("caller"), F.col("op").alias("parent"), F.col("place").alias("up"), F.col("node").alias("up_node"))
    nested = up.join(below, "caller").select("dispatch", "caller", "target", F.col("op").alias("operation"), "parent", F.lit(None).cast("long").alias("header"), F.array("up", "place", "node").alias("key"), F.lit(1).alias("depth"))
    ordinal = F.row_number().over(Window.partitionBy("dispatch").orderBy("key", "operation")) - 1
    steps = steps.unionAll(nested).select("dispatch", ordinal.cast("long").alias("ordinal"), "depth", "caller", "target", "operation", "parent", "header")

    one = returns.groupBy(F.col("method").alias("handler")).agg(F.count("*").alias("n"), F.min("operation").alias("operation")).where("n = 1").drop("n")
    effective = text.effective_return_type(F.col("return_type"))
    ended = sound.join(one, "handler").withColumn("type_name", effective)
    same = F.coalesce(F.col("type_name") == F.col("response_type"), F.lit(False))
    told.append(ended.where(~same & F.col("response_type").isNotNull()).select("dispatch", F.lit(HARMLESS[1]), F.col("operation").cast("string")))
    found = told[0]
    for more in told[1:]:
        found = found.unionAll(more)
    return {"steps": steps, "returned": ended.where(same).select("dispatch", "operation", "type_name"), "diagnostics": found}
