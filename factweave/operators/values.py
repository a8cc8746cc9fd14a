"""Operations of methods: flow nodes, the operations of a block, constant arguments, the value graph.

Operations are rows (method, op, block, evaluation, kind, ...), their operands rows (method, op, place, operand). Operations of a
method follow each other by (block, evaluation, op). Every look-up is an equi-join on (method, op); null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .calls import closure_within

CALLS = ("Invocation", "DynamicInvocation", "EventAssignment", "ObjectCreation")
ASSIGNMENTS = ("Assignment", "CompoundAssignment")
MEMBERS = ("FieldReference", "PropertyReference")
NO_VALUE = ("ExpressionStatement", "Return", "Throw")


def flow_kind(kind: Column) -> Column:
    """The kind of flow node that an operation becomes; a null kind is an Operation."""
    own = F.when(kind.isin("Await", "Return", "Throw"), kind).when(kind == "Unknown", "UnknownOperation")
    return F.when(kind.isin(*CALLS), "Invocation").otherwise(F.coalesce(own, F.lit("Operation")))


def anchors(ops: DataFrame, operands: DataFrame) -> DataFrame:
    """(method, operation, anchor): the flow nodes, named by their op, at which an operation stands.

    Calls and plain operations stand for themselves, an await for its operand (without one for itself), others for nothing.
    """
    awaited = operands.where("place = 0").select("method", "op", "operand")
    rows = ops.withColumn("node", flow_kind(F.col("kind"))).where("node in ('Operation', 'Invocation', 'Await')").join(awaited, ["method", "op"], "left")
    key = F.when(F.col("node") == "Await", F.coalesce("operand", "op")).otherwise(F.col("op"))
    return rows.select("method", key.alias("operation"), F.col("op").alias("anchor"))


def block_operations(roots: DataFrame, operands: DataFrame, ops: DataFrame) -> DataFrame:
    """(method, block, op, ordinal): all operations below a block's roots(method, block, op), once a block, in evaluation order."""
    down = closure_within(roots.select("method", F.col("block").alias("start"), F.col("op").alias("node")), operands.select("method", F.col("op").alias("source"), F.col("operand").alias("target")), ["method"])
    rows = down.select("method", F.col("start").alias("block"), F.col("node").alias("op")).join(ops.select("method", "op", "evaluation"), ["method", "op"])
    order = Window.partitionBy("method", "block").orderBy("evaluation", "op")
    return rows.select("method", "block", "op", (F.row_number().over(order) - 1).cast("long").alias("ordinal"))


def terminal_values(blocks: DataFrame, roots: DataFrame, ops: DataFrame) -> DataFrame:
    """(method, block, node, value): the terminal node of blocks(method, block, terminal) that return or throw.

    The value is the first root by (evaluation, op) that neither returns nor throws; a rethrow has none.
    """
    first = roots.join(ops.select("method", "op", "evaluation", "kind"), ["method", "op"]).where("kind not in ('Return', 'Throw')")
    first = first.groupBy("method", "block").agg(F.min_by("op", F.struct("evaluation", "op")).alias("value"))
    ends = blocks.where("terminal in ('Return', 'Throw', 'Rethrow')").join(first, ["method", "block"], "left")
    value = F.when(F.col("terminal") != "Rethrow", F.col("value"))
    return ends.select("method", "block", F.col("terminal").alias("node"), value.alias("value"))


def constant_arguments(arguments: DataFrame) -> DataFrame:
    """Arguments (method, op, ordinal, type, value, is_constant) of calls of which every argument is proven constant.

    Arguments of one call go together: one without ordinal, constant or type leaves the call without any.
    """
    proven = F.col("ordinal").isNotNull() & F.coalesce("is_constant", F.lit(False)) & (F.trim(F.coalesce("type", F.lit(""))) != "")
    whole = arguments.groupBy("method", "op").agg(F.bool_and(proven).alias("whole")).where("whole").drop("whole")
    return arguments.join(whole, ["method", "op"], "left_semi").select("method", "op", "ordinal", "type", "value")


def argument_labels(arguments: DataFrame) -> DataFrame:
    """(method, op, label): the arguments of a call in order, strings quoted; null unless the ordinals are 0 to n-1, each once,
    and no value is null or looks sensitive. The arguments of one call are few, as its source is."""
    quoted = F.col("value")
    for sign, escape in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t"), ("`", "\\`")):
        quoted = F.replace(quoted, F.lit(sign), F.lit(escape))
    shown = F.when(F.col("type") == "System.String", F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(F.col("value"))
    rows = arguments.withColumn("shown", shown).withColumn("hidden", text.looks_sensitive(F.col("value")))
    n = F.count("*")
    sound = (F.count_distinct("ordinal") == n) & (F.min("ordinal") == 0) & (F.max("ordinal") == n - 1) & ~F.bool_or("hidden")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "shown"))), lambda p: p["shown"])
    return rows.groupBy("method", "op").agg(F.when(sound, F.array_join(parts, ", ")).alias("label"))


def _value() -> Column:
    """The value kind and role of an operation that is a value node, else null; any: it has operands, assigns: two at places 0 and 1."""
    kind = F.col("kind")
    cases = [
        ((kind == "ParameterReference") & F.col("parameter").isNotNull(), "Parameter", F.lit("parameter")),
        (kind == "Literal", "Constant", F.lit("constant")),
        ((kind == "LocalReference") & F.col("local_name").isNotNull(), "OperationResult", F.concat(F.lit("local:"), "local_name")),
        (kind.isin(*ASSIGNMENTS) & F.col("assigns"), "LocalDefinition", F.lit("definition")),
        (kind == "Invocation", "InvocationResult", F.lit("invocation")),
        (kind.isin(*MEMBERS) & F.col("member").isNotNull(), "MemberRead", F.lit("member-read")),
        (kind == "Conversion", "OperationResult", F.lit("conversion")),
        (F.col("any") & ~kind.isin(*NO_VALUE), "OperationResult", F.lit("result")),
    ]
    return F.coalesce(*[F.when(when, F.struct(F.lit(value).alias("value_kind"), role.alias("role"))) for when, value, role in cases])


def value_nodes(ops: DataFrame, operands: DataFrame) -> DataFrame:
    """(method, op, kind, value_kind, role): the operations that yield a value, or define one.

    ops also holds parameter (its ordinal), local_name and member, null where the operation has none; an assignment has its
    target at place 0 and its value at place 1.
    """
    has = operands.groupBy("method", "op").agg((F.count_distinct(F.when(F.col("place") < 2, F.col("place"))) == 2).alias("assigns"), F.lit(True).alias("any"))
    rows = ops.join(has, ["method", "op"], "left").withColumn("v", _value()).where("v is not null")
    return rows.select("method", "op", "kind", "v.value_kind", "v.role")


def _assigned(ops: DataFrame, operands: DataFrame, nodes: DataFrame) -> DataFrame:
    """Assignments whose value is a value node, with the kind, local name and member of their target."""
    sides = operands.groupBy("method", "op").agg(F.min(F.when(F.col("place") == 0, F.col("operand"))).alias("target"), F.min(F.when(F.col("place") == 1, F.col("operand"))).alias("value"))
    target = ops.select("method", F.col("op").alias("target"), F.col("kind").alias("target_kind"), "local_name", "member")
    value = nodes.select("method", F.col("op").alias("value"))
    rows = ops.where(F.col("kind").isin(*ASSIGNMENTS)).select("method", "op", "block", "evaluation")
    return rows.join(sides, ["method", "op"]).join(target, ["method", "target"]).join(value, ["method", "value"], "left_semi")


def value_edges(ops: DataFrame, operands: DataFrame) -> DataFrame:
    """(method, source, target, kind): how values flow between the value nodes of a method.

    Assignment: from the value to the definition of a local. CaptureCollapse: from the latest definition before it to a use of
    a local. Argument, Conversion (of a single operand), Operand: from an operand to its operation.

    A method is dealt once, and what an operation needs to know of another is told within it: no join deals it again. An operation
    of a method is one row of ops.
    """
    own = F.struct("block", "evaluation", "kind", "parameter", "local_name", "member")
    rows = ops.select("method", "op", own.alias("own"), F.lit(None).alias("given")).unionByName(operands.select("method", "op", F.lit(None).alias("own"), F.struct("place", "operand").alias("given")))
    at = lambda k: F.min(F.when(F.col("given.place") == k, F.col("given.operand")))
    has = lambda k: F.coalesce(F.bool_or(F.col("given.place") == k), F.lit(False))
    per = rows.where("method is not null and op is not null").repartition("method").groupBy("method", "op").agg(
        F.first("own", ignorenulls=True).alias("own"), F.collect_list("given").alias("given"), at(0).alias("first"), at(1).alias("second"), (has(0) & has(1)).alias("assigns")
    )
    per = per.where("own is not null").select("method", "op", "own.*", "given", "first", "second", "assigns", (F.size("given") > 0).alias("any"))
    kind, asks = F.col("kind"), lambda key, way: F.struct(key.alias("key"), F.lit(way).alias("way") if isinstance(way, str) else way.alias("way"))
    per = per.withColumn("node", _value().isNotNull())
    # What an operation asks for: an assignment its sides, any other value its operands; and its own row, which answers.
    takes = F.col("node") & (kind != "LocalReference") & ((kind != "Conversion") | (F.size("given") == 1))
    way = F.when(kind == "Invocation", "Argument").when(kind == "Conversion", "Conversion").otherwise("Operand")
    asked = F.when(kind.isin(*ASSIGNMENTS), F.array(asks(F.col("first"), "Target"), asks(F.col("second"), "Value"))).when(takes, F.transform("given", lambda g: asks(g["operand"], way)))
    own = F.array(asks(F.col("op"), F.lit(None).cast("string")))
    asked = per.select("method", "op", "block", "evaluation", "kind", "local_name", "node", F.inline(F.concat(own, F.coalesce(asked, F.slice(own, 1, 0))))).where("key is not null")
    answers = Window.partitionBy("method", "key")
    told = asked.withColumn("is_node", F.max(F.when(F.col("way").isNull(), F.col("node"))).over(answers)).withColumn("named", F.max(F.when(F.col("way").isNull(), F.col("local_name"))).over(answers))
    only = lambda when, c: F.max(F.when(when, F.col(c)))
    way, used = F.col("way"), F.col("way").isNull() & (kind == "LocalReference")
    per = told.groupBy("method", "op").agg(
        F.first("block").alias("block"), F.first("evaluation").alias("evaluation"), only(way == "Target", "named").alias("assigned"), only((way == "Value") & F.col("is_node"), "key").alias("value"), only(used, "local_name").alias("used"),
        F.collect_list(F.when(~way.isin("Target", "Value") & F.col("is_node"), F.struct(F.col("key").alias("source"), way.alias("kind")))).alias("passed"),
    )
    per = per.withColumn("defines", F.col("assigned").isNotNull() & F.col("value").isNotNull()).withColumn("local", F.when(F.col("defines"), F.col("assigned")).otherwise(F.col("used")))
    order = Window.partitionBy("method", "local").orderBy("block", "evaluation", "op").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("latest", F.last(F.when(F.col("defines"), F.col("op")), ignorenulls=True).over(order))
    flow = lambda source, kind: F.array(F.struct(source.alias("source"), F.lit(kind).alias("kind")))
    more = F.when(F.col("defines"), flow(F.col("value"), "Assignment")).when(F.col("used").isNotNull() & F.col("latest").isNotNull(), flow(F.col("latest"), "CaptureCollapse"))
    edges = per.select("method", "op", F.inline(F.concat("passed", F.coalesce(more, F.slice("passed", 1, 0)))))
    return edges.select("method", "source", F.col("op").alias("target"), "kind")


def source_ordinal(block, evaluation):
    """The place of an operation in its method: by block, then evaluation; null beyond a million evaluations of a block."""
    return F.when(F.col(evaluation).between(0, 999_999), F.col(block) * 1_000_000 + F.col(evaluation))


def local_usage(ops: DataFrame, operands: DataFrame, by_reference: DataFrame) -> DataFrame:
    """(method, local_name, reads, writes, escapes, single_assignment) of the locals of methods.

    A write is an assignment with the local at place 0 (a compound one also reads it); a local escapes if a reference to it is one of
    by_reference(method, op). It is assigned once if it is written once and does not escape.
    """
    refs = ops.where("kind = 'LocalReference' and local_name is not null").select("method", "op", "local_name")
    targets = ops.where(F.col("kind").isin(*ASSIGNMENTS)).select("method", F.col("op").alias("by"), (F.col("kind") == "CompoundAssignment").alias("also_reads"))
    targets = operands.where("place = 0").select("method", F.col("op").alias("by"), F.col("operand").alias("op")).join(targets, ["method", "by"])
    # An operation may be the target of several assignments, so they are counted before they meet it.
    targets = targets.groupBy("method", "op").agg(F.count("*").alias("written"), F.bool_or("also_reads").alias("also_reads"))
    rows = refs.join(targets, ["method", "op"], "left").join(by_reference.select("method", "op").distinct().withColumn("given", F.lit(True)), ["method", "op"], "left")
    reads = F.count_if(F.col("written").isNull() | F.col("also_reads"))
    per = rows.groupBy("method", "local_name").agg(reads.alias("reads"), F.sum(F.coalesce("written", F.lit(0))).alias("writes"), F.bool_or(F.col("given").isNotNull()).alias("escapes"))
    return per.withColumn("single_assignment", (F.col("writes") == 1) & ~F.col("escapes"))


#: Ways along which a value stays itself.
SAME_VALUE = ("Assignment", "CaptureCollapse", "Conversion")


def returned_values(ops: DataFrame, operands: DataFrame) -> DataFrame:
    """(method, op, value): the value node that each return hands back, its first operand; returns without one are left out."""
    given = operands.where("place = 0").select("method", "op", F.col("operand").alias("value"))
    nodes = value_nodes(ops, operands).select("method", F.col("op").alias("value"))
    return ops.where("kind = 'Return'").select("method", "op").join(given, ["method", "op"]).join(nodes, ["method", "value"], "left_semi").select("method", "op", "value")


def return_provenance(ops: DataFrame, operands: DataFrame) -> DataFrame:
    """(method, return_op, operation): the calls and creations whose result a return hands back.

    A slice backwards from the returned value along SAME_VALUE edges: through locals and conversions, not into arguments.
    """
    starts = returned_values(ops, operands).select("method", F.col("op").alias("start"), F.col("value").alias("node"))
    edges = value_edges(ops, operands).where(F.col("kind").isin(*SAME_VALUE)).select("method", F.col("target").alias("source"), F.col("source").alias("target"))
    found = closure_within(starts, edges, ["method"])
    made = ops.where(F.col("kind").isin(*CALLS)).select("method", F.col("op").alias("node"))
    return found.join(made, ["method", "node"], "left_semi").select("method", F.col("start").alias("return_op"), F.col("node").alias("operation"))


def state_access(ops: DataFrame, operands: DataFrame) -> DataFrame:
    """(method, access, member, ordinal): the distinct members that a method reads and writes, in order, as rows."""
    reads = ops.where(F.col("kind").isin(*MEMBERS) & F.col("member").isNotNull()).select("method", F.lit("Read").alias("access"), "member")
    written = _assigned(ops, operands, value_nodes(ops, operands)).where(F.col("target_kind").isin(*MEMBERS) & F.col("member").isNotNull())
    rows = reads.unionAll(written.select("method", F.lit("Write"), "member")).distinct()
    order = Window.partitionBy("method", "access").orderBy("member")
    return rows.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))


def span_index(ops: DataFrame, key: list[str]) -> DataFrame:
    """(key, op): the operation of each source span and kind; null where several share it."""
    return ops.groupBy(*key).agg(F.when(F.count("*") == 1, F.min("op")).alias("op"))
