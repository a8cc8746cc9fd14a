"""Order, text and checks of rendered diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Deepest nesting of blocks in a diagram.
MAX_DEPTH = 3
# What opens a block, the forms of a line that is no block, and control lines that say nothing of their own.
OPENERS = ("alt", "opt", "break", "loop")
PARTICIPANT = r"^participant\s+\S+\s+as\s+(?:#(?:quot|59|96);|[^\"`;\p{Cc}])+$"
MESSAGE = r"^\S+(-{2}>>|->>)\S+:\s*\S.*$"
GENERIC = r"^(?:alt|else|opt|break|loop)\s+(?:Condition|Continue|Continue evaluating condition|Path terminates)$"


def _rank(roles: dict[str, int]):
    table = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    return F.coalesce(table[F.col("participant")], F.lit(max(roles.values()) + 1))


def participant_order(messages: DataFrame, roles: dict[str, int]) -> DataFrame:
    """(plan, participant, place) by rank of the role, then name; unnamed roles come last."""
    order = Window.partitionBy("plan").orderBy(_rank(roles), "participant")
    return messages.select("plan", "participant").distinct().withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def message_order(messages: DataFrame, roles: dict[str, int]) -> DataFrame:
    """Messages with their place by rank of the role, ordinal, participant and text."""
    order = Window.partitionBy("plan").orderBy(_rank(roles), "ord", "participant", "text")
    return messages.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def diagram(lines: DataFrame) -> DataFrame:
    """(plan, diagram): a sequence diagram of lines(plan, ord, source, target, label, depth), two spaces for each depth."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), text.participant_key(F.col("source")), F.lit("->>"), text.participant_key(F.col("target")), F.lit(": "), text.diagram_label(F.col("label")))
    whole = lines.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("ord", "source", line.alias("line")))).alias("lines"))
    return whole.select("plan", F.concat(F.lit("sequenceDiagram\n"), F.array_join("lines.line", "\n"), F.lit("\n")).alias("diagram"))


def markdown(plans: DataFrame, diagrams: DataFrame) -> DataFrame:
    """(plan, document): a title, the evidence and the diagram in a fenced block."""
    both = plans.join(diagrams, "plan")
    return both.select("plan", F.concat(F.lit("# "), text.markdown_text(F.col("title")), F.lit("\n\n```mermaid\n"), F.col("diagram"), F.lit("```\n")).alias("document"))


def block_depths(lines: DataFrame, plan: str) -> DataFrame:
    """Whether blocks nest: lines(line, step: 1 opens, -1 closes, 0 neither) never close more than is open, stay within
    MAX_DEPTH and close all at the end."""
    depth = F.sum("step").over(Window.partitionBy(plan).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = lines.withColumn("depth", depth).groupBy(plan).agg(F.min("depth").alias("lowest"), F.max("depth").alias("deepest"), F.max_by("depth", "line").alias("open_at_end"))
    return out.withColumn("valid", (F.col("lowest") >= 0) & (F.col("deepest") <= MAX_DEPTH) & (F.col("open_at_end") == 0))


def diagram_errors(diagram: Column) -> Column:
    """What is wrong with a sequence diagram: an array of (line, problem), lines from 1, of the whole diagram null; empty if it is right.

    The first line names the kind of diagram; no line is blank; every other one is a participant, a message or part of a block.
    Blocks close in order, at most MAX_DEPTH deep; else stands directly in an alt, break in some block. The lines are folded over
    a stack, as a diagram is one value. Null and blank texts have the one problem of being empty.
    """
    form = "array<struct<line:int,problem:string>>"
    lines = F.transform(F.split(diagram, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def kind(line: Column, k: Column) -> Column:
        known = F.when(k == 0, F.when(line == "sequenceDiagram", "plain").otherwise("header"))
        known = known.when(line == "", "blank").when(line.rlike(GENERIC), "generic").when(line == "end", "end").when(line.startswith("else "), "else")
        for opener in (*OPENERS, "par"):
            known = known.when(line.startswith(f"{opener} "), opener)
        return known.when(line.rlike(PARTICIPANT) | line.rlike(MESSAGE), "plain").otherwise("unknown")

    plain_problems = {"header": "no sequenceDiagram", "blank": "blank line", "generic": "generic label", "par": "par is not supported", "unknown": "unknown syntax"}

    def step(s: Column, x: Column) -> Column:
        stack, what = s["stack"], x["kind"]
        opens = what.isin(*OPENERS) & ((what != "break") | (F.size(stack) > 0))
        problem = F.create_map(*[F.lit(v) for pair in plain_problems.items() for v in pair])[what]
        problem = F.when(problem.isNotNull(), problem).when((what == "end") & (F.size(stack) == 0), "end without a block")
        problem = problem.when((what == "else") & ~F.coalesce(F.get(stack, F.size(stack) - 1) == "alt", F.lit(False)), "else outside alt")
        problem = problem.when((what == "break") & (F.size(stack) == 0), "break outside a block").when(opens & (F.size(stack) >= MAX_DEPTH), "nested too deep")
        after = F.when(opens, F.concat(stack, F.array(what))).when(what == "end", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
        found = F.when(problem.isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(F.struct(x["line"].alias("line"), problem.alias("problem")))))
        return F.struct(after.alias("stack"), found.alias("found"))

    def finish(s: Column) -> Column:
        left = F.array(F.struct(F.lit(None).cast("int").alias("line"), F.lit("block not closed").alias("problem"))).cast(form)
        return F.when(F.size(s["stack"]) > 0, F.concat(s["found"], left)).otherwise(s["found"])

    items = F.transform(lines, lambda x, k: F.struct((k + 1).alias("line"), kind(x, k).alias("kind")))
    empty = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast(form).alias("found"))
    nothing = F.array(F.struct(F.lit(None).cast("int").alias("line"), F.lit("empty diagram").alias("problem"))).cast(form)
    return F.when(F.coalesce(F.trim(F.regexp_replace(diagram, r"\s+", " ")), F.lit("")) == "", nothing).otherwise(F.aggregate(items, empty, step, finish))


# The order of a scenario's nodes and edges, and the exit codes of outcomes.
NODE_RANKS = {"EntryPoint": 0, "Action": 1, "MethodCall": 2, "ServiceCall": 2, "EntityQuery": 3, "StateAssignment": 4, "EntityMutation": 5, "SourceObservation": 6, "Delay": 10}
RESULT_RANKS = {"result-status": 7, "result-failure": 8, "result-success": 10}
EDGE_RANKS = {
    "Entry": 0, "Call": 1, "Query": 2, "StateAssignment": 3, "Mutation": 4, "Save": 5, "Observation": 6, "ResultStatus": 7, "ResultFailure": 8,
    "OutcomeFailure": 9, "ResultSuccess": 10, "OutcomeSuccess": 11,
}
EXIT_CODES = {
    "Succeeded": 0, "InvalidInput": 2, "BuildFailure": 3, "AnalysisFailure": 4, "ValidationFailure": 5, "UnsupportedRequiredFeature": 6,
    "PersistenceFailure": 7, "DocumentationGenerationFailure": 8, "Cancelled": 130,
}


def _by_name(table: dict, name: Column, other: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[name], F.lit(other))


def exit_code(outcome: Column) -> Column:
    """The exit code of an outcome; that of a failed analysis for unknown and null ones."""
    return _by_name(EXIT_CODES, outcome, EXIT_CODES["AnalysisFailure"])


def node_order(kind: Column, key: Column, incoming: Column, ordinal: Column, minimal: Column, source_ordinal: Column) -> Column:
    """(segment, ordinal, rank) of a node: the way of the request, facts in source order, observations, results and outcomes.

    incoming is the kind of the outcome edge that leads to an outcome, minimal whether the node belongs to a minimal route's
    handler, whose delays and outcomes follow their source_ordinal (without one they come last).
    """
    minimal = F.coalesce(minimal, F.lit(False))
    rank = F.when(kind == "Result", _by_name(RESULT_RANKS, key, 12)).when(kind == "Outcome", F.when(incoming == "OutcomeFailure", 9).otherwise(11)).otherwise(_by_name(NODE_RANKS, kind, 13))
    segment = F.when(kind.isin("EntryPoint", "Action", "MethodCall", "ServiceCall"), 0).when(kind.isin("EntityQuery", "StateAssignment", "EntityMutation"), 1)
    segment = F.coalesce(segment.when((kind == "SourceObservation") | (kind.isin("Delay", "Outcome") & minimal), 2), F.lit(3))
    place = F.when((segment == 1) | (kind == "MethodCall"), ordinal).when((segment == 2) & minimal, F.coalesce(source_ordinal, F.lit((1 << 31) - 1))).otherwise(rank)
    return F.struct(segment.alias("segment"), place.cast("long").alias("ordinal"), rank.alias("rank"))


def edge_order(kind: Column, ordinal: Column) -> Column:
    """(segment, ordinal, rank) of an edge, as for nodes."""
    rank = _by_name(EDGE_RANKS, kind, 12)
    segment = F.when(kind.isin("Entry", "Call"), 0).when(kind.isin("Query", "StateAssignment", "Mutation", "Save"), 1).when(kind == "Observation", 2).otherwise(3)
    place = F.when((kind == "Call") | (segment == 1), ordinal).otherwise(rank)
    return F.struct(segment.alias("segment"), place.cast("long").alias("ordinal"), rank.alias("rank"))
