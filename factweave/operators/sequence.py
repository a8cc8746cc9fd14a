"""Sequence trees written as diagrams, without recursion: each element becomes lines with a key, and sorting the keys gives the text.

elements(plan, element, parent, place, kind, label, is_else, message): kind message (a reference), alt (whose children are arms), arm, opt, loop
or break; parent is null at the top, place orders siblings. messages(plan, message, source, target, label, kind, place),
participants(plan, place, key, label), branches(plan, place, label, message) for plans without elements.

An element's key is the places from the top down to it. What opens a block sorts before all below it, what closes it behind, so the
depth-first text is one sort. Paths are found level by level (a tree is as deep as its source nests); whether anything is shown below an
element is one aggregate over the references, each of which knows what it lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .calls import cut

#: Levels of elements that are followed; a tree that goes deeper, or on in a circle, is withheld.
LEVELS = 64
FIRST, LAST = -1, (1 << 62)
BASE, STEP, FLAT = 4, 2, 8


def paths(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements with path, above (ids), blocks (fragments above) and hidden (below or in a break), and the plans with elements that no path reaches)."""
    rows = cut(elements.select("plan", "element", "parent", F.col("place").cast("long").alias("place"), "kind", "label", F.coalesce("is_else", F.lit(False)).alias("is_else"), "message"))
    fragment = F.col("kind").isin("alt", "opt", "loop", "break")
    level = rows.where("parent is null").withColumns({"path": F.array("place"), "above": F.array().cast(f"array<{rows.schema['element'].dataType.simpleString()}>"), "blocks": F.lit(0), "hidden": F.col("kind") == "break"})
    fresh = lambda frame: cut(frame).toDF(*frame.columns)  # noqa: E731  rows of two levels must not share attributes
    found = level = fresh(level)
    for _ in range(LEVELS):
        up = level.select("plan", F.col("element").alias("parent"), F.col("path").alias("up_path"), F.concat("above", F.array("element")).alias("up_above"), (F.col("blocks") + fragment.cast("int")).alias("up_blocks"), F.col("hidden").alias("up_hidden"))
        level = rows.join(up, ["plan", "parent"])
        level = fresh(level.select(*rows.columns, F.concat("up_path", F.array("place")).alias("path"), F.col("up_above").alias("above"), F.col("up_blocks").alias("blocks"), (F.col("up_hidden") | (F.col("kind") == "break")).alias("hidden")))
        if level.isEmpty():
            break
        found = found.unionAll(level)
    lost = rows.join(found.select("plan", "element"), ["plan", "element"], "left_anti").select("plan").distinct()
    return found, lost


def _line(indent: Column, *parts) -> Column:
    return F.concat(F.repeat(F.lit(" "), indent), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def message_line(indent: Column) -> Column:
    arrow = F.when(F.col("message_kind") == "Request", "->>").otherwise("-->>")
    return _line(indent, F.col("source"), arrow, F.col("target"), ": ", text.diagram_label(F.col("message_label")))


def tree_lines(elements: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((plan, key, line), (plan, code)): the lines of plans with elements, and why some have none.

    A fragment or arm is shown if a reference below it is, other than through a break, which is never shown. Of an alt one shown arm
    becomes an opt of the arm's label; several follow as alt and else, and a first arm that is an else has its own line unless its label
    is the alt's. UnresolvedReference withholds a plan that shows a reference to no message, Unreached one with elements that hang on no
    path from the top, or deeper than LEVELS.
    """
    found, lost = paths(elements)
    known = messages.select("plan", "message", "source", "target", F.col("label").alias("message_label"), F.col("kind").alias("message_kind")).dropDuplicates(["plan", "message"])
    found = cut(found.join(known, ["plan", "message"], "left"))
    refs = found.where("kind = 'message' and not hidden")
    full = refs.where("source is not null").select("plan", F.explode("above").alias("element")).distinct().withColumn("full", F.lit(True))
    shown = found.where("kind <> 'message' and not hidden").join(full, ["plan", "element"])
    # What lies in an element without content is not shown, so a lost reference only counts where all above it is full.
    inside = refs.select("plan", "message", "path", "blocks", "source", "target", "message_label", "message_kind", F.size("above").alias("n"), F.explode_outer("above").alias("element"))
    held = inside.join(full, ["plan", "element"], "left").groupBy("plan", "path").agg(F.count("full").alias("full"), F.max("n").alias("n"), F.first("source").alias("source"))
    codes = held.where("full = n and source is null").select("plan", F.lit("UnresolvedReference").alias("code")).unionAll(lost.select("plan", F.lit("Unreached"))).groupBy("plan").agg(F.min("code").alias("code"))
    arms = shown.where("kind = 'arm'").withColumn("rank", F.row_number().over(Window.partitionBy("plan", "parent").orderBy("place", "element")))
    first = arms.groupBy("plan", F.col("parent").alias("element")).agg(F.count("*").alias("arms"), F.min_by(F.struct("label", "is_else", "path"), F.col("rank")).alias("arm"))
    outer, inner = F.col("blocks") * STEP + BASE, (F.col("blocks") - 1) * STEP + BASE
    mark = lambda path, at: F.concat(path, F.array(F.lit(at).cast("long")))
    label = lambda c: text.diagram_label(F.col(c))
    blocks = shown.where("kind in ('opt', 'loop')")
    alts = shown.where("kind = 'alt'").join(first, ["plan", "element"])
    opening = F.when(F.col("arms") == 1, _line(outer, "opt ", label("arm.label"))).otherwise(_line(outer, "alt ", label("label")))
    else_first = (F.col("arms") > 1) & F.col("arm.is_else") & (F.col("arm.label") != F.col("label"))
    lines = [
        refs.where("source is not null").select("plan", F.col("path").alias("key"), message_line(outer).alias("line")),
        blocks.select("plan", mark(F.col("path"), FIRST), _line(outer, F.col("kind"), " ", label("label"))),
        blocks.unionByName(alts.select(*blocks.columns)).select("plan", mark(F.col("path"), LAST), _line(outer, "end")),
        alts.select("plan", mark(F.col("path"), FIRST), opening),
        alts.where(else_first).select("plan", mark(F.col("arm.path"), FIRST), _line(outer, "else ", label("arm.label"))),
        arms.where("rank > 1").select("plan", mark(F.col("path"), FIRST), _line(inner, "else ", label("label"))),
    ]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionAll(more)
    return out.join(codes, "plan", "left_anti"), codes


def flat_lines(messages: DataFrame, branches: DataFrame) -> DataFrame:
    """(plan, key, line) of plans without elements: messages in order, then one alt of the branches with theirs.

    A message of a branch stands there only; a branch's reference to no message is passed over.
    """
    named = messages.select("plan", "message", "source", "target", F.col("label").alias("message_label"), F.col("kind").alias("message_kind"), F.col("place").cast("long").alias("place"))
    key = lambda *parts: F.array(*[p if isinstance(p, Column) else F.lit(p).cast("long") for p in parts])
    own = named.join(branches.select("plan", "message").distinct(), ["plan", "message"], "left_anti")
    own = own.select("plan", key(0, F.col("place")).alias("key"), message_line(F.lit(BASE)).alias("line"))
    told = branches.select("plan", F.col("place").cast("long").alias("branch"), "label").distinct()
    rank = F.row_number().over(Window.partitionBy("plan").orderBy("branch", "label"))
    told = told.withColumn("word", F.when(rank == 1, "alt ").otherwise("else "))
    heads = told.select("plan", key(1, F.col("branch"), FIRST), _line(F.lit(BASE), F.col("word"), text.diagram_label(F.col("label"))))
    inside = branches.select("plan", "message", F.col("place").cast("long").alias("branch")).join(named, ["plan", "message"])
    inside = inside.select("plan", key(1, F.col("branch"), F.col("place")), message_line(F.lit(FLAT)))
    ends = told.select("plan").distinct().select("plan", key(2), F.lit(" " * BASE + "end"))
    return own.unionAll(heads).unionAll(inside).unionAll(ends)


def diagram_lines(participants: DataFrame, messages: DataFrame, elements: DataFrame, branches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((plan, ordinal, line), (plan, code)): every plan's diagram line by line, from 0; plans with a code have no line."""
    plans = participants.select("plan").unionAll(messages.select("plan")).unionAll(elements.select("plan")).distinct()
    sequenced = elements.select("plan").distinct()
    tree, codes = tree_lines(elements, messages)
    flat = flat_lines(messages.join(sequenced, "plan", "left_anti"), branches.join(sequenced, "plan", "left_anti"))
    kept = plans.join(codes, "plan", "left_anti")
    head = kept.select("plan", F.lit(0).alias("part"), F.array(F.lit(0).cast("long")).alias("key"), F.lit("sequenceDiagram").alias("line"))
    named = participants.join(codes, "plan", "left_anti").select("plan", F.lit(1), F.array(F.col("place").cast("long")), _line(F.lit(BASE), "participant ", F.col("key"), " as ", text.diagram_alias(F.col("label"))))
    body = tree.unionAll(flat).select("plan", F.lit(2), "key", "line")
    order = Window.partitionBy("plan").orderBy("part", "key", "line")
    lines = head.unionAll(named).unionAll(body)
    return lines.select("plan", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "line"), codes


def diagram_text(lines: DataFrame) -> DataFrame:
    """(plan, diagram) of diagram_lines(): one text each, as a diagram is one value."""
    whole = F.array_sort(F.collect_list(F.struct("ordinal", "line")))
    return lines.groupBy("plan").agg(F.array_join(F.transform(whole, lambda x: x["line"]), "\n").alias("diagram"))
