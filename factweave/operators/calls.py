"""Call graphs: candidates, pruning, bounded expansion; and reachability over edge tables.

Expansion is bounded in depth, so it is a fixed number of equi-joins; reachability is unbounded and runs as rounds that
join only the newest pairs, cut from their lineage in the shared checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _folder(df: DataFrame) -> str:
    """spark.checkpoint.dir (a folder of its own only where that is unset on a local master)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to spark.checkpoint.dir."""
    _folder(df)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """cut() in Parquet files: for tables that are read many times over, each time in a few of their columns."""
    path = f"{_folder(df)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def call_kind(delegate: Column, dynamic: Column, constructor: Column, static: Column) -> Column:
    """The kind of a call by its flags, the first that holds in this order; null flags do not hold."""
    kinds = ((delegate, "DelegateOrEvent"), (dynamic, "Dynamic"), (constructor, "Constructor"), (static, "Static"))
    return F.coalesce(*[F.when(flag, name) for flag, name in kinds], F.lit("Instance"))


def _rounds(seen: DataFrame, step: DataFrame, keys: list[str], max_rounds: int) -> DataFrame:
    """seen(*keys, node) with all that step(bounds among the keys, node, target) leads to, round by round from the newest rows."""
    seen = new = cut(seen.distinct())
    on = [c for c in step.columns if c != "target"]
    step = step.distinct()
    for _ in range(max_rounds):
        # New names for the columns: rows of two rounds must not share attributes in the union below.
        found = new.join(step, on).select(*[F.col(c).alias(c) for c in keys], F.col("target").alias("node")).distinct()
        new = cut(found.join(seen, [*keys, "node"], "left_anti"))
        if not new.limit(1).count():
            return seen
        seen = cut(seen.unionAll(new))
    raise RuntimeError(f"the closure is not complete after {max_rounds} rounds")


def closure(starts: DataFrame, edges: DataFrame, on: list[str] | None = None, max_rounds: int = 1000) -> DataFrame:
    """All (start, node) with node reached from start, itself included, over edges(source, target).

    on: columns that starts and edges share and that bound the search (a method, a profile). starts may tell node, where a start begins if
    not at itself. Edges are distinct per bound; cycles end as only new pairs go on. Raises RuntimeError rather than return an
    unfinished result.
    """
    on = on or []
    begin = F.col("node") if "node" in starts.columns else F.col("start")
    step = edges.select(*on, F.col("source").alias("node"), "target")
    return _rounds(starts.select(*on, "start", begin.alias("node")), step, [*on, "start"], max_rounds)


def _reach(data: pa.RecordBatch, keys: list[str]) -> pa.RecordBatch:
    """(*keys, start, node) of rows (*keys, starts, edges), whose methods are walked together, a round for each step."""
    def pairs(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = data.column(name)
        flat = lists.flatten()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        return np.repeat(np.arange(len(counts)), counts), a, b

    group, start, node = pairs("starts")
    owner, source, target = pairs("edges")
    # Nodes of all groups are numbered together; a start is told by its number among the rows of starts.
    begin, origin = np.unique(np.stack([group, start], 1), axis=0, return_inverse=True)
    names, place = np.unique(np.concatenate([np.stack([group, node], 1), np.stack([owner, source], 1), np.stack([owner, target], 1)]), axis=0, return_inverse=True)
    origin, place = origin.ravel(), place.ravel()
    at, source, target = np.split(place, [len(node), len(node) + len(source)])
    order = np.argsort(source, kind="stable")
    source, target, wide = source[order], target[order], len(names)
    new = seen = np.unique(origin * wide + at)
    while len(new):
        lo, hi = (np.searchsorted(source, new % wide, side) for side in ("left", "right"))
        n = hi - lo
        edge = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = np.unique(np.repeat(new // wide, n) * wide + target[edge])
        new = found[~np.isin(found, seen)]
        seen = np.union1d(seen, new)
    begin, node = begin[seen // wide], names[seen % wide, 1]
    return pa.RecordBatch.from_arrays([*[data.column(c).take(pa.array(begin[:, 0])) for c in keys], pa.array(begin[:, 1]), pa.array(node)], [*keys, "start", "node"])


def closure_within(starts: DataFrame, edges: DataFrame, on: list[str]) -> DataFrame:
    """closure() bounded by the columns `on`, in one pass: the starts and edges of a bound (a method, whose source bounds it) meet in one row.

    start, node, source and target are whole numbers, none of them null. There are no rounds of joins and no files.
    """
    begin = F.col("node") if "node" in starts.columns else F.col("start")
    long = lambda c: c.cast("long")
    s = starts.select(*on, F.struct(long(F.col("start")), long(begin)).alias("s"), F.lit(None).alias("e"))
    e = edges.select(*on, F.lit(None).alias("s"), F.struct(long(F.col("source")), long(F.col("target"))).alias("e"))
    rows = s.unionByName(e).groupBy(*on).agg(F.collect_set("s").alias("starts"), F.collect_set("e").alias("edges")).where("size(starts) > 0")
    schema = ", ".join([*[f"{c} {starts.schema[c].dataType.simpleString()}" for c in on], "start long", "node long"])
    return rows.mapInArrow(lambda batches: (_reach(b, on) for b in batches if len(b)), schema)


def reached(starts: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node): what edges(source, target) lead to from any of starts(node), these included; nodes only, not pairs with a start."""
    return _rounds(starts.select("node"), edges.select(F.col("source").alias("node"), "target"), [], max_rounds)


def candidates(sites: DataFrame, implementations: DataFrame, methods: DataFrame) -> DataFrame:
    """(site, target, candidate, resolution): implementations of a site's target that are indexed and have a body.

    Sites without any are kept with a null candidate, as Unresolved; one candidate that is the target is DirectExact.
    """
    body = methods.where("has_body").select(F.col("method_id").alias("candidate"))
    found = implementations.join(body, "candidate", "left_semi").distinct()
    out = sites.join(found, "target", "left")
    exact = F.col("candidate") == F.col("target")
    n = F.count("candidate").over(Window.partitionBy("site"))
    kind = F.when(n == 0, "Unresolved").when((n == 1) & exact, "DirectExact").otherwise("Cha")
    return out.select("site", "target", "candidate", kind.alias("resolution"))


def class_candidates(sites: DataFrame, members: DataFrame, methods: DataFrame, key: list[str]) -> DataFrame:
    """candidates() where the implementations of a target are the members(*key, candidate) of the class(*key) of its sites(site, target, *key).

    A class is counted by itself, so pairs are made by the last join alone and neither dealt again nor sorted by site.
    """
    body = methods.where("has_body").select(F.col("method_id").alias("candidate"))
    found = members.select(*key, "candidate").distinct().join(body, "candidate", "left_semi")
    sized = sites.join(found.groupBy(*key).agg(F.count("*").alias("n")), key, "left")
    kind = F.when(F.col("n").isNull(), "Unresolved").when((F.col("n") == 1) & (F.col("candidate") == F.col("target")), "DirectExact").otherwise("Cha")
    return sized.join(found, key, "left").select("site", "target", "candidate", kind.alias("resolution"))


def virtual_targets(targets: DataFrame, overrides: DataFrame, methods: DataFrame) -> DataFrame:
    """(target, candidate) of virtual targets(target): the method itself and, at any depth, what overrides(base, override) it, where concrete.

    methods(method_id, is_abstract) are the indexed ones; one that is not among them is no candidate.
    """
    concrete = methods.where("not coalesce(is_abstract, true)").select(F.col("method_id").alias("candidate"))
    down = closure(targets.select(F.col("target").alias("start")), overrides.select(F.col("base").alias("source"), F.col("override").alias("target")))
    return down.select(F.col("start").alias("target"), F.col("node").alias("candidate")).join(concrete, "candidate", "left_semi").select("target", "candidate")


def prune_types(candidates: DataFrame, ancestors: DataFrame, roots: DataFrame, closed_world: bool) -> DataFrame:
    """Candidates whose containing type is among the roots or above one; an open world keeps all.

    ancestors(type, above): direct bases and interfaces. Without roots a closed world is an error.
    """
    if not closed_world:
        return candidates
    if not roots.limit(1).count():
        raise ValueError("a closed world needs at least one root type")
    up = reached(roots.select(F.col("type").alias("node")), ancestors.select(F.col("type").alias("source"), F.col("above").alias("target")))
    return candidates.join(up.select(F.col("node").alias("type")), "type", "left_semi")


def call_tree(roots: DataFrame, calls: DataFrame, methods: DataFrame, depth: int = 2, budget: int = 64, carried: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """Call trees of roots(root) over admitted calls(caller, callee, owner, op_ord), in pre-order, with the reason why a node stops.

    Children follow in the order of (owner, op_ord). The first reason that holds stops a callee: BodyUnavailable, SourceUnavailable
    (its project is not loaded or it is generated), NoFlow, AmbiguousFlow (several flows), Cycle (it is on its own path), Depth (at the
    last level, if it calls on). calls may also tell guarded, methods(method_id, has_body) loaded and flows; else false, true and 1.
    A call is no step of the tree, only a mark where it ends, if it is guarded and not the root's own (Guarded), or if `budget` steps
    (the root not among them) come before it (NodeBudget); nothing follows below it. More columns of roots are told with each node of
    their tree; roots that only differ in these have a tree each. few: roots are a part of the methods, so callees are looked up where
    they stand in a tree, not for all calls, and the levels above the last are kept.
    Returns root, path (places joined by dots), up (the path above), depth, caller, place (of the call in its caller, from 1), method_id,
    stop (null: complete or expanded), step (false for the root and marks), and the columns of calls named in carried (null for the root).
    """
    order = Window.partitionBy("caller").orderBy("owner", "op_ord", "callee")
    guarded = F.coalesce("guarded", F.lit(False)) if "guarded" in calls.columns else F.lit(False)
    calls_on = calls.groupBy(F.col("caller").alias("callee")).agg(F.count_if(~guarded).alias("below"))
    told = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in methods.columns else F.lit(default)
    reason = F.when(~F.coalesce("has_body", F.lit(False)), "BodyUnavailable").when(~told("loaded", True), "SourceUnavailable").when(told("flows", 1) == 0, "NoFlow").when(told("flows", 1) > 1, "AmbiguousFlow")
    bodies = methods.select(F.col("method_id").alias("callee"), reason.alias("reason"), F.lit(True).alias("known")).join(calls_on, "callee", "left")
    # Of a call how many of its caller's up to it are steps below the root.
    steps = calls.select("caller", "callee", "owner", "op_ord", guarded.alias("guarded"), *[c for c in carried if c not in ("owner", "op_ord")]).withColumn("place", F.row_number().over(order))
    steps = steps.withColumn("among", F.count(F.when(~F.col("guarded"), 1)).over(Window.partitionBy("caller").orderBy("place")))
    if not few:
        steps = steps.join(bodies, "callee", "left")
    nothing = [F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in carried]
    own = [c for c in roots.columns if c != "root"]
    level = roots.select("root", *own, F.col("root").alias("method_id"), F.array("root").alias("trail"), F.array().cast("array<int>").alias("places"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("stop"), *nothing, F.lit(0).cast("long").alias("below"))

    def calls_of(open_: DataFrame, k: int, *more: Column) -> DataFrame:
        reason = F.when(F.col("known"), F.col("reason")).otherwise("BodyUnavailable")
        stop = F.when(F.col("guarded") & F.lit(k > 1), "Guarded").otherwise(F.coalesce(reason, F.when(F.array_contains("trail", F.col("callee")), "Cycle")))
        stop = F.coalesce(stop, F.when(F.lit(k == depth) & F.col("below").isNotNull(), "Depth"))
        made = open_.drop("below", *carried).join(steps, F.col("method_id") == F.col("caller"))
        made = made.join(bodies, "callee", "left") if few else made
        return made.select("root", *own, F.col("callee").alias("method_id"), F.concat("trail", F.array("callee")).alias("trail"), F.concat("places", F.array("place")).alias("places"), F.lit(k).alias("depth"), stop.alias("stop"), *carried, *more)

    # The levels above the last. A call behind `budget` others of its caller cannot be a step, so nothing below it is looked up.
    inner, again = level, F.expr(f"size(places) = 0 or element_at(places, -1) <= {budget}")
    for k in range(1, depth):
        level = calls_of(level.where(F.col("stop").isNull() & again), k, (F.coalesce("below", F.lit(0)) * int(k == depth - 1)).alias("below"))
        inner = inner.unionByName(level)
    by_place = Window.partitionBy("root", *own).orderBy("places")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    counts = (F.col("depth") > 0) & ~F.coalesce(F.col("stop") == "Guarded", F.lit(False))
    # Steps up to a node: those of the levels above the last, and the last level's, which all stand right behind the call above them.
    ranked = inner.withColumn("rank", F.count(F.when(counts, 1)).over(by_place) + F.coalesce(F.sum(F.when(F.col("stop").isNull(), F.col("below"))).over(before), F.lit(0)))
    # In pre-order a node's parent is the last node before it that is one level up.
    up = F.coalesce(*[F.when(F.col("depth") == k + 1, F.last(F.when(F.col("depth") == k, F.col("rank")), ignorenulls=True).over(before)) for k in range(depth - 1)], F.lit(0))
    ranked = ranked.withColumn("up", up).where(F.col("up") <= budget).drop("below")
    if depth > 0:
        ranked = kept(ranked) if few else ranked  # read for its rows and for the last level
        # Only what the budget leaves open is looked up at the last level, whose steps need no order of a whole tree.
        open_ = ranked.where(F.col("stop").isNull() & (F.col("depth") == depth - 1) & (F.col("rank") <= budget) & again)
        up_to = F.col("place").cast("long") if depth == 1 else F.col("among")
        ranked = ranked.unionByName(calls_of(open_, depth, (F.col("rank") + up_to).alias("rank"), F.col("rank").alias("up")))
    stop = F.when(counts & (F.col("rank") > budget), "NodeBudget").otherwise(F.col("stop"))
    places = F.col("places")
    above = F.when(F.col("depth") > 0, F.array_join(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), "."))
    caller = F.when(F.col("depth") > 0, F.get("trail", F.size("trail") - 2))
    return ranked.select(
        "root", *own, F.array_join("places", ".").alias("path"), above.alias("up"), F.col("depth").cast("long"), caller.alias("caller"),
        F.get("places", F.size("places") - 1).cast("long").alias("place"), "method_id", stop.alias("stop"), (counts & (F.col("rank") <= budget)).alias("step"), *carried,
    )


def expand(roots: DataFrame, calls: DataFrame, methods: DataFrame, depth: int = 2, budget: int = 64) -> DataFrame:
    """call_tree() without where a call stands in its caller: root, path, depth, method_id, stop, step."""
    return call_tree(roots, calls, methods, depth, budget).select("root", "path", "depth", "method_id", "stop", "step")


def expansion_conflicts(tree: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(root, path, method_id, operation): where an expanded node of expand() leaves out operations whose invocations disagree.

    conflicts(caller, operation) are such operations; a method that stops shows none of its own.
    """
    shown = tree.where("stop is null").select("root", "path", "method_id")
    return shown.join(conflicts.select(F.col("caller").alias("method_id"), "operation").distinct(), "method_id").select("root", "path", "method_id", "operation")
