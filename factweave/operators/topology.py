"""Decisions and what stands under their arms: memberships, pruning, the tree of fragments.

Memberships are found with counts instead of compared sets: anchors of one operation agree if each (decision, polarity) that one of
them depends on is held by all of them.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flow, joins
from .calls import cut

MAX_DEPTH = 3


def memberships(nodes: DataFrame, anchors: DataFrame, dependences: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((method, node, decision, polarity), (method, node, code, decision)) of nodes(method, node, operation).

    anchors(method, operation, anchor), dependences(method, decision, node, polarity) with node an anchor, decisions(method, decision). SC011
    withholds a node without operation or anchor, or whose anchors disagree; SC012 withholds the decision that holds a node with
    both its arms. Methods without a decision have no question to answer and give no row; a dependence on what is no decision
    still makes anchors disagree, but gives no membership.
    """
    nodes = nodes.join(decisions.select("method").distinct(), "method", "left_semi").select("method", "node", "operation")
    all_of = anchors.distinct().groupBy("method", "operation").agg(F.count("*").alias("anchors"))
    held = anchors.distinct().join(dependences.select("method", F.col("node").alias("anchor"), "decision", "polarity").distinct(), ["method", "anchor"])
    held = held.groupBy("method", "operation", "decision", "polarity").agg(F.count("*").alias("held"))
    per = held.join(all_of, ["method", "operation"])
    split = per.where("held < anchors").select("method", "operation").distinct().withColumn("split", F.lit(True))
    both = per.groupBy("method", "operation", "decision").agg(F.count("*").alias("arms"), F.min("polarity").alias("polarity"))
    placed = nodes.join(all_of, ["method", "operation"], "left").join(split, ["method", "operation"], "left")
    lost = placed.where("anchors is null or split").select("method", "node", F.lit("SC011").alias("code"), F.lit(None).cast(dependences.schema["decision"].dataType).alias("decision"))
    sound = placed.where("anchors is not null and split is null").join(both, ["method", "operation"])
    found = sound.where("arms = 1").select("method", "node", "decision", "polarity").join(decisions.distinct(), ["method", "decision"], "left_semi")
    return found.select("method", "node", "decision", "polarity"), lost.unionAll(sound.where("arms > 1").select("method", "node", F.lit("SC012"), "decision"))


def decision_topology(scopes: DataFrame, nodes: DataFrame, anchors: DataFrame, dependences: DataFrame, terminals: DataFrame) -> dict[str, DataFrame]:
    """Decisions, arms, memberships and diagnostics of entries, each over all the methods of its scope together.

    scopes(entry, method): commonly the entry's root and the service method that it calls. nodes(entry, node, operation) are the material
    nodes, anchors(method, operation, anchor), dependences(method, decision, node, polarity) and terminals(method, decision, arm,
    terminal, reason) facts of methods. An operation may be anchored in any method of the scope; all its anchors must agree.
    Returns arms(entry, method, decision, polarity, terminal), memberships(entry, node, method, decision, polarity) and
    diagnostics(entry, code, node, method, decision, detail): SC011 and SC012 of memberships(), SC013 for a decision of which an arm is
    not classified, with the true arm's reason, else the false arm's.
    """
    scopes = scopes.select("entry", "method").distinct()
    at = lambda c: F.struct("method", F.col(c).alias("place"))
    arms = scopes.join(terminals, "method").select("entry", "method", "decision", F.col("arm").alias("polarity"), "terminal", "reason")
    decisions = arms.select(F.col("entry").alias("method"), at("decision").alias("decision")).distinct()
    all_anchors = scopes.join(anchors, "method").select(F.col("entry").alias("method"), "operation", at("anchor").alias("anchor"))
    control = scopes.join(dependences, "method").select(F.col("entry").alias("method"), at("decision").alias("decision"), at("node").alias("node"), "polarity")
    members, lost = memberships(nodes.select(F.col("entry").alias("method"), "node", "operation"), all_anchors, control, decisions)
    spread = lambda rows, *more: rows.select(F.col("method").alias("entry"), "node", *more, F.col("decision.method").alias("method"), F.col("decision.place").alias("decision"))
    found = spread(lost, "code").select("entry", "code", "node", "method", "decision", F.lit(None).cast("string").alias("detail"))
    why = F.coalesce(F.max(F.when(F.col("polarity"), F.col("reason"))), F.max(F.when(~F.col("polarity"), F.col("reason"))))
    unclear = arms.groupBy("entry", "method", "decision").agg(why.alias("detail")).where("detail is not null")
    node = F.lit(None).cast(nodes.schema["node"].dataType)
    found = found.unionAll(unclear.select("entry", F.lit("SC013"), node, "method", "decision", "detail"))
    return {"arms": arms.drop("reason"), "memberships": spread(members, "polarity").select("entry", "node", "method", "decision", "polarity"), "diagnostics": found}


def prune(nodes: DataFrame, edges: DataFrame, members: DataFrame, withheld: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes(method, node), edges(method, source, target) and members(method, node) without the withheld nodes and all that touches them."""
    gone = withheld.select("method", "node").distinct()
    end = lambda c: gone.withColumnRenamed("node", c)
    kept = edges.join(end("source"), ["method", "source"], "left_anti").join(end("target"), ["method", "target"], "left_anti")
    return nodes.join(gone, ["method", "node"], "left_anti"), kept.select(*edges.columns), members.join(gone, ["method", "node"], "left_anti").select(*members.columns)


def fragments(members: DataFrame) -> DataFrame:
    """(method, decision, parent, parent_arm, depth, placement) of decisions by members(method, decision, polarity, node).

    A decision lies in the one minimal arm of another decision that properly holds all its nodes. Decisions of equal node sets
    are Hoisted: they own nothing and hold nothing. Without such an arm, or with several minimal ones, a decision is at the Top. A
    method whose tree is deeper than MAX_DEPTH is Flat throughout (DP001).
    """
    rows = nested(members)
    place = F.when(F.col("hoisted"), "Hoisted").when(F.col("deepest") > MAX_DEPTH, "Flat").when(F.col("parent").isNull(), "Top").otherwise("Nested")
    kept = F.col("place") == "Nested"
    out = rows.withColumn("place", place)
    return out.select("method", "decision", F.when(kept, F.col("parent")).alias("parent"), F.when(kept, F.col("parent_arm")).alias("parent_arm"), F.when(F.col("place") == "Flat", 1).otherwise(F.col("depth")).cast("long").alias("depth"), F.col("place").alias("placement"))


def nested(members: DataFrame) -> DataFrame:
    """(method, decision, parent, parent_arm, depth, deepest, hoisted) of members(method, decision, polarity, node), before any limit of depth.

    No decision reaches beyond its method, which is bounded by its source: a method's members are dealt to one task once and its tree is
    told there. Null methods and decisions are none.
    """
    kind = members.schema["decision"].dataType.simpleString()
    # Nodes are only compared, and texts stay themselves beside nulls, which whole numbers do not in a data frame; a decision without parent names itself.
    rows = members.where("method is not null and decision is not null").select("method", "decision", "polarity", F.col("node").cast("string").alias("node"))
    told = flow.walk_methods(rows, ["decision", "polarity", "node"], ["decision"], _nest, f"decision {kind}, parent {kind}, parent_arm boolean, depth long, deepest long, hoisted boolean")
    return told.withColumn("parent", F.when(F.col("parent") != F.col("decision"), F.col("parent")))


def _nest(rows: list[tuple]) -> list[tuple]:
    """The rows of nested() of one method.

    If just one arm that properly holds a decision's nodes is minimal, it is the smallest and lies properly within all the others. All of them
    hold the decision's rarest node, so only the arms of that node are looked at.
    """
    arms: dict[tuple, set] = {}
    for decision, polarity, node in rows:
        arms.setdefault((decision, polarity), set()).add(node)
    whole: dict = {}
    for (decision, _), held in arms.items():
        whole[decision] = whole.get(decision, frozenset()) | held
    same = Counter(whole.values())
    holders: dict = {}
    for arm, held in arms.items():
        if same[whole[arm[0]]] == 1:
            for node in held:
                holders.setdefault(node, []).append((len(held), arm, held))
    above: dict = {}
    for decision, nodes in whole.items():
        over = [] if same[nodes] > 1 else [h for h in min((holders.get(n, []) for n in nodes), key=len) if h[0] > len(nodes) and nodes <= h[2]]
        best = min(over, key=lambda h: h[0], default=None)
        if best and all(h is best or best[2] < h[2] for h in over):
            above[decision] = best[1]
    depth: dict = {}
    for decision in sorted(whole, key=lambda d: -len(whole[d])):  # a parent holds more nodes
        depth[decision] = depth[above[decision][0]] + 1 if decision in above else 1
    deepest = max(depth.values())
    return [(d, *above.get(d, (d, None)), depth[d], deepest, same[whole[d]] > 1) for d in whole]


def supported_decisions(members: DataFrame, messages: DataFrame, terminals: DataFrame) -> DataFrame:
    """(method, decision) of decisions that a fragment can show: both arms end in a known way, some message stands under an arm, and no node
    under both. messages(method, message, node), terminals(method, decision, arm, terminal)."""
    known = terminals.groupBy("method", "decision").agg((F.count_distinct("arm") == 2).alias("two"), F.bool_and(F.coalesce(F.col("terminal").isin("Terminates", "Rejoins"), F.lit(False))).alias("known")).where("two and known")
    told = members.join(messages.select("method", "node").distinct(), ["method", "node"], "left_semi").select("method", "decision").distinct()
    both = members.groupBy("method", "decision", "node").agg(F.count_distinct("polarity").alias("n")).where("n > 1").select("method", "decision")
    return known.select("method", "decision").join(told, ["method", "decision"], "left_semi").join(both, ["method", "decision"], "left_anti")


def plan_fragments(members: DataFrame, messages: DataFrame, terminals: DataFrame, worded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((method, decision, parent, parent_arm, depth), (method, message, placement, decision, arm), (method, code)).

    Decisions that are supported and worded(method, decision) become fragments, but for those of equal node sets, which are hoisted. A
    fragment nests in the one minimal arm, of another fragment, that properly holds its nodes. A message stands in the deepest fragment
    that holds its node (of several as deep the first decision), else Flat if it is under no decision or under a hoisted one, else it is
    Withheld (DP002): it would look unconditional. A method deeper than MAX_DEPTH has no fragments, and all messages but the withheld
    ones are Flat (DP001).
    """
    members = cut(members.select("method", "decision", "polarity", "node").distinct())
    able = cut(supported_decisions(members, messages, terminals).join(worded.select("method", "decision").distinct(), ["method", "decision"], "left_semi"))
    ways = supported_decisions(members, messages, terminals)
    marks = joins.marks(members.select("method", "decision", "node").distinct().join(ways, ["method", "decision"], "left_semi"), ["method", "decision"], ["method", "node"])
    twins = marks.join(marks.groupBy("method", *joins.MARK).agg(F.count("*").alias("same")).where("same > 1").drop("same"), ["method", *joins.MARK]).select("method", "decision")
    shown = cut(able.join(twins, ["method", "decision"], "left_anti"))
    deep = cut(nested(members.join(shown, ["method", "decision"], "left_semi")).select("method", "decision", "parent", "parent_arm", "depth"))
    flat = deep.where(F.col("depth") > MAX_DEPTH).select("method").distinct()
    kept = deep.join(flat, "method", "left_anti")
    # Where a message may stand: under a fragment, else under a hoisted decision that could be one, else under others.
    held = messages.select("method", "message", "node").join(members, ["method", "node"], "left")
    held = held.join(kept.select("method", "decision", F.col("depth")), ["method", "decision"], "left").join(able.withColumn("able", F.lit(True)), ["method", "decision"], "left")
    per = held.groupBy("method", "message").agg(F.count("decision").alias("owners"), F.bool_or(F.col("able").isNotNull()).alias("able"), F.max("depth").alias("deepest"), F.min(F.when(F.col("depth").isNotNull(), F.struct(-F.col("depth"), "decision", "polarity"))).alias("best"))
    place = F.when(F.col("deepest").isNotNull(), "Fragment").when((F.col("owners") == 0) | F.col("able"), "Flat").otherwise("Withheld")
    placed = per.select("method", "message", place.alias("placement"), F.col("best.decision").alias("decision"), F.col("best.polarity").alias("arm"))
    codes = flat.select("method", F.lit("DP001").alias("code")).unionAll(placed.where("placement = 'Withheld'").select("method", F.lit("DP002")).distinct())
    return kept.select("method", "decision", "parent", "parent_arm", F.col("depth").cast("long")), placed, codes


def predicate_groups(tree: DataFrame, wording: DataFrame, terminals: DataFrame, supported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((method, predicate, owner, valid), (method, decision, arm, owner, owner_arm)) of predicates that one owner shares with subordinates.

    tree(method, decision, parent, parent_arm) is that of fragments(), wording(method, decision, predicate, role) names a decision's
    predicate as its Owner or a Subordinate, terminals(method, decision, arm, terminal) how arms end, supported(method, decision) what a
    diagram can show. A group of exactly one owner is valid if the owner and all subordinates are supported, every subordinate lies
    somewhere below the owner, and each arm of theirs is known not to end the method. Only then do their arms give what they hold to
    the owner's arm that they lie in: a group is taken whole, or left as it is.
    """
    group = Window.partitionBy("method", "predicate")
    owner = F.when(F.col("role") == "Owner", F.col("decision"))
    rows = wording.where("method is not null and predicate is not null").withColumn("owner", F.min(owner).over(group)).withColumn("other", F.max(owner).over(group))
    rows = rows.where("role = 'Subordinate' and owner = other").select("method", "predicate", "decision", "owner").distinct()
    # A decision's links upwards and the owners it is asked for are dealt to its method's task.
    kind = tree.schema["decision"].dataType.simpleString()
    links = tree.where("method is not null and decision is not null and parent is not null").select("method", F.lit(0).alias("tag"), "decision", F.col("parent").alias("above"), F.col("parent_arm").alias("arm"))
    asked = rows.where("decision is not null").select("method", F.lit(1), "decision", "owner", F.lit(None).cast("boolean"))
    hung = flow.walk_methods(links.unionAll(asked), ["tag", "decision", "above", "arm"], ["tag", "decision"], _hang, f"decision {kind}, owner {kind}, owner_arm boolean").distinct()
    # One row for each decision with what is known of it.
    no = F.lit(None)
    facts = supported.select("method", "decision", F.lit(True).alias("shown"), no.cast("boolean").alias("arm"), no.cast("boolean").alias("on"))
    facts = facts.unionAll(terminals.select("method", "decision", F.lit(False), "arm", F.coalesce(F.col("terminal") == "Rejoins", F.lit(False))))
    facts = facts.groupBy("method", "decision").agg(F.bool_or("shown").alias("shown"), ((F.min("arm") != F.max("arm")) & F.bool_and("on")).alias("on"))
    placed = rows.join(hung, ["method", "decision", "owner"], "left").join(facts, ["method", "decision"], "left")
    placed = placed.join(facts.where("shown").select("method", F.col("decision").alias("owner"), F.col("shown").alias("owner_shown")), ["method", "owner"], "left")
    fine = F.col("owner_arm").isNotNull() & F.coalesce(F.col("shown") & F.col("owner_shown") & F.col("on"), F.lit(False))
    placed = cut(placed.select("method", "predicate", "decision", "owner", "owner_arm", fine.alias("fine")))
    groups = placed.groupBy("method", "predicate", "owner").agg(F.bool_and("fine").alias("valid"))
    moved = placed.join(groups.where("valid"), ["method", "predicate", "owner"], "left_semi").join(terminals.select("method", "decision", "arm").distinct(), ["method", "decision"])
    return groups, moved.select("method", "decision", "arm", "owner", "owner_arm").distinct()


def _hang(rows: list[tuple]) -> list[tuple]:
    """(decision, owner, arm): the owner's arm is that by which the last decision below it hangs on it.

    A decision of several parents ends the way up; on a way that goes in a circle nothing hangs.
    """
    up: dict = {}
    out = []
    for tag, decision, above, arm in rows:
        if tag == 0:
            up.setdefault(decision, set()).add((above, arm))
            continue
        found, seen, node = [], set(), decision
        while node not in seen:
            seen.add(node)
            found += [(decision, above, a) for parent, a in up.get(node, ()) if parent == above]
            parents = {parent for parent, _ in up.get(node, ())}
            if len(parents) != 1:
                out += found
                break
            node = parents.pop()
    return out
