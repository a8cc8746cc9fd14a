"""Which calls may be followed: each rule is a list of conditions, and a call that fails one carries its name.

Invocations are rows (caller, op, node, target, type_name, member_name, certainty, proven, source_backed, platform, nested, dynamic,
delegate, constructor), call sites rows (caller, op, site, declared_target, site_certainty, site_proven, resolution, complete,
candidates, candidate, resolution_certainty, resolution_proven). "proven" says whether the evidence is all exact; null if there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import exactly_one

MATERIAL = ("ServiceCall", "MethodCall", "EntityQuery", "StateAssignment", "EntityMutation", "Result", "Outcome")
SITE = ["site", "declared_target", "site_certainty", "site_proven", "resolution", "complete", "candidates", "candidate", "resolution_certainty", "resolution_proven"]


def material(kind: Column) -> Column:
    """Whether a scenario node stands for something that happens; a null kind does not."""
    return F.coalesce(kind.isin(*MATERIAL), F.lit(False))


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _named(blank_counts: bool) -> Column:
    names = [F.col(c) for c in ("type_name", "member_name")]
    held = [(F.trim(n) != "") if blank_counts else n.isNotNull() for n in names]
    return F.coalesce(held[0] & held[1], F.lit(False))


def _conditions(rule: str) -> list[tuple[str, Column]]:
    exact = lambda c: F.coalesce(F.col(c) == "Exact", F.lit(False))
    same = lambda a: F.coalesce(F.col(a) == F.col("target"), F.lit(False))
    source = ("Source", _true("source_backed") & ~_true("nested") & ~_true("platform"))
    resolved = F.coalesce((F.col("resolution") == "DirectExact") & (F.col("candidates") == 1), F.lit(False)) & _true("complete")
    if rule == "leaf":
        return [source, ("Name", _named(False)), ("Site", F.col("code").isNull()), ("Resolution", resolved)]
    certain = exact("certainty") & exact("site_certainty") & (exact("resolution_certainty") if rule == "root" else F.lit(True))
    return [
        source,
        ("Name", _named(rule == "root")),
        ("Form", ~_true("dynamic") & ~_true("delegate") & ~_true("constructor")),
        ("Site", F.col("code").isNull()),
        ("Resolution", resolved),
        ("Target", same("declared_target") & same("candidate")),
        ("Certainty", certain),
        ("Evidence", _true("proven") & _true("site_proven") & _true("resolution_proven")),
    ]


def admit(invocations: DataFrame, sites: DataFrame, rule: str) -> DataFrame:
    """(caller, op, node, site, target, withheld): every invocation with its one call site, and the first condition that fails.

    rule: "direct" for calls within an expansion, "root" for calls of an entry's own method (one node, the first, for each
    operation; names must not be blank; the resolution must be exact too), "leaf" for calls of a dispatched handler. A site is
    taken only if it is the operation's only one.
    """
    if rule not in ("direct", "root", "leaf"):
        raise ValueError(f"no rule {rule!r}")
    if rule == "root":
        first = invocations.groupBy("caller", "op").agg(F.min("node").alias("node"))
        invocations = invocations.join(first, ["caller", "op", "node"], "left_semi")
    rows = exactly_one(invocations, sites, ["caller", "op"], "NoSite", "ManySites", SITE)
    failed = F.coalesce(*[F.when(~held, name) for name, held in _conditions(rule)])
    return rows.select("caller", "op", "node", "site", "target", failed.alias("withheld"))


def guarded(calls: DataFrame, anchors: DataFrame, dependences: DataFrame) -> DataFrame:
    """Calls (method, operation) of which some anchor(method, operation, anchor) depends on a decision(method, node)."""
    held = anchors.join(dependences.select("method", F.col("node").alias("anchor")).distinct(), ["method", "anchor"], "left_semi")
    return calls.join(held.select("method", "operation").distinct(), ["method", "operation"], "left_semi")
