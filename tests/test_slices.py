"""Guards, layers of evidence, returned values and groups of predicates on hand-built rows."""

import random

from factweave.operators import facts, guards, topology, values
from factweave.plans import registry
from tests.test_operators import got

GUARD = "method long, ordinal long, symbol string, operator string, constant int, low int, high int, terminates boolean"
HOLDS = {"<=": lambda x, c: x <= c, "<": lambda x, c: x < c, ">": lambda x, c: x > c, ">=": lambda x, c: x >= c}


def test_reduced_guards_hold_for_the_same_values(spark):
    """For every value that comes as far as a guard, the reduced form says what the two bounds say."""
    rng = random.Random(2)
    rows = []
    for method in range(300):
        bound = None
        for k in range(rng.randrange(1, 7)):
            ends, symbol, high = rng.random() < 0.8, rng.choice("xxxy"), rng.randrange(6)
            if rng.random() < 0.4:
                operator = rng.choice(["<=", "<=", "<", ">"])
                rows.append((method, k, symbol, operator, high, None, None, ends))
                bound = high if operator == "<=" else None
            else:
                low = bound if bound is not None and rng.random() < 0.7 else rng.randrange(6)
                rows.append((method, k, symbol, None, None, low, high, ends))
                bound = high
    found = {(r.method, r.ordinal): r for r in guards.reduce_guards(spark.createDataFrame(rows, GUARD)).collect()}
    assert len(found) == len(rows) and sum(r.reduced for r in found.values()) > 30
    for method, k, symbol, operator, constant, low, high, _ in rows:
        r = found[method, k]
        if operator:
            assert (r.operator, r.constant, r.reduced) == (operator, constant, False)
        elif r.reduced:
            assert (r.operator, r.constant) == ("<=", high)
            first = [g for g in rows if g[0] == method and g[1] < k]
            for x in range(-1, 8):
                # Guards before that end the handler let only other values of the symbol through.
                passed = all(not g[7] or g[2] != symbol or not (HOLDS[g[3]](x, g[4]) if g[3] else g[5] < x <= g[6]) for g in first)
                assert not passed or (low < x <= high) == (x <= high)
        else:
            assert (r.operator, r.constant) == (None, None)


def test_guards_that_stay(spark):
    rows = [
        (1, 0, "x", "<=", 3, None, None, True), (1, 1, "x", None, None, 3, 5, True), (1, 2, "x", None, None, 5, 9, False), (1, 3, "x", None, None, 9, 11, True),  # the last follows one that goes on
        (2, 0, "x", "<", 3, None, None, True), (2, 1, "x", None, None, 3, 5, True),  # x < 3 leaves 3
        (3, 0, "x", "<=", 3, None, None, False), (3, 1, "x", None, None, 3, 5, True),
        (4, 0, "y", "<=", 3, None, None, True), (4, 1, "x", None, None, 3, 5, True),
        (5, 0, "x", "<=", 2, None, None, True), (5, 1, "x", None, None, 3, 5, True),
        (6, 0, "x", "<=", 3, None, None, True), (6, 2, "x", None, None, 3, 5, True),  # a guard between is missing
        (7, 0, "x", None, None, 3, 5, True), (7, 1, "x", None, None, 5, 6, True),  # nothing is known before
    ]
    found = got(guards.reduce_guards(spark.createDataFrame(rows, GUARD)).where("reduced"), "method", "ordinal", "constant")
    assert found == [(1, 1, 5), (1, 2, 9)]


def test_layers_against_recursion(spark):
    rng = random.Random(4)
    ids = list(range(60))
    links = [(a, rng.choice((rng.randrange(a), rng.randrange(60), 99)) if rng.random() < 0.3 else rng.randrange(a)) for a in ids[1:] for _ in range(rng.randrange(3))]
    below = {a: {b for x, b in links if x == a} for a in ids}

    def layer(a, path=()):
        if a not in below:
            return "Missing"
        if a in path:
            return "Cycle"
        found = [layer(b, (*path, a)) for b in below[a]]
        return "Missing" if "Missing" in found else "Cycle" if "Cycle" in found else 1 + max(found, default=-1)

    rows = facts.evidence_layers(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "id long, underlying long"))
    found = {r.id: r.code or r.layer for r in rows.collect()}
    want = {a: layer(a) for a in ids}
    assert found == want and {"Missing", 0, 1} <= set(map(str, want.values())) | set(want.values())
    ring = facts.evidence_layers(spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long"), spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 4)], "id long, underlying long"))
    assert {r.code for r in ring.collect()} == {"Cycle"}


def test_returned_results(spark):
    """The first return hands back a call through a local and a conversion; the second what a call makes of another's result."""
    ops = [("m", 1, 0, 0, "Invocation", None, None), ("m", 2, 0, 1, "LocalReference", "x", None), ("m", 3, 0, 2, "Assignment", None, None), ("m", 4, 1, 0, "LocalReference", "x", None), ("m", 5, 1, 1, "Conversion", None, None), ("m", 6, 1, 2, "Return", None, None),
           ("m", 7, 2, 0, "ObjectCreation", None, None), ("m", 8, 2, 1, "Invocation", None, None), ("m", 9, 2, 2, "Return", None, None), ("m", 10, 3, 0, "Return", None, None), ("m", 11, 3, 1, "Literal", None, None)]
    frame = spark.createDataFrame([(*o[:5], None, *o[5:]) for o in ops], "method string, op int, block int, evaluation int, kind string, parameter int, local_name string, member string")
    operands = spark.createDataFrame([("m", 3, 0, 2), ("m", 3, 1, 1), ("m", 5, 0, 4), ("m", 6, 0, 5), ("m", 7, 0, 11), ("m", 8, 0, 7), ("m", 9, 0, 8)], "method string, op int, place int, operand int")
    assert got(values.returned_values(frame, operands), "op", "value") == [(6, 5), (9, 8)]
    assert got(values.return_provenance(frame, operands), "return_op", "operation") == [(6, 1), (9, 8)]


def test_groups_are_taken_whole_or_left(spark):
    """Owner 1 holds 2 under its true arm, which holds 3; each case spoils one thing."""
    cases = {"whole": {}, "unsupported": {"supported": {1, 2}}, "ends": {"ends": {(3, True): "Terminates"}}, "unknown": {"ends": {(2, False): "Unknown"}}, "apart": {"tree": {3: (None, None)}}, "no arm": {"drop": {(3, False)}}, "two owners": {"roles": {3: "Owner"}}}
    tree, wording, ends, supported = [], [], [], []
    for m, change in cases.items():
        up = {1: (None, None), 2: (1, True), 3: (2, False)} | change.get("tree", {})
        tree += [(m, d, *p) for d, p in up.items()]
        wording += [(m, d, 9, {1: "Owner", 2: "Subordinate", 3: "Subordinate"}.get(d) if d not in change.get("roles", {}) else change["roles"][d]) for d in (1, 2, 3)]
        ends += [(m, d, arm, change.get("ends", {}).get((d, arm), "Rejoins")) for d in (1, 2, 3) for arm in (True, False) if (d, arm) not in change.get("drop", ())]
        supported += [(m, d) for d in change.get("supported", {1, 2, 3})]
    frame = lambda rows, schema: spark.createDataFrame(rows, f"method string, {schema}")
    groups, moved = topology.predicate_groups(frame(tree, "decision int, parent int, parent_arm boolean"), frame(wording, "decision int, predicate int, role string"), frame(ends, "decision int, arm boolean, terminal string"), frame(supported, "decision int"))
    assert {m: valid for m, valid in got(groups, "method", "valid")} == {m: m == "whole" for m in cases if m != "two owners"}
    assert got(moved, "method", "decision", "arm", "owner", "owner_arm") == [("whole", d, arm, 1, True) for d in (2, 3) for arm in (False, True)]


def test_groups_without_rounds(spark):
    """A chain of 40 below the owner, whose last link's arm counts; circles and two parents end the way up; null keys are no group."""
    big = 2**60
    frame = lambda rows, schema: spark.createDataFrame(rows, f"method string, {schema}")
    tree = [("long", big, None, None), ("long", big + 1, big, True), *(("long", big + k, big + k - 1, False) for k in range(2, 41))]
    tree += [("ring", 1, None, None), ("ring", 2, 3, True), ("ring", 3, 2, True), ("two", 1, None, None), ("two", 2, 1, True), ("two", 3, 2, True), ("two", 3, 4, True)]
    wording = [("long", big, 9, "Owner"), ("long", big + 40, 9, "Subordinate"), ("ring", 1, 9, "Owner"), ("ring", 3, 9, "Subordinate"), ("two", 1, 9, "Owner"), ("two", 3, 9, "Subordinate")]
    wording += [(None, 1, 9, "Owner"), (None, 2, 9, "Subordinate"), ("null", 1, None, "Owner"), ("null", 2, None, "Subordinate"), ("lost", 1, 9, "Owner"), ("lost", None, 9, "Subordinate")]
    ends = [(m, d, arm, "Rejoins") for m, d, _, _ in wording for arm in (True, False)]
    groups, moved = topology.predicate_groups(frame(tree, "decision long, parent long, parent_arm boolean"), frame(wording, "decision long, predicate long, role string"), frame(ends, "decision long, arm boolean, terminal string"), frame([(m, d) for m, d, _, _ in wording], "decision long"))
    assert got(groups, "method", "owner", "valid") == [("long", big, True), ("lost", 1, False), ("ring", 1, False), ("two", 1, False)]
    assert got(moved, "decision", "arm", "owner", "owner_arm") == [(big + 40, arm, big, True) for arm in (False, True)]


def test_groups_take_few_jobs(spark):
    """Trees and ways up are told within methods: no rounds of jobs."""
    spark.sparkContext.setJobGroup("groups", "groups")
    try:
        registry.QUERIES["predicate_groups"](spark, "/root/testdata/sf0.001").collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("groups")) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_messages_stand_in_the_deepest_fragment(spark):
    """Decision 1 holds 2 under its true arm; each other method spoils something; a message under no fragment is withheld."""
    nested = {(1, True): {1, 2, 3}, (1, False): {4}, (2, True): {1}, (2, False): {2}}
    chain = {(k, True): set(range(1, 6 - k)) for k in range(1, 5)}
    cases = {
        "nested": (nested, {}, {1, 2}), "no words": (nested, {}, {1}), "unknown": (nested, {(1, False): "Unknown"}, {1, 2}), "both arms": (nested | {(1, False): {3, 4}}, {}, {1, 2}),
        "twins": ({(1, True): {1}, (2, True): {1}}, {}, {1, 2}), "deep": (chain, {}, {1, 2, 3, 4}), "lone": ({(1, True): {1}}, {}, set()),
    }
    members = [(m, d, arm, n) for m, (sets, _, _) in cases.items() for (d, arm), held in sets.items() for n in held]
    ends = [(m, d, arm, odd.get((d, arm), "Rejoins")) for m, (sets, odd, _) in cases.items() for d in {d for d, _ in sets} for arm in (True, False)]
    told = [(m, 10 * n, n) for m in cases for n in (1, 3, 9)]
    frame = lambda rows, schema: spark.createDataFrame(rows, f"method string, {schema}")
    tree, placed, codes = topology.plan_fragments(frame(members, "decision int, polarity boolean, node int"), frame(told, "message int, node int"), frame(ends, "decision int, arm boolean, terminal string"), frame([(m, d) for m, (_, _, words) in cases.items() for d in words], "decision int"))
    shape = {}
    for m, *row in got(tree, "method", "decision", "parent", "parent_arm", "depth"):
        shape.setdefault(m, []).append(tuple(row))
    assert shape == {"nested": [(1, None, None, 1), (2, 1, True, 2)], "no words": [(1, None, None, 1)], "unknown": [(2, None, None, 1)], "both arms": [(2, None, None, 1)]}
    spots = {}
    for m, message, *row in got(placed, "method", "message", "placement", "decision", "arm"):
        spots.setdefault(m, {})[message] = tuple(row)
    flat, lost = ("Flat", None, None), ("Withheld", None, None)
    assert spots["nested"] == {10: ("Fragment", 2, True), 30: ("Fragment", 1, True), 90: flat}
    assert spots["no words"] == {10: ("Fragment", 1, True), 30: ("Fragment", 1, True), 90: flat}
    assert spots["unknown"] == spots["both arms"] == {10: ("Fragment", 2, True), 30: lost, 90: flat}
    assert spots["twins"] == {10: flat, 30: flat, 90: flat} and spots["lone"] == {10: lost, 30: flat, 90: flat}
    assert spots["deep"] == {10: flat, 30: flat, 90: flat}
    assert got(codes) == sorted([("deep", "DP001"), ("unknown", "DP002"), ("both arms", "DP002"), ("lone", "DP002")], key=repr)
