"""Scenario graphs, dispatched handlers, callbacks, receiver chains and dominator trees on hand-built rows."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.functions import text
from factweave.operators import callbacks, chains, dispatch, flow, scenario_graph
from tests.test_operators import BLOCKS, got, one


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def resolve(spark, bindings, sites, candidates, methods=((1, "C", False), (2, "C", True))):
    return got(
        scenario_graph.resolve_services(
            frame(spark, "entry string, root long", [("e", 1)]), frame(spark, "method_id long, type_name string, is_constructor boolean", list(methods)),
            frame(spark, "constructor long, service_type string, implementation string, registration long", bindings),
            frame(spark, "caller long, site long, operation long, declared_type string, complete boolean", sites),
            frame(spark, "site long, candidate long, declaring_type string", candidates),
        ), "service_type", "implementation", "method", "reason")


BIND, SITE, CANDIDATE = (2, "S", "Impl", 7), (1, 10, 100, "S", True), (10, 50, "Impl")


@pytest.mark.parametrize(
    "bindings, sites, candidates, methods, reason",
    [
        ([BIND], [SITE], [CANDIDATE], None, None),
        ([BIND, BIND], [SITE, (1, 11, 101, "Other", False)], [CANDIDATE, CANDIDATE, (10, 51, "Else")], None, None),
        ([BIND, (2, "A", "X", 8)], [SITE], [CANDIDATE], None, None),  # a service that is not called decides nothing
        ([BIND], [SITE], [CANDIDATE], [(2, "C", True)], "action-method-missing"),
        ([BIND], [SITE], [CANDIDATE], [(1, "C", False), (2, "D", True)], "controller-constructor-missing"),
        ([(3, "S", "Impl", 7)], [SITE], [CANDIDATE], None, "no-di-bindings"),
        ([BIND], [(1, 10, 100, "T", True)], [CANDIDATE], None, "no-service-call-matched"),
        ([BIND], [SITE, (1, 11, 101, "S", True)], [CANDIDATE], None, "multiple-matching-call-sites:S"),
        ([BIND], [(1, 10, 100, "S", None)], [CANDIDATE], None, "incomplete-resolution:S"),
        ([BIND, (2, "S", "Impl2", 9)], [SITE], [CANDIDATE], None, "multiple-di-targets:S"),
        ([BIND], [SITE], [(10, 50, "Else")], None, "no-implementation-candidate:S"),
        ([BIND], [SITE], [CANDIDATE, (10, 51, "Impl")], None, "multiple-implementation-candidates:S"),
        ([(2, "S", "Impl", None)], [SITE], [CANDIDATE], None, "registration-missing"),
    ],
)
def test_each_hop_of_a_service(spark, bindings, sites, candidates, methods, reason):
    want = ("S", "Impl", 50, None) if reason is None else (None, None, None, reason)
    assert resolve(spark, bindings, sites, candidates, methods or ((1, "C", False), (2, "C", True))) == [want]


SCHEMAS = {
    "entries": "entry string, root long, kind string, label string", "methods": "method_id long, name string, type_name string, has_body boolean, loaded boolean, flows int, is_constructor boolean",
    "calls": "caller long, callee long, owner long, op_ord long, operation long, guarded boolean", "root_calls": "caller long, callee long, operation long, place long",
    "dispatches": "method long, operation long, request_type string, resolution string, handler long", "bindings": "constructor long, service_type string, implementation string, registration long",
    "sites": "caller long, site long, operation long, declared_type string, complete boolean", "candidates": "site long, candidate long, declaring_type string",
    "steps": "method long, operation long, kind string, detail string, ordinal long", "observations": "method long, observation long, operation long, detail string",
    "arms": "method long, member string, operation long, switch long, enum string, helper string, created long", "terminals": "method long, operation long, helper string, created long, ordinal long",
    "outcomes": "method long, operation long, helper string, status int", "routes": "root long, route string", "decisions": "method long, local string",
    "factories": "method long, operation long, outcome string, type_name string", "returned": "method long, operation long", "locals": "method long, name string, type_name string", "paths": "method long, outcome string, helper string",
}
ROWS = {
    "entries": [("get", 1, "Controller", "GET a"), ("status", 2, "Controller", "POST a"), ("conf", 3, "Configured", "M"), ("send", 4, "Minimal", "PUT a"), ("lost", 5, "Controller", "GET b"), ("bare", 6, "Configured", "N")],
    "methods": [(k, f"m{k}", "C", k != 6, True, 1, k == 9) for k in (1, 2, 3, 4, 9)] + [(5, "m5", "D", True, True, 1, False), (6, "m6", "D", False, True, 1, False), (50, "Do", "Impl", True, True, 1, False)],
    "calls": [(3, 50, 0, 0, 300, False), (3, 6, 0, 1, 301, False), (50, 4, 0, 0, 500, True)], "root_calls": [(5, 50, 510, 0)],
    "dispatches": [(4, 401, "Rq", "ExactSingle", 50), (4, 402, "Rq", "Ambiguous", None)],
    "bindings": [(9, "S", "Impl", 1)], "sites": [(1, 10, 100, "S", True), (2, 20, 200, "S", True)], "candidates": [(10, 50, "Impl"), (20, 50, "Impl")],
    "steps": [(50, 1000, "EntityQuery", "q", 1), (50, 1001, "Save", "s", 2), (77, 1, "EntityQuery", "not reached", 0)], "observations": [(50, 8, 1000, "TODO"), (1, 9, 100, "NOTE")],
    "arms": [(2, "Good", 210, 209, "E", "Ok", None), (2, "Odd", 211, 209, "E", "BadRequest", None)], "terminals": [(2, 210, "Ok", None, 1), (2, 212, "CreatedAtAction", 1, 2), (2, 213, "CreatedAtAction", 99, 3)],
    "outcomes": [(2, 210, "Ok", 200), (2, 212, "CreatedAtAction", 201), (2, 213, "CreatedAtAction", 201), (1, 110, "Ok", 200), (1, 111, "NotFound", 404)], "routes": [(1, "a/{id}")],
    "decisions": [(1, "r")], "factories": [(50, 1002, "Success", "T"), (50, 1003, "NotFound", "T"), (50, 1004, "Success", "T")], "returned": [(50, 1002), (50, 1003)], "locals": [(1, "r", "T")],
    "paths": [(1, "Success", "Ok"), (1, "NotFound", "NotFound"), (1, "NotFound", "Gone")],
}


def test_scenario_graph(spark):
    facts = scenario_graph.Facts(**{k: frame(spark, SCHEMAS[k], ROWS[k]) for k in SCHEMAS})
    nodes, edges, codes = (x.collect() for x in scenario_graph.scenario_graph(facts))
    by_id = {n.node: (n.entry, n.key) for n in nodes}
    assert len(by_id) == len(nodes)
    keys = {}
    for n in nodes:
        keys.setdefault(n.entry, set()).add(n.key)
    service = {"service:50", "query:1000", "mutation:1001", "observation:8"}
    assert keys["get"] == {"get", "action:1", *service, "observation:9", "result-success", "result-failure", "outcome:200:Ok", "outcome:404:NotFound"}
    assert keys["status"] == {"status", "action:2", *service, "result-status", "outcome:200:Ok", "outcome:201:CreatedAtAction"}
    assert keys["conf"] == {"conf", "action:3", "method-call:1", "method-call:2"} and keys["bare"] == {"bare", "action:6"}
    assert keys["send"] == {"send", "action:4", "dispatch:401", "dispatch:402", "handler:401:50"} and keys["lost"] == {"lost", "action:5", "method-call:510"}
    (created,) = [n.detail for n in nodes if n.key == "outcome:201:CreatedAtAction"]
    assert created == "CreatedAtAction -> HTTP 201 links to GET a/{id}"
    links = {(by_id[e.source], by_id[e.target][1], e.kind) for e in edges}
    assert all(by_id[e.source][0] == by_id[e.target][0] == e.entry for e in edges)
    assert {(("get", "service:50"), "mutation:1001", "Save"), (("get", "action:1"), "observation:9", "Observation"), (("get", "service:50"), "observation:8", "Observation"), (("get", "result-failure"), "outcome:404:NotFound", "OutcomeFailure"), (("status", "result-status"), "outcome:200:Ok", "OutcomeSuccess"), (("send", "dispatch:401"), "handler:401:50", "Dispatch")} <= links
    assert sorted((c.entry, c.code) for c in codes) == [
        ("bare", "SC002"), ("conf", "SC-DIRECT-BODY-UNAVAILABLE"), ("conf", "SC-DIRECT-GUARDED"), ("get", "SC004"), ("lost", "SC001"), ("send", "SC-DISPATCH-AMBIGUOUS"), ("status", "SC004"), ("status", "SC010"),
    ]


@pytest.mark.parametrize("change, code, detail", [({}, None, None), ({"decisions": []}, "SC006", "1"), ({"returned": []}, "SC007", "no-return-provenance"), ({"returned": [(50, 1002), (50, 1004)]}, "SC007", "success=2 failure=0"), ({"locals": [(1, "r", "Other")]}, "SC007", "local=r"), ({"locals": []}, "SC007", "local=r")])
def test_result_association(spark, change, code, detail):
    tables = [frame(spark, SCHEMAS[k], change.get(k, ROWS[k])) for k in ("decisions", "factories", "returned", "locals")]
    found = scenario_graph.associate_results(frame(spark, "entry string, root long, method long", [("get", 1, 50)]), *tables)
    assert got(found, "success", "failure", "code", "detail") == [(None, None, code, detail) if code else (1002, 1003, None, None)]


def test_dispatched_handler(spark):
    """The handler's calls in order, each with its target's; a loop that is complete; a call that is withheld; what is returned."""
    call = "caller long, op long, node long, block long, evaluation long, target long, type_name string, member_name string, certainty string, proven boolean, source_backed boolean, platform boolean, nested boolean, dynamic boolean, delegate boolean, constructor boolean"
    site = "caller long, op long, site long, declared_target long, site_certainty string, site_proven boolean, resolution string, complete boolean, candidates long, candidate long, resolution_certainty string, resolution_proven boolean"
    calls = [(7, 2, 2, 1, 0, 8, 0), (7, 1, 1, 0, 5, 8, 0), (7, 3, 3, 2, 0, 9, 1), (7, 4, 4, 3, 0, 9, 0), (8, 5, 5, 0, 0, 9, 0), (8, 6, 6, 0, 1, 9, 0), (9, 9, 9, 0, 0, 7, 0)]
    invocations = frame(spark, call, [(c, o, n, b, e, t, "T", "M", "Exact", True, True, bool(p), False, False, False, False) for c, o, n, b, e, t, p in calls])
    sites = frame(spark, site, [(c, o, o, t, "Exact", True, "Cha" if o in (4, 6) else "DirectExact", True, 1, t, "Exact", True) for c, o, _, _, _, t, _ in calls])
    shape = "dispatch long, boundary string, cardinality string, resolution string, handler long, body_available boolean, response_type string"
    rows = [(1, "RequestResponse", "ExactlyOne", "ExactSingle", 7, True, "R"), (2, "RequestResponse", "ExactlyOne", "Ambiguous", None, None, None), (3, "RequestResponse", "Many", "ExactSingle", 7, True, "R"), (4, "RequestResponse", "ExactlyOne", "ExactSingle", 7, False, "R"), (5, "RequestResponse", "ExactlyOne", "ExactSingle", 70, True, "R"), (6, "RequestResponse", "ExactlyOne", "ExactSingle", 7, True, "Q"), (8, "RequestResponse", "ExactlyOne", None, 7, True, "Q")]
    methods = frame(spark, "method_id long, return_type string, flows int", [(7, "System.Threading.Tasks.Task<R>", 1), (8, "void", 1), (9, "void", 2)])
    loops = frame(spark, "method long, latch long, header long, node long", [(7, 1, 0, 0), (7, 1, 0, 1)])
    exits = frame(spark, "method long, latch long, header long, node long", [(7, 1, 0, 3)])
    returns = frame(spark, "method long, operation long", [(7, 99)])
    run = lambda lo, ex: dispatch.expand_handlers(frame(spark, shape, rows), methods, invocations, sites, lo, ex, returns)
    out = run(loops, exits)
    assert got(out["steps"].where("dispatch = 1"), "ordinal", "depth", "operation", "parent", "header") == [(0, 0, 1, None, None), (1, 1, 5, 1, None), (2, 0, 2, None, 0), (3, 1, 5, 2, None)]
    assert got(out["returned"]) == [(1, 99, "R")]
    codes = got(out["diagnostics"], "dispatch", "code")
    assert [c for c in codes if c[0] != 1 and c[0] != 6] == [(2, "SC-DISPATCH-AMBIGUOUS"), (3, "SC-DISPATCH-UNRESOLVED"), (4, "SC-DISPATCH-BODY-UNAVAILABLE"), (5, "SC-DISPATCH-HANDLER-FLOW-MISSING"), (8, "SC-DISPATCH-UNRESOLVED")]
    assert [c for c in codes if c[0] in (1, 6)] == [(1, "SC-DISPATCH-CALL-WITHHELD"), (6, "SC-DISPATCH-CALL-WITHHELD"), (6, "SC-DISPATCH-RETURN-MISMATCH")]
    # Two ways back are no one complete loop, nor is a loop that nothing leaves.
    for lo, ex in ((loops.unionAll(loops.withColumn("latch", F.lit(2).cast("long"))), exits), (loops, exits.limit(0))):
        broken = run(lo, ex)
        assert (1, "SC-DISPATCH-LOOP-INCOMPLETE") in got(broken["diagnostics"], "dispatch", "code") and broken["steps"].where("header is not null").count() == 0


@pytest.mark.parametrize("display, expected", [("R", "R"), ("System.Threading.Tasks.Task<R>", "R"), ("System.Threading.Tasks.ValueTask<A<B, C<D>>>", "A<B, C<D>>"), ("System.Threading.Tasks.Task<A, B>", None), ("A.Box<R>", None), ("System.Threading.Tasks.Task<A><B>", None), ("", None), (None, None)])
def test_effective_return_types(spark, display, expected):
    assert one(spark, text.effective_return_type, display) == expected


def test_callback_contracts(spark):
    """Blocks 0 -> 1 | 2 -> 3 (exit 4): a call in 0 or 3 lies on every way, one in 1 does not."""
    blocks = frame(spark, BLOCKS, [("m", 0, 4, "Conditional", 2, 1), ("m", 1, 4, "None", None, 3), ("m", 2, 4, "None", None, 3), ("m", 3, 4, "None", None, 4)])
    uses = {  # parameter: [(op, kind, loop, unsupported, access, conditions, condition, statement)]
        "none": [], "escapes": [(1, "invoke", False, False, False, 0, None, None), (2, "escape", None, None, None, None, None, None)], "once": [(3, "invoke", False, False, False, 0, None, None)],
        "around": [(4, "invoke", False, False, False, 0, None, None)], "twice": [(5, "invoke", False, False, False, 0, None, None), (6, "invoke", False, False, False, 0, None, None)], "loop": [(7, "invoke", True, False, False, 0, None, None)],
        "lock": [(8, "invoke", True, True, False, 0, None, None)], "if": [(9, "invoke", False, False, False, 1, 77, True)], "ternary": [(10, "invoke", False, False, False, 1, 77, False)], "nested": [(11, "invoke", False, False, False, 2, 77, True)],
        "access": [(12, "invoke", False, False, True, 0, None, None)], "unknown condition": [(13, "invoke", False, False, False, 1, None, True)], "two blocks": [(14, "invoke", False, False, False, 0, None, None)],
    }
    spans = [("m", op, {4: 1, 9: 1}.get(op, 0)) for op in range(1, 14)] + [("m", 14, 0), ("m", 14, 3)]
    found = callbacks.callback_contracts(
        frame(spark, "method string, parameter string", [("m", p) for p in uses]),
        frame(spark, "method string, parameter string, op long, kind string, loop boolean, unsupported boolean, access boolean, conditions int, condition long, statement boolean", [("m", p, *u) for p, us in uses.items() for u in us]),
        frame(spark, "method string, op long, block long", spans), flow.dominator_tree(blocks), frame(spark, "method string, exit long", [("m", 4)]))
    want = {"none": ("Unbounded", None, None, None), "escapes": ("Unbounded", None, None, None), "once": ("ExactlyOnce", "Unconditional", 3, None), "around": ("Unknown", "Unknown", 4, None), "twice": ("RepeatedOrUnknown", "Unknown", 5, None), "loop": ("RepeatedOrUnknown", "Unknown", 7, None), "lock": ("Unknown", "Unknown", 8, None), "if": ("ZeroOrOne", "Conditional", 9, 77), "ternary": ("Unknown", "Unknown", 10, None), "nested": ("Unknown", "Unknown", 11, None), "access": ("Unknown", "Unknown", 12, None), "unknown condition": ("Unknown", "Unknown", 13, None), "two blocks": ("Unknown", "Unknown", 14, None)}
    assert {p: rest for p, *rest in got(found, "parameter", "cardinality", "trigger", "invoke", "condition")} == {k: list(v) for k, v in want.items()}


def test_regions_hold_members_by_operation(spark):
    nodes = frame(spark, "entry string, node long, method long, operation long", [("e", 1, 5, 50), ("e", 2, 6, 60), ("f", 3, 6, 60), ("f", 4, 6, None)])
    boundaries = frame(spark, "boundary long, method long, cardinality string, trigger string", [(9, 5, "ZeroOrOne", "Conditional"), (8, 7, "Unknown", "Unknown"), (10, 6, "ExactlyOnce", "Unconditional")])
    regions, members = callbacks.callback_regions(boundaries, frame(spark, "boundary long, operation long", [(9, 60), (9, 60), (8, 60), (10, 99)]), nodes)
    assert got(regions) == [("e", 9, "ZeroOrOne", "Conditional")] and got(members) == [("e", 9, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_tree_against_deletion(seed):
    """A node dominates another if no way is left without it; random graphs, also with nodes that nothing reaches."""
    rng = random.Random(seed)
    for _ in range(150):
        n = rng.randrange(1, 12)
        after = [sorted({rng.randrange(n) for _ in range(rng.randrange(3))}) for _ in range(n)]
        before = [[a for a in range(n) if b in after[a]] for b in range(n)]
        heads = sorted(rng.sample(range(n), rng.randrange(1, min(n, 2) + 1)))
        tree = flow.Tree(heads, after, before)

        def reach(gone):
            seen, todo = set(), [h for h in heads if h != gone]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += [t for t in after[k] if t != gone]
            return seen

        live = reach(None)
        for a in range(n):
            left = reach(a)
            for b in range(n):
                assert tree.dominates(a, b) == (a == b or b not in left or b not in live)
        for b in range(n):
            assert sorted(tree.over(b)) == [a for a in range(n) if tree.dominates(a, b)]


def test_points_on_every_way(spark):
    blocks = frame(spark, BLOCKS, [("m", 0, 2, "None", None, 1), ("m", 1, 2, "None", None, 1), ("n", 0, 1, "None", None, 1)])
    points = frame(spark, "method string, node long", [("m", 0), ("m", 1), ("n", 0), ("n", 7), ("n", None), ("x", 0)])
    exits = frame(spark, "method string, exit long", [("m", 2), ("n", 1), ("n", 1)])
    # The exit of m is not reached at all, so no way goes around anything.
    assert got(flow.on_every_way(points, flow.dominator_tree(blocks), exits)) == [("m", 0, True), ("m", 1, True), ("n", 0, True), ("n", 7, False), ("n", None, False), ("x", 0, False)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 40])
def test_chain_of_n_steps(spark, n):
    """A property, n calls on it, and the terminal; also a shared beginning, a circle and an unknown receiver."""
    calls = [("m", k, k - 1, f"c{k}") for k in range(1, n + 2)] + [("m", 500, n, "fork"), ("m", 601, 602, "a"), ("m", 602, 603, "b"), ("m", 603, 602, "c"), ("m", 700, 999, "lost")]
    terminals = frame(spark, "method string, op long", [("m", n + 1), ("m", 500), ("m", 601), ("m", 700), ("m", 12345)])
    steps, begun = chains.query_steps(terminals, frame(spark, "method string, op long, receiver long, name string", calls), frame(spark, "method string, op long, member string, entity string", [("m", 0, "Set", "T"), ("m", 999999, "x", "y")]))
    found = got(steps, "terminal", "place", "op")
    assert found == sorted([(t, k - 1, k) for t in (n + 1, 500) for k in range(1, n + 1)], key=repr)
    assert got(begun) == sorted([("m", t, "Set", "T", n) for t in (n + 1, 500)], key=repr)


def test_minimal_routes(spark):
    groups = [("m", 1, None, "/api/", True), ("m", 2, 1, "v1", True), ("m", 3, 2, None, True), ("m", 4, 1, "x", False), ("m", 5, 6, "a", True), ("m", 6, 5, "b", True)]
    maps = [("m", 10, "MapGet", 3, "items/{id}/", 9), ("m", 11, "MapPost", None, "/", 9), ("m", 12, "MapPut", 4, "r", 9), ("m", 13, "MapDelete", 2, " ", 9), ("m", 14, "MapGet", 1, "r", None), ("m", 15, "MapGet", 5, "r", 9), ("m", 16, "MapGet", 77, "r", 9)]
    found = chains.minimal_routes(frame(spark, "method string, op long, member string, receiver long, route string, handler long", maps), frame(spark, "method string, op long, receiver long, prefix string, exact boolean", groups))
    assert got(found, "op", "verb", "route", "operation_key", "code") == [
        (10, "GET", "/api/v1/items/{id}", "GET api/v1/items/{id}", None), (11, "POST", "/", "POST ", None), (12, None, None, None, "group"), (13, None, None, None, "route"),
        (14, None, None, None, "callback"), (15, None, None, None, "group"), (16, None, None, None, "group"),
    ]
