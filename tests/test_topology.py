"""Memberships, fragments, pruning, admission and the value graph on hand-built cases."""

from factweave.operators import admission, arms, joins, topology, values


def got(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_memberships_need_agreeing_anchors_and_one_arm(spark):
    nodes = spark.createDataFrame([("m", 1, "a"), ("m", 2, "b"), ("m", 3, None), ("m", 4, "gone"), ("m", 5, "both"), ("flat", 6, "a")], "method string, node int, operation string")
    anchors = spark.createDataFrame([("m", "a", 10), ("m", "a", 11), ("m", "a", 11), ("m", "b", 12), ("m", "b", 13), ("m", "both", 14), ("flat", "a", 1)], "method string, operation string, anchor int")
    dependences = spark.createDataFrame([("m", 0, 10, True), ("m", 0, 11, True), ("m", 0, 12, False), ("m", 1, 14, True), ("m", 1, 14, False), ("m", 2, 14, True)], "method string, decision int, node int, polarity boolean")
    decisions = spark.createDataFrame([("m", 0), ("m", 1), ("m", 2), ("idle", 9)], "method string, decision int")
    found, codes = topology.memberships(nodes, anchors, dependences, decisions)
    assert got(found, "node", "decision", "polarity") == [(1, 0, True), (5, 2, True)]
    assert got(codes, "node", "code", "decision") == [(2, "SC011", None), (3, "SC011", None), (4, "SC011", None), (5, "SC012", 1)]
    # A decision is a question to answer, whether or not anything depends on it.
    found, codes = topology.memberships(nodes.where("node in (1, 4)"), anchors, dependences.limit(0), decisions)
    assert got(found, "node") == [] and got(codes, "node", "code") == [(4, "SC011")]


def test_topology_of_root_and_service(spark):
    """Nodes of an entry are anchored in either method; an operation anchored in both must agree in both."""
    scopes = spark.createDataFrame([("e", "root"), ("e", "svc"), ("e", "svc"), ("f", "root")], "entry string, method string")
    nodes = spark.createDataFrame([("e", 1, "a"), ("e", 2, "b"), ("e", 3, "c"), ("f", 4, "b"), ("f", 5, "a")], "entry string, node int, operation string")
    anchors = spark.createDataFrame([("root", "a", 10), ("svc", "b", 10), ("root", "c", 11), ("svc", "c", 11)], "method string, operation string, anchor int")
    dependences = spark.createDataFrame([("root", 0, 10, True), ("svc", 5, 10, False), ("root", 0, 11, True)], "method string, decision int, node int, polarity boolean")
    terminals = spark.createDataFrame([("root", 0, True, "Terminates", None), ("root", 0, False, "Unknown", "switch"), ("svc", 5, True, "Unknown", "loop"), ("svc", 5, False, "Unknown", "switch")], "method string, decision int, arm boolean, terminal string, reason string")
    out = topology.decision_topology(scopes, nodes, anchors, dependences, terminals)
    assert got(out["arms"], "entry", "method", "decision", "polarity", "terminal") == [("e", "root", 0, False, "Unknown"), ("e", "root", 0, True, "Terminates"), ("e", "svc", 5, False, "Unknown"), ("e", "svc", 5, True, "Unknown"), ("f", "root", 0, False, "Unknown"), ("f", "root", 0, True, "Terminates")]
    assert got(out["memberships"], "entry", "node", "method", "decision", "polarity") == [("e", 1, "root", 0, True), ("e", 2, "svc", 5, False), ("f", 5, "root", 0, True)]
    assert got(out["diagnostics"], "entry", "code", "node", "method", "decision", "detail") == [("e", "SC011", 3, None, None, None), ("e", "SC013", None, "root", 0, "switch"), ("e", "SC013", None, "svc", 5, "loop"), ("f", "SC011", 4, None, None, None), ("f", "SC013", None, "root", 0, "switch")]


# One graph a case: kinds of nodes, edges, loops (loop, header, body, exits), regions (node, kind), and the true arm of decision 1.
ARMS = {
    "Terminates": ({1: "Decision", 2: "Block", 3: "Return", 4: "Exit"}, [(1, 2, "True"), (1, 4, "False"), (2, 3, "Normal"), (3, 4, "Return")], [], [(1, "Root"), (1, "Try")]),
    "Rejoins": ({1: "Decision", 2: "Block", 4: "Exit"}, [(1, 2, "True"), (1, 4, "False"), (2, 4, "Normal")], [], []),
    "loop-back": ({1: "Decision", 4: "Exit"}, [(1, 0, "LoopBack"), (1, 4, "True")], [], []),
    "foreign-loop-back": ({1: "Decision", 4: "Exit"}, [(1, 0, "LoopBack"), (1, 4, "True")], [(9, 1, {2}, {4})], []),
    "switch": ({1: "Decision", 4: "Exit"}, [(1, 4, "True"), (1, 4, "False"), (1, 5, "SwitchCase")], [], []),
    "exception-region": ({1: "Decision", 4: "Exit"}, [(1, 4, "True"), (1, 4, "False")], [], [(1, "Lock")]),
    "missing-arm-edge": ({1: "Decision", 4: "Exit"}, [(1, 1, "LoopBack"), (1, 4, "False")], [(9, 1, set(), {4})], []),
    "exception-edge": ({1: "Decision", 4: "Exit"}, [(1, 4, "True"), (1, 4, "False"), (1, 7, "ExceptionHandler")], [], []),
    "missing-node": ({1: "Decision", 4: "Exit"}, [(1, 8, "True"), (1, 4, "False")], [], []),
    "exception-region-target": ({1: "Decision", 2: "Block", 4: "Exit"}, [(1, 2, "True"), (2, 4, "Normal")], [], [(2, "Catch")]),
    "mismatched-exit": ({1: "Decision", 2: "Block", 4: "Exit"}, [(1, 2, "True"), (2, 4, "Normal")], [(9, 1, {2}, {5})], []),
    "loop": ({1: "Decision", 2: "Loop", 4: "Exit"}, [(1, 2, "True"), (2, 4, "Normal")], [], []),
    "exception-boundary-target": ({1: "Decision", 3: "Throw", 4: "Block"}, [(1, 3, "True"), (3, 4, "Throw")], [], [(4, "Finally")]),
    "operation-derived-duplicate-terminal": ({1: "Decision", 3: "Return", 4: "Exit"}, [(1, 3, "True"), (3, 4, "Normal")], [], []),
    "unsupported-edge:LoopBack": ({0: "Decision", 1: "Decision", 2: "Block", 4: "Exit"}, [(1, 2, "True"), (1, 4, "False"), (2, 0, "LoopBack")], [(9, 0, {1, 2}, {4})], []),
    "foreign-body-source": ({1: "Decision", 2: "Block", 4: "Exit"}, [(1, 2, "True"), (1, 4, "False"), (2, 1, "LoopBack")], [(9, 1, {3}, {4})], []),
    "no-reachable-boundary": ({1: "Decision", 2: "Block", 4: "Exit"}, [(1, 2, "True"), (1, 4, "False")], [], []),
    "mixed-boundary": ({1: "Decision", 2: "Block", 3: "Return", 4: "Exit"}, [(1, 2, "True"), (2, 3, "Normal"), (2, 4, "Normal")], [], []),
}


def arm_table(spark, cases):
    rows = lambda k: [(m, *x) for m, case in cases.items() for x in (case[k].items() if k == 0 else case[k])]
    loops = [(m, loop, header, node, role) for m, loop, header, body, exits in rows(2) for held, role in ((body, "Body"), (exits, "Exit")) for node in (held or {None})]
    return arms.arm_terminals(
        spark.createDataFrame(rows(0), "method string, node long, kind string"), spark.createDataFrame(rows(1), "method string, source long, target long, kind string"),
        spark.createDataFrame(loops, "method string, loop long, header long, node long, role string"), spark.createDataFrame(rows(3), "method string, node long, kind string"))


def test_every_reason_of_an_arm(spark):
    found = {m: reason or end for m, d, arm, end, reason in got(arm_table(spark, ARMS), "method", "decision", "arm", "terminal", "reason") if d == 1 and arm}
    assert found == {m: m for m in ARMS}


def test_arms_of_loops(spark):
    """A loop's header: one arm iterates, the other leaves by the agreed exit. A decision inside: its way back to the header is not followed."""
    kinds = {0: "Block", 1: "Decision", 2: "Block", 3: "Decision", 4: "Block", 5: "Exit", 6: "Block"}
    edges = [(0, 1, "Normal"), (1, 2, "True"), (1, 5, "False"), (2, 1, "LoopBack")]
    inner = [(0, 1, "Normal"), (1, 3, "True"), (1, 5, "False"), (3, 4, "True"), (3, 6, "False"), (4, 1, "LoopBack"), (6, 6, "Normal")]
    cases = {"own": (kinds, edges, [(2, 1, {2}, {5})], [(1, "Try")]), "inner": (kinds, inner, [(4, 1, {3, 4}, {5})], [])}
    found = {(m, d, arm): reason or end for m, d, arm, end, reason in got(arm_table(spark, cases), "method", "decision", "arm", "terminal", "reason")}
    assert found["own", 1, True] == "Rejoins" and found["own", 1, False] == "Rejoins"
    assert found["inner", 3, True] == "unsupported-edge:LoopBack" and found["inner", 3, False] == "no-reachable-boundary"
    assert found["inner", 1, True] == "mismatched-exit"


def members(spark, **methods):
    rows = [(m, d, True, n) for m, sets in methods.items() for d, held in sets.items() for n in held]
    return spark.createDataFrame(rows, "method string, decision int, polarity boolean, node int")


def test_fragments(spark):
    """Nested in the one minimal arm; at the top with two of them; hoisted if equal; flat beyond the depth."""
    found = topology.fragments(members(
        spark,
        nested={1: {1, 2, 3, 4}, 2: {1, 2, 3}, 3: {1, 2}, 4: {7, 8}, 5: {7, 8}, 6: {7}},
        split={1: {1}, 2: {1, 2}, 3: {1, 3, 4}, 4: {1, 2, 5}},
        deep={k: set(range(k)) for k in (1, 2, 3, 4)},
    ))
    assert got(found, "method", "decision", "parent", "depth", "placement") == sorted([
        *[("nested", *r) for r in [(1, None, 1, "Top"), (2, 1, 2, "Nested"), (3, 2, 3, "Nested"), (4, None, 1, "Hoisted"), (5, None, 1, "Hoisted"), (6, None, 1, "Top")]],
        *[("split", *r) for r in [(1, None, 1, "Top"), (2, 4, 2, "Nested"), (3, None, 1, "Top"), (4, None, 1, "Top")]],
        *[("deep", k, None, 1, "Flat") for k in (1, 2, 3, 4)],
    ], key=repr)


def test_no_rows(spark):
    assert topology.fragments(members(spark, m={1: {1}}).limit(0)).count() == 0
    assert joins.minimal_supersets(spark.createDataFrame([], "g int, m int"), "g", "m").count() == 0


def test_a_tree_of_fragments_is_told_in_one_walk(spark):
    """Ids beyond 2**53, nulls among nodes, an arm that two decisions share; no job runs before the result is asked for."""
    big = 2**60
    rows = [("m", big + d, p, n) for d, arms in {1: {True: [1, 2, None], False: [3]}, 2: {True: [1], False: [None]}, 3: {True: [4, 5]}, 4: {True: [4], False: [5]}, 5: {True: [6, 7]}, 6: {True: [6, 7], False: [8]}, 7: {True: [6]}}.items() for p, held in arms.items() for n in held]
    rows += [(None, 1, True, 1), ("m", None, True, 1)]
    found = topology.fragments(spark.createDataFrame(rows, "method string, decision long, polarity boolean, node long"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan
    assert got(found, "decision", "parent", "parent_arm", "placement") == sorted([(big + 1, None, None, "Top"), (big + 2, big + 1, True, "Nested"), (big + 3, None, None, "Hoisted"), (big + 4, None, None, "Hoisted"), (big + 5, None, None, "Top"), (big + 6, None, None, "Top"), (big + 7, None, None, "Top")], key=repr)


def test_prune_takes_edges_and_memberships_along(spark):
    nodes = spark.createDataFrame([("m", 1), ("m", 2), ("n", 1)], "method string, node int")
    edges = spark.createDataFrame([("m", 1, 2), ("n", 1, 1)], "method string, source int, target int")
    arms = spark.createDataFrame([("m", "t", 1), ("m", "t", 2)], "method string, arm string, node int")
    kept = topology.prune(nodes, edges, arms, spark.createDataFrame([("m", 1)], "method string, node int"))
    assert [got(k, *k.columns) for k in kept] == [[("m", 2), ("n", 1)], [("n", 1, 1)], [("m", "t", 2)]]


CALL = {"caller": "c", "op": 1, "node": "n1", "target": "t", "type_name": "T", "member_name": "M", "certainty": "Exact", "proven": True, "source_backed": True, "platform": False, "nested": False, "dynamic": False, "delegate": False, "constructor": False}
SITE = {"caller": "c", "op": 1, "site": "s", "declared_target": "t", "site_certainty": "Exact", "site_proven": True, "resolution": "DirectExact", "complete": True, "candidates": 1, "candidate": "t", "resolution_certainty": "Exact", "resolution_proven": True}


def table(spark, rows):
    kind = lambda v: "boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "string"
    model = CALL if "node" in rows[0] else SITE
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {kind(v)}" for k, v in model.items()))


CASES = [
    ({}, "direct", None), ({}, "root", None), ({}, "leaf", None),
    ({"nested": True}, "leaf", "Source"), ({"source_backed": None}, "direct", "Source"), ({"platform": True}, "root", "Source"),
    ({"type_name": " "}, "root", "Name"), ({"type_name": " "}, "direct", None), ({"member_name": None}, "leaf", "Name"),
    ({"constructor": True}, "direct", "Form"), ({"constructor": True}, "leaf", None), ({"dynamic": True}, "root", "Form"),
    ({"resolution": "Cha"}, "leaf", "Resolution"), ({"candidates": 2}, "direct", "Resolution"), ({"complete": False}, "root", "Resolution"),
    ({"declared_target": "u"}, "direct", "Target"), ({"declared_target": "u"}, "leaf", None), ({"target": None}, "direct", "Target"),
    ({"resolution_certainty": "Heuristic"}, "root", "Certainty"), ({"resolution_certainty": "Heuristic"}, "direct", None),
    ({"site_proven": None}, "direct", "Evidence"), ({"proven": False}, "root", "Evidence"),

]


def test_admission(spark):
    """Each case changes one column of a call, or its site, that is admitted otherwise."""
    at = lambda model: table(spark, [{k: change.get(k, v) for k, v in model.items()} | {"op": n} for n, (change, _, _) in enumerate(CASES)])
    found = {rule: dict(got(admission.admit(at(CALL), at(SITE), rule), "op", "withheld")) for rule in ("direct", "root", "leaf")}
    assert [found[rule][n] for n, (_, rule, _) in enumerate(CASES)] == [reason for _, _, reason in CASES]


def test_admission_takes_one_site_and_the_first_node(spark):
    calls = table(spark, [CALL, CALL | {"node": "n0"}, CALL | {"op": 2, "node": "n2"}, CALL | {"op": 3, "node": "n3"}])
    sites = table(spark, [SITE, SITE | {"op": 2}, SITE | {"op": 2, "site": "s2"}])
    assert got(admission.admit(calls, sites, "root"), "node", "site", "withheld") == [("n0", "s", None), ("n2", None, "Site"), ("n3", None, "Site")]


def test_values_flow_from_the_latest_definition(spark):
    ops = spark.createDataFrame(
        [("m", 1, 0, 0, "LocalReference", None, "x", None), ("m", 2, 0, 1, "Literal", None, None, None), ("m", 3, 0, 2, "Assignment", None, None, None),
         ("m", 4, 1, 0, "LocalReference", None, "x", None), ("m", 5, 1, 1, "Invocation", None, None, None), ("m", 6, 1, 2, "FieldReference", None, None, "f"), ("m", 7, 1, 3, "Assignment", None, None, None)],
        "method string, op int, block int, evaluation int, kind string, parameter int, local_name string, member string")
    operands = spark.createDataFrame([("m", 3, 0, 1), ("m", 3, 1, 2), ("m", 5, 0, 4), ("m", 7, 0, 6), ("m", 7, 1, 5)], "method string, op int, place int, operand int")
    assert got(values.value_edges(ops, operands), "source", "target", "kind") == [(2, 3, "Assignment"), (3, 4, "CaptureCollapse"), (4, 5, "Argument")]
    assert got(values.state_access(ops, operands), "access", "member") == [("Read", "f"), ("Write", "f")]


def test_argument_labels(spark):
    s = "System.String"
    rows = [("m", 1, 1, "System.Int32", "7"), ("m", 1, 0, s, 'a"\n'), ("m", 2, 1, s, "x"), ("m", 3, 0, s, "x"), ("m", 3, 0, s, "y"), ("m", 4, 0, s, "my token"), ("m", 5, 0, s, None)]
    found = values.argument_labels(spark.createDataFrame(rows, "method string, op int, ordinal int, type string, value string"))
    assert got(found, "op", "label") == [(1, '"a\\"\\n", 7'), (2, None), (3, None), (4, None), (5, None)]
