"""Small hand-built inputs: none, one and several matches, nulls, order of rows, degenerate graphs."""

import random

import pytest

from factweave.functions import text
from factweave.operators import calls, catalog, facts, flow, joins, render
from pyspark.sql import functions as F


def got(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


BLOCKS = "method string, ord long, n long, terminal string, cond_succ long, fall long"


def test_diamond(spark):
    """0 -> 1; 1 decides between 3 (true) and 2 (false); both meet in the exit block 4."""
    rows = [("m", 0, 4, "None", None, 1), ("m", 1, 4, "Conditional", 3, 2), ("m", 2, 4, "None", None, 4), ("m", 3, 4, "None", None, 4)]
    for given in (rows, rows[::-1]):
        blocks = spark.createDataFrame(given, BLOCKS)
        assert ("m", 4, 0) in got(flow.post_dominators(blocks)) and ("m", 4, 3) in got(flow.post_dominators(blocks))
        assert got(flow.back_edges(blocks)) == [] and got(flow.natural_loops(blocks)) == []
        assert got(flow.edges(blocks)) == [("m", 0, 1, "Normal"), ("m", 1, 2, "False"), ("m", 1, 3, "True"), ("m", 2, 4, "Normal"), ("m", 3, 4, "Normal")]
        assert got(flow.control_dependences(blocks)) == [("m", 1, 2, False), ("m", 1, 3, True)]
        assert got(flow.outcomes(blocks.withColumn("escaping", F.lit(False)))) == [("m", None, "NormalCompletion")]


def test_loops_and_unreachable(spark):
    """A self-loop on 1; block 2 is reached by nothing and so dominated by everything."""
    blocks = spark.createDataFrame([("m", 0, 3, "None", None, 1), ("m", 1, 3, "Conditional", 1, 3), ("m", 2, 3, "None", None, 3)], BLOCKS)
    assert got(flow.back_edges(blocks)) == [("m", 1, 1)]
    assert got(flow.natural_loops(blocks)) == [("m", 1, 1, 1)]
    assert got(flow.loop_exits(blocks)) == [("m", 1, 1, 3)]
    assert [d for _, d, n in got(flow.dominators(blocks)) if n == 2] == [0, 1, 2, 3]


def test_terminals(spark):
    """A throw without fall-through leads to the exit, a return back to the entry stays a return, a caught throw ends nothing."""
    schema = BLOCKS + ", escaping boolean"
    rows = [("m", 0, 4, "Conditional", 2, 1, False), ("m", 1, 4, "Throw", None, None, True), ("m", 2, 4, "Return", None, 0, False), ("m", 3, 4, "Rethrow", None, 4, False)]
    blocks = spark.createDataFrame(rows, schema)
    assert got(flow.edges(blocks)) == [("m", 0, 1, "False"), ("m", 0, 2, "True"), ("m", 1, 4, "Throw"), ("m", 2, 0, "Return"), ("m", 3, 4, "Rethrow")]
    assert got(flow.outcomes(blocks)) == [("m", 1, "EscapingThrow"), ("m", 2, "ExplicitReturn")]
    alone = spark.createDataFrame([("k", 0, 1, "Unknown", None, None, None)], schema)
    assert got(flow.outcomes(alone)) == [("k", 0, "Unknown"), ("k", None, "NoNormalExit")]


@pytest.mark.parametrize("matches, expected", [(0, [(1, None, "none")]), (1, [(1, "a", None)]), (2, [(1, None, "many")])])
def test_exactly_one(spark, matches, expected):
    left = spark.createDataFrame([(1,)], "k long")
    right = spark.createDataFrame([(1, "a"), (1, "b")][:matches], "k long, v string")
    assert got(joins.exactly_one(left, right, ["k"], "none", "many", ["v"])) == expected


def test_conflicts_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (3, None), (4, None), (4, "a")], "k long, v string")
    kept, dropped = facts.resolve_conflicts(rows, ["k"], ["v"], "C")
    assert got(kept) == [(1, "a"), (3, None)] and got(dropped) == [(2, "C"), (4, "C")]


def test_sets_and_supersets(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3), ("d", 1), ("d", 2)], "g string, m long")
    assert got(joins.equal_sets(rows, "g", "m"), "first", "other") == [("b", "d")]
    # b and d are both smallest supersets of a, so a has no unique parent.
    assert got(joins.minimal_supersets(rows, "g", "m")) == [("a", None), ("b", "c"), ("c", None), ("d", "c")]


def test_innermost(spark):
    points = spark.createDataFrame([("m", 1), ("m", 5), ("m", 9)], "m string, p long")
    intervals = spark.createDataFrame([("m", 0, 6, 1), ("m", 4, 6, 2)], "m string, s long, e long, id long")
    assert got(joins.innermost(points, intervals, ["m"], "p", "s", "e", F.col("id")), "p", "id") == [(1, 1), (5, 2), (9, None)]


CALLS = "caller long, callee long, owner long, op_ord long"


def test_expansion_stops(spark):
    """Each reason once; a leaf at the last level that calls nothing is complete, one that calls on is cut for its depth."""
    methods = spark.createDataFrame([(1, True, True, 1), (2, True, True, 1), (3, False, True, 1), (4, True, True, 1), (5, True, False, 1), (6, True, True, 0), (7, True, True, 2), (8, True, True, 1)], "method_id long, has_body boolean, loaded boolean, flows int")
    edges = spark.createDataFrame([(1, 2, 0, 0), (2, 1, 0, 1), (2, 4, 0, 2), (2, 8, 0, 3), (1, 3, 0, 3), (1, 5, 0, 4), (1, 6, 0, 5), (1, 7, 0, 6), (8, 4, 0, 0)], CALLS)
    roots = spark.createDataFrame([(1,)], "root long")
    found = got(calls.expand(roots, edges, methods), "path", "method_id", "stop", "step")
    assert found == [("", 1, None, False), ("1", 2, None, True), ("1.1", 1, "Cycle", True), ("1.2", 4, None, True), ("1.3", 8, "Depth", True), ("2", 3, "BodyUnavailable", True), ("3", 5, "SourceUnavailable", True), ("4", 6, "NoFlow", True), ("5", 7, "AmbiguousFlow", True)]
    assert got(calls.expand(roots, edges.limit(0), methods), "path", "stop") == [("", None)]


@pytest.mark.parametrize("n", [63, 64, 65, 70])
def test_expansion_budget(spark, n):
    """64 steps without the root; every call that a step makes behind them is marked, also with its own calls left out."""
    methods = spark.createDataFrame([(1, True), (2, True), (4, True)], "method_id long, has_body boolean")
    roots = spark.createDataFrame([(1,)], "root long")
    flat = got(calls.expand(roots, spark.createDataFrame([(1, 4, 0, k) for k in range(n)], CALLS), methods), "path", "stop", "step")
    assert [sum(step for *_, step in flat), [s for _, s, _ in flat].count("NodeBudget")] == [min(n, 64), max(0, n - 64)]
    deep = spark.createDataFrame([(1, 2, 0, 0), (1, 4, 0, 1)] + [(2, 4, 0, k) for k in range(n)], CALLS)
    out = got(calls.expand(roots, deep, methods), "path", "stop", "step")
    assert sum(step for *_, step in out) == min(64, n + 2) and ("2", "NodeBudget" if n > 62 else None, n <= 62) in out
    assert len(out) == n + 3


def test_guarded_calls_are_marked_below_the_root_only(spark):
    methods = spark.createDataFrame([(1, True), (2, True), (4, True)], "method_id long, has_body boolean")
    edges = spark.createDataFrame([(1, 2, 0, 0, True), (2, 4, 0, 1, True), (2, 4, 0, 2, False), (2, 4, 0, 3, None)], CALLS + ", guarded boolean")
    found = calls.expand(spark.createDataFrame([(1,)], "root long"), edges, methods)
    assert got(found, "path", "stop", "step") == [("", None, False), ("1", None, True), ("1.1", "Guarded", False), ("1.2", None, True), ("1.3", None, True)]
    conflicts = spark.createDataFrame([(2, "op"), (2, "op"), (4, "x"), (9, "y")], "caller long, operation string")
    assert got(calls.expansion_conflicts(found, conflicts), "path", "operation") == [("1", "op"), ("1.2", "x"), ("1.3", "x")]


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "source long, target long")
    starts = spark.createDataFrame([(1,), (4,)], "start long")
    assert got(calls.closure(starts, edges)) == [(1, 1), (1, 2), (1, 3), (4, 4)]


def test_candidates(spark):
    methods = spark.createDataFrame([(1, True), (2, True), (3, False)], "method_id long, has_body boolean")
    impl = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 3)], "target long, candidate long")
    sites = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "site long, target long")
    assert got(calls.candidates(sites, impl, methods)) == [(10, 1, 1, "DirectExact"), (20, 2, 1, "Cha"), (20, 2, 2, "Cha"), (30, 3, None, "Unresolved")]


def test_closed_world_needs_roots(spark):
    rows = spark.createDataFrame([(1, 1)], "candidate long, type long")
    up = spark.createDataFrame([(1, 2)], "type long, above long")
    none = spark.createDataFrame([], "type long")
    assert calls.prune_types(rows, up, none, False).count() == 1
    with pytest.raises(ValueError):
        calls.prune_types(rows, up, none, True)


def one(spark, fn, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "fn, value, expected",
    [
        (text.normalize_path, "a/./b//../c", "a/c"),
        (text.normalize_path, "../a", None),
        (text.normalize_path, "/a", None),
        (text.normalize_path, "C:\\a", None),
        (text.slug, "--Foo  Bar.baz!", "foo-bar-baz"),
        (text.unquote, r'"a\\n\"\t"', 'a\\n"\t'),
        (text.unquote, r'"a\x"', None),
        (text.unquote, "a", None),
        (text.simple_type_name, "A.B+C`2<X.Y>", "C"),
        (text.single_generic_argument, "D<A<B,C>>", "A<B,C>"),
        (text.single_generic_argument, "D<A,B>", None),
        (text.effective_return_type, "System.Threading.Tasks.ValueTask<X>", "X"),
        (text.aliased_type, "System.Int32?", "int"),
        (text.humanize, "CustomerService", "Customer service"),
        (text.humanize, "getHttpResponseById", "Get HTTP response by ID"),
        (text.humanize, "GetSQLUrl", "Get sQL URL"),
        (text.pluralize, "query", "queries"),
        (text.pluralize, "Box", None),
        (text.pluralize, "Part", "Parts"),
        (text.observation_kind, "// fixme: later", "Todo"),
        (text.observation_kind, "/* Note this", "Note"),
        (text.observation_kind, "// noted", "Note"),
        (text.observation_kind, "/// TODOs: more */", "Todo"),
        (text.observation_kind, "// see TODO", None),
        (text.diagram_label, 'a "b";`c`\r\n\n#', "a #quot;b#quot;;`c`  #"),
        (text.diagram_alias, 'a "b";`c`\n#', "a #quot;b#quot;#59;#96;c#96; #"),
        (text.delay_label, 2000, "Wait 2 seconds"),
        (text.delay_label, 1500, "Wait 1500 milliseconds"),
        (text.sensitive_key, "Auth:Authorization", True),
        (text.sensitive_key, "My:Pass Phrase", True),
        (text.sensitive_key, "Access/Key", True),
        (text.sensitive_key, "Certificate", False),
        (text.looks_sensitive, "my password is x", True),
        (text.looks_sensitive, "ASIA" + "X" * 16, True),
        (text.looks_sensitive, "ASIA" + "X" * 17, False),
        (text.looks_sensitive, "github_pat_x", True),
        (text.looks_sensitive, "abcdefghij123456", True),
        (text.looks_sensitive, "abcdefghijklmnop", False),
        (text.looks_sensitive, "abcdefgh.abcdefgh.abcdefgh", True),
        (text.looks_sensitive, "abcdefgh.abcdefgh.abc", False),
        (text.sensitive_key, "Db:Connection_String", True),
        (text.looks_sensitive, "hello", False),
    ],
)
def test_text(spark, fn, value, expected):
    assert one(spark, fn, value) == expected


def test_placeholders_and_routes(spark):
    assert one(spark, text.placeholders, "/a/{id:int}/{*rest}/{x?}") == ["id", "rest", "x"]
    assert one(spark, lambda c: text.route_combine(F.lit("api/"), c), "~/x/") == "x"
    assert one(spark, lambda c: text.route_combine(F.lit("/api/"), c), "x") == "api/x"


def test_canonical_json_keeps_nulls(spark):
    row = spark.createDataFrame([('a"b', None, 3)], "s string, t string, n long").select(text.canonical_json({"s": F.col("s"), "t": F.col("t"), "n": F.col("n")})).first()
    assert row[0] == '{"s":"a\\"b","t":null,"n":3}'


def test_hidden_calls_and_labels(spark):
    rows = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "z"), ("C", "w")], "type_name string, member string")
    patterns = spark.createDataFrame([("A.x",), ("B.*",)], "pattern string")
    shown, hidden = catalog.unhidden(rows, patterns)
    assert got(shown) == [("A", "y"), ("C", "w")] and got(hidden) == [("A", 1), ("B", 1)]
    names = spark.createDataFrame([(1, "a.x"), (2, "b.x"), (3, "b.y"), (4, "b.y")], "k long, p string")
    assert got(catalog.label_suffixes(names, "k", "p")) == [(1, "a.x"), (2, "b.x"), (3, "y"), (4, "y")]


def test_diagram(spark):
    lines = spark.createDataFrame([("p", 1, "b", "a c", "x", 1), ("p", 0, "a c", "b", "y;", 0)], "plan string, ord long, source string, target string, label string, depth int")
    assert got(render.diagram(lines), "diagram") == [("sequenceDiagram\n  a_c->>b: y;\n    b->>a_c: x\n",)]


def test_call_kind_precedence(spark):
    flags = spark.createDataFrame([(True, True, True, True), (False, True, True, True), (None, False, True, True), (False, None, False, True), (False, False, None, None)], "a boolean, b boolean, c boolean, d boolean")
    assert [r[0] for r in flags.select(calls.call_kind(*[F.col(c) for c in "abcd"])).collect()] == ["DelegateOrEvent", "Dynamic", "Constructor", "Static", "Instance"]


def test_contained_files(spark):
    files = spark.createDataFrame([("a/b/c.json",), ("a/bc.json",), ("top.json",), (None,)], "path string")
    directories = spark.createDataFrame([("a",), ("a/b",), ("",), ("a/b",), (None,), ("top",)], "dir string")
    assert got(joins.contained_files(files, directories, "path", "dir"), "path", "dir") == [("a/b/c.json", ""), ("a/b/c.json", "a"), ("a/b/c.json", "a/b"), ("a/bc.json", ""), ("a/bc.json", "a"), ("top.json", "")]


def test_supersets_through_the_rarest_member(spark):
    """x is in every set; sets of x alone still find their smallest superset, and ties give none."""
    sets = {1: "x", 2: "xy", 3: "xyz", 4: "xyw", 5: "xyzw", 6: "q"}
    rows = spark.createDataFrame([(g, m) for g, s in sets.items() for m in s], "g long, m string")
    assert got(joins.minimal_supersets(rows, "g", "m")) == [(1, 2), (2, None), (3, 5), (4, 5), (5, None), (6, None)]


@pytest.mark.parametrize(
    "body, expected",
    [
        ("participant a as A #quot;x#quot;\n  a->>b: hello\n  alt is open\n    a-->>b: yes\n  else is shut\n    break gone\n      b-->>a: no\n    end\n  end", []),
        ("alt x\nopt y\nloop z\nend\nend\nend", []),
        ("alt x\nopt y\nloop z\nopt w\nend\nend\nend\nend", [(5, "nested too deep")]),
        ("end\nelse x\nbreak y", [(2, "end without a block"), (3, "else outside alt"), (4, "break outside a block")]),
        ("opt x\nelse y", [(3, "else outside alt"), (None, "block not closed")]),
        ("par x\n\nalt Condition\nhello\na->>b:", [(2, "par is not supported"), (3, "blank line"), (4, "generic label"), (5, "unknown syntax"), (6, "unknown syntax")]),
        ("participant a as A;B", [(2, "unknown syntax")]),
    ],
)
def test_diagram_errors(spark, body, expected):
    assert [tuple(e) for e in one(spark, render.diagram_errors, "sequenceDiagram\n" + body)] == expected


def test_diagrams_without_a_header_or_text(spark):
    assert [tuple(e) for e in one(spark, render.diagram_errors, "flowchart\na->>b: x")] == [(1, "no sequenceDiagram")]
    assert [tuple(e) for e in one(spark, render.diagram_errors, " \n ")] == [(None, "empty diagram")]
    assert [tuple(e) for e in one(spark, render.diagram_errors, None)] == [(None, "empty diagram")]


def test_an_expansion_looks_up_no_last_level_behind_its_budget(spark):
    """40 methods that call 60 others each: of 144,000 calls of calls only those of what the budget leaves open are made."""
    n = 60
    edges = spark.createDataFrame([(a, 1 + (a + k) % 40, a, k) for a in range(1, 41) for k in range(n)], CALLS)
    roots, methods = spark.createDataFrame([(a,) for a in range(1, 41)], "root long"), spark.createDataFrame([(a, True) for a in range(1, 41)], "method_id long, has_body boolean")
    sc = spark.sparkContext

    def shuffled():
        args = (None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        stages = sc._jsc.sc().statusStore().stageList(*args)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    found = calls.expand(roots, edges, methods).groupBy("root").agg(F.count_if("step").alias("steps")).collect()
    assert {r["steps"] for r in found} == {64}
    assert shuffled() - before < 50_000


def test_closures_within_bounds_need_no_rounds(spark):
    """One pass gives what the rounds of closure() give, cycles, starts without edges and edges without starts among them."""
    rng = random.Random(7)
    edges = spark.createDataFrame([(f"m{rng.randrange(9)}", rng.randrange(8), rng.randrange(8)) for _ in range(90)], "method string, source long, target long")
    starts = spark.createDataFrame([(f"m{rng.randrange(1, 11)}", rng.randrange(3), rng.randrange(8)) for _ in range(30)], "method string, start long, node long")
    key = ["method", "start", "node"]
    found = got(calls.closure_within(starts, edges, ["method"]), *key)
    assert found == got(calls.closure(starts, edges, ["method"]), *key) and len(found) > 60
    assert got(calls.closure_within(starts, edges.limit(0), ["method"]), *key) == got(starts.distinct(), *key)
    assert got(calls.closure_within(starts.limit(0), edges, ["method"]), *key) == []


def test_unions_of_evidence_tell_their_ids(spark):
    rows = spark.createDataFrame([("a", 10, 2), ("a", 9, 1), ("a", 9, 3), ("b", 1, 3), (None, 4, 0)], "owner string, evidence_id long, certainty int")
    found = {r["owner"]: (r["evidence"], r["n_evidence"], r["certainty"]) for r in facts.evidence_union(rows).collect()}
    assert found == {"a": ("10,9", 2, "Conservative"), "b": ("1", 1, "Unknown"), None: ("4", 1, "Exact")}


def test_equal_sets_tell_their_members(spark):
    rows = spark.createDataFrame([("b", "y"), ("b", "x"), ("b", "x"), ("d", "x"), ("d", "y"), ("a", "x"), ("e", "y"), ("e", "x")], "g string, m string")
    assert got(joins.equal_sets(rows, "g", "m"), "first", "other", "members") == [("b", "d", "x,y"), ("b", "e", "x,y")]


def test_blocks_that_share_an_id_are_one_node_of_a_circle(spark):
    """Block 101 of method 1 is block 1 of method 2, through which the only circle goes; method 5 is apart, with an edge to itself."""
    rows = [(1, 50, 120, 101, None), (1, 70, 120, 50, None), (1, 103, 120, 70, None), (2, 1, 9, None, 3), (2, 4, 9, None, 5), (5, 2, 9, 2, None), (5, 3, 9, None, 4)]
    blocks = spark.createDataFrame(rows, "method long, ord long, n long, cond_succ long, fall long")
    assert got(flow.on_numbered_cycles(blocks, 100), "node") == [(150,), (170,), (201,), (203,), (502,)]


def test_candidates_of_a_class_equal_those_of_its_pairs(spark):
    """None, one (the target or another) and several candidates; a class without sites, a null class and a method without a body."""
    methods = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True), (5, False), (6, True), (7, True)], "method_id long, has_body boolean")
    classes = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 3), ("b", 4), ("b", 5), (None, 6), ("c", 7)], "k string, candidate long")
    sites = spark.createDataFrame([(10, 1, "a"), (11, 4, "b"), (12, 5, "b"), (13, 6, None), (14, 8, "z")], "site long, target long, k string")
    pairs = sites.join(classes, "k").select("target", "candidate")
    cols = ["site", "target", "candidate", "resolution"]
    found = calls.class_candidates(sites, classes, methods, ["k"])
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, found.select(cols).collect())) == sorted(map(repr, calls.candidates(sites.select("site", "target"), pairs, methods).select(cols).collect()))
