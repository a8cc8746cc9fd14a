"""Framework models, predicates and behaviour-graph operators on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from factweave.operators import frameworks, predicates, scenario
from factweave.plans import registry
from tests.test_operators import got


def test_host(spark):
    def model(rows):
        return lambda d: d.sparkSession.createDataFrame(rows, "fact_id string, kind string, owner string, payload string, certainty int")

    a = frameworks.Model("a", 1, frozenset({"p"}), model([("1", "k", "o", "x", 0), ("2", "k", "o", "x", 0), ("3", "k", None, "x", 0)]))
    b = frameworks.Model("b", 2, frozenset(), model([("1", "k", "o", "x", 0), ("2", "k", "o", "y", 0)]))
    kept, codes = frameworks.run_models([b, a], {"p", "q"}, spark.range(1))
    assert got(kept, "fact_id") == [("1",)] and got(codes) == [("2", "SEQFW003"), ("3", "SEQFW001")]
    kept, codes = frameworks.run_models([b, a], set(), spark.range(1))
    assert got(kept, "fact_id") == [("1",), ("2",)] and got(codes) == []


def test_dispatch_none_one_many(spark):
    sends = spark.createDataFrame([(1, "A", "R"), (2, "B", "R"), (3, "C", "R"), (4, "A", "S")], "operation long, request string, response string")
    handlers = spark.createDataFrame([(10, "A", "R"), (11, "B", "R"), (12, "B", "R"), (10, "A", "R")], "handler long, request string, response string")
    assert got(frameworks.dispatches(sends, handlers)) == [(1, "ExactSingle", 10), (2, "Ambiguous", None), (3, "Unresolved", None), (4, "Unresolved", None)]


NODES = "tree string, node long, parent long, place long, kind string, operator string, type string, constant string"
BOOL = "System.Boolean"


def test_predicates(spark):
    rows = [("t", 0, None, 0, "binary", "&&", None, None), ("t", 1, 0, 0, "binary", "||", None, None), ("t", 2, 0, 1, "unary", "!", None, None), ("t", 3, 1, 0, "parameter", None, BOOL, "p"), ("t", 4, 1, 1, "local", None, BOOL, "q"), ("t", 5, 2, 0, "member", None, BOOL, "r")]
    deep = [("deep", k, k - 1 if k else None, 0, "unary" if k < 69 else "constant", "!", BOOL, "true") for k in range(70)]
    bad = [("bad", 0, None, 0, "call", None, BOOL, "c")]
    bad += [("loop", 1, 2, 0, "unary", "!", None, None), ("loop", 2, 1, 0, "unary", "!", None, None), ("lone", 1, None, 0, "unary", "!", None, None)]
    nodes = spark.createDataFrame(rows[::-1] + deep + bad, NODES)
    assert got(predicates.readable(nodes)) == [("bad", None, "PRED001"), ("deep", None, "PRED003"), ("lone", None, "PRED001"), ("loop", None, "PRED003"), ("t", "(p || q) && !r", None)]
    (text,) = [t for tree, t, _ in got(predicates.canonical(nodes)) if tree == "t"]
    sym = lambda x: f"sym(14:System.Boolean,1:{x})"
    assert text == f"and(14:System.Boolean,or(14:System.Boolean,{sym('p')},{sym('q')}),neg(14:System.Boolean,{sym('r')}))"


INT, TEXT, TIME = "System.Int32", "System.String", "System.DateTime"


@pytest.mark.parametrize(
    "operator, left, right, expected",
    [
        (None, ("local", BOOL, "ok"), None, "truth(14:System.Boolean,sym(14:System.Boolean,2:ok))"),
        (None, ("constant", BOOL, "True"), None, "bool(14:System.Boolean,4:true)"),
        (None, ("constant", "System.Char", "x"), None, "chr(11:System.Char,1:x)"),
        ("<", ("local", INT, "n"), ("constant", INT, "12"), "cmp(14:System.Boolean,8:LessThan,sym(12:System.Int32,1:n),num(12:System.Int32,2:12))"),
        ("==", ("local", TEXT, "s"), ("constant", TEXT, ""), "cmp(14:System.Boolean,5:Equal,sym(13:System.String,1:s),str(13:System.String,0:))"),
        ("!=", ("local", "A.B", "b"), ("constant", "A.B", None), "cmp(14:System.Boolean,8:NotEqual,sym(3:A.B,1:b),null(3:A.B))"),
        ("==", ("local", "A.Kind", "k"), ("constant", "A.Kind", "Big"), "cmp(14:System.Boolean,5:Equal,sym(6:A.Kind,1:k),enum(6:A.Kind,3:Big))"),
        (">", ("opaque", TIME, "DateTime.UtcNow"), ("local", TIME, "t"), "cmp(14:System.Boolean,11:GreaterThan,opaque(15:System.DateTime,15:DateTime.UtcNow),sym(15:System.DateTime,1:t))"),
        ("%", ("local", INT, "n"), ("constant", INT, "2"), "arith(12:System.Int32,9:Remainder,sym(12:System.Int32,1:n),num(12:System.Int32,1:2))"),
        ("<", ("local", TEXT, "s"), ("local", TEXT, "t"), None),  # strings have no order
        ("==", ("local", INT, "n"), ("local", "System.Int64", "m"), None),  # types differ
        ("&&", ("local", BOOL, "p"), ("local", INT, "n"), None),
        ("<=", ("local", "A.B", "b"), ("constant", "A.B", None), None),  # null compares for equality only
        ("+", ("local", TEXT, "s"), ("local", TEXT, "t"), None),
        ("??", ("local", BOOL, "p"), ("local", BOOL, "q"), None),  # no such operator
        ("==", ("constant", "System.Double", "NaN"), ("local", "System.Double", "x"), None),
        ("==", ("local", INT, None), ("local", INT, "n"), None),  # a symbol without a name
    ],
)
def test_admission_of_predicates(spark, operator, left, right, expected):
    leaves = [x for x in (left, right) if x]
    rows = [("t", 0, None, 0, "binary", operator, None, None)] if operator else []
    rows += [("t", k + len(rows[:1]), 0 if operator else None, k, kind, None, type_, value) for k, (kind, type_, value) in enumerate(leaves)]
    nodes = spark.createDataFrame(rows, NODES)
    assert got(predicates.canonical(nodes)) == [("t", expected, None if expected else "PRED001")]


def test_either_key_once(spark):
    left = spark.createDataFrame([(1, 5, 5), (2, 5, 6), (3, None, 6)], "id long, x long, y long")
    right = spark.createDataFrame([(5,), (6,)], "k long")
    assert got(scenario.either_key(left, right, "x", "y", "k"), "id", "k") == [(1, 5), (2, 5), (2, 6), (3, 6)]


def test_caught(spark):
    throws = spark.createDataFrame([("m", 1, "Child"), ("m", 5, "Child"), ("m", 9, "Other")], "method string, ord long, type string")
    catches = spark.createDataFrame([("m", 0, 2, "Base"), ("m", 4, 6, "Other"), ("m", 8, 9, None)], "method string, start_block long, end_block long, caught_type string")
    above = spark.createDataFrame([("Child", "Base")], "type string, above string")
    assert got(scenario.caught(throws, catches, above), "ord", "caught") == [(1, True), (5, False), (9, True)]


def test_profiles_and_focus(spark):
    rows = spark.createDataFrame([(1, "Net8", {"a": "1", "t": "x"}), (2, "net8", {"a": "2"})], "id long, framework string, properties map<string,string>")
    assert got(scenario.profile_matches(rows, {"framework": "NET8"}, {"a": "1"}, ("t",)), "id") == [(1,)]
    entries = spark.createDataFrame([(1, "op", "e"), (2, "op2", "e"), (3, "x", "op2")], "id long, operation_key string, entry_key string")
    for wanted, expected in (("op", (1, None)), ("e", (None, "SD4005")), ("op2", (2, None)), ("no", (None, "SD4004"))):
        assert got(scenario.focused(entries, wanted)) == [expected]


def test_cardinality(spark):
    uses = [("a", "escape", False, False, False, True), ("b", "invoke", False, False, False, True), ("c", "invoke", False, False, True, False), ("d", "invoke", True, False, False, True), ("e", "invoke", False, True, False, True), ("f", "read", False, False, False, False), ("g", "invoke", False, False, False, False)]
    rows = spark.createDataFrame(uses, "callback string, kind string, in_loop boolean, in_region boolean, conditional boolean, on_every_path boolean")
    assert [c for _, c in got(frameworks.callback_cardinality(rows))] == ["Unbounded", "ExactlyOnce", "ZeroOrOne", "RepeatedOrUnknown", "Unknown", "Unbounded", "Unknown"]
    assert rows.where(F.col("kind") == "read").count() == 1


def test_trees_are_dealt_once_and_ids_stay_whole(spark):
    """Ids beyond 2**53 beside the root's null; trees in any order of rows; a null tree is one too."""
    big = 2**60
    rows = [(t, big + k, p if p is None else big + p, k, *r) for t in (big, big + 1, None) for k, p, *r in [(0, None, "binary", "&&", None, None), (1, 0, "unary", "!", None, None), (2, 0, "local", None, "System.Boolean", "b"), (3, 1, "local", None, "System.Boolean", "a")]]
    nodes = spark.createDataFrame(rows[::-1], "tree long, node long, parent long, place long, kind string, operator string, type string, constant string")
    assert got(predicates.readable(nodes)) == sorted([(t, "!a && b", None) for t in (big, big + 1, None)], key=repr)
    assert predicates.readable(nodes.repartition("tree"))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_parents_answer_without_a_join(spark):
    for name in ("predicate_text", "predicate_canonical"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Repartition") == 1
