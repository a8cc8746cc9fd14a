"""Stops of an expansion, checks of bodies and expansions, frameworks and paths on hand-built cases."""

from pyspark.sql import functions as F

from factweave.functions import text
from factweave.operators import calls, catalog, validation


def test_stops_of_an_expansion(spark):
    step = spark.createDataFrame([(0, k, 0, k) for k in (1, 2, 3, 4, 5, 6)] + [(6, 7, 0, 0), (6, 6, 0, 1), (6, 8, 0, 2), (8, 9, 0, 0)], "caller int, callee int, owner int, op_ord int")
    body = {1: (False, False, 0), 2: (True, False, 0), 3: (True, True, 0), 4: (True, True, 2)}
    methods = spark.createDataFrame([(k, *body.get(k, (True, True, 1))) for k in (0, 1, 2, 3, 4, 6, 7, 8)], "method_id int, has_body boolean, loaded boolean, flows int")
    roots = spark.createDataFrame([(0,)], "root int")
    stops = {r["path"]: r["stop"] for r in calls.expand(roots, step, methods).collect()}
    # Method 7 calls nothing, so the last level cuts nothing off it; method 8 calls on.
    assert stops == {"": None, "1": "BodyUnavailable", "2": "SourceUnavailable", "3": "NoFlow", "4": "AmbiguousFlow", "5": "BodyUnavailable", "6": None, "6.1": None, "6.2": "Cycle", "6.3": "Depth"}
    plain = {r["path"]: r["stop"] for r in calls.expand(roots, step, methods.drop("loaded", "flows")).collect()}
    assert plain["2"] is None and plain["4"] is None and plain["6.3"] == "Depth"


def test_a_sound_body_has_no_errors(spark):
    tables = [
        spark.createDataFrame([("a", 0, "x"), ("b", 1, "y")], "method string, place int, fingerprint string"),
        spark.createDataFrame([("a", 0, "o", 0), ("a", 1, "p", 1)], "method string, place int, op string, evaluation int"),
        spark.createDataFrame([("a", 0, 0, "o", 1, None), ("a", 1, 1, None, None, 0)], "method string, place int, ord int, condition string, fall int, cond_succ int"),
        spark.createDataFrame([("a", 0, "o"), ("a", 1, "p")], "method string, ord int, op string"),
        spark.createDataFrame([("a", 0, "r", 0, None, "Root", 0, 9), ("a", 1, "t", 1, "r", "Try", 0, 1)], "method string, place int, region string, ord int, parent string, kind string, start_block int, end_block int"),
    ]
    assert validation.extraction_errors(*tables).count() == 0
    assert validation.extraction_errors(*[t.limit(0) for t in tables]).count() == 0


def test_expansion_errors(spark):
    steps = [("e", "a", None, 0, 1, False, True), ("e", "b", "a", 1, 2, True, True), ("e", "c", "a", 2, 3, True, False), ("e", "d", "e", 3, 2, False, True), ("e", "e", "a", 4, 1, False, True), ("e", "f", "x", 5, 2, False, None)]
    frame = spark.createDataFrame(steps, "expansion string, step string, parent string, place int, depth int, cycle boolean, complete boolean")
    found = sorted((r["step"], r["error"]) for r in validation.expansion_errors(frame).collect())
    assert found == [("b", "OpenCycle"), ("c", "Parent"), ("d", "Parent"), ("e", "Parent"), ("f", "Parent")]


def test_frameworks_and_paths(spark):
    rows = spark.createDataFrame([(".NETCoreApp,Version=v8.0", None, None, "net8.0-Android"), (".NETCoreApp,Version=v8.0", "Windows", "10.0", None), (".NETFramework,Version=v4.7.2", None, None, "net8.0"), ("Other", None, None, "own"), (None, None, None, None)], "m string, p string, v string, o string")
    got = [r[0] for r in rows.select(text.canonical_framework(*map(F.col, "mpvo"))).collect()]
    assert got == ["net8.0-android", "net8.0-windows10.0", "net472", "own", None]
    paths = spark.createDataFrame([(p,) for p in ("a\\b", "a/..b", "", " ", "/a", "\\a", "x://y", "a/.", "..", "./a", None)], "p string")
    assert [r[0] for r in paths.select(text.output_path(F.col("p"))).collect()] == ["a/b", "a/..b"] + [None] * 9


def test_participant_keys_stay_apart(spark):
    types = spark.createDataFrame([("g", "A.B"), ("g", "A+B"), ("g", "A_B_412e42"), ("g", "service"), ("h", "A.B"), ("h", " "), ("h", None)], "graph string, type_name string")
    keys = {(r["graph"], r["type_name"]): r["key"] for r in catalog.participant_keys(types).collect()}
    assert keys[("h", "A.B")] == "A_B" and keys[("g", "service")] == "service_73657276696365"
    assert keys[("g", "A+B")] == "A_B_412b42" and keys[("g", "A.B")] == "A_B_412e42_412e42" and keys[("g", "A_B_412e42")].startswith("A_B_412e42_")
    assert len(keys) == 5
