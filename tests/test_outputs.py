"""Models with several outputs, and closed generic types, on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from factweave.operators import generics, hints
from tests.test_operators import got, one

MINE = [("e", "m:1", True)]


def said(spark, rows):
    """Outputs from (tag, id, fields, evidence)."""
    names = sorted({f for fields in hints.FIELDS.values() for f in fields})
    kinds = {f: k for fields in hints.FIELDS.values() for f, k in fields.items()}
    frame = spark.createDataFrame([(t, i, e, *[fields.get(n) for n in names]) for t, i, fields, e in rows], "tag string, id string, evidence array<struct<id: string, producer: string, direct: boolean>>, " + ", ".join(f"{n} {kinds[n]}" for n in names))
    return frame.select("tag", "id", hints.payload(**{n: F.col(n) for n in names}).alias("payload"), "evidence")


def test_outputs_are_split_and_checked(spark):
    call = {"operation": "op", "target_method": "m", "target_type": None, "reason": "why", "ordinal": 0, "certainty": 1}
    hide = {"scope": "s", "reason": "why", "ordinal": 2, "certainty": 0}
    fact = {"owner": "o", "kind": "k", "value": "v", "certainty": 0}
    rows = [
        ("resolution", "r1", call, MINE), ("resolution", "r2", call, None), ("resolution", "r3", call | {"ordinal": -1}, []), ("resolution", "r4", call | {"target_method": None}, MINE), ("resolution", "r5", call | {"target_method": " "}, MINE), ("resolution", "r6", call | {"target_method": None, "target_type": "t"}, MINE),
        ("resolution", "r7", call | {"operation": ""}, [("e", "other:1", True)]), ("resolution", "r8", call, [*MINE, ("f", "other:1", True)]), ("resolution", "r9", call, [("e", "m:1", False)]), ("resolution", "r10", call | {"reason": None}, MINE),
        ("suppression", "s1", hide, MINE), ("suppression", "s2", hide | {"scope": " "}, MINE), ("summary", "y1", hide, MINE), ("summary", "y2", hide | {"ordinal": None}, MINE), ("diagnostic", "d1", {"code": "X", "detail": "y"}, None),
        ("fact", "f1", fact, MINE), ("fact", "f1", fact, MINE), ("fact", "f2", fact, MINE), ("fact", "f2", fact | {"value": None}, MINE), ("fact", " ", fact, MINE), ("fact", "f4", fact, None), ("fact", "f5", fact, [("e", None, True)]),
    ]
    models = [hints.OutputModel("m", "1", 2, frozenset({"p"}), operations=lambda d: said(spark, rows)), hints.OutputModel("m", "1", 3, frozenset(), symbols=lambda d: said(spark, [("fact", "f6", fact, MINE)])), hints.OutputModel("n", "1", 1, frozenset({"absent"}), operations=lambda d: said(spark, rows))]
    out = hints.run_outputs(models, {"p", "q"}, spark.range(1), spark.range(1))
    assert got(out["resolution"], "id", "target_type") == [("r1", None), ("r6", "t")] and got(out["suppression"], "id", "scope", "ordinal") == [("s1", "s", 2)] and got(out["summary"], "id") == [("y1",)]
    assert got(out["diagnostic"], "id", "code", "detail") == [("d1", "X", "y")] and got(out["fact"], "id", "value", "producer") == [("f1", "v", "m:1"), ("f6", "v", "m:1")]
    assert got(out["codes"], "id", "code") == sorted([("r2", "SEQFW002"), ("r3", "SEQFW002"), *[(r, "SEQFW004") for r in ("r4", "r5", "r7", "r10", "s2", "y2")], ("r8", "SEQFW005"), ("r9", "SEQFW005"), ("f2", "SEQFW003"), (" ", "SEQFW001"), ("f4", "SEQFW001"), ("f5", "SEQFW005")], key=repr)
    nothing = hints.run_outputs(models[:1], set(), spark.range(1), spark.range(1))
    assert all(rows.count() == 0 for rows in nothing.values())


@pytest.mark.parametrize("display, expected", [("A", ["A"]), ("A<B>", ["A", "B"]), ("A<B<C,D>,E<F<G>>>", ["A", "B<C,D>", "E<F<G>>"]), ("", [""])])
def test_parts_of_a_type(spark, display, expected):
    assert one(spark, generics.parts, display) == expected


def test_handlers_behind_generic_bases(spark):
    """Arguments are put in at once (swapped ones too), definitions fit by the number of their parameters, and circles end."""
    rules = [("H1", [], "I<Q, R>"), ("H2", [], "Swap<R,Q>"), ("Swap", ["A", "B"], "Mid<B,A>"), ("Mid", ["A", "B"], "I<A,B>"), ("H3", [], "Wrap<Q>"), ("Wrap", ["T"], "I<List<T>,Pair<T,Wrap<T>>>"), ("H4", [], "Mid<Q>"), ("H5", [], "Ring"), ("Ring", [], "Ring2"), ("Ring2", [], "Ring"), ("Gen", ["T"], "I<Q,R>")]
    definitions = spark.createDataFrame(rules, "name string, parameters array<string>, above string")
    types = spark.createDataFrame([(f"H{k}", False) for k in range(1, 6)] + [("Gen", True)], "type string, generic boolean")
    handlers = spark.createDataFrame([(f"H{k}", k, k != 2) for k in range(1, 6)] + [("Gen", 9, True)], "type string, method long, has_body boolean")
    sends = spark.createDataFrame([(1, "Q", "R"), (2, "R", "Q"), (3, "List< Q >", "Pair<Q, Wrap<Q>>"), (4, "Q", None)], "operation long, request string, response string")
    assert got(generics.source_handlers(sends, types, definitions, handlers, "I")) == [(1, 1, True), (1, 2, False), (3, 3, True)]
    endless = spark.createDataFrame([("E", [], "W<E>"), ("W", ["T"], "W<W<T>>")], "name string, parameters array<string>, above string")
    with pytest.raises(RuntimeError):
        generics.implemented(spark.createDataFrame([("E",)], "type string"), endless, max_rounds=4)


def test_outputs_are_read_once(spark):
    """The codes of all tags come from one reading of the outputs, besides that for facts which disagree."""
    tag = F.element_at(F.array(*[F.lit(t) for t in hints.FIELDS]), (F.col("id") + 1).cast("int"))
    fields = {f: F.lit("1").cast(k) for of in hints.FIELDS.values() for f, k in of.items()}
    evidence = F.lit(None).cast("array<struct<id: string, producer: string, direct: boolean>>")
    model = hints.OutputModel("m", "1", 1, frozenset(), operations=lambda d: d.select(tag.alias("tag"), F.col("id").cast("string").alias("id"), hints.payload(**fields).alias("payload"), evidence.alias("evidence")))
    codes = hints.run_outputs([model], set(), spark.range(5), spark.range(1))["codes"]
    assert codes._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 5") == 2
    assert got(codes, "id", "code") == [("0", "SEQFW001"), ("1", "SEQFW002"), ("2", "SEQFW002"), ("3", "SEQFW002")]
