"""Pairs that grow with the square of their tables: they are made where the larger side is, the other in bounded groups."""

import pyarrow.parquet as pq
import pytest

from factweave.operators import generics, joins


@pytest.mark.parametrize("bound, group", [(2_000_000, 10_000), (2_000_000, 2), (0, 10_000)])
def test_handlers_in_groups(spark, monkeypatch, bound, group):
    """A frequent request's handlers go to the sends in groups, or beyond the bound by a plain join; the pairs are the same."""
    monkeypatch.setattr(generics, "BROADCAST_HANDLERS", bound)
    monkeypatch.setattr(generics, "GROUP", group)
    definitions = spark.createDataFrame([(f"H{k}", [], "I<Q,R>" if k % 3 else "I<P,R>") for k in range(20)], "name string, parameters array<string>, above string")
    types = spark.createDataFrame([(f"H{k}", False) for k in range(20)], "type string, generic boolean")
    handlers = spark.createDataFrame([(f"H{k}", k if k != 7 else None, k % 2 == 0) for k in range(20)], "type string, method long, has_body boolean")
    sends = spark.createDataFrame([(1, "Q", "R"), (2, " Q", "R "), (3, "P", "R"), (4, "P", "S"), (5, None, "R")], "operation long, request string, response string")
    found = generics.source_handlers(sends, types, definitions, handlers, "I")
    expected = [(o, k if k != 7 else None, k % 2 == 0) for o, q in ((1, True), (2, True), (3, False)) for k in range(20) if bool(k % 3) == q]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert ("Generate inline" in found._jdf.queryExecution().executedPlan().toString()) == (bound > 0)


def test_pairs_take_little_room(spark, tmp_path):
    """Written to files, the pairs of two tables are long runs of a handler and take a fraction of a byte each; sends of one operation or of none stay apart, each with all handlers."""
    n = 1500
    numbers = spark.range(n).selectExpr("id", "abs(xxhash64(id)) method", "'H' || id type", "if(id % 3 = 0, 'I<P,R>', 'I<Q,R>') above")
    definitions = numbers.selectExpr("type name", "cast(array() as array<string>) parameters", "above")
    operations = spark.range(n).selectExpr("case when id < 200 then 7 when id >= 300 then abs(xxhash64(id, 1)) end operation", "case id % 4 when 0 then 'P ' when 1 then 'S' else 'Q' end request", "'R' response")
    found = generics.source_handlers(operations, numbers.selectExpr("type", "false generic"), definitions, numbers.selectExpr("type", "method", "id % 2 = 0 has_body"), "I")
    found.write.parquet(f"{tmp_path}/pairs")
    pairs = n // 4 * (n // 3) + n // 2 * (n - n // 3)
    size, runs = 0, 0
    for file in tmp_path.glob("pairs/*.parquet"):
        method = pq.read_table(file, columns=["method"])["method"].to_numpy()
        size, runs = size + file.stat().st_size, runs + 1 + (method[1:] != method[:-1]).sum()
    assert size < pairs / 2 and runs < pairs / 20, (size / pairs, runs / pairs)
    rows = spark.read.parquet(f"{tmp_path}/pairs")
    assert rows.count() == pairs and rows.dtypes == [("operation", "bigint"), ("method", "bigint"), ("has_body", "boolean")]
    handlers = numbers.selectExpr("trim(substr(above, 3, 1)) request", "method", "id % 2 = 0 has_body")
    expected = operations.selectExpr("operation", "trim(request) request").join(handlers, "request").select("operation", "method", "has_body")
    assert rows.exceptAll(expected).isEmpty() and expected.exceptAll(rows).isEmpty()


def test_agreement_holds_bounded_rows_in_a_task(spark, monkeypatch):
    """Equal and unequal sets, repeats, nulls among values, anchors and owners; tasks are as many as the rows ask for, not as the session says."""
    monkeypatch.setattr(joins, "ROWS_A_TASK", 3, raising=False)
    sets = {"same": [{"x", "y"}, {"y", "x"}], "less": [{"x", "y"}, {"x"}], "other": [{"x"}, {"y"}], "one": [{"x", "y"}], "null": [{"x", None}, {"x", None}], "no null": [{"x", None}, {"x"}], None: [{"x"}, {"x"}]}
    rows = [(o, k or None, v, 1) for o, held in sets.items() for k, values in enumerate(held) for v in values] * 2
    found = joins.agreement(spark.createDataFrame(rows, "owner string, anchor long, kind string, status long"), "owner", "anchor", ["kind", "status"])
    assert {r[0]: r[1] for r in found.collect()} == {o: o in ("same", "one", "null", None) for o in sets} and found.count() == len(sets)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [owner" in plan and f", {len(rows) // 3 + 1}" in plan
