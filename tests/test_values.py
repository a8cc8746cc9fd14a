"""Value edges of a method are told within it."""

from factweave.operators import values

OPS = "method long, op long, block long, evaluation long, kind string, parameter long, local_name string, member string"


def test_value_edges_need_no_join(spark):
    """Sides of assignments, uses before and after a definition, operands without a row, null keys; methods keep to themselves."""
    rows = [(0, "Literal", None), (1, "LocalReference", "a"), (2, "LocalReference", "a"), (3, "Assignment", None), (4, "LocalReference", "a"), (5, "Conversion", None), (6, "Invocation", None), (7, "Return", None), (8, "Assignment", None), (9, "Binary", None)]
    ops = spark.createDataFrame([(m, op, 0, op, kind, None, name, None) for m in (1, 2, None) for op, kind, name in rows if (m, op) != (2, 0)], OPS)
    given = [(3, 0, 2), (3, 1, 0), (5, 0, 4), (6, 0, 5), (6, 1, 99), (6, 2, None), (7, 0, 6), (8, 0, 2), (9, 0, 6), (9, 0, 6), (9, 1, 7), (77, 0, 0)]
    operands = spark.createDataFrame([(m, *g) for m in (1, 2, None) for g in given], "method long, op long, place long, operand long")
    found = values.value_edges(ops, operands)
    shared = [(4, 5, "Conversion"), (5, 6, "Argument"), (6, 9, "Operand"), (6, 9, "Operand")]
    expected = [(1, 0, 3, "Assignment"), (1, 3, 4, "CaptureCollapse"), *[(m, *e) for m in (1, 2) for e in shared]]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
