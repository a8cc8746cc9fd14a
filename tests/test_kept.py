"""Views that a query reads many times are made once, and read again from files of their own."""

import pytest

from factweave.operators import calls
from factweave.plans import bind, registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["scenario_nodes", "scenario_edges", "extraction_errors"])
def test_the_table_is_dealt_and_sorted_once(spark, name):
    found = registry.QUERIES[name](spark, DATA).inputFiles()
    assert any("kept-" in f for f in found) and not any("lineitem" in f for f in found)


def test_kept_views_are_the_views(spark):
    ready = bind.keep(spark, DATA, "v_inv", "v_call")
    for name in ("v_inv", "v_call", "v_operand"):
        plain, again = bind.view(spark, DATA, name), bind.view(spark, DATA, name, ready)
        assert plain.dtypes == again.dtypes and plain.exceptAll(again).isEmpty() and again.exceptAll(plain).isEmpty()
    empty = calls.kept(spark.createDataFrame([], "a long, b string"))
    assert empty.dtypes == [("a", "bigint"), ("b", "string")] and empty.count() == 0


def test_calls_are_kept_with_invocations(spark):
    """Each row is dealt once for both views, in the columns that the table has."""
    sc = spark.sparkContext

    def shuffled():
        args = (None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        stages = sc._jsc.sc().statusStore().stageList(*args)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    ready = bind.keep(spark, DATA, "v_inv", "v_call")
    rows = ready["v_inv"].count()
    assert set(ready["v_inv"].inputFiles()) == set(ready["v_call"].inputFiles())
    assert shuffled() - before < 1.1 * rows


@pytest.mark.parametrize("few", [False, True])
def test_entries_of_one_root_have_a_tree_each(spark, few):
    """What a call carries comes with its place in the tree; levels above the last are made once."""
    roots = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "root long, entry string")
    edges = spark.createDataFrame([(1, 2, 0, 0, 70), (2, 3, 5, 1, 71), (3, 9, 1, 0, 72)] + [(1, 3, 1, k, 100 + k) for k in range(63)], "caller long, callee long, owner long, op_ord long, operation long")
    methods = spark.createDataFrame([(k, True) for k in (1, 2, 3)], "method_id long, has_body boolean")
    tree = calls.call_tree(roots, edges, methods, carried=("operation", "op_ord"), few=few)
    assert any("kept-" in f for f in tree.inputFiles()) == few
    rows = [tuple(r) for r in tree.select("entry", "root", "path", "stop", "step", "operation", "op_ord").collect()]
    of = lambda entry: sorted((r[1:] for r in rows if r[0] == entry), key=repr)
    assert of("a") == of("b") and of("c") == sorted([(3, "", None, False, None, None), (3, "1", "BodyUnavailable", True, 72, 0)], key=repr)
    # 64 steps: the call to 2, its own to 3, one call to 3 and its own to 9, and so on.
    assert sum(r[3] for r in of("a")) == 64 and (1, "1.1", "Depth", True, 71, 1) in of("a") and (1, "2.1", "BodyUnavailable", True, 72, 0) in of("a") and (1, "64", "NodeBudget", False, 162, 62) in of("a")
