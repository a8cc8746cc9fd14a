"""Queries on all rows, against hand-built cases that lie beyond the first rows of a group."""

import pytest

from factweave.plans import registry


def test_long_method(spark, tmp_path):
    """A user of 120 events: a jump back from block 110, nothing of which is among the first twelve blocks."""
    kinds = {110: "view"}
    events = [(220 if k == 110 else 1000 + k, 7, kinds.get(k, "click"), k) for k in range(120)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, t long").selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(t) ts").write.parquet(f"{tmp_path}/events.parquet")
    found = {tuple(r) for r in registry.QUERIES["cfg_back_edges"](spark, str(tmp_path)).collect()}
    assert found == {(7, 110, 100)}
    assert {r.node for r in registry.QUERIES["evidence_cycles"](spark, str(tmp_path)).collect()} == {7000 + k for k in range(100, 111)}


def test_coverage_of_a_late_plan(spark, tmp_path):
    """Plan 900: line 1 is a message referenced once, line 2 a reference without a message."""
    spark.createDataFrame([(900, 1, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    lines = spark.createDataFrame([(900, 1), (900, 2)], "l_orderkey long, l_linenumber int").selectExpr("*", "1L l_partkey", "1L l_suppkey", "1.0 l_extendedprice", "1.0 l_quantity", "date'2020-01-01' l_shipdate", "'A' l_returnflag", "'F' l_linestatus")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in registry.QUERIES["plan_coverage"](spark, str(tmp_path)).collect()] == [(900, 2, 1)]


@pytest.mark.parametrize("n", [1, 7, 8, 17, 26, 40])
def test_large_trees(spark, tmp_path, n):
    """One tree of n nodes in the view's layout (node k has children 2k + 1 and 2k + 2), by a fold of its own."""
    names = {"==": "Equal", "<=": "LessThanOrEqual"}
    ops = ["&&", "||", "==", "<="]
    lines = spark.range(n).selectExpr("5L l_orderkey", "cast(id as int) l_linenumber", "id l_partkey", "100 + id l_suppkey", "1.0 l_extendedprice", "1.0 l_quantity", "date'2020-01-01' l_shipdate", "'A' l_returnflag", "'F' l_linestatus")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    framed = lambda t: f"{len(t)}:{t}"

    def fold(k):
        """(canonical, readable, rank, type) of a node; type None where it is not admitted."""
        kids = [fold(c) for c in (2 * k + 1, 2 * k + 2) if c < n]
        if not kids:
            p = (k - 1) // 2
            number = k > 0 and ops[p % 4] in names and 4 * p + 3 >= n and 2 * p + 2 < n
            kind = "System.String" if (100 + k) % 60 == 7 else "System.Int32" if number else "System.Boolean"
            value = f"local{100 + k}" if (100 + k) % 3 == 0 else str(100 + k) if number else str((100 + k) % 2 == 0)
            word = "sym" if (100 + k) % 3 == 0 else {"System.String": "str", "System.Int32": "num"}.get(kind, "bool")
            text = f"{word}({framed(kind)},{framed(value.lower() if word == 'bool' else value)})"
            return (f"truth(14:System.Boolean,{text})" if k == 0 and word == "sym" else text), value, 9, kind
        if len(kids) == 1:
            (c, r, rank, kind), = kids
            return f"neg(14:System.Boolean,{c})", "!" + (f"({r})" if rank < 7 else r), 7, kind if kind == "System.Boolean" else None
        op = ops[k % 4]
        (ca, a, ra, ta), (cb, b, rb, tb) = kids
        rank = {"||": 1, "&&": 2, "==": 3, "<=": 4}[op]
        sound = ta == tb == "System.Boolean" if op not in names else ta is not None and ta == tb and (ta != "System.String" or op == "==")
        word = f"cmp(14:System.Boolean,{framed(names[op])}" if op in names else f"{ {'&&': 'and', '||': 'or'}[op] }(14:System.Boolean"
        return f"{word},{ca},{cb})", f"{f'({a})' if ra < rank else a} {op} {f'({b})' if rb <= rank else b}", rank, "System.Boolean" if sound else None

    text, shown, _, kind = fold(0)
    got = lambda name: [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    assert got("predicate_canonical") == [(5, text if kind else None, None if kind else "PRED001")]
    assert got("predicate_text") == [(5, shown if kind else None, None if kind else "PRED001")]
