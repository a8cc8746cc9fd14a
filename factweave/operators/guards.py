"""Ordered guards of a handler, reduced by what the guards before them leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reduce_guards(guards: DataFrame) -> DataFrame:
    """(method, ordinal, symbol, operator, constant, reduced) of guards(method, ordinal, symbol, operator, constant, low, high, terminates).

    A guard compares its symbol with a constant, or (operator null) asks for low < symbol <= high. The latter says no more than symbol
    <= high where the guard before it, of the ordinal before, ends the handler if symbol <= low: then the handler only goes on above low. That
    guard may be a comparison or a reduced one itself, so what is known is carried along a run of guards. A guard of two bounds
    that cannot be reduced has neither operator nor constant.
    """
    order = Window.partitionBy("method").orderBy("ordinal")
    before = lambda c: F.lag(c).over(order)
    pair = F.col("operator").isNull()
    bound = F.when(F.col("operator") == "<=", F.col("constant")).when(pair, F.col("high"))
    rows = guards.withColumns({"pair": pair, "bound": bound})
    follows = F.coalesce((before("ordinal") == F.col("ordinal") - 1) & before("terminates") & (before("symbol") == F.col("symbol")) & (before("bound") == F.col("low")), F.lit(False)) & F.col("high").isNotNull()
    # A run begins with a comparison; a guard of it is reduced if it and all between follow on each other.
    run = F.count(F.when(~F.col("pair"), 1)).over(order)
    rows = rows.withColumns({"follows": ~F.col("pair") | follows, "run": run})
    in_run = Window.partitionBy("method", "run").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("reduced", F.col("pair") & F.bool_and("follows").over(in_run) & (F.col("run") > 0))
    operator = F.when(F.col("reduced"), "<=").otherwise(F.col("operator"))
    return rows.select("method", "ordinal", "symbol", operator.alias("operator"), F.when(F.col("reduced"), F.col("high")).when(~F.col("pair"), F.col("constant")).alias("constant"), "reduced")
