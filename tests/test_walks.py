"""Walks of methods: how often rows are dealt, and one walk against several joined ones."""

import random

from pyspark.sql import functions as F

from factweave.operators import arms, flow, joins
from tests.test_operators import got


def random_blocks(spark, methods=25, size=14):
    pick, rows = random.Random(5), []
    for m in range(methods):
        for o in range(size):
            terminal = pick.choice(["Conditional", "Conditional", "None", "Return", "Throw", "Rethrow", None])
            cond = pick.randrange(size + 1) if terminal == "Conditional" else None
            fall = None if terminal in ("Throw", "Rethrow") else size if terminal == "Return" else o + 1
            rows.append((m, o, size, terminal, cond, fall))
    return spark.createDataFrame(rows, "method long, ord long, n long, terminal string, cond_succ long, fall long")


def test_arms_of_blocks_in_one_walk(spark):
    blocks = random_blocks(spark).cache()
    regions = blocks.where("ord % 5 = 1").select("method", F.col("ord").alias("start_block"), (F.col("ord") + F.col("method") % 4).alias("end_block"), F.element_at(F.array(F.lit("Try"), F.lit("Catch"), F.lit("Lock"), F.lit("Try")), (F.col("method") % 4 + 1).cast("int")).alias("kind"))
    found = arms.block_terminals(blocks, regions)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    ends = F.col("terminal")
    kind = F.when(F.col("cond_succ").isNotNull() & F.col("fall").isNotNull(), "Decision").when(ends == "Return", "Return").when(ends.isin("Throw", "Rethrow"), "Throw").otherwise("Block")
    nodes = blocks.select("method", F.col("ord").alias("node"), kind.alias("kind")).unionAll(blocks.select("method", F.col("n"), F.lit("Exit")).distinct())
    body = flow.natural_loops(blocks).select("method", F.col("latch").alias("loop"), "header", F.when(F.col("node") != F.col("header"), F.col("node")).alias("node"), F.lit("Body").alias("role"))
    loops = body.unionAll(flow.loop_exits(blocks).select("method", "latch", "header", "node", F.lit("Exit")))
    held = joins.in_intervals(nodes.select("method", "node"), regions, ["method"], "node", "start_block", "end_block").select("method", "node", "kind")
    told = got(found)
    assert told == got(arms.arm_terminals(nodes, flow.edges(blocks), loops, held)) and len({r[4] for r in told}) > 4


def test_pairs_of_dominators_are_made_behind_the_walk(spark):
    """Nodes that nothing reaches have as many dominators as the method has nodes; the walk itself tells one row a node."""
    blocks = random_blocks(spark)
    for found in (flow.dominators(blocks), flow.post_dominators(blocks)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= plan.find("Generate explode") < plan.find("MapInPandas")
    lone = spark.createDataFrame([(1, 0, 2, "Return", None, 2), (1, 1, 2, "None", None, 2)], "method long, ord long, n long, terminal string, cond_succ long, fall long")
    assert got(flow.dominators(lone)) == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 1), (1, 2, 1), (1, 2, 2)]
