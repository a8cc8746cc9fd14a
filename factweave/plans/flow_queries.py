"""Control-flow queries and their DuckDB counterparts, which define dominance by reachability without a node."""

from pyspark.sql import functions as F

from ..operators import flow
from .bind import view, with_views

_NAMES = ["edge_ordinals", "dominators", "post_dominators", "back_edges", "natural_loops", "loop_exits", "control_dependences", "outcomes"]


def _query(fn):
    return lambda spark, sf_dir: fn(view(spark, sf_dir, "v_block"))


QUERIES = {"cfg_edges": _query(flow.edges)} | {f"cfg_{n}": _query(getattr(flow, n)) for n in _NAMES}



def _immediate(spark, d):
    return flow.dominator_tree(view(spark, d, "v_block")).where("enter is not null").select("method", "node", "parent")


def _once(spark, d):
    blocks = view(spark, d, "v_block")
    points = blocks.select("method", F.col("ord").alias("node"))
    return flow.on_every_way(points, flow.dominator_tree(blocks), blocks.select("method", F.col("n").alias("exit")))


QUERIES |= {"cfg_immediate_dominators": _immediate, "exactly_once": _once}

_W = with_views("v_edge", "v_node", recursive=True)
# free(m, d, y): y is reached from the entry without passing d.
_DOM = f"""{_W},
free AS (SELECT k.method, k.node AS d, CAST(0 AS BIGINT) AS y FROM v_node k WHERE k.node <> 0
  UNION SELECT r.method, r.d, e.target FROM free r JOIN v_edge e ON e.method = r.method AND e.source = r.y WHERE e.target <> r.d),
dom AS (SELECT a.method, a.node AS dominator, b.node FROM v_node a JOIN v_node b ON a.method = b.method
  WHERE a.node = b.node OR NOT EXISTS (SELECT 1 FROM free WHERE free.method = a.method AND free.d = a.node AND free.y = b.node)),
back AS (SELECT DISTINCT e.method, source, target FROM v_edge e JOIN dom ON dom.method = e.method AND dominator = target AND node = source WHERE target <= source)"""
_PDOM = f"""{_W},
ends AS (SELECT method, node FROM v_node n WHERE NOT EXISTS (SELECT 1 FROM v_edge e WHERE e.method = n.method AND e.source = n.node)),
free AS (SELECT k.method, k.node AS d, x.node AS y FROM v_node k JOIN ends x ON x.method = k.method AND x.node <> k.node
  UNION SELECT r.method, r.d, e.source FROM free r JOIN v_edge e ON e.method = r.method AND e.target = r.y WHERE e.source <> r.d),
pdom AS (SELECT a.method, a.node AS dominator, b.node FROM v_node a JOIN v_node b ON a.method = b.method
  WHERE a.node = b.node OR NOT EXISTS (SELECT 1 FROM free WHERE free.method = a.method AND free.d = a.node AND free.y = b.node))"""
_LOOP = f"""{_DOM},
body AS (SELECT method, source AS latch, target AS header, target AS node FROM back UNION SELECT method, source, target, source FROM back
  UNION SELECT b.method, b.latch, b.header, e.source FROM body b JOIN v_edge e ON e.method = b.method AND e.target = b.node WHERE b.node <> b.header)"""

_EDGES = f"""{_DOM} SELECT e.method, e.source, e.target, way, CASE WHEN terminal IN ('Return', 'Throw', 'Rethrow') THEN terminal WHEN back.method IS NOT NULL THEN 'LoopBack' WHEN way = 'Cond' THEN 'True' WHEN terminal = 'Conditional' THEN 'False' ELSE 'Normal' END AS kind
      FROM v_edge e JOIN v_block b ON b.method = e.method AND b.ord = e.source LEFT JOIN back ON back.method = e.method AND back.source = e.source AND back.target = e.target
      UNION ALL SELECT method, ord, n, 'Fall', terminal FROM v_block WHERE fall IS NULL AND terminal IN ('Throw', 'Rethrow')"""

ORACLES = {
    # Of the dominators of a node the immediate one has the most dominators itself.
    "cfg_immediate_dominators": f"""{_DOM}, live AS (SELECT DISTINCT method, y AS node FROM free UNION SELECT method, node FROM v_node n WHERE node = 0 OR EXISTS (SELECT 1 FROM v_edge e WHERE e.method = n.method AND e.source = 0 AND e.target = n.node)),
      n AS (SELECT method, node, count(*) AS above FROM dom GROUP BY method, node)
      SELECT l.method, l.node, (SELECT arg_max(d.dominator, n.above) FROM dom d JOIN n ON n.method = d.method AND n.node = d.dominator WHERE d.method = l.method AND d.node = l.node AND d.dominator <> l.node) AS parent FROM live l""",
    # By deletion: the exit is not reached without passing the block.
    "exactly_once": f"""{_DOM} SELECT b.method, b.ord AS node, b.ord = 0 OR NOT EXISTS (SELECT 1 FROM free WHERE free.method = b.method AND free.d = b.ord AND free.y = b.n) AS on_every_way FROM v_block b""",
    "cfg_edges": f"SELECT method, source, target, kind FROM ({_EDGES})",
    "cfg_edge_ordinals": f"SELECT method, source, target, kind, row_number() OVER (PARTITION BY method ORDER BY source, way, target) - 1 AS ordinal FROM ({_EDGES})",
    "cfg_dominators": f"{_DOM} SELECT method, dominator, node FROM dom",
    "cfg_post_dominators": f"{_PDOM} SELECT method, dominator, node FROM pdom",
    "cfg_back_edges": f"{_DOM} SELECT method, source, target FROM back",
    "cfg_natural_loops": f"{_LOOP} SELECT method, latch, header, node FROM body",
    "cfg_loop_exits": f"""{_LOOP} SELECT DISTINCT b.method, b.latch, b.header, e.target AS node FROM body b JOIN v_edge e ON e.method = b.method AND e.source = b.node
      WHERE NOT EXISTS (SELECT 1 FROM body x WHERE x.method = b.method AND x.latch = b.latch AND x.header = b.header AND x.node = e.target)""",
    "cfg_control_dependences": f"""{_PDOM} SELECT b.method, b.ord AS decision, n.node, EXISTS (SELECT 1 FROM pdom p WHERE p.method = b.method AND p.dominator = n.node AND p.node = b.cond_succ) AS polarity
      FROM v_block b JOIN v_node n ON n.method = b.method WHERE b.cond_succ IS NOT NULL AND b.fall IS NOT NULL
      AND EXISTS (SELECT 1 FROM pdom p WHERE p.method = b.method AND p.dominator = n.node AND p.node = b.cond_succ) <> EXISTS (SELECT 1 FROM pdom p WHERE p.method = b.method AND p.dominator = n.node AND p.node = b.fall)
      AND NOT EXISTS (SELECT 1 FROM pdom p WHERE p.method = b.method AND p.dominator = n.node AND p.node = b.ord)""",
    "cfg_outcomes": f"""{with_views('v_block')}, f AS (SELECT method, bool_or(coalesce(fall = n, false) AND (terminal NOT IN ('Throw', 'Rethrow') OR escaping)) AS done, bool_or(terminal = 'Return') AS ret FROM v_block GROUP BY method)
      SELECT method, ord, CASE terminal WHEN 'Return' THEN 'ExplicitReturn' WHEN 'Unknown' THEN 'Unknown' ELSE 'EscapingThrow' END AS outcome FROM v_block WHERE terminal IN ('Return', 'Unknown') OR (terminal IN ('Throw', 'Rethrow') AND escaping)
      UNION ALL SELECT method, NULL, 'NormalCompletion' FROM f WHERE done UNION ALL SELECT method, NULL, 'NoNormalExit' FROM f WHERE NOT done AND NOT ret""",
}
