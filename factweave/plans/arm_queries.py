"""Queries on arms of decisions and on topologies of entries, and their DuckDB counterparts."""

from pyspark.sql import functions as F

from ..operators import admission, arms, callbacks, flow, joins, topology
from .bind import view, with_views
from .fact_queries import _regions
from .flow_queries import _EDGES, _LOOP
from .flow_queries import ORACLES as FLOW
from .value_queries import _DEPENDS, _SCENARIO, _STANDS

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


_KIND = "CASE region % 25 WHEN 0 THEN 'Catch' WHEN 1 THEN 'Finally' WHEN 2 THEN 'Lock' ELSE 'Try' END"
# Edges with their kinds, regions by node, the loop of each header (the first of several) with its exits.
_GRAPH = f"""{_LOOP}, v_def AS ({with_views('v_def').removeprefix('WITH v_def AS (').removesuffix(')')}), edge AS ({_EDGES[_EDGES.index(' SELECT e.method, e.source, e.target, way'):]}),
 handled AS (SELECT n.method, n.node, bool_or({_KIND} IN ('Catch', 'Finally')) AS handles, bool_or({_KIND} <> 'Try') AS odd FROM v_node n JOIN (SELECT method, event_id AS region, ord AS start_block, ord + event_id % 7 AS end_block FROM v_def WHERE ord % 5 = 1) g ON g.method = n.method AND n.node BETWEEN start_block AND end_block GROUP BY ALL),
 own AS (SELECT method, header, min(latch) AS latch FROM body GROUP BY method, header),
 leave AS (SELECT DISTINCT o.method, o.header, e.target AS node FROM own o JOIN body b ON b.method = o.method AND b.latch = o.latch AND b.header = o.header JOIN v_edge e ON e.method = b.method AND e.source = b.node
   WHERE NOT EXISTS (SELECT 1 FROM body x WHERE x.method = o.method AND x.latch = o.latch AND x.header = o.header AND x.node = e.target)),
 kind AS (SELECT method, ord AS node, CASE WHEN cond_succ IS NOT NULL AND fall IS NOT NULL THEN 'Decision' WHEN terminal = 'Return' THEN 'Return' WHEN terminal IN ('Throw', 'Rethrow') THEN 'Throw' ELSE 'Block' END AS kind FROM v_block UNION SELECT method, n, 'Exit' FROM v_block),
 d AS (SELECT k.method, k.node AS decision, arm, o.header IS NOT NULL AS heads, (SELECT max(e.target) FROM edge e WHERE e.method = k.method AND e.source = k.node AND e.kind = CASE WHEN arm THEN 'True' ELSE 'False' END) AS start,
   EXISTS (SELECT 1 FROM edge e WHERE e.method = k.method AND e.source = k.node AND e.kind = 'LoopBack') AS back, EXISTS (SELECT 1 FROM edge e WHERE e.method = k.method AND e.source = k.node AND e.kind = 'LoopBack' AND e.target <> k.node) AS far, coalesce(h.handles, false) AS handles, coalesce(h.odd, false) AS odd
   FROM kind k CROSS JOIN (VALUES (true), (false)) a(arm) LEFT JOIN own o ON o.method = k.method AND o.header = k.node LEFT JOIN handled h ON h.method = k.method AND h.node = k.node WHERE k.kind = 'Decision'),
 q AS (SELECT *, CASE WHEN back AND NOT heads THEN 'loop-back' WHEN far THEN 'foreign-loop-back' WHEN handles OR (odd AND NOT heads) THEN 'exception-region' WHEN start IS NULL THEN 'missing-arm-edge' END AS first FROM d),
 w AS (SELECT method, decision, arm, heads, start AS node FROM q WHERE first IS NULL
   UNION SELECT w.method, w.decision, w.arm, w.heads, e.target FROM w JOIN kind k ON k.method = w.method AND k.node = w.node JOIN edge e ON e.method = w.method AND e.source = w.node LEFT JOIN handled h ON h.method = w.method AND h.node = w.node
   WHERE k.kind = 'Block' AND NOT coalesce(h.handles, false) AND e.kind <> 'LoopBack'),
 v AS (SELECT w.*, CASE WHEN h.handles THEN 'exception-region-target' WHEN k.kind IN ('Exit', 'Decision') THEN CASE WHEN w.heads AND l.node IS NULL THEN 'mismatched-exit' ELSE 'Rejoins' END
   WHEN k.kind IN ('Return', 'Throw') THEN CASE WHEN EXISTS (SELECT 1 FROM edge e JOIN handled x ON x.method = e.method AND x.node = e.target WHERE e.method = w.method AND e.source = w.node AND x.handles) THEN 'exception-boundary-target' ELSE 'Terminates' END
   WHEN b.method IS NOT NULL THEN CASE WHEN w.heads AND b.target = w.decision THEN CASE WHEN EXISTS (SELECT 1 FROM own o JOIN body y ON y.method = o.method AND y.latch = o.latch AND y.header = o.header WHERE o.method = w.method AND o.header = w.decision AND y.node = w.node) THEN 'Rejoins' ELSE 'foreign-body-source' END ELSE 'unsupported-edge:LoopBack' END END AS event
   FROM w JOIN kind k ON k.method = w.method AND k.node = w.node LEFT JOIN handled h ON h.method = w.method AND h.node = w.node LEFT JOIN leave l ON l.method = w.method AND l.header = w.decision AND l.node = w.node
   LEFT JOIN edge b ON b.method = w.method AND b.source = w.node AND b.kind = 'LoopBack' AND k.kind = 'Block'),
 z AS (SELECT q.method, q.decision, q.arm, coalesce(q.first, (SELECT max(event) FROM v WHERE v.method = q.method AND v.decision = q.decision AND v.arm = q.arm), 'no-reachable-boundary') AS event FROM q)"""
_ARMS = f"{_GRAPH} SELECT method, decision, arm, CASE WHEN event IN ('Rejoins', 'Terminates') THEN event ELSE 'Unknown' END AS terminal, CASE WHEN event NOT IN ('Rejoins', 'Terminates') THEN event END AS reason FROM z"


def _terminals(spark, d):
    return arms.block_terminals(view(spark, d, "v_block"), _regions(spark, d)[1].withColumn("kind", F.expr(_KIND)))


@query("arm_terminals", _ARMS)
def _arms(spark, d):
    return _terminals(spark, d)


@query("arm_reasons", f"SELECT terminal, reason, count(*) AS arms FROM ({_ARMS}) GROUP BY terminal, reason")
def _reasons(spark, d):
    return _terminals(spark, d).groupBy("terminal", "reason").agg(F.count("*").alias("arms"))


# An entry's root is a method, and the next method is the service that every second one calls. Operations of a method are its own, or
# (those from 500 on) any method's.
_SCOPES = "SELECT DISTINCT method AS entry, method FROM v_def UNION SELECT DISTINCT method - 1, method FROM v_def WHERE method % 2 = 1"
_OPERATION = "CASE WHEN operation >= 500 THEN 'any' ELSE 'm' || method END || '/' || operation"
_SCOPED = f"""{_DEPENDS}, scope AS ({_SCOPES}), arm AS ({_ARMS}), k AS (SELECT entry, node, {_OPERATION} AS operation, kind FROM (SELECT * FROM ({_SCENARIO}) s JOIN scope USING (method))),
  a AS (SELECT method, {_OPERATION} AS operation, anchor FROM ({_STANDS})), x AS (SELECT entry, operation, a.method, anchor, string_agg(a.method || ':' || decision || '/' || polarity, ',' ORDER BY decision, polarity) AS s FROM a JOIN scope USING (method) LEFT JOIN dep ON dep.method = a.method AND dep.node = a.anchor GROUP BY ALL),
  g AS (SELECT entry, operation, count(DISTINCT coalesce(s, '')) = 1 AS agrees FROM x GROUP BY entry, operation),
  n AS (SELECT k.entry, k.node, k.operation, agrees FROM k LEFT JOIN g ON g.entry = k.entry AND g.operation = k.operation WHERE kind <> 'Action' AND k.entry IN (SELECT entry FROM scope JOIN arm USING (method))),
  m AS (SELECT DISTINCT n.entry, n.node, a.method, decision, polarity FROM n JOIN scope USING (entry) JOIN a ON a.method = scope.method AND a.operation = n.operation JOIN dep ON dep.method = a.method AND dep.node = a.anchor WHERE agrees),
  b AS (SELECT *, count(*) OVER (PARTITION BY entry, node, method, decision) AS arms FROM m)"""


def _topology(spark, d):
    definitions = view(spark, d, "v_def")
    read = lambda sql: spark.sql(sql.replace("v_def", "{d}"), d=definitions)
    scopes = read(_SCOPES)
    nodes = read(_SCENARIO).where(admission.material(F.col("kind"))).withColumn("operation", F.expr(_OPERATION)).join(scopes, "method")
    anchors = read(_STANDS).withColumn("operation", F.expr(_OPERATION))
    return topology.decision_topology(scopes, nodes.select("entry", "node", "operation"), anchors, flow.control_dependences(view(spark, d, "v_block")), _terminals(spark, d))


@query("topology_arms", f"{_SCOPED} SELECT entry, method, decision, arm AS polarity, terminal FROM scope JOIN arm USING (method)")
def _topology_arms(spark, d):
    return _topology(spark, d)["arms"]


@query("topology_memberships", f"{_SCOPED} SELECT entry, node, method, decision, polarity FROM b WHERE arms = 1")
def _topology_members(spark, d):
    return _topology(spark, d)["memberships"]


@query("topology_diagnostics", f"""{_SCOPED} SELECT entry, 'SC011' AS code, node, NULL AS method, NULL AS decision, NULL AS detail FROM n WHERE NOT coalesce(agrees, false) UNION ALL SELECT DISTINCT entry, 'SC012', node, method, decision, NULL FROM b WHERE arms > 1
  UNION ALL SELECT entry, 'SC013', NULL, method, decision, coalesce(max(reason) FILTER (arm), max(reason)) FROM scope JOIN arm USING (method) WHERE reason IS NOT NULL GROUP BY entry, method, decision""")
def _topology_codes(spark, d):
    return _topology(spark, d)["diagnostics"]


# Clicks and sign-ups call one of five delegates; what encloses them comes from loops, regions and control dependences.
_SPANS = "SELECT method, event_id AS op, ord AS block FROM v_def UNION ALL SELECT method, event_id, ord + 1 FROM v_def WHERE event_id % 19 = 0"
_USES = "SELECT method, event_id % 5 AS parameter, event_id AS op, ord, CASE WHEN event_id % 97 = 0 THEN 'escape' ELSE 'invoke' END AS kind, event_id % 23 = 0 AS access FROM v_def WHERE local_name IN ('click', 'signup') AND event_id % 3 = 0"


@query("callback_contracts", f"""{with_views('v_def')}, loops AS ({_LOOP} SELECT DISTINCT method, node FROM body), dep AS ({FLOW['cfg_control_dependences']}), once AS ({FLOW['exactly_once']}),
  odd AS (SELECT DISTINCT p.method, p.ord FROM v_def p JOIN (SELECT method, event_id AS region, ord AS start_block, ord + event_id % 7 AS end_block FROM v_def WHERE ord % 5 = 1) g ON g.method = p.method AND p.ord BETWEEN start_block AND end_block WHERE {_KIND} <> 'Try'),
  u AS (SELECT u.*, EXISTS (SELECT 1 FROM loops l WHERE l.method = u.method AND l.node = u.ord) AS loop, EXISTS (SELECT 1 FROM odd o WHERE o.method = u.method AND o.ord = u.ord) AS unsupported,
    (SELECT count(DISTINCT decision) FROM dep WHERE dep.method = u.method AND dep.node = u.ord) AS conditions, (SELECT min(decision) FROM dep WHERE dep.method = u.method AND dep.node = u.ord) AS condition FROM ({_USES}) u),
  p AS (SELECT method, parameter, bool_or(kind = 'escape') AS escapes, count(*) FILTER (kind = 'invoke') AS n, min(op) FILTER (kind = 'invoke') AS op, bool_or(kind = 'invoke' AND loop) AS loop, bool_or(kind = 'invoke' AND unsupported) AS unsupported, bool_or(kind = 'invoke' AND access) AS access,
    max(conditions) FILTER (kind = 'invoke') AS conditions, arg_min(condition, op) FILTER (kind = 'invoke') AS condition FROM u GROUP BY method, parameter),
  s AS (SELECT method, op, min(block) AS block FROM ({_SPANS}) GROUP BY method, op HAVING count(*) = 1),
  x AS (SELECT c.method, c.parameter, p.op, condition, CASE WHEN coalesce(escapes, true) OR n = 0 THEN 'Unbounded' WHEN unsupported THEN 'Unknown' WHEN n > 1 OR loop THEN 'RepeatedOrUnknown'
      WHEN conditions = 0 AND NOT access AND coalesce(on_every_way, false) THEN 'ExactlyOnce' WHEN conditions = 1 AND NOT access AND condition % 3 > 0 THEN 'ZeroOrOne' ELSE 'Unknown' END AS cardinality
    FROM (SELECT DISTINCT method, event_id % 5 AS parameter FROM v_def) c LEFT JOIN p ON p.method = c.method AND p.parameter = c.parameter LEFT JOIN s ON s.method = p.method AND s.op = p.op LEFT JOIN once ON once.method = s.method AND once.node = s.block)
  SELECT method, parameter, cardinality, CASE cardinality WHEN 'ExactlyOnce' THEN 'Unconditional' WHEN 'ZeroOrOne' THEN 'Conditional' WHEN 'Unbounded' THEN NULL ELSE 'Unknown' END AS trigger, CASE WHEN cardinality <> 'Unbounded' THEN op END AS invoke, CASE WHEN cardinality = 'ZeroOrOne' THEN condition END AS condition FROM x""")
def _contracts(spark, d):
    definitions, blocks = view(spark, d, "v_def"), view(spark, d, "v_block")
    read = lambda sql: spark.sql(sql.replace("v_def", "{d}"), d=definitions)
    points, regions = _regions(spark, d)
    odd = joins.in_intervals(points, regions.where(F.expr(_KIND) != "Try"), ["method"], "ord", "start_block", "end_block").select("method", "ord").distinct().withColumn("unsupported", F.lit(True))
    loops = flow.natural_loops(blocks).select("method", F.col("node").alias("ord")).distinct().withColumn("loop", F.lit(True))
    control = flow.control_dependences(blocks).groupBy("method", F.col("node").alias("ord")).agg(F.count_distinct("decision").alias("conditions"), F.min("decision").alias("condition"))
    uses = read(_USES).join(loops, ["method", "ord"], "left").join(odd, ["method", "ord"], "left").join(control, ["method", "ord"], "left").withColumn("statement", F.col("condition") % 3 > 0)
    named = definitions.select("method", (F.col("event_id") % 5).alias("parameter"))
    return callbacks.callback_contracts(named, uses, read(_SPANS), flow.dominator_tree(blocks), blocks.select("method", F.col("n").alias("exit")))
