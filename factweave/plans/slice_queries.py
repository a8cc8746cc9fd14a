"""Queries on returned values, guards, layers of evidence and groups of predicates, and their DuckDB counterparts."""

from pyspark.sql import functions as F

from ..operators import facts, guards, topology, values
from .bind import view, with_views
from .value_queries import _STRETCH, _TREE
from .value_queries import ORACLES as VALUES

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


def _ops(spark, d):
    return view(spark, d, "v_op"), view(spark, d, "v_operand")


_RETURNED = f"""{with_views('v_op', 'v_operand', recursive=True)}, vn AS ({VALUES['value_nodes']}), ve AS ({VALUES['value_edges']}),
  rv AS (SELECT o.method, o.op, a.operand AS value FROM v_op o JOIN v_operand a ON a.method = o.method AND a.op = o.op AND a.place = 0 JOIN vn ON vn.method = o.method AND vn.op = a.operand WHERE o.kind = 'Return')"""


@query("returned_values", f"{_RETURNED} SELECT method, op, value FROM rv")
def _returned(spark, d):
    return values.returned_values(*_ops(spark, d))


@query("return_provenance", f"""{_RETURNED}, b AS (SELECT method, op, value AS node FROM rv UNION SELECT b.method, b.op, e.source FROM b JOIN ve e ON e.method = b.method AND e.target = b.node WHERE e.kind IN ('Assignment', 'CaptureCollapse', 'Conversion'))
  SELECT b.method, b.op AS return_op, b.node AS operation FROM b JOIN v_op o ON o.method = b.method AND o.op = b.node WHERE o.kind IN ('Invocation', 'DynamicInvocation', 'EventAssignment', 'ObjectCreation')""")
def _provenance(spark, d):
    return values.return_provenance(*_ops(spark, d))


_GUARDS = "SELECT method, ord AS ordinal, 's' || (event_id % 2) AS symbol, CASE local_name WHEN 'view' THEN '<=' WHEN 'purchase' THEN '<' WHEN 'error' THEN '>' END AS operator, event_id % 3 AS constant, CASE WHEN event_id % 19 > 0 THEN event_id * 5 % 3 END AS low, event_id % 3 AS high, event_id % 7 > 0 AS terminates FROM v_def"


@query("guard_reduction", f"""{with_views('v_def', recursive=True)}, g AS ({_GUARDS}), r AS (SELECT *, false AS reduced, CASE WHEN operator = '<=' THEN constant END AS bound FROM g WHERE ordinal = 1
  UNION ALL SELECT n.method, n.ordinal, n.symbol, n.operator, n.constant, n.low, n.high, n.terminates, n.operator IS NULL AND coalesce(r.bound = n.low AND r.terminates AND r.symbol = n.symbol, false),
    CASE WHEN n.operator = '<=' THEN n.constant WHEN n.operator IS NULL AND coalesce(r.bound = n.low AND r.terminates AND r.symbol = n.symbol, false) THEN n.high END FROM r JOIN g n ON n.method = r.method AND n.ordinal = r.ordinal + 1)
  SELECT method, ordinal, symbol, CASE WHEN reduced THEN '<=' ELSE operator END AS operator, CASE WHEN reduced THEN high WHEN operator IS NOT NULL THEN constant END AS constant, reduced FROM r""")
def _guards(spark, d):
    return guards.reduce_guards(spark.sql(_GUARDS.replace("v_def", "{d}"), d=view(spark, d, "v_def")))


# Blocks are evidence that rests on the blocks behind them; one in 23 is not there.
_EVIDENCE = "SELECT DISTINCT method * 1000 + node AS id FROM v_node WHERE (method * 7 + node) % 23 <> 5"
_RESTS = "SELECT method * 1000 + source AS id, method * 1000 + target AS underlying FROM v_edge"


@query("evidence_layers", f"""{with_views('v_node', 'v_edge', recursive=True)}, e AS ({_EVIDENCE}), l AS (SELECT DISTINCT * FROM ({_RESTS}) WHERE id IN (SELECT id FROM e)),
  way AS (SELECT id, underlying AS node FROM l UNION SELECT way.id, l.underlying FROM way JOIN l ON l.id = way.node),
  miss AS (SELECT DISTINCT id FROM (SELECT id, node FROM way) WHERE node NOT IN (SELECT id FROM e)), ring AS (SELECT DISTINCT id FROM way WHERE id = node), bad AS (SELECT id FROM miss UNION SELECT id FROM ring UNION SELECT way.id FROM way JOIN ring ON ring.id = way.node),
  lay AS (SELECT id, 0 AS layer FROM e WHERE id NOT IN (SELECT id FROM l) UNION SELECT l.id, lay.layer + 1 FROM lay JOIN l ON l.underlying = lay.id WHERE l.id NOT IN (SELECT id FROM bad))
  SELECT id, max(layer) AS layer, NULL AS code FROM lay GROUP BY id UNION ALL SELECT id, NULL, CASE WHEN id IN (SELECT id FROM miss) THEN 'Missing' ELSE 'Cycle' END FROM bad""")
def _layers(spark, d):
    read = lambda sql, v: spark.sql(sql.replace(v, "{t}"), t=view(spark, d, v))
    return facts.evidence_layers(read(_EVIDENCE, "v_node"), read(_RESTS, "v_edge"))


_WORDING = "SELECT method, ord AS decision, CAST(floor(ord / 5) AS BIGINT) AS predicate, CASE WHEN row_number() OVER (PARTITION BY method, floor(ord / 5) ORDER BY ord) = 1 OR event_id % 31 = 0 THEN 'Owner' ELSE 'Subordinate' END AS role FROM v_def WHERE local_name = 'view'"
_ENDS = "SELECT method, ord AS decision, event_id % 3 = 0 AS arm, CASE WHEN event_id % 23 = 0 THEN 'Terminates' WHEN event_id % 27 = 0 THEN 'Unknown' ELSE 'Rejoins' END AS terminal FROM v_def WHERE local_name = 'view' UNION ALL SELECT method, ord, event_id % 3 > 0, 'Rejoins' FROM v_def WHERE local_name = 'view' AND event_id % 29 > 0"
_SHOWN = "SELECT method, ord AS decision FROM v_def WHERE local_name = 'view' AND event_id % 10 > 0"
_GROUPED = f"""{_TREE}, tr AS (SELECT method, decision, CASE WHEN placement = 'Nested' THEN parent END AS parent, CASE WHEN placement = 'Nested' THEN arm END AS parent_arm FROM f), wo AS ({_WORDING}), en AS ({_ENDS}), su AS ({_SHOWN}),
  ow AS (SELECT method, predicate, min(decision) AS owner FROM wo WHERE role = 'Owner' GROUP BY method, predicate HAVING count(*) = 1),
  ro AS (SELECT wo.method, wo.predicate, wo.decision, owner FROM wo JOIN ow ON ow.method = wo.method AND ow.predicate = wo.predicate WHERE role = 'Subordinate'),
  up AS (SELECT ro.method, ro.decision, tr.parent AS above, tr.parent_arm AS arm FROM ro JOIN tr ON tr.method = ro.method AND tr.decision = ro.decision WHERE tr.parent IS NOT NULL UNION ALL SELECT up.method, up.decision, tr.parent, tr.parent_arm FROM up JOIN tr ON tr.method = up.method AND tr.decision = up.above WHERE tr.parent IS NOT NULL),
  ju AS (SELECT ro.*, up.arm AS owner_arm, up.above IS NOT NULL AND EXISTS (SELECT 1 FROM su WHERE su.method = ro.method AND su.decision = ro.decision) AND EXISTS (SELECT 1 FROM su WHERE su.method = ro.method AND su.decision = ro.owner)
    AND (SELECT count(DISTINCT en.arm) = 2 AND bool_and(terminal = 'Rejoins') FROM en WHERE en.method = ro.method AND en.decision = ro.decision) AS fine FROM ro LEFT JOIN up ON up.method = ro.method AND up.decision = ro.decision AND up.above = ro.owner),
  gr AS (SELECT method, predicate, owner, bool_and(fine) AS valid FROM ju GROUP BY method, predicate, owner)"""


def _grouped(spark, d):
    read = lambda sql: spark.sql(sql.replace("v_def", "{d}"), d=view(spark, d, "v_def"))
    tree = topology.fragments(read(_STRETCH).distinct()).select("method", "decision", "parent", "parent_arm")
    return topology.predicate_groups(tree, read(_WORDING), read(_ENDS), read(_SHOWN))


@query("predicate_groups", f"{_GROUPED} SELECT method, predicate, owner, valid FROM gr")
def _groups(spark, d):
    return _grouped(spark, d)[0]


@query("predicate_placements", f"{_GROUPED} SELECT DISTINCT ju.method, ju.decision, en.arm, ju.owner, ju.owner_arm FROM ju JOIN gr ON gr.method = ju.method AND gr.predicate = ju.predicate AND gr.valid JOIN en ON en.method = ju.method AND en.decision = ju.decision")
def _placements(spark, d):
    return _grouped(spark, d)[1]


@query("guard_kinds", f"SELECT reduced, operator, count(*) AS guards FROM ({ORACLES['guard_reduction']}) GROUP BY reduced, operator")
def _kinds(spark, d):
    return _guards(spark, d).groupBy("reduced", "operator").agg(F.count("*").alias("guards"))


# Two events make a node, every third event a message of it; one in eight decisions has no wording.
_TOLD = "SELECT method, event_id AS message, CAST(floor(ord / 2) AS BIGINT) AS node FROM v_def WHERE event_id % 3 = 0"
_WORDED = "SELECT method, ord AS decision FROM v_def WHERE local_name = 'view' AND event_id % 8 > 0"
_FRAGMENTS = f"""{with_views('v_def', recursive=True)}, mb AS (SELECT DISTINCT * FROM ({_STRETCH})), ms AS ({_TOLD}), en AS ({_ENDS}),
  sup AS (SELECT method, decision FROM en GROUP BY method, decision HAVING count(DISTINCT arm) = 2 AND bool_and(terminal <> 'Unknown') INTERSECT SELECT mb.method, mb.decision FROM mb JOIN ms ON ms.method = mb.method AND ms.node = mb.node
    EXCEPT SELECT method, decision FROM mb GROUP BY method, decision, node HAVING count(DISTINCT polarity) = 2),
  able AS (SELECT * FROM sup INTERSECT SELECT * FROM ({_WORDED})),
  se AS (SELECT method, decision, list_sort(list(DISTINCT node)) AS l FROM mb GROUP BY method, decision), tw AS (SELECT method, decision FROM (SELECT se.*, count(*) OVER (PARTITION BY se.method, l) AS same FROM se JOIN sup ON sup.method = se.method AND sup.decision = se.decision) WHERE same > 1),
  sh AS (SELECT * FROM able EXCEPT SELECT * FROM tw), ar AS (SELECT mb.method, mb.decision, polarity, list_sort(list(DISTINCT node)) AS l FROM mb JOIN sh ON sh.method = mb.method AND sh.decision = mb.decision GROUP BY ALL),
  ca AS (SELECT se.method, se.decision, ar.decision AS parent, ar.polarity, ar.l FROM se JOIN sh ON sh.method = se.method AND sh.decision = se.decision JOIN ar ON ar.method = se.method AND len(se.l) < len(ar.l) AND list_has_all(ar.l, se.l)),
  pa AS (SELECT method, decision, min(parent) AS parent, bool_or(polarity) AS arm FROM ca WHERE NOT EXISTS (SELECT 1 FROM ca x WHERE x.method = ca.method AND x.decision = ca.decision AND len(x.l) < len(ca.l) AND list_has_all(ca.l, x.l)) GROUP BY method, decision HAVING count(*) = 1),
  tr AS (SELECT sh.method, sh.decision, parent, arm FROM sh LEFT JOIN pa ON pa.method = sh.method AND pa.decision = sh.decision),
  de AS (SELECT method, decision, 1 AS depth FROM tr WHERE parent IS NULL UNION ALL SELECT tr.method, tr.decision, de.depth + 1 FROM de JOIN tr ON tr.method = de.method AND tr.parent = de.decision),
  fl AS (SELECT DISTINCT method FROM de WHERE depth > 3), ke AS (SELECT tr.*, depth FROM tr JOIN de ON de.method = tr.method AND de.decision = tr.decision WHERE tr.method NOT IN (SELECT method FROM fl)),
  pl AS (SELECT ms.method, ms.message, count(mb.decision) AS owners, bool_or(able.decision IS NOT NULL) AS able, min((-ke.depth, mb.decision, mb.polarity)) FILTER (ke.depth IS NOT NULL) AS best FROM ms LEFT JOIN mb ON mb.method = ms.method AND mb.node = ms.node LEFT JOIN ke ON ke.method = mb.method AND ke.decision = mb.decision LEFT JOIN able ON able.method = mb.method AND able.decision = mb.decision GROUP BY ms.method, ms.message),
  pp AS (SELECT method, message, CASE WHEN best IS NOT NULL THEN 'Fragment' WHEN owners = 0 OR able THEN 'Flat' ELSE 'Withheld' END AS placement, best[2] AS decision, best[3] AS arm FROM pl)"""


def _planned(spark, d):
    read = lambda sql: spark.sql(sql.replace("v_def", "{d}"), d=view(spark, d, "v_def"))
    return topology.plan_fragments(read(_STRETCH), read(_TOLD), read(_ENDS), read(_WORDED))


@query("planned_fragments", f"{_FRAGMENTS} SELECT method, decision, parent, arm AS parent_arm, depth FROM ke")
def _planned_tree(spark, d):
    return _planned(spark, d)[0]


@query("planned_messages", f"{_FRAGMENTS} SELECT method, message, placement, decision, arm FROM pp")
def _planned_messages(spark, d):
    return _planned(spark, d)[1]


@query("planned_codes", f"{_FRAGMENTS} SELECT method, 'DP001' AS code FROM fl UNION ALL SELECT DISTINCT method, 'DP002' FROM pp WHERE placement = 'Withheld'")
def _planned_codes(spark, d):
    return _planned(spark, d)[2]
