"""Queries on operations, values, admission of calls and decision topology, and their DuckDB counterparts."""

from pyspark.sql import functions as F

from ..operators import admission, flow, topology, values
from .bind import keep, view, with_views
from .flow_queries import ORACLES as FLOW
from .text_queries import LOOKS_SENSITIVE

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


_OPS = with_views("v_op", "v_operand")
_FLOW = "CASE WHEN kind IN ('Invocation', 'DynamicInvocation', 'EventAssignment', 'ObjectCreation') THEN 'Invocation' WHEN kind IN ('Await', 'Return', 'Throw') THEN kind WHEN kind = 'Unknown' THEN 'UnknownOperation' ELSE 'Operation' END"


@query("flow_nodes", f"{_OPS} SELECT method, op, {_FLOW} AS node FROM v_op")
def _nodes(spark, d):
    return view(spark, d, "v_op").select("method", "op", values.flow_kind(F.col("kind")).alias("node"))


_ANCHORS = f"""SELECT o.method, CASE WHEN kind = 'Await' THEN coalesce(a.operand, o.op) ELSE o.op END AS operation, o.op AS anchor
  FROM v_op o LEFT JOIN v_operand a ON a.method = o.method AND a.op = o.op AND a.place = 0 WHERE {_FLOW} IN ('Operation', 'Invocation', 'Await')"""


@query("operation_anchors", f"{_OPS} {_ANCHORS}")
def _anchors(spark, d):
    return values.anchors(view(spark, d, "v_op"), view(spark, d, "v_operand"))


def _roots(spark, d):
    return view(spark, d, "v_op").where("is_root").select("method", "block", "op")


@query("block_operations", f"""{with_views('v_op', 'v_operand', recursive=True)}, r AS (SELECT method, block, op FROM v_op WHERE is_root UNION SELECT r.method, r.block, a.operand FROM r JOIN v_operand a ON a.method = r.method AND a.op = r.op)
  SELECT r.method, r.block, r.op, row_number() OVER (PARTITION BY r.method, r.block ORDER BY evaluation, r.op) - 1 AS ordinal FROM r JOIN v_op o ON o.method = r.method AND o.op = r.op""")
def _below(spark, d):
    return values.block_operations(_roots(spark, d), view(spark, d, "v_operand"), view(spark, d, "v_op"))


_ENDS = "SELECT method, block, CASE min(line) WHEN 1 THEN 'Return' WHEN 2 THEN 'Throw' WHEN 3 THEN 'Rethrow' ELSE 'None' END AS terminal FROM v_op GROUP BY method, block"


@query("terminal_values", f"""{_OPS}, e AS ({_ENDS}), f AS (SELECT method, block, op, row_number() OVER (PARTITION BY method, block ORDER BY evaluation, op) AS k FROM v_op WHERE is_root AND kind NOT IN ('Return', 'Throw'))
  SELECT e.method, e.block, terminal AS node, CASE WHEN terminal <> 'Rethrow' THEN op END AS value FROM e LEFT JOIN f ON f.method = e.method AND f.block = e.block AND k = 1 WHERE terminal <> 'None'""")
def _ends(spark, d):
    ops = view(spark, d, "v_op")
    least = ops.groupBy("method", "block").agg(F.min("line").alias("line"))
    terminal = F.when(F.col("line") == 1, "Return").when(F.col("line") == 2, "Throw").when(F.col("line") == 3, "Rethrow").otherwise("None")
    return values.terminal_values(least.select("method", "block", terminal.alias("terminal")), _roots(spark, d), ops)


# Arguments of every call: its operands, by place; the ordinal of some repeats or lacks.
_ARGUMENT = """c.method, c.op, CASE WHEN x.target % 17 = 0 THEN NULL WHEN x.target % 7 = 0 THEN CAST(0 AS BIGINT) ELSE a.place END AS ordinal, CASE x.target % 19 WHEN 0 THEN ' ' WHEN 1 THEN 'System.Int32' ELSE 'System.String' END AS type,
  CASE x.target % 11 WHEN 0 THEN 'my Token' WHEN 1 THEN 'say "hi" \\ `x`' WHEN 2 THEN NULL ELSE 'v' || x.method_id END AS value, x.target % 5 <> 0 AS is_constant"""
_ARGUMENTS = f"SELECT {_ARGUMENT} FROM v_op c JOIN v_operand a ON a.method = c.method AND a.op = c.op JOIN v_op x ON x.method = a.method AND x.op = a.operand WHERE c.kind IN ('Invocation', 'ObjectCreation', 'Binary')"
_CONSTANT = f"{_OPS}, a AS ({_ARGUMENTS}), k AS (SELECT method, op, ordinal, type, value FROM a QUALIFY bool_and(ordinal IS NOT NULL AND is_constant AND trim(type) <> '') OVER (PARTITION BY method, op))"


def _arguments(spark, d):
    ops = view(spark, d, "v_op")
    return spark.sql(_ARGUMENTS.replace("\\", "\\\\").replace("v_operand", "{operands}").replace("v_op", "{ops}"), ops=ops, operands=view(spark, d, "v_operand"))


@query("constant_arguments", f"{_CONSTANT} SELECT * FROM k")
def _constant(spark, d):
    return values.constant_arguments(_arguments(spark, d))


@query("argument_labels", f"""{_CONSTANT}, y AS (SELECT *, value AS v, lower(value) AS low, string_split(value, '.') AS parts FROM k),
  z AS (SELECT *, {LOOKS_SENSITIVE} AS hidden, CASE WHEN type = 'System.String' THEN '"' || replace(replace(replace(replace(replace(replace(value, '\\', '\\\\'), '"', '\\"'), chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t'), '`', '\\`') || '"' ELSE value END AS shown FROM y)
  SELECT method, op, CASE WHEN count(DISTINCT ordinal) = count(*) AND min(ordinal) = 0 AND max(ordinal) = count(*) - 1 AND NOT bool_or(hidden) THEN string_agg(shown, ', ' ORDER BY ordinal) END AS label FROM z GROUP BY method, op""")
def _labels(spark, d):
    return values.argument_labels(values.constant_arguments(_arguments(spark, d)))


_VALUES = f"""{_OPS}, h AS (SELECT method, op, count(*) AS n, min(operand) FILTER (place = 0) AS target, min(operand) FILTER (place = 1) AS value FROM v_operand GROUP BY method, op),
  c AS (SELECT o.*, h.n, h.target AS target_op, h.value AS value_op, CASE WHEN kind = 'ParameterReference' AND parameter IS NOT NULL THEN 'parameter' WHEN kind = 'Literal' THEN 'constant' WHEN kind = 'LocalReference' THEN 'local:' || local_name
    WHEN kind IN ('Assignment', 'CompoundAssignment') AND h.target IS NOT NULL AND h.value IS NOT NULL THEN 'definition' WHEN kind = 'Invocation' THEN 'invocation' WHEN kind IN ('FieldReference', 'PropertyReference') AND member IS NOT NULL THEN 'member-read'
    WHEN kind = 'Conversion' THEN 'conversion' WHEN h.n > 0 AND kind NOT IN ('ExpressionStatement', 'Return', 'Throw') THEN 'result' END AS role FROM v_op o LEFT JOIN h ON h.method = o.method AND h.op = o.op),
  w AS (SELECT * FROM c WHERE role IS NOT NULL),
  s AS (SELECT a.method, a.op, a.block, a.evaluation, t.kind AS target_kind, t.local_name, t.member, a.value_op FROM c a JOIN v_op t ON t.method = a.method AND t.op = a.target_op JOIN w v ON v.method = a.method AND v.op = a.value_op WHERE a.kind IN ('Assignment', 'CompoundAssignment'))"""


@query("value_nodes", f"{_VALUES} SELECT method, op, kind, CASE role WHEN 'parameter' THEN 'Parameter' WHEN 'constant' THEN 'Constant' WHEN 'definition' THEN 'LocalDefinition' WHEN 'invocation' THEN 'InvocationResult' WHEN 'member-read' THEN 'MemberRead' ELSE 'OperationResult' END AS value_kind, role FROM w")
def _values(spark, d):
    return values.value_nodes(view(spark, d, "v_op"), view(spark, d, "v_operand"))


@query("value_edges", f"""{_VALUES} SELECT method, value_op AS source, op AS target, 'Assignment' AS kind FROM s WHERE local_name IS NOT NULL
  UNION ALL SELECT u.method, (SELECT arg_max(x.op, (x.block, x.evaluation, x.op)) FROM s x WHERE x.method = u.method AND x.local_name = u.local_name AND (x.block, x.evaluation, x.op) < (u.block, u.evaluation, u.op)) AS source, u.op, 'CaptureCollapse' FROM v_op u WHERE u.kind = 'LocalReference' AND source IS NOT NULL
  UNION ALL SELECT w.method, a.operand, w.op, CASE w.kind WHEN 'Invocation' THEN 'Argument' WHEN 'Conversion' THEN 'Conversion' ELSE 'Operand' END FROM w JOIN v_operand a ON a.method = w.method AND a.op = w.op JOIN w g ON g.method = w.method AND g.op = a.operand
    WHERE w.kind NOT IN ('LocalReference', 'Assignment', 'CompoundAssignment') AND (w.kind <> 'Conversion' OR w.n = 1)""")
def _edges(spark, d):
    ready = keep(spark, d, "v_inv")
    return values.value_edges(view(spark, d, "v_op", ready), view(spark, d, "v_operand", ready))


@query("state_access", f"""{_VALUES}, q AS (SELECT method, 'Read' AS access, member FROM v_op WHERE member IS NOT NULL UNION SELECT method, 'Write', member FROM s WHERE member IS NOT NULL)
  SELECT *, row_number() OVER (PARTITION BY method, access ORDER BY member) - 1 AS ordinal FROM q""")
def _state(spark, d):
    return values.state_access(view(spark, d, "v_op"), view(spark, d, "v_operand"))


@query("span_index", f"{with_views('v_op')} SELECT method, line, kind, CASE WHEN count(*) = 1 THEN min(op) END AS op FROM v_op GROUP BY method, line, kind")
def _spans(spark, d):
    return values.span_index(view(spark, d, "v_op"), ["method", "line", "kind"])


# Calls of a method, some of two nodes, and sites that some of them lack or have twice; each flag fails for a few.
_CALLS = """SELECT owner AS caller, op_ord - CASE WHEN op_ord % 7 = 6 THEN 1 ELSE 0 END AS op, op_ord AS node, CASE WHEN target % 23 > 0 THEN method_id END AS target, CASE line WHEN 7 THEN NULL WHEN 6 THEN ' ' ELSE kind END AS type_name, status AS member_name,
  CASE WHEN target % 13 = 1 THEN 'Conservative' ELSE 'Exact' END AS certainty, CASE WHEN target % 19 = 2 THEN NULL ELSE target % 17 <> 3 END AS proven, target % 11 <> 4 AS source_backed, target % 29 = 5 AS platform,
  target % 31 = 6 AS nested, method_id % 13 = 0 AS dynamic, method_id % 17 = 0 AS delegate, method_id % 11 = 0 AS constructor FROM v_inv"""
_SITES = """SELECT owner AS caller, op_ord - CASE WHEN op_ord % 5 = 4 THEN 1 ELSE 0 END AS op, op_ord AS site, CASE WHEN target % 23 > 0 THEN method_id + CASE WHEN method_id % 19 = 0 THEN 1 ELSE 0 END END AS declared_target, 'Exact' AS site_certainty,
  true AS site_proven, CASE WHEN method_id % 7 = 0 THEN 'Cha' ELSE 'DirectExact' END AS resolution, target % 37 <> 7 AS complete, CASE WHEN target % 41 = 8 THEN 2 ELSE 1 END AS candidates, method_id AS candidate,
  CASE WHEN method_id % 29 = 0 THEN 'Heuristic' ELSE 'Exact' END AS resolution_certainty, CASE WHEN method_id % 31 = 0 THEN NULL ELSE true END AS resolution_proven FROM v_inv"""
_JOINED = f"""{with_views('v_inv')}, i AS ({_CALLS}), s AS ({_SITES}), u AS (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY caller, op) = 1),
  j AS (SELECT i.*, u.* EXCLUDE (caller, op), source_backed AND NOT nested AND NOT platform AS sourced, resolution = 'DirectExact' AND complete AND candidates = 1 AS resolved, NOT dynamic AND NOT delegate AND NOT constructor AS formed,
    coalesce(declared_target = target AND candidate = target, false) AS aimed, coalesce(proven AND site_proven AND resolution_proven, false) AS evident FROM i LEFT JOIN u ON u.caller = i.caller AND u.op = i.op)"""
_ADMIT = {
    "leaf": "SELECT caller, op, node, site, target, CASE WHEN NOT sourced THEN 'Source' WHEN type_name IS NULL OR member_name IS NULL THEN 'Name' WHEN site IS NULL THEN 'Site' WHEN NOT resolved THEN 'Resolution' END AS withheld FROM j",
    "direct": """SELECT caller, op, node, site, target, CASE WHEN NOT sourced THEN 'Source' WHEN type_name IS NULL OR member_name IS NULL THEN 'Name' WHEN NOT formed THEN 'Form' WHEN site IS NULL THEN 'Site' WHEN NOT resolved THEN 'Resolution'
      WHEN NOT aimed THEN 'Target' WHEN certainty <> 'Exact' THEN 'Certainty' WHEN NOT evident THEN 'Evidence' END AS withheld FROM j""",
    "root": """SELECT caller, op, node, site, target, CASE WHEN NOT sourced THEN 'Source' WHEN coalesce(trim(type_name), '') = '' OR coalesce(trim(member_name), '') = '' THEN 'Name' WHEN NOT formed THEN 'Form' WHEN site IS NULL THEN 'Site'
      WHEN NOT resolved THEN 'Resolution' WHEN NOT aimed THEN 'Target' WHEN certainty <> 'Exact' OR resolution_certainty <> 'Exact' THEN 'Certainty' WHEN NOT evident THEN 'Evidence' END AS withheld FROM j QUALIFY node = min(node) OVER (PARTITION BY caller, op)""",
}


def _admit(rule):
    def run(spark, d):
        rows = view(spark, d, "v_inv")
        parts = [spark.sql(sql.replace("v_inv", "{i}"), i=rows) for sql in (_CALLS, _SITES)]
        return admission.admit(*parts, rule)

    return run


for _rule, _sql in _ADMIT.items():
    query(f"admitted_{_rule}", f"{_JOINED} {_sql}")(_admit(_rule))


# Nodes of a scenario: each event is one, and two blocks stand for one operation; some nodes have none, or one that no block stands for.
_SCENARIO = """SELECT method, event_id AS node, CASE WHEN event_id % 13 > 0 THEN CAST(floor(ord / 2) AS BIGINT) + CASE WHEN event_id % 17 = 0 THEN 1000 ELSE 0 END END AS operation,
  CASE local_name WHEN 'view' THEN 'MethodCall' WHEN 'click' THEN 'Action' WHEN 'purchase' THEN 'Result' WHEN 'signup' THEN 'EntityQuery' ELSE 'Outcome' END AS kind FROM v_def"""
_STANDS = "SELECT method, CASE WHEN event_id % 3 > 0 THEN CAST(floor((ord + 1) / 2) AS BIGINT) ELSE 500 + ord END AS operation, ord - 1 AS anchor FROM v_def"
_DEPENDS = f"{FLOW['cfg_control_dependences'].rsplit(' SELECT b.method, b.ord AS decision', 1)[0]}, v_def AS ({with_views('v_def').removeprefix('WITH v_def AS (').removesuffix(')')}), dep AS (SELECT b.method, b.ord AS decision{FLOW['cfg_control_dependences'].rsplit(' SELECT b.method, b.ord AS decision', 1)[1]})"
_MEMBERS = f"""{_DEPENDS}, k AS ({_SCENARIO}), a AS ({_STANDS}), x AS (SELECT a.method, operation, anchor, string_agg(decision || '/' || polarity, ',' ORDER BY decision, polarity) AS s FROM a LEFT JOIN dep ON dep.method = a.method AND dep.node = a.anchor GROUP BY a.method, operation, anchor),
  g AS (SELECT method, operation, count(DISTINCT coalesce(s, '')) = 1 AS agrees FROM x GROUP BY method, operation),
  n AS (SELECT k.method, k.node, k.operation, agrees FROM k LEFT JOIN g ON g.method = k.method AND g.operation = k.operation WHERE kind <> 'Action' AND k.method IN (SELECT method FROM v_block WHERE cond_succ IS NOT NULL AND fall IS NOT NULL)),
  m AS (SELECT DISTINCT n.method, n.node, decision, polarity FROM n JOIN a ON a.method = n.method AND a.operation = n.operation JOIN dep ON dep.method = a.method AND dep.node = a.anchor WHERE agrees),
  b AS (SELECT *, count(*) OVER (PARTITION BY method, node, decision) AS arms FROM m)"""


def _members(spark, d):
    definitions = view(spark, d, "v_def")
    read = lambda sql: spark.sql(sql.replace("v_def", "{d}"), d=definitions)
    nodes = read(_SCENARIO).where(admission.material(F.col("kind")))
    blocks = view(spark, d, "v_block")
    return topology.memberships(nodes, read(_STANDS), flow.control_dependences(blocks), blocks.where("cond_succ is not null and fall is not null").select("method", F.col("ord").alias("decision")))


@query("decision_memberships", f"{_MEMBERS} SELECT method, node, decision, polarity FROM b WHERE arms = 1")
def _memberships(spark, d):
    return _members(spark, d)[0]


@query("decision_diagnostics", f"{_MEMBERS} SELECT method, node, 'SC011' AS code, NULL AS decision FROM n WHERE NOT coalesce(agrees, false) UNION ALL SELECT DISTINCT method, node, 'SC012', decision FROM b WHERE arms > 1")
def _diagnostics(spark, d):
    return _members(spark, d)[1]


@query("guarded_calls", f"{_DEPENDS}, k AS ({_SCENARIO}), a AS ({_STANDS}) SELECT method, node, operation FROM k WHERE kind = 'MethodCall' AND EXISTS (SELECT 1 FROM a JOIN dep ON dep.method = a.method AND dep.node = a.anchor WHERE a.method = k.method AND a.operation = k.operation)")
def _guarded(spark, d):
    read = lambda sql: spark.sql(sql.replace("v_def", "{d}"), d=view(spark, d, "v_def"))
    calls = read(_SCENARIO).where("kind = 'MethodCall'").select("method", "node", "operation")
    return admission.guarded(calls, read(_STANDS), flow.control_dependences(view(spark, d, "v_block"))).select("method", "node", "operation")


# Views decide about the stretch of events behind them, the greater part under the true arm; two events make a node.
_STRETCH = """SELECT a.method, a.ord AS decision, b.ord <= a.ord + a.event_id % 24 - a.event_id % 5 AS polarity, CAST(floor(b.ord / 2) AS BIGINT) AS node
  FROM v_def a JOIN v_def b ON a.method = b.method AND b.ord > a.ord AND b.ord <= a.ord + a.event_id % 24 WHERE a.local_name = 'view' AND a.event_id % 4 > 0"""
_TREE = f"""{with_views('v_def', recursive=True)}, dep AS (SELECT DISTINCT * FROM ({_STRETCH})), o AS (SELECT method, decision, list_sort(list(DISTINCT node)) AS l FROM dep GROUP BY method, decision), h AS (SELECT *, count(*) OVER (PARTITION BY method, l) > 1 AS hoisted FROM o),
  r AS (SELECT d.method, d.decision, polarity, list_sort(list(DISTINCT node)) AS l FROM dep d JOIN h ON h.method = d.method AND h.decision = d.decision WHERE NOT hoisted GROUP BY ALL),
  c AS (SELECT h.method, h.decision, r.decision AS parent, r.polarity, r.l FROM h JOIN r ON r.method = h.method AND len(h.l) < len(r.l) AND list_has_all(r.l, h.l) WHERE NOT hoisted),
  u AS (SELECT method, decision, min(parent) AS parent, bool_or(polarity) AS arm FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.method = c.method AND x.decision = c.decision AND len(x.l) < len(c.l) AND list_has_all(c.l, x.l)) GROUP BY method, decision HAVING count(*) = 1),
  p AS (SELECT h.method, h.decision, hoisted, parent, arm FROM h LEFT JOIN u ON u.method = h.method AND u.decision = h.decision),
  t AS (SELECT method, decision, 1 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.method, p.decision, t.depth + 1 FROM t JOIN p ON p.method = t.method AND p.parent = t.decision),
  f AS (SELECT p.*, t.depth, CASE WHEN hoisted THEN 'Hoisted' WHEN max(t.depth) OVER (PARTITION BY p.method) > 3 THEN 'Flat' WHEN parent IS NULL THEN 'Top' ELSE 'Nested' END AS placement FROM p JOIN t ON t.method = p.method AND t.decision = p.decision)"""


@query("fragment_tree", f"{_TREE} SELECT method, decision, CASE WHEN placement = 'Nested' THEN parent END AS parent, CASE WHEN placement = 'Nested' THEN arm END AS parent_arm, CASE WHEN placement = 'Flat' THEN 1 ELSE depth END AS depth, placement FROM f")
def _tree(spark, d):
    return topology.fragments(spark.sql(_STRETCH.replace("v_def", "{d}"), d=view(spark, d, "v_def")).distinct())


# Scenario nodes of events, an edge from each to the next, and what is left when throws are withheld.
_LINKS = "SELECT method, event_id AS source, lead(event_id) OVER (PARTITION BY method ORDER BY ord) AS target FROM v_def"


def _pruned(part):
    def run(spark, d):
        rows = view(spark, d, "v_def")
        nodes = rows.select("method", F.col("event_id").alias("node"))
        edges = spark.sql(_LINKS.replace("v_def", "{d}"), d=rows).where("target is not null")
        members = rows.select("method", (F.col("ord") % 3).alias("arm"), F.col("event_id").alias("node"))
        gone = rows.where("local_name = 'error'").select("method", F.col("event_id").alias("node"))
        return topology.prune(nodes, edges, members, gone)[part]

    return run


_KEPT = "(SELECT event_id FROM v_def WHERE local_name = 'error')"
query("pruned_nodes", f"{with_views('v_def')} SELECT method, event_id AS node FROM v_def WHERE local_name <> 'error'")(_pruned(0))
query("pruned_edges", f"{with_views('v_def')}, l AS ({_LINKS}) SELECT method, source, target FROM l WHERE target IS NOT NULL AND source NOT IN {_KEPT} AND target NOT IN {_KEPT}")(_pruned(1))
query("pruned_memberships", f"{with_views('v_def')} SELECT method, ord % 3 AS arm, event_id AS node FROM v_def WHERE local_name <> 'error'")(_pruned(2))
