"""Queries on scenario graphs, and their DuckDB counterparts."""

from pyspark.sql import functions as F

from ..operators import scenario_graph
from .bind import keep, view, with_views
from .fact_queries import _EXPAND

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


_NAMES = {
    "entries": "entry", "methods": "method", "calls": "call", "root_calls": "root", "dispatches": "dispatch", "bindings": "bind", "sites": "site", "candidates": "cand", "steps": "step", "observations": "obs",
    "arms": "arm", "terminals": "terminal", "outcomes": "outcome", "routes": "route", "decisions": "decision", "factories": "factory", "returned": "returned", "locals": "local", "paths": "path",
}


def _graph(spark, d):
    ready = keep(spark, d, "v_inv", "v_call", "v_def")
    return scenario_graph.scenario_graph(scenario_graph.Facts(**{k: view(spark, d, f"v_g_{v}", ready) for k, v in _NAMES.items()}))


_REASON = """CASE WHEN NOT known THEN 'action-method-missing' WHEN ctor IS NULL THEN 'controller-constructor-missing' WHEN NOT bound THEN 'no-di-bindings' WHEN st IS NULL THEN 'no-service-call-matched'
  WHEN sites > 1 THEN 'multiple-matching-call-sites:' || st WHEN NOT complete THEN 'incomplete-resolution:' || st WHEN impls > 1 THEN 'multiple-di-targets:' || st WHEN found = 0 THEN 'no-implementation-candidate:' || st
  WHEN found > 1 THEN 'multiple-implementation-candidates:' || st WHEN regs = 0 THEN 'registration-missing' END"""
_RESOLVE = f"""{with_views(*[f'v_g_{v}' for v in _NAMES.values()])},
 req AS (SELECT entry, root FROM v_g_entry WHERE kind <> 'Configured'), disp AS (SELECT * FROM v_g_dispatch),
 tc AS (SELECT e.entry, e.root, m.method_id IS NOT NULL AS known, (SELECT min(c.method_id) FROM v_g_method c WHERE c.is_constructor AND c.type_name = m.type_name) AS ctor
   FROM req e LEFT JOIN v_g_method m ON m.method_id = e.root WHERE e.root NOT IN (SELECT method FROM disp)),
 pick AS (SELECT tc.*, EXISTS (SELECT 1 FROM v_g_bind b WHERE b.constructor = tc.ctor) AS bound, (SELECT min(b.service_type) FROM v_g_bind b JOIN v_g_site s ON s.declared_type = b.service_type WHERE b.constructor = tc.ctor AND s.caller = tc.root) AS st FROM tc),
 hop AS (SELECT pick.*, s.sites, s.site, s.complete, b.impls, b.impl, b.regs FROM pick
   LEFT JOIN (SELECT caller, declared_type, count(*) AS sites, min(site) AS site, bool_and(complete) AS complete FROM v_g_site GROUP BY ALL) s ON s.caller = pick.root AND s.declared_type = pick.st
   LEFT JOIN (SELECT constructor, service_type, count(DISTINCT implementation) AS impls, min(implementation) AS impl, count(registration) AS regs FROM v_g_bind GROUP BY ALL) b ON b.constructor = pick.ctor AND b.service_type = pick.st),
 svc AS (SELECT hop.*, coalesce(c.found, 0) AS found, c.method FROM hop LEFT JOIN (SELECT site, declaring_type, count(DISTINCT candidate) AS found, min(candidate) AS method FROM v_g_cand GROUP BY ALL) c ON c.site = hop.site AND c.declaring_type = hop.impl),
 res AS (SELECT *, {_REASON} AS reason FROM svc)"""


@query("resolved_services", f"{_RESOLVE} SELECT entry, root, CASE WHEN reason IS NULL THEN st END AS service_type, CASE WHEN reason IS NULL THEN impl END AS implementation, CASE WHEN reason IS NULL THEN site END AS site, CASE WHEN reason IS NULL THEN site END AS operation, CASE WHEN reason IS NULL THEN method END AS method, reason FROM res")
def _resolved(spark, d):
    plain = view(spark, d, "v_g_entry").where("kind <> 'Configured'").join(view(spark, d, "v_g_dispatch").select(F.col("method").alias("root")).distinct(), "root", "left_anti")
    return scenario_graph.resolve_services(plain.select("entry", "root"), *[view(spark, d, f"v_g_{v}") for v in ("method", "bind", "site", "cand")])


_POLARITY = "CASE WHEN status BETWEEN 200 AND 299 THEN 'Success' WHEN status BETWEEN 400 AND 599 THEN 'Failure' END"
_ASSOCIATE = f"""{_RESOLVE}, plain AS (SELECT * FROM res WHERE reason IS NULL AND root NOT IN (SELECT method FROM v_g_arm)),
 mk AS (SELECT method, count(*) FILTER (outcome = 'Success') AS ns, count(*) FILTER (outcome = 'NotFound') AS nf, min(operation) FILTER (outcome = 'Success') AS success, min(operation) FILTER (outcome = 'NotFound') AS failure, min(type_name) FILTER (outcome = 'Success') AS type_name
   FROM v_g_factory f WHERE EXISTS (SELECT 1 FROM v_g_returned r WHERE r.method = f.method AND r.operation = f.operation) GROUP BY method),
 de AS (SELECT method, min(local) AS local FROM v_g_decision GROUP BY method),
 st AS (SELECT p.entry, p.root, p.method, de.local, ns, nf, success, failure, mk.type_name, (SELECT min(l.type_name) FROM v_g_local l WHERE l.method = p.root AND l.name = de.local) AS lt, de.method IS NOT NULL AS decided FROM plain p LEFT JOIN mk ON mk.method = p.method LEFT JOIN de ON de.method = p.root),
 ass AS (SELECT *, CASE WHEN NOT decided THEN 'SC006' WHEN ns IS NULL OR ns <> 1 OR nf <> 1 OR coalesce(lt <> type_name, true) THEN 'SC007' END AS code,
   CASE WHEN NOT decided THEN CAST(root AS VARCHAR) WHEN ns IS NULL THEN 'no-return-provenance' WHEN ns <> 1 OR nf <> 1 THEN 'success=' || ns || ' failure=' || nf WHEN coalesce(lt <> type_name, true) THEN 'local=' || local END AS detail FROM st)"""


@query("result_association", f"{_ASSOCIATE} SELECT entry, root, method, CASE WHEN code IS NULL THEN success END AS success, CASE WHEN code IS NULL THEN failure END AS failure, CASE WHEN code IS NULL THEN type_name END AS type_name, code, detail FROM ass")
def _associated(spark, d):
    rows = _resolved(spark, d).where("reason is null").select("entry", "root", "method")
    rows = rows.join(view(spark, d, "v_g_arm").select(F.col("method").alias("root")).distinct(), "root", "left_anti")
    return scenario_graph.associate_results(rows, *[view(spark, d, f"v_g_{v}") for v in ("decision", "factory", "returned", "local")])


_CALLED = "'calls ' || coalesce(concat_ws('.', m.type_name, m.name), '?')"
_OUT = """SELECT entry, c.method, c.operation, c.helper, c.created, place, o.n, o.status, o.found, o.op_at, r.route FROM {claims} c
  LEFT JOIN (SELECT method, {on} AS k, count(*) AS n, min(status) AS status, min(helper) AS found, min(operation) AS op_at FROM v_g_outcome GROUP BY ALL) o ON o.method = c.method AND o.k = c.{on}
  LEFT JOIN (SELECT root, min(route) AS route FROM v_g_route GROUP BY root HAVING count(*) = 1) r ON r.root = c.created"""
_GRAPH = f"""{_ASSOCIATE}, gate AS (SELECT e.entry, e.root, CASE WHEN NOT coalesce(has_body, false) THEN 'SC002' WHEN flows = 0 THEN 'SC-DIRECT-NO-FLOW' WHEN flows > 1 THEN 'SC-DIRECT-AMBIGUOUS-FLOW' END AS code FROM v_g_entry e LEFT JOIN v_g_method m ON m.method_id = e.root WHERE kind = 'Configured'),
 tree AS ({_EXPAND}),
 spot AS (SELECT t.*, g.entry, array_to_string(string_split(path, '.')[:-2], '.') AS up, try_cast(string_split(path, '.')[-1] AS BIGINT) AS place FROM tree t JOIN gate g ON g.root = t.root AND g.code IS NULL),
 numb AS (SELECT caller, operation, op_ord, row_number() OVER (PARTITION BY caller ORDER BY owner, op_ord, callee) AS place FROM v_g_call),
 walk AS (SELECT s.entry, s.root, s.path, s.up, s.method_id, s.stop, s.step, n.operation, n.op_ord FROM spot s JOIN spot p ON p.entry = s.entry AND p.path = s.up JOIN numb n ON n.caller = p.method_id AND n.place = s.place WHERE s.depth > 0),
 dis AS (SELECT entry, r.root, d.operation, request_type, resolution, handler, row_number() OVER (PARTITION BY entry ORDER BY operation) - 1 AS ordinal, resolution = 'ExactSingle' AND handler IS NOT NULL AS ok FROM req r JOIN disp d ON d.method = r.root),
 ok AS (SELECT entry, root, method, site AS operation, st AS service_type, impl FROM res WHERE reason IS NULL),
 stp AS (SELECT ok.entry, ok.method, s.operation, s.kind, s.detail, s.ordinal, CASE WHEN s.kind IN ('Mutation', 'Save') THEN 'EntityMutation' ELSE s.kind END AS node_kind, CASE s.kind WHEN 'EntityQuery' THEN 'query:' WHEN 'StateAssignment' THEN 'state:' ELSE 'mutation:' END || s.operation AS key FROM ok JOIN v_g_step s ON s.method = ok.method),
 obs AS (SELECT ok.entry, ok.root, ok.method AS service, o.* FROM ok JOIN v_g_obs o ON o.method IN (ok.root, ok.method)),
 sw AS (SELECT ok.*, a.switch, a.enum FROM ok JOIN (SELECT method, min(switch) AS switch, min(enum) AS enum FROM v_g_arm GROUP BY method) a ON a.method = ok.root),
 cl AS (SELECT entry, a.method, a.operation, helper, created, '0' || member AS place FROM sw JOIN v_g_arm a ON a.method = sw.root
   UNION ALL SELECT entry, t.method, t.operation, helper, created, '1' || lpad(CAST(ordinal AS VARCHAR), 12, '0') FROM sw JOIN v_g_terminal t ON t.method = sw.root WHERE NOT EXISTS (SELECT 1 FROM v_g_arm a WHERE a.method = t.method AND a.operation = t.operation)),
 pa AS (SELECT DISTINCT a.entry, a.root AS method, NULL::BIGINT AS operation, p.helper, NULL::BIGINT AS created, CASE p.outcome WHEN 'Success' THEN 'result-success' ELSE 'result-failure' END || p.helper AS place, p.outcome FROM ass a JOIN v_g_path p ON p.method = a.root WHERE a.code IS NULL),
 o1 AS ({_OUT.format(claims='cl', on='operation')}), o2 AS ({_OUT.format(claims='pa', on='helper')}),
 oc AS (SELECT *, 'result-status' AS result, {_POLARITY} AS polarity, CASE WHEN coalesce(n, 0) <> 1 OR found <> helper OR {_POLARITY} IS NULL THEN 'SC004' END AS code FROM o1
   UNION ALL SELECT *, CASE WHEN place LIKE 'result-success%' THEN 'result-success' ELSE 'result-failure' END, CASE WHEN place LIKE 'result-success%' THEN 'Success' ELSE 'Failure' END, CASE WHEN coalesce(n, 0) <> 1 OR found <> helper OR {_POLARITY} IS NULL THEN 'SC004' END FROM o2),
 oe AS (SELECT *, 'outcome:' || status || ':' || helper AS key, helper || ' -> HTTP ' || status || CASE WHEN helper = 'CreatedAtAction' AND created IS NOT NULL AND route IS NOT NULL THEN ' links to GET ' || route ELSE '' END AS detail FROM oc),
 oz AS (SELECT *, row_number() OVER (PARTITION BY entry, key, result ORDER BY place, operation) AS first FROM oe WHERE code IS NULL),
 rc AS (SELECT r.entry, r.root, c.callee, c.operation, c.place FROM res r JOIN v_g_root c ON c.caller = r.root WHERE r.reason IS NOT NULL),
 n0 AS (SELECT entry, 'EntryPoint' AS kind, entry AS key, root AS method, NULL::BIGINT AS operation, label AS detail, NULL::BIGINT AS ordinal FROM v_g_entry
   UNION ALL SELECT entry, 'Action', 'action:' || root, root, NULL, CASE kind WHEN 'Configured' THEN 'configured method' WHEN 'Minimal' THEN 'minimal API handler' ELSE 'controller action' END, NULL FROM v_g_entry
   UNION ALL SELECT entry, 'MethodCall', 'method-call:' || path, w.method_id, operation, {_CALLED}, op_ord FROM walk w LEFT JOIN v_g_method m ON m.method_id = w.method_id WHERE step
   UNION ALL SELECT entry, 'MethodCall', 'method-call:' || operation, callee, operation, {_CALLED}, place FROM rc LEFT JOIN v_g_method m ON m.method_id = callee
   UNION ALL SELECT entry, 'Dispatch', 'dispatch:' || operation, root, operation, request_type, NULL FROM dis UNION ALL SELECT entry, 'Handler', 'handler:' || operation || ':' || handler, handler, operation, 'handler ' || handler, NULL FROM dis WHERE ok
   UNION ALL SELECT entry, 'ServiceCall', 'service:' || method, method, operation, 'resolved service implementation ' || impl, NULL FROM ok UNION ALL SELECT entry, node_kind, key, method, operation, detail, ordinal FROM stp
   UNION ALL SELECT entry, 'SourceObservation', 'observation:' || observation, method, operation, detail, NULL FROM obs UNION ALL SELECT entry, 'Result', 'result-status', root, switch, 'status result of ' || enum, NULL FROM sw
   UNION ALL SELECT entry, 'Result', 'result-success', method, success, 'success result of ' || type_name, NULL FROM ass WHERE code IS NULL UNION ALL SELECT entry, 'Result', 'result-failure', method, failure, 'failure result of ' || type_name, NULL FROM ass WHERE code IS NULL
   UNION ALL SELECT entry, 'Outcome', key, method, op_at, detail, NULL FROM oz WHERE first = 1),
 nodes AS (SELECT entry, kind, key, min((method, operation, detail, ordinal)) AS x FROM (SELECT entry, kind, key, method, operation, detail, ordinal FROM n0) GROUP BY ALL),
 e0 AS (SELECT entry, 'EntryPoint' AS sk, entry AS s, 'Action' AS tk, 'action:' || root AS t, 'Entry' AS kind, '' AS detail, NULL::BIGINT AS ordinal FROM v_g_entry
   UNION ALL SELECT entry, CASE WHEN up = '' THEN 'Action' ELSE 'MethodCall' END, CASE WHEN up = '' THEN 'action:' || root ELSE 'method-call:' || up END, 'MethodCall', 'method-call:' || path, 'Call', 'direct method call', op_ord FROM walk WHERE step
   UNION ALL SELECT entry, 'Action', 'action:' || root, 'MethodCall', 'method-call:' || operation, 'Call', 'direct method call', place FROM rc
   UNION ALL SELECT entry, 'Action', 'action:' || root, 'Dispatch', 'dispatch:' || operation, 'Dispatch', 'dispatch', ordinal FROM dis UNION ALL SELECT entry, 'Dispatch', 'dispatch:' || operation, 'Handler', 'handler:' || operation || ':' || handler, 'Dispatch', 'dispatch', ordinal FROM dis WHERE ok
   UNION ALL SELECT entry, 'Action', 'action:' || root, 'ServiceCall', 'service:' || method, 'Call', 'call through ' || service_type, NULL FROM ok
   UNION ALL SELECT entry, 'ServiceCall', 'service:' || method, node_kind, key, CASE kind WHEN 'EntityQuery' THEN 'Query' ELSE kind END, detail, ordinal FROM stp
   UNION ALL SELECT entry, CASE WHEN method = root THEN 'Action' ELSE 'ServiceCall' END, CASE WHEN method = root THEN 'action:' ELSE 'service:' END || method, 'SourceObservation', 'observation:' || observation, 'Observation', '', NULL FROM obs
   UNION ALL SELECT entry, 'ServiceCall', 'service:' || method, 'Result', 'result-status', 'ResultStatus', 'status result', NULL FROM sw
   UNION ALL SELECT entry, 'ServiceCall', 'service:' || method, 'Result', 'result-success', 'ResultSuccess', 'success factory', NULL FROM ass WHERE code IS NULL UNION ALL SELECT entry, 'ServiceCall', 'service:' || method, 'Result', 'result-failure', 'ResultFailure', 'failure factory', NULL FROM ass WHERE code IS NULL
   UNION ALL SELECT DISTINCT entry, 'Result', result, 'Outcome', key, 'Outcome' || polarity, helper || ' outcome', NULL::BIGINT FROM oz)"""


def _id(prefix: str, **fields: str) -> str:
    """The id that text.stable_id() gives; no value here has a character that JSON escapes."""
    return f"'{prefix}:v1:' || sha256('{{' || " + " || ',' || ".join(f"""'"{k}":"' || {v} || '"'""" for k, v in fields.items()) + " || '}')"


@query("scenario_nodes", f"{_GRAPH} SELECT entry, {_id('scenario-node', entry='entry', kind='kind', key='key')} AS node, kind, key, x.method AS method, x.operation AS operation, x.detail AS detail, x.ordinal AS ordinal FROM (SELECT entry, kind, key, {{'method': x[1], 'operation': x[2], 'detail': x[3], 'ordinal': x[4]}} AS x FROM nodes)")
def _nodes(spark, d):
    return _graph(spark, d)[0]


@query("scenario_edges", f"""{_GRAPH}, e1 AS (SELECT entry, {_id('scenario-node', entry='entry', kind='sk', key='s')} AS source, {_id('scenario-node', entry='entry', kind='tk', key='t')} AS target, kind, detail, ordinal FROM e0)
  SELECT entry, {_id('scenario-edge', entry='entry', source='source', target='target', kind='kind', detail='detail')} AS edge, source, target, kind, detail, ordinal FROM e1""")
def _edges(spark, d):
    return _graph(spark, d)[1]


@query("scenario_diagnostics", f"""{_GRAPH} SELECT entry, 'SC001' AS code, root || '|' || reason AS detail FROM res WHERE reason IS NOT NULL UNION ALL SELECT entry, code, CAST(root AS VARCHAR) FROM gate WHERE code IS NOT NULL
  UNION ALL SELECT entry, CASE stop WHEN 'NodeBudget' THEN 'SC-DIRECT-NODE-BUDGET' WHEN 'BodyUnavailable' THEN 'SC-DIRECT-BODY-UNAVAILABLE' WHEN 'SourceUnavailable' THEN 'SC-DIRECT-SOURCE-UNAVAILABLE' WHEN 'NoFlow' THEN 'SC-DIRECT-NO-FLOW' WHEN 'AmbiguousFlow' THEN 'SC-DIRECT-AMBIGUOUS-FLOW' ELSE 'SC-DIRECT-' || upper(stop) END, operation || '@' || path FROM walk WHERE stop IS NOT NULL
  UNION ALL SELECT entry, CASE resolution WHEN 'Ambiguous' THEN 'SC-DISPATCH-AMBIGUOUS' WHEN 'OpenGeneric' THEN 'SC-DISPATCH-OPEN-GENERIC' ELSE 'SC-DISPATCH-UNRESOLVED' END, CAST(operation AS VARCHAR) FROM dis WHERE NOT ok
  UNION ALL SELECT entry, code, detail FROM ass WHERE code IS NOT NULL UNION ALL SELECT entry, code, helper || '@' || place FROM oc WHERE code IS NOT NULL
  UNION ALL SELECT entry, 'SC010', CAST(created AS VARCHAR) FROM oc WHERE code IS NULL AND helper = 'CreatedAtAction' AND created IS NOT NULL AND route IS NULL""")
def _diagnostics(spark, d):
    return _graph(spark, d)[2]
