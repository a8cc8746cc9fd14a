"""Queries on dispatched handlers, and their DuckDB counterparts."""

from pyspark.sql import functions as F

from ..operators import dispatch, flow
from .bind import view, with_views
from .flow_queries import ORACLES as FLOW

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


# One back edge in nine counts as a loop, so that methods have none, one and several.
def _expanded(spark, d):
    blocks = view(spark, d, "v_block")
    few = lambda rows: rows.where(F.col("latch") % 9 == 1)
    tables = [view(spark, d, f"v_d_{t}") for t in ("dispatch", "method", "inv", "site")]
    return dispatch.expand_handlers(*tables, few(flow.natural_loops(blocks)), few(flow.loop_exits(blocks)), view(spark, d, "v_d_return"))


_EFFECTIVE = "CASE WHEN return_type LIKE 'System.Threading.Tasks.%<%' THEN regexp_extract(return_type, '<(.*)>$', 1) WHEN return_type NOT LIKE '%<%' THEN return_type END"
_HANDLED = f"""{with_views('v_d_dispatch', 'v_d_method', 'v_d_inv', 'v_d_site', 'v_d_return')}, lo AS (SELECT * FROM ({FLOW['cfg_natural_loops']}) WHERE latch % 9 = 1), lx AS (SELECT * FROM ({FLOW['cfg_loop_exits']}) WHERE latch % 9 = 1),
 lp AS (SELECT method, latch, header, count(*) FILTER (node <> header) > 0 AND (method, latch, header) IN (SELECT (method, latch, header) FROM lx) AS fine FROM lo GROUP BY method, latch, header),
 sel AS (SELECT method, min(header) AS header, count(*) = 1 AND bool_and(fine) AS whole FROM lp GROUP BY method),
 di AS (SELECT d.*, return_type, CASE WHEN NOT (boundary = 'RequestResponse' AND cardinality = 'ExactlyOne') THEN 'SC-DISPATCH-UNRESOLVED' WHEN resolution = 'Ambiguous' THEN 'SC-DISPATCH-AMBIGUOUS'
   WHEN resolution = 'GeneratedBodyUnavailable' OR (handler IS NOT NULL AND NOT body_available) THEN 'SC-DISPATCH-BODY-UNAVAILABLE' WHEN resolution <> 'ExactSingle' THEN 'SC-DISPATCH-UNRESOLVED' END AS code, handler IS NOT NULL AND coalesce(flows, 0) <> 1 AS missing
   FROM v_d_dispatch d LEFT JOIN v_d_method m ON m.method_id = d.handler),
 ok AS (SELECT * FROM di WHERE code IS NULL AND NOT missing AND handler IS NOT NULL),
 si AS (SELECT caller, op, count(*) AS n, min(resolution) AS resolution, bool_and(complete) AS complete, min(candidates) AS candidates FROM v_d_site GROUP BY caller, op),
 iv AS (SELECT i.*, row_number() OVER (PARTITION BY i.caller ORDER BY block, evaluation, node) - 1 AS place, source_backed AND NOT nested AND NOT platform AS eligible,
   source_backed AND NOT nested AND NOT platform AND member_name IS NOT NULL AND coalesce(s.n = 1 AND s.resolution = 'DirectExact' AND s.complete AND s.candidates = 1, false) AS admitted FROM v_d_inv i LEFT JOIN si s ON s.caller = i.caller AND s.op = i.op),
 one AS (SELECT dispatch, iv.*, CASE WHEN EXISTS (SELECT 1 FROM sel JOIN lo ON lo.method = sel.method AND lo.header = sel.header WHERE sel.whole AND sel.method = iv.caller AND lo.node = iv.block AND lo.node <> lo.header) THEN (SELECT header FROM sel WHERE method = iv.caller) END AS header FROM ok JOIN iv ON iv.caller = ok.handler WHERE eligible),
 st AS (SELECT dispatch, 0 AS depth, caller, target, op AS operation, NULL::BIGINT AS parent, header, [place, -1, node] AS key FROM one WHERE admitted
   UNION ALL SELECT o.dispatch, 1, n.caller, n.target, n.op, o.op, NULL, [o.place, n.place, n.node] FROM one o JOIN iv n ON n.caller = o.target WHERE o.admitted AND n.admitted AND n.caller IN (SELECT method_id FROM v_d_method WHERE flows = 1)),
 rt AS (SELECT ok.dispatch, r.operation, response_type, {_EFFECTIVE} AS type_name FROM ok JOIN (SELECT method, min(operation) AS operation FROM v_d_return GROUP BY method HAVING count(*) = 1) r ON r.method = ok.handler)"""


@query("dispatch_expansion", f"{_HANDLED} SELECT dispatch, row_number() OVER (PARTITION BY dispatch ORDER BY key, operation) - 1 AS ordinal, depth, caller, target, operation, parent, header FROM st")
def _steps(spark, d):
    return _expanded(spark, d)["steps"]


@query("dispatch_returns", f"{_HANDLED} SELECT dispatch, operation, type_name FROM rt WHERE type_name = response_type")
def _returned(spark, d):
    return _expanded(spark, d)["returned"]


@query("dispatch_diagnostics", f"""{_HANDLED} SELECT dispatch, code, CAST(handler AS VARCHAR) AS detail FROM di WHERE code IS NOT NULL UNION ALL SELECT dispatch, 'SC-DISPATCH-HANDLER-FLOW-MISSING', CAST(handler AS VARCHAR) FROM di WHERE missing
  UNION ALL SELECT dispatch, 'SC-DISPATCH-CALL-WITHHELD', CAST(op AS VARCHAR) FROM one WHERE NOT admitted UNION ALL SELECT dispatch, 'SC-DISPATCH-LOOP-INCOMPLETE', CAST(handler AS VARCHAR) FROM ok WHERE handler IN (SELECT method FROM sel WHERE NOT whole)
  UNION ALL SELECT dispatch, 'SC-DISPATCH-RETURN-MISMATCH', CAST(operation AS VARCHAR) FROM rt WHERE response_type IS NOT NULL AND coalesce(type_name <> response_type, true)""")
def _codes(spark, d):
    return _expanded(spark, d)["diagnostics"]
