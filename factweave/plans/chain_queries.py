"""Queries on receiver chains, and their DuckDB counterparts."""

from ..operators import chains
from .bind import view, with_views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


# Every 41st event of a method is a property, the others are called on the event before; some on nothing known, some on the next, in a circle.
_CALLS = "SELECT method, ord AS op, CASE WHEN event_id % 97 = 0 THEN 100000 WHEN event_id % 89 = 0 THEN ord + 1 ELSE ord - 1 END AS receiver, local_name || (event_id % 3) AS name FROM v_def WHERE ord % 41 <> 1"
_SETS = "SELECT method, ord AS op, 'set' || (event_id % 4) AS member, CASE WHEN event_id % 5 > 0 THEN 'T' || (event_id % 5) END AS entity FROM v_def WHERE ord % 41 = 1"
_ENDS = "SELECT method, ord AS op FROM v_def WHERE ord % 41 <> 1 AND (local_name = 'purchase' OR ord % 41 = 0)"
_WALK = f"""{with_views('v_def', recursive=True)}, c AS ({_CALLS}), s AS ({_SETS}), e AS ({_ENDS}),
  w AS (SELECT e.method, e.op AS terminal, c.receiver AS op, 1 AS up FROM e JOIN c ON c.method = e.method AND c.op = e.op UNION ALL SELECT w.method, w.terminal, c.receiver, w.up + 1 FROM w JOIN c ON c.method = w.method AND c.op = w.op WHERE w.up < 200),
  b AS (SELECT w.method, terminal, up, member, entity FROM w JOIN s ON s.method = w.method AND s.op = w.op)"""


def _found(spark, d):
    read = lambda sql: spark.sql(sql.replace("v_def", "{d}"), d=view(spark, d, "v_def"))
    return chains.query_steps(read(_ENDS), read(_CALLS), read(_SETS))


@query("query_chain_steps", f"{_WALK} SELECT w.method, w.terminal, b.up - 1 - w.up AS place, w.op, c.name FROM w JOIN b ON b.method = w.method AND b.terminal = w.terminal AND w.up < b.up JOIN c ON c.method = w.method AND c.op = w.op")
def _steps(spark, d):
    return _found(spark, d)[0]


@query("query_chain_roots", f"{_WALK} SELECT method, terminal, member, entity, up - 1 AS steps FROM b")
def _roots(spark, d):
    return _found(spark, d)[1]


# Clicks open groups on the click before, one in four on the application; purchases map a verb on the last click.
_GROUPS = "SELECT method, ord AS op, CASE WHEN event_id % 83 = 0 THEN ord WHEN event_id % 4 > 0 THEN lag(ord) OVER (PARTITION BY method ORDER BY ord) END AS receiver, '/g' || (event_id % 5) || '//' AS prefix, event_id % 29 > 0 AS exact FROM v_def WHERE local_name = 'click'"
_MAPS = "SELECT method, ord AS op, CASE event_id % 4 WHEN 0 THEN 'MapGet' WHEN 1 THEN 'MapPost' WHEN 2 THEN 'MapPut' ELSE 'MapDelete' END AS member, last_click AS receiver, CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '/' ELSE 'r' || (event_id % 3) || '/{id}/' END AS route, CASE WHEN event_id % 11 > 0 THEN event_id END AS handler FROM (SELECT *, max(CASE WHEN local_name = 'click' THEN ord END) OVER (PARTITION BY method ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM v_def) AS x WHERE local_name = 'purchase'"


@query("minimal_routes", f"""{with_views('v_def', recursive=True)}, g AS ({_GROUPS}), m AS ({_MAPS}),
  w AS (SELECT method, op AS start, receiver AS op, 1 AS up FROM m WHERE receiver IS NOT NULL UNION ALL SELECT w.method, w.start, g.receiver, up + 1 FROM w JOIN g ON g.method = w.method AND g.op = w.op WHERE g.receiver IS NOT NULL AND up < 200),
  p AS (SELECT w.method, w.start, string_agg(g.prefix, '/' ORDER BY up DESC) AS prefix, bool_and(g.exact) AND max(up) < 200 AS sound FROM w JOIN g ON g.method = w.method AND g.op = w.op GROUP BY w.method, w.start),
  x AS (SELECT m.method, m.op, upper(m.member[4:]) AS verb, trim(regexp_replace(coalesce(prefix, '') || '/' || coalesce(route, ''), '/+', '/', 'g'), '/') AS path, CASE WHEN NOT coalesce(sound, true) THEN 'group' WHEN handler IS NULL THEN 'callback' WHEN trim(coalesce(route, '')) = '' THEN 'route' END AS code FROM m LEFT JOIN p ON p.method = m.method AND p.start = m.op)
  SELECT method, op, CASE WHEN code IS NULL THEN verb END AS verb, CASE WHEN code IS NULL THEN '/' || path END AS route, CASE WHEN code IS NULL THEN verb || ' ' || path END AS operation_key, code FROM x""")
def _minimal(spark, d):
    definitions = view(spark, d, "v_def")
    return chains.minimal_routes(spark.sql(_MAPS.replace("v_def", "{d}").replace("{id}", "{{id}}"), d=definitions), spark.sql(_GROUPS.replace("v_def", "{d}"), d=definitions))
