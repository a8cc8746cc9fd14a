"""Queries on validation, semantic order, entry points and frameworks, and their DuckDB counterparts."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, joins, render, validation
from .bind import keep, view, with_views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


def _read(spark, d, sql, *names, ready=None):
    """A text on views, read alike by Spark and, with the views defined before it, by DuckDB."""
    frames = {n: view(spark, d, n, ready) for n in names}
    for n in names:
        sql = sql.replace(n, "{" + n + "}")
    return spark.sql(sql, **frames)


# Extracted bodies with faults of every kind: methods of customers, operations of line items, blocks of events, regions of suppliers.
_X = {
    "m": "SELECT CAST(method AS BIGINT) AS method, place, fingerprint FROM (SELECT method_id - CASE WHEN method_id % 41 = 0 THEN 1 ELSE 0 END + CASE WHEN method_id % 53 = 0 THEN 5 ELSE 0 END AS method, method_id AS place, CASE WHEN method_id % 37 = 0 THEN ' ' WHEN method_id % 31 = 0 THEN NULL ELSE name END AS fingerprint FROM v_method) AS x",
    "o": "SELECT method, op AS place, op - CASE WHEN target % 19 = 1 THEN 1 ELSE 0 END AS op, CASE WHEN target % 23 = 2 THEN NULL ELSE op + CASE WHEN target % 17 = 0 THEN 1 ELSE 0 END END AS evaluation FROM v_op",
    "b": "SELECT method, CAST(block AS BIGINT) AS place, CAST(block AS BIGINT) + CASE WHEN max(target) % 13 = 0 THEN 2 ELSE 0 END AS ord, CASE WHEN min(line) < 3 THEN max(op) + max(target) % 2 END AS condition, CAST(block AS BIGINT) + 1 AS fall, CASE WHEN min(line) = 1 THEN max(target) % 3 END AS cond_succ FROM v_op GROUP BY method, block",
    "u": "SELECT method, block AS ord, op + CASE WHEN target % 21 = 0 THEN 3 ELSE 0 END AS op FROM v_op",
    "r": "SELECT method, op AS place, op + CASE WHEN target % 11 = 5 THEN 1 ELSE 0 END AS ord, op - CASE WHEN target % 29 = 0 THEN 1 ELSE 0 END AS region, CASE WHEN target % 4 > 0 THEN op - 1 + target % 7 - target % 6 END AS parent, CASE WHEN op = 0 THEN 'Root' ELSE 'Try' END AS kind, block - CASE WHEN target % 9 = 0 THEN 1 ELSE 0 END AS start_block, block + target % 2 - CASE WHEN target % 8 = 0 THEN 1 ELSE 0 END AS end_block FROM v_op",
}
_FAULTS = f"""{with_views('v_method', 'v_op')}, {', '.join(f'{k} AS ({sql})' for k, sql in _X.items())}, z AS (SELECT method, count(*) AS blocks FROM b GROUP BY method),
  f AS (SELECT method, 'BD1001' AS code, place AS ordinal FROM m QUALIFY row_number() OVER (PARTITION BY method ORDER BY place) > 1
  UNION ALL SELECT arg_min(y.method, y.place), 'BD1002', min(y.place) FROM m x JOIN m y ON y.place = x.place + 1 WHERE x.method >= y.method HAVING count(*) > 0
  UNION ALL SELECT method, 'BD1003', place FROM m WHERE coalesce(trim(fingerprint), '') = ''
  UNION ALL SELECT method, 'BD1004', place FROM o WHERE evaluation IS DISTINCT FROM place
  UNION ALL (SELECT method, 'BD1005', place FROM o QUALIFY row_number() OVER (PARTITION BY method, op ORDER BY place) > 1)
  UNION ALL SELECT method, 'BD1006', place FROM b WHERE ord IS DISTINCT FROM place
  UNION ALL SELECT method, 'BD1007', place FROM b WHERE condition IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.method = b.method AND o.op = b.condition)
  UNION ALL SELECT method, 'BD1008', ord FROM u WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.method = u.method AND o.op = u.op)
  UNION ALL SELECT method, 'BD1009', place FROM b WHERE NOT EXISTS (SELECT 1 FROM b x WHERE x.method = b.method AND x.ord = b.fall)
  UNION ALL SELECT method, 'BD1010', place FROM b WHERE cond_succ IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b x WHERE x.method = b.method AND x.ord = b.cond_succ)
  UNION ALL SELECT method, 'BD1011', place FROM r WHERE ord IS DISTINCT FROM place
  UNION ALL (SELECT method, 'BD1012', place FROM r QUALIFY row_number() OVER (PARTITION BY method, region ORDER BY place) > 1)
  UNION ALL SELECT method, 'BD1013', place FROM r WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r x WHERE x.method = r.method AND x.region = r.parent AND x.place <= r.place)
  UNION ALL SELECT r.method, 'BD1014', place FROM r LEFT JOIN z ON z.method = r.method WHERE start_block < 0 OR end_block < start_block OR (kind <> 'Root' AND (start_block >= coalesce(blocks, 0) OR end_block >= coalesce(blocks, 0))))"""


@query("extraction_errors", f"{_FAULTS} SELECT method, code, CAST(ordinal AS BIGINT) AS ordinal FROM f")
def _extraction(spark, d):
    ready = keep(spark, d, "v_inv")
    return validation.extraction_errors(*[_read(spark, d, sql, "v_method" if k == "m" else "v_op", ready=ready) for k, sql in _X.items()])


# Steps of an expansion: the invocations of an owner, each below the one before; ids, depths and flags fail for some.
_STEPS = "SELECT owner AS expansion, op_ord - CASE WHEN target % 13 = 0 THEN 1 ELSE 0 END AS step, CASE WHEN op_ord > 0 THEN op_ord - 1 + CASE WHEN target % 11 = 0 THEN 2 ELSE 0 END END AS parent, op_ord AS place, op_ord + CASE WHEN target % 17 = 0 THEN 1 ELSE 0 END AS depth, target % 5 = 0 AS cycle, method_id % 3 = 0 AS complete FROM v_inv"


@query("expansion_errors", f"""{with_views('v_inv')}, s AS ({_STEPS}), p AS (SELECT expansion, step, min(place) AS before, arg_min(depth, place) AS level FROM s GROUP BY expansion, step)
  SELECT expansion, step, 'Repeated' AS error FROM s GROUP BY expansion, step HAVING count(*) > 1 UNION ALL SELECT DISTINCT expansion, step, 'OpenCycle' FROM s WHERE cycle AND complete
  UNION ALL SELECT DISTINCT s.expansion, s.step, 'Parent' FROM s LEFT JOIN p ON p.expansion = s.expansion AND p.step = s.parent WHERE s.parent IS NOT NULL AND (before IS NULL OR before >= place OR level <> depth - 1)""")
def _expansion(spark, d):
    return validation.expansion_errors(_read(spark, d, _STEPS, "v_inv"))


@query("foreign_key_errors", f"""{with_views('v_inv', 'v_method', 'v_member', 'v_hier', 'v_evid')} SELECT 'invocation.method' AS link, CAST(method_id AS VARCHAR) AS value, count(*) AS rows FROM v_inv WHERE method_id NOT IN (SELECT method_id FROM v_method WHERE loaded) GROUP BY method_id
  UNION ALL SELECT 'member.type', CAST(type_id AS VARCHAR), count(*) FROM v_member WHERE type_id NOT IN (SELECT type_id FROM v_hier WHERE namespace_id > 0) GROUP BY type_id
  UNION ALL SELECT 'evidence.document', CAST(evidence_id AS VARCHAR), count(*) FROM v_evid WHERE evidence_id NOT IN (SELECT page_id FROM pages) GROUP BY evidence_id""")
def _foreign(spark, d):
    types = view(spark, d, "v_hier").where("namespace_id > 0").select(F.col("type_id").cast("long").alias("type_id"))
    return validation.foreign_key_errors([
        ("invocation.method", view(spark, d, "v_inv"), "method_id", view(spark, d, "v_method").where("loaded"), "method_id"),
        ("member.type", view(spark, d, "v_member"), "type_id", types, "type_id"),
        ("evidence.document", view(spark, d, "v_evid"), "evidence_id", view(spark, d, "v_route"), "page_id"),
    ])


@query("structural_exclusions", f"{with_views('v_method')} SELECT DISTINCT type_name FROM v_method WHERE size < 9 AND type_name IN (SELECT type_name FROM v_method WHERE size > 42)")
def _structural(spark, d):
    m = view(spark, d, "v_method")
    return validation.structural_exclusions(m.where("size < 9"), m.where("size > 42"))


_LOAD = """SELECT method_id, CASE size % 4 WHEN 0 THEN 'Warning' ELSE 'Failure' END AS kind, method_id % 7 = 0 AS promoted, 'Msbuild failed when processing the file ''' || name || ''' with message: ' || CASE method_id % 6
  WHEN 0 THEN 'Package ''a'' ' || type_name || ' has a known ' || CASE size % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'minor' END || ' severity vulnerability, https://github.com/advisories/GHSA-' || project_key
  WHEN 1 THEN name || ' doesn''t support ' || type_name || ' and has not been tested with it. Consider upgrading your TargetFramework to net8.0 or later. You may also set <SuppressTfmSupportBuildWarnings>true</SuppressTfmSupportBuildWarnings> in the project file to ignore this warning and attempt to run in this unsupported configuration at your own risk.'
  ELSE type_name END AS message FROM (SELECT *, replace(replace(project, '#', '-'), ' ', '') AS project_key FROM v_method) AS m"""


@query("load_severities", f"""{with_views('v_method')}, x AS ({_LOAD}), y AS (SELECT *, CASE WHEN regexp_matches(message, 'has a known (low|moderate|high|critical) severity vulnerability, https://github[.]com/advisories/GHSA-[0-9A-Za-z-]+$') THEN regexp_extract(message, 'known ([a-z]+) severity', 1) END AS level FROM x)
  SELECT method_id, CASE WHEN kind = 'Failure' AND NOT promoted AND (level IS NOT NULL OR message LIKE '% at your own risk.') THEN 'Warning' ELSE kind END AS severity, CASE level WHEN 'low' THEN 'NU1901' WHEN 'moderate' THEN 'NU1902' WHEN 'high' THEN 'NU1903' WHEN 'critical' THEN 'NU1904' END AS code FROM y""")
def _load(spark, d):
    rows = _read(spark, d, _LOAD, "v_method")
    return rows.select("method_id", validation.severity_of_load(F.col("kind"), F.col("message"), F.col("promoted")).alias("severity"), validation.audit_code(F.col("message")).alias("code"))


_PATH = "CASE size % 7 WHEN 0 THEN '/' WHEN 1 THEN 'c://' WHEN 2 THEN '' WHEN 3 THEN 'a/../' WHEN 4 THEN 'x.y/' ELSE 'docs\\' END || replace(name, ' ', '\\') || CASE method_id % 5 WHEN 0 THEN '/.' WHEN 1 THEN '/..b' ELSE '' END"


@query("output_paths", f"{with_views('v_method')}, x AS (SELECT method_id, replace({_PATH}, '\\', '/') AS path FROM v_method) SELECT method_id, CASE WHEN path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, '://') AND NOT list_has_any(string_split(path, '/'), ['.', '..']) THEN path END AS path FROM x")
def _paths(spark, d):
    return view(spark, d, "v_method").select("method_id", text.output_path(F.expr(_PATH.replace("\\", "\\\\"))).alias("path"))


_MONIKER = "SELECT method_id, CASE size % 6 WHEN 0 THEN '.NETCoreApp' WHEN 1 THEN '.netstandard' WHEN 2 THEN '.NETFramework' WHEN 3 THEN 'Silverlight' ELSE '.NETCOREAPP' END || ',Version=v' || (method_id % 9) || '.' || (size % 3) AS moniker, CASE method_id % 4 WHEN 0 THEN 'Windows' WHEN 1 THEN ' ' END AS platform, CASE method_id % 3 WHEN 0 THEN '10.' || size END AS platform_version, CASE method_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'net6.0' ELSE 'NET' || (method_id % 9) || '.' || (size % 3) || '-Android' END AS own FROM v_method"


@query("target_frameworks", f"""{with_views('v_method')}, x AS ({_MONIKER}), y AS (SELECT *, string_split(moniker, ',Version=v') AS p FROM x), z AS (SELECT *, CASE lower(p[1]) WHEN '.netcoreapp' THEN 'net' || p[2] WHEN '.netstandard' THEN 'netstandard' || p[2] WHEN '.netframework' THEN 'net' || replace(p[2], '.', '') END AS framework FROM y)
  SELECT method_id, framework, CASE WHEN framework IS NULL THEN own ELSE framework || CASE WHEN trim(platform) <> '' THEN '-' || lower(platform) || coalesce(platform_version, '') WHEN starts_with(lower(own), lower(framework)) AND contains(own, '-') THEN lower(own[position('-' in own):]) ELSE '' END END AS canonical FROM z""")
def _frameworks(spark, d):
    c = F.col
    return _read(spark, d, _MONIKER, "v_method").select("method_id", text.target_framework(c("moniker")).alias("framework"), text.canonical_framework(c("moniker"), c("platform"), c("platform_version"), c("own")).alias("canonical"))


_KINDS = ["EntryPoint", "Action", "MethodCall", "ServiceCall", "EntityQuery", "StateAssignment", "EntityMutation", "SourceObservation", "Result", "Outcome", "Delay", "Other"]
_NODES = f"SELECT owner, op_ord, CASE target % 12 {' '.join(f'WHEN {n} THEN {chr(39)}{k}{chr(39)}' for n, k in enumerate(_KINDS))} END AS kind, CASE kind WHEN 'A' THEN 'result-status' WHEN 'R' THEN 'result-failure' ELSE CASE status WHEN 'F' THEN 'result-success' ELSE 'result' END END AS key, CASE status WHEN 'F' THEN 'OutcomeFailure' ELSE 'OutcomeSuccess' END AS incoming, line AS ordinal, method_id % 3 = 0 AS minimal, CASE WHEN method_id % 2 = 0 THEN method_id END AS source_ordinal FROM v_inv"


@query("node_order", f"""{with_views('v_inv')}, x AS ({_NODES}), y AS (SELECT *, CASE kind WHEN 'EntryPoint' THEN 0 WHEN 'Action' THEN 1 WHEN 'MethodCall' THEN 2 WHEN 'ServiceCall' THEN 2 WHEN 'EntityQuery' THEN 3 WHEN 'StateAssignment' THEN 4 WHEN 'EntityMutation' THEN 5 WHEN 'SourceObservation' THEN 6 WHEN 'Delay' THEN 10
    WHEN 'Result' THEN CASE key WHEN 'result-status' THEN 7 WHEN 'result-failure' THEN 8 WHEN 'result-success' THEN 10 ELSE 12 END WHEN 'Outcome' THEN CASE incoming WHEN 'OutcomeFailure' THEN 9 ELSE 11 END ELSE 13 END AS rank,
    CASE WHEN kind IN ('EntryPoint', 'Action', 'MethodCall', 'ServiceCall') THEN 0 WHEN kind IN ('EntityQuery', 'StateAssignment', 'EntityMutation') THEN 1 WHEN kind = 'SourceObservation' OR (kind IN ('Delay', 'Outcome') AND minimal) THEN 2 ELSE 3 END AS segment FROM x)
  SELECT owner, op_ord, segment, CAST(CASE WHEN segment = 1 OR kind = 'MethodCall' THEN ordinal WHEN segment = 2 AND minimal THEN coalesce(source_ordinal, 2147483647) ELSE rank END AS BIGINT) AS ordinal, rank FROM y""")
def _node_order(spark, d):
    order = render.node_order(*map(F.col, ("kind", "key", "incoming", "ordinal", "minimal", "source_ordinal")))
    return _read(spark, d, _NODES, "v_inv").withColumn("o", order).select("owner", "op_ord", "o.*")


@query("edge_order", f"""{with_views('v_inv')}, x AS (SELECT owner, op_ord, line, ['Entry', 'Call', 'Query', 'StateAssignment', 'Mutation', 'Save', 'Observation', 'ResultStatus', 'ResultFailure', 'OutcomeFailure', 'ResultSuccess', 'OutcomeSuccess', 'Other'][target % 13 + 1] AS kind, target % 13 AS rank FROM v_inv)
  SELECT owner, op_ord, CASE WHEN rank < 2 THEN 0 WHEN rank < 6 THEN 1 WHEN rank = 6 THEN 2 ELSE 3 END AS segment, CAST(CASE WHEN kind = 'Call' OR rank BETWEEN 2 AND 5 THEN line ELSE rank END AS BIGINT) AS ordinal, rank FROM x""")
def _edge_order(spark, d):
    kinds = F.array(*map(F.lit, [*render.EDGE_RANKS, "Other"]))
    rows = view(spark, d, "v_inv").withColumn("o", render.edge_order(F.element_at(kinds, (F.col("target") % 13 + 1).cast("int")), F.col("line")))
    return rows.select("owner", "op_ord", "o.*")


@query("exit_codes", f"{with_views('v_run')} SELECT run_id, CASE state WHEN 'Completed' THEN 0 WHEN 'Failed' THEN 3 ELSE 4 END AS code FROM v_run")
def _exits(spark, d):
    outcome = F.when(F.col("state") == "Completed", "Succeeded").when(F.col("state") == "Failed", "BuildFailure").otherwise(F.col("state"))
    return view(spark, d, "v_run").select("run_id", render.exit_code(outcome).alias("code"))


@query("entry_points", f"{with_views('v_method')} SELECT 'f' || method_id AS entry, method_id AS root, 'Framework' AS kind FROM v_method WHERE size < 20 AND has_body UNION ALL SELECT 'c' || method_id, method_id, 'Configured' FROM v_method WHERE size > 10 AND NOT (size < 20 AND has_body)")
def _entries(spark, d):
    named = lambda rows, mark, kind: rows.select(F.concat(F.lit(mark), "method_id").alias("entry"), F.col("method_id").alias("root"), F.lit(kind).alias("kind"))
    m = view(spark, d, "v_method")
    return catalog.entry_points(named(m.where("size < 20 and has_body"), "f", "Framework"), named(m.where("size > 10"), "c", "Configured"))


@query("symbol_universe", f"{with_views('v_method', 'v_member', 'v_hier')} SELECT name AS symbol FROM v_hier UNION SELECT name FROM v_member UNION SELECT type_name FROM v_method")
def _symbols(spark, d):
    named = lambda v, c="name": view(spark, d, v).select(F.col(c).alias("symbol"))
    return catalog.symbols(named("v_hier"), named("v_member"), named("v_method", "type_name"))


_TYPES = "SELECT project AS graph, CASE size % 8 WHEN 0 THEN 'service' WHEN 1 THEN replace(type_name, ' ', '.') WHEN 2 THEN replace(type_name, ' ', '+') ELSE type_name END AS type_name FROM v_method"


@query("participant_keys", f"""{with_views('v_method')}, x AS (SELECT DISTINCT * FROM ({_TYPES})), y AS (SELECT *, regexp_replace(type_name, '[^A-Za-z0-9_]', '_', 'g') AS bare FROM x)
  SELECT graph, type_name, CASE WHEN bare = 'service' OR count(*) OVER (PARTITION BY graph, bare) > 1 THEN bare || '_' || lower(hex(type_name)) ELSE bare END AS key FROM y""")
def _keys(spark, d):
    return catalog.participant_keys(_read(spark, d, _TYPES, "v_method"))


@query("ordered_children", f"""{with_views('v_run', 'v_inv')} SELECT run_id, state, row_number() OVER (PARTITION BY owner ORDER BY line, i.op_ord) - 1 AS ordinal, i.method_id, i.kind FROM v_run r JOIN v_inv i ON i.owner = r.run_id WHERE i.status = 'F' AND i.line > 2
  UNION ALL SELECT run_id, state, NULL, NULL, NULL FROM v_run WHERE run_id NOT IN (SELECT owner FROM v_inv WHERE status = 'F' AND line > 2)""")
def _children(spark, d):
    children = view(spark, d, "v_inv").where("status = 'F' and line > 2").withColumnRenamed("owner", "run_id")
    return joins.with_children(view(spark, d, "v_run").select("run_id", "state"), children, "run_id", ["line", "op_ord"], ["method_id", "kind"])


@query("created_routes", f"""{with_views('v_method', 'v_route')}, g AS (SELECT page_id % 97 AS target, url FROM v_route WHERE page_id % 3 > 0) SELECT m.method_id, CASE WHEN count(url) = 1 THEN min(url) END AS url FROM v_method m LEFT JOIN g ON g.target = m.method_id GROUP BY m.method_id""")
def _created(spark, d):
    routes = view(spark, d, "v_route").where("page_id % 3 > 0").select((F.col("page_id") % 97).alias("method_id"), "url")
    return joins.exactly_one(view(spark, d, "v_method").select("method_id"), routes, ["method_id"], "None", "Several", ["url"]).drop("code")
