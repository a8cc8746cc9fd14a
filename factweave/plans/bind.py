"""Fact views over relational test tables, so that every operator can run, and be checked, on them.

Each view is one SQL text that Spark and DuckDB read alike; {table} stands for a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.calls import kept

VIEWS = {
    # Methods with their containing type and project.
    "v_method": "SELECT p_partkey AS method_id, p_type AS type_name, p_brand AS project, p_name AS name, p_size % 5 <> 0 AS has_body, p_partkey % 23 <> 0 AS loaded, CAST(CASE p_partkey % 29 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS flows, CAST(p_size AS BIGINT) AS size FROM {part}",
    # Invocations in source order; the natural key repeats, so the ordinal comes from a total order.
    "v_inv": "SELECT l_orderkey AS owner, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS BIGINT) - 1 AS op_ord, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS method_id, l_suppkey AS target, l_returnflag AS kind, l_linestatus AS status FROM {lineitem}",
    # Call edges: an invocation calls the next one of its owner.
    "v_call": "SELECT caller, callee, owner, op_ord, (owner + op_ord) % 11 = 3 AS guarded FROM (SELECT method_id AS caller, lead(method_id) OVER (PARTITION BY owner ORDER BY op_ord) AS callee, owner, op_ord FROM v_inv) AS c WHERE callee IS NOT NULL",
    # Basic blocks: the events of a user are the blocks of one method, the block after the last is its exit. Views decide,
    # purchases return, errors throw, throw again or end in a way unknown, and two of three throws escape.
    "v_block": """SELECT f.user_id AS method, ord, n, event_type,
      CASE WHEN event_type = 'view' AND event_id % n <> ord + 1 THEN event_id % n END AS cond_succ,
      CASE WHEN event_type IN ('view','click','signup') THEN ord + 1 WHEN event_type = 'purchase' THEN n END AS fall,
      CASE WHEN event_type = 'view' AND event_id % n <> ord + 1 THEN 'Conditional' WHEN event_type = 'purchase' THEN 'Return'
        WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'Rethrow' WHEN 1 THEN 'Unknown' ELSE 'Throw' END ELSE 'None' END AS terminal,
      event_id % 3 <> 0 AS escaping
      FROM (SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS ord FROM {events}) AS f
      JOIN (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id) AS c ON f.user_id = c.user_id""",
    "v_edge": "SELECT method, ord AS source, fall AS target, 'Fall' AS way FROM v_block WHERE fall IS NOT NULL UNION ALL SELECT method, ord, cond_succ, 'Cond' FROM v_block WHERE cond_succ IS NOT NULL",
    "v_node": "SELECT method, ord AS node FROM v_block UNION SELECT method, n FROM v_block",
    # Definitions of locals in evaluation order.
    "v_def": "SELECT user_id AS method, event_type AS local_name, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS ord FROM {events}",
    # Operations: the invocations of an owner are the operations of one method, three to a block, and take earlier ones as operands.
    "v_op": """SELECT owner AS method, op_ord AS op, CAST(floor(op_ord / 3) AS BIGINT) AS block, CAST(target * 5 % 4 AS BIGINT) AS evaluation, kind, target % 2 = 0 AS is_root,
      CASE WHEN kind = 'ParameterReference' AND target % 4 <> 1 THEN target % 4 END AS parameter, CASE WHEN kind = 'LocalReference' THEN 'local' || (target % 2) END AS local_name,
      CASE WHEN kind IN ('FieldReference', 'PropertyReference') AND target % 5 <> 1 THEN 'member' || (target % 9) END AS member, target, line, method_id
      FROM (SELECT owner, op_ord, target, line, method_id, CASE method_id % 20 WHEN 0 THEN 'ParameterReference' WHEN 1 THEN 'Literal' WHEN 2 THEN 'LocalReference' WHEN 3 THEN 'LocalReference' WHEN 4 THEN 'Assignment'
        WHEN 5 THEN 'CompoundAssignment' WHEN 6 THEN 'Invocation' WHEN 7 THEN 'ObjectCreation' WHEN 8 THEN 'Await' WHEN 9 THEN 'Return' WHEN 10 THEN 'Throw' WHEN 11 THEN 'FieldReference' WHEN 12 THEN 'PropertyReference'
        WHEN 13 THEN 'Conversion' WHEN 14 THEN 'ExpressionStatement' WHEN 15 THEN 'Unknown' WHEN 16 THEN 'DynamicInvocation' WHEN 17 THEN 'EventAssignment' WHEN 18 THEN 'Assignment' ELSE 'Binary' END AS kind FROM v_inv) AS i""",
    "v_operand": """SELECT method, op, CAST(0 AS BIGINT) AS place, op - 1 AS operand FROM v_op WHERE op >= 1 AND target % 6 <> 0
      UNION ALL SELECT method, op, CAST(1 AS BIGINT), op - 2 FROM v_op WHERE op >= 2 AND target % 3 <> 0""",
    # Evidence with certainty: 0 exact, 1 conservative, 2 heuristic, 3 unknown.
    "v_evid": "SELECT d.doc_id AS evidence_id, d.source AS owner, d.lang AS artifact, CASE WHEN l.quality IS NULL THEN 3 WHEN l.toxic = 1 THEN 2 WHEN l.quality = 0 THEN 1 ELSE 0 END AS certainty FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    # Runs of profiles; the sequence orders them.
    "v_run": "SELECT o_orderkey AS run_id, o_custkey AS profile, o_orderdate AS started, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Staging' ELSE 'Failed' END AS state, o_orderpriority AS stage FROM {orders}",
    "v_route": "SELECT page_id, url FROM {pages}",
    "v_msg": "SELECT conv_id AS plan, turn AS ord, role AS participant, text FROM {conversations}",
    "v_cfg": "SELECT event_id, user_id, event_type, props, value FROM {events}",
    "v_hier": "SELECT n.n_nationkey AS type_id, n.n_name AS name, n.n_regionkey AS namespace_id, r.r_name AS namespace FROM {nation} n LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey",
    # Facts of a scenario graph: entries on methods, services by arithmetic on ids, the facts of a service method from a user's events.
    "v_g_entry": "SELECT 'e' || method_id AS entry, method_id AS root, CASE WHEN method_id % 4 = 0 THEN 'Configured' WHEN method_id % 4 = 1 THEN 'Minimal' ELSE 'Controller' END AS kind, name AS label FROM v_method WHERE size < 40 UNION ALL SELECT 'gone', -1, 'Controller', type_name FROM v_method WHERE method_id = 1",
    "v_g_method": "SELECT method_id, name, type_name || '/' || project AS type_name, has_body, loaded, flows, size % 7 = 0 AS is_constructor FROM v_method",
    "v_g_call": "SELECT caller, callee, owner, op_ord, owner * 100 + op_ord AS operation, guarded FROM v_call",
    "v_g_root": "SELECT caller, callee, owner * 100 + op_ord AS operation, CAST(row_number() OVER (PARTITION BY caller ORDER BY owner, op_ord) AS BIGINT) - 1 AS place FROM v_call WHERE (owner + op_ord) % 3 = 0",
    "v_g_dispatch": "SELECT method_id AS method, owner * 100 + op_ord AS operation, 'R' || (target % 9) AS request_type, CASE target % 5 WHEN 0 THEN 'Ambiguous' WHEN 1 THEN 'OpenGeneric' WHEN 2 THEN 'Unresolved' ELSE 'ExactSingle' END AS resolution, CASE WHEN target % 5 > 2 AND target % 11 > 0 THEN target END AS handler FROM v_inv WHERE kind = 'R' AND method_id % 6 = 1 AND line = 2",
    "v_g_bind": """SELECT method_id AS constructor, 'S' || (method_id * 3 % 40) AS service_type, 'I' || (method_id * 3 % 40) AS implementation, CASE WHEN method_id % 19 > 0 THEN method_id END AS registration FROM v_method WHERE size % 7 = 0 AND method_id % 8 > 0
      UNION ALL SELECT method_id, 'S' || ((method_id * 3 + 1) % 40), 'I' || ((method_id * 3 + 1) % 40), method_id FROM v_method WHERE size % 7 = 0 AND method_id % 3 = 0 UNION ALL SELECT method_id, 'S' || (method_id * 3 % 40), 'X', method_id FROM v_method WHERE size % 7 = 0 AND method_id % 9 = 0""",
    "v_g_site": "SELECT method_id AS caller, owner * 100 + op_ord AS site, owner * 100 + op_ord AS operation, 'S' || (target % 40) AS declared_type, line <> 3 AS complete FROM v_inv WHERE (owner + op_ord) % 4 = 0",
    "v_g_cand": "SELECT owner * 100 + op_ord AS site, target AS candidate, CASE WHEN target % 7 = 0 THEN 'J' ELSE 'I' || (target % 40) END AS declaring_type FROM v_inv UNION ALL SELECT owner * 100 + op_ord, target + 1, 'I' || (target % 40) FROM v_inv WHERE line = 5",
    "v_g_step": "SELECT method, event_id AS operation, CASE local_name WHEN 'view' THEN 'EntityQuery' WHEN 'click' THEN 'StateAssignment' ELSE CASE WHEN event_id % 3 = 0 THEN 'Save' ELSE 'Mutation' END END AS kind, local_name || ' on T' || (event_id % 7) AS detail, ord AS ordinal FROM v_def WHERE local_name IN ('view', 'click', 'purchase')",
    "v_g_obs": "SELECT method, event_id AS observation, event_id AS operation, local_name AS detail FROM v_def WHERE local_name = 'signup'",
    "v_g_end": "SELECT method_id AS method, owner * 100 + op_ord AS operation, CASE target % 5 WHEN 0 THEN 'Ok' WHEN 1 THEN 'CreatedAtAction' WHEN 2 THEN 'BadRequest' WHEN 3 THEN 'NotFound' ELSE 'Redirect' END AS helper, CASE WHEN target % 5 = 1 AND line > 1 THEN target * 2 END AS created, target, line, kind, owner, op_ord FROM v_inv",
    "v_g_arm": "SELECT method, 'M' || line AS member, operation, owner AS switch, 'E' || (method % 4) AS enum, helper, created FROM v_g_end WHERE kind = 'N' AND method % 3 = 0 AND op_ord % 3 = 0",
    "v_g_terminal": "SELECT method, operation, helper, created, line AS ordinal FROM v_g_end WHERE kind = 'A' AND method % 3 = 0 AND op_ord % 4 = 0 UNION ALL SELECT method, operation, helper, created, 9 FROM v_g_arm WHERE operation % 2 = 0",
    "v_g_outcome": """SELECT method, operation, CASE WHEN target % 13 = 0 THEN 'Conflict' ELSE helper END AS helper, CASE target % 5 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 400 WHEN 3 THEN 404 ELSE 302 END AS status FROM v_g_end WHERE line <> 4 AND (method % 3 = 0 OR (op_ord = 0 AND owner % 3 = 0))
      UNION ALL SELECT method, operation, helper, 500 FROM v_g_end WHERE line = 6 AND method % 3 = 0""",
    "v_g_route": "SELECT method_id AS root, '/r/' || name AS route FROM v_method WHERE size % 3 = 0 UNION ALL SELECT method_id, '/s/' || name FROM v_method WHERE method_id % 10 = 0",
    "v_g_decision": "SELECT method_id AS method, 'r' || (size % 3) AS local FROM v_method WHERE size % 11 > 0",
    "v_g_factory": "SELECT method, event_id AS operation, CASE WHEN event_id % 2 = 0 THEN 'Success' ELSE 'NotFound' END AS outcome, 'T' || (method % 2) AS type_name FROM v_def WHERE ord IN (1, 2, 3)",
    "v_g_returned": "SELECT method, event_id AS operation FROM v_def WHERE event_id % 3 > 0",
    "v_g_local": "SELECT method_id AS method, 'r' || (size % 3) AS name, 'T' || (method_id % 2) AS type_name FROM v_method WHERE size % 13 > 0",
    "v_g_path": "SELECT method_id AS method, 'Success' AS outcome, 'Ok' AS helper FROM v_method UNION ALL SELECT method_id, 'NotFound', 'NotFound' FROM v_method UNION ALL SELECT method_id, 'Success', 'CreatedAtAction' FROM v_method WHERE size % 2 = 0 UNION ALL SELECT method_id, 'NotFound', 'Ok' FROM v_method WHERE size % 5 = 0",
    # Dispatches to handlers, whose bodies are a method's invocations over all owners; a site repeats or fails now and then.
    "v_d_dispatch": """SELECT owner * 100 + op_ord AS dispatch, CASE WHEN line = 5 THEN 'Notification' ELSE 'RequestResponse' END AS boundary, CASE WHEN line = 6 THEN 'Many' ELSE 'ExactlyOne' END AS cardinality,
      CASE method_id % 9 WHEN 0 THEN 'Ambiguous' WHEN 1 THEN 'GeneratedBodyUnavailable' WHEN 2 THEN 'OpenGeneric' ELSE 'ExactSingle' END AS resolution, CASE WHEN method_id % 23 > 0 THEN target END AS handler, method_id % 10 > 0 AS body_available, CASE WHEN method_id % 4 > 0 THEN 'R' || (target % 5) END AS response_type FROM v_inv WHERE kind = 'R' AND owner % 5 = 0""",
    "v_d_method": "SELECT method_id, CASE method_id % 7 WHEN 0 THEN 'System.Threading.Tasks.Task<R' || (method_id % 5) || '>' WHEN 1 THEN 'A.Box<R>' WHEN 2 THEN 'System.Threading.Tasks.ValueTask<R0>' ELSE 'R' || (method_id % 5) END AS return_type, flows FROM v_method WHERE method_id % 31 > 0",
    "v_d_inv": "SELECT method_id AS caller, owner * 100 + op_ord AS op, owner * 100 + op_ord AS node, owner % 40 AS block, line AS evaluation, target, 'T' || (target % 6) AS type_name, CASE WHEN target % 29 > 0 THEN 'M' || target END AS member_name, 'Exact' AS certainty, true AS proven, line <> 2 AS source_backed, line = 3 AS platform, op_ord = 4 AS nested, false AS dynamic, false AS delegate, false AS constructor FROM v_inv WHERE (owner + op_ord) % 3 = 0",
    "v_d_site": """SELECT caller, op, op AS site, target AS declared_target, 'Exact' AS site_certainty, true AS site_proven, CASE WHEN target % 8 = 0 THEN 'Cha' ELSE 'DirectExact' END AS resolution, evaluation <> 7 AS complete, CAST(1 AS BIGINT) AS candidates, target AS candidate, 'Exact' AS resolution_certainty, true AS resolution_proven FROM v_d_inv WHERE block <> 17
      UNION ALL SELECT caller, op, op + 1, target, 'Exact', true, 'DirectExact', true, CAST(1 AS BIGINT), target, 'Exact', true FROM v_d_inv WHERE block = 18""",
    "v_d_return": "SELECT method, event_id AS operation FROM v_def WHERE local_name = 'purchase' AND event_id % 9 = 0",
    "v_member": "SELECT s_suppkey AS member_id, CAST(s_nationkey AS BIGINT) AS type_id, s_name AS name, 'supplier' AS kind FROM {supplier} UNION ALL SELECT c_custkey, CAST(c_nationkey AS BIGINT), c_name, 'customer' FROM {customer}",
}


def needs(name: str) -> list[str]:
    """The view and those that it reads, in the order in which they can be defined."""
    out: list[str] = []
    for other in re.findall(r"\bv_\w+", VIEWS[name]):
        out += [x for x in needs(other) if x not in out]
    return [*out, name]


def view(spark: SparkSession, sf_dir: str, name: str, ready: dict[str, DataFrame] | None = None) -> DataFrame:
    """The view over the tables in sf_dir, and over those views and tables that keep() has made ready."""
    if ready and name in ready:
        return ready[name].toDF(*ready[name].columns)
    sql = VIEWS[name]
    tables = {t: ready[t] if ready and t in ready else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    for other in set(re.findall(r"\bv_\w+", sql)):
        tables[other] = view(spark, sf_dir, other, ready)
        sql = re.sub(rf"\b{other}\b", "{" + other + "}", sql)
    return spark.sql(sql, **tables)


def keep(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Views made once for a query that reads them many times: each reading would deal and sort the whole table again. Later ones are made of earlier ones."""
    ready: dict[str, DataFrame] = {}
    if "v_inv" in names:
        # Dealt as they are read: the view's own names for the columns that order them would be dealt beside these.
        inv = view(spark, sf_dir, "v_inv", {"lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition("l_orderkey")})
        if "v_call" in names:
            # What an invocation calls is told where its owner's lie in order, so that they are neither dealt again nor kept twice.
            told = kept(inv.withColumn("callee", F.lead("method_id").over(Window.partitionBy("owner").orderBy("op_ord"))))
            guarded = (F.col("owner") + F.col("op_ord")) % 11 == 3
            ready = {"v_inv": told.select(*inv.columns), "v_call": told.where("callee is not null").select(F.col("method_id").alias("caller"), "callee", "owner", "op_ord", guarded.alias("guarded"))}
        else:
            ready = {"v_inv": kept(inv)}
    for name in names:
        if name not in ready:
            ready[name] = kept(view(spark, sf_dir, name, ready))
    return ready


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines the views for DuckDB, open for further definitions."""
    order: list[str] = []
    for name in names:
        order += [x for x in needs(name) if x not in order]
    parts = ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}"
