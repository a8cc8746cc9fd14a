"""Queries on framework models and predicates, and their DuckDB counterparts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frameworks, joins, predicates
from .bind import view, with_views

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


_TYPE = "SELECT 't' || type_id AS type_id, replace(name, ' ', '') || 'Controller' AS name, type_id % 7 = 0 AS is_abstract, type_id % 5 <> 0 AS has_controller_base FROM v_hier"
_METHOD = "SELECT 'm' || member_id AS method_id, 't' || type_id AS type_id, name, member_id % 3 <> 0 AS is_public, member_id % 11 = 0 AS is_static, 0 AS arity, member_id AS k FROM v_member WHERE kind = 'customer'"
_VERB = "SELECT 'm' || member_id AS target, CASE member_id % 4 WHEN 0 THEN 'HttpGetAttribute' WHEN 1 THEN 'HttpPostAttribute' WHEN 2 THEN 'HttpPutAttribute' ELSE 'ObsoleteAttribute' END AS name, CASE WHEN member_id % 5 = 0 THEN '/top/' || (member_id % 9) ELSE (member_id % 9) || '/' || chr(123) || 'id' || chr(125) END AS argument FROM v_member WHERE kind = 'customer'"
_OTHER = "SELECT 't' || type_id AS target, 'RouteAttribute' AS name, 'api/[controller]' AS argument FROM v_hier WHERE type_id % 3 <> 0"
_NOT = "SELECT 'm' || member_id AS target, 'NonActionAttribute' AS name, NULL AS argument FROM v_member WHERE kind = 'customer' AND member_id % 13 = 0"


def _sql(spark, d, sql, *views):
    for v in views:
        sql = sql.replace(v, "{" + v + "}")
    return spark.sql(sql, **{v: view(spark, d, v) for v in views})


@query("http_entry_points", f"""{with_views('v_hier', 'v_member')}, t AS ({_TYPE}), m AS ({_METHOD}), a AS ({_VERB}), p AS ({_OTHER})
  SELECT DISTINCT method_id, CASE a.name WHEN 'HttpGetAttribute' THEN 'GET' WHEN 'HttpPostAttribute' THEN 'POST' ELSE 'PUT' END AS verb,
    '/' || CASE WHEN starts_with(a.argument, '/') THEN ltrim(a.argument, '/') WHEN p.argument IS NULL THEN a.argument ELSE 'api/' || regexp_replace(t.name, 'Controller$', '') || '/' || a.argument END AS route
  FROM m JOIN t ON t.type_id = m.type_id JOIN a ON a.target = m.method_id LEFT JOIN p ON p.target = t.type_id
  WHERE NOT is_abstract AND has_controller_base AND is_public AND NOT is_static AND k % 13 <> 0 AND a.name <> 'ObsoleteAttribute'""")
def _entries(spark, d):
    attributes = _sql(spark, d, _VERB, "v_member").unionAll(_sql(spark, d, _OTHER, "v_hier")).unionAll(_sql(spark, d, _NOT, "v_member"))
    return frameworks.controllers(_sql(spark, d, _TYPE, "v_hier"), _sql(spark, d, _METHOD, "v_member"), attributes)


_PARAM = "SELECT owner AS method_id, op_ord AS ordinal, CASE line WHEN 1 THEN 'id' WHEN 2 THEN 'p' ELSE 'other' END AS name, CASE WHEN line = 3 THEN 'System.Threading.CancellationToken' ELSE 'T' END AS type, line = 4 AS custom, line = 5 AS simple, line >= 6 AS body FROM v_inv"


@query("parameter_binding", f"""{with_views('v_inv')}, p AS ({_PARAM}), q AS (SELECT *, CASE WHEN name = 'id' OR (name = 'p' AND method_id % 2 = 0) THEN 'Route' WHEN type <> 'T' THEN 'Cancellation' WHEN custom THEN 'Unknown' WHEN simple THEN 'Query' END AS first FROM p)
  SELECT method_id, ordinal, coalesce(first, CASE WHEN body AND count(*) FILTER (first IS NULL AND body) OVER (PARTITION BY method_id) = 1 THEN 'Body' ELSE 'Unknown' END) AS binding FROM q""")
def _binding(spark, d):
    routes = view(spark, d, "v_inv").select(F.col("owner").alias("method_id")).distinct().withColumn("route", F.when(F.col("method_id") % 2 == 0, "/x/{id:int}/{p}").otherwise("/x/{id}"))
    return frameworks.bind_parameters(_sql(spark, d, _PARAM, "v_inv"), routes)


@query("query_chains", f"""{with_views('v_method')} SELECT method_id AS operation, CASE size % 3 WHEN 0 THEN 'SingleOrDefaultAsync' WHEN 1 THEN 'CountAsync' ELSE 'FirstOrDefaultAsync' END AS terminal, CASE WHEN size % 4 = 0 THEN 'AsNoTracking>Where' ELSE 'Include>Where' END AS steps
  FROM v_method WHERE size % 5 <> 0 AND size % 3 < 3 AND size % 7 <> 0 AND size % 11 <> 0 AND (size % 3 = 1 OR size % 2 = 0)""")
def _chains(spark, d):
    n = F.col("size")
    steps = F.when(n % 7 == 0, F.array(F.lit("AsNoTracking"), F.lit("AsNoTracking"))).when(n % 11 == 0, F.array(F.lit("OrderBy"))).when(n % 4 == 0, F.array(F.lit("AsNoTracking"), F.lit("Where"))).otherwise(F.array(F.lit("Include"), F.lit("Where")))
    terminal = F.when(n % 3 == 0, "SingleOrDefaultAsync").when(n % 3 == 1, "CountAsync").otherwise("FirstOrDefaultAsync")
    rows = view(spark, d, "v_method").select(F.col("method_id").alias("operation"), terminal.alias("terminal"), steps.alias("steps"), F.when(n % 2 == 0, "Equality").alias("predicate"), F.when(n % 5 != 0, "DbSet").otherwise("List").alias("source"))
    return frameworks.queries(rows)


@query("query_mutations", f"{with_views('v_method')} SELECT method_id AS operation, CASE size % 3 WHEN 0 THEN 'Add' WHEN 1 THEN 'SaveChangesAsync' END AS kind FROM v_method WHERE (size % 3 = 0 AND size % 2 = 0) OR (size % 3 = 1 AND size % 2 = 1)")
def _mutations(spark, d):
    n = F.col("size")
    member = F.when(n % 3 == 0, "Add").when(n % 3 == 1, "SaveChangesAsync").otherwise("Update")
    return frameworks.mutations(view(spark, d, "v_method").select(F.col("method_id").alias("operation"), member.alias("member"), F.when(n % 2 == 0, "DbSet").otherwise("DbContext").alias("receiver")))


@query("request_dispatch", f"""{with_views('v_method')}, h AS (SELECT type_name AS request, project AS response, count(*) AS n, min(method_id) AS handler FROM v_method WHERE size % 9 = 0 GROUP BY type_name, project)
  SELECT method_id AS operation, CASE WHEN n IS NULL THEN 'Unresolved' WHEN n = 1 THEN 'ExactSingle' ELSE 'Ambiguous' END AS resolution, CASE WHEN n = 1 THEN handler END AS handler FROM v_method m LEFT JOIN h ON h.request = m.type_name AND h.response = m.project""")
def _dispatch(spark, d):
    m = view(spark, d, "v_method")
    sends = m.select(F.col("method_id").alias("operation"), F.col("type_name").alias("request"), F.col("project").alias("response"))
    return frameworks.dispatches(sends, m.where("size % 9 = 0").select(F.col("method_id").alias("handler"), F.col("type_name").alias("request"), F.col("project").alias("response")))


@query("service_registrations", f"{with_views('v_method')} SELECT method_id AS operation, CASE size % 4 WHEN 0 THEN 'Scoped' WHEN 1 THEN 'Singleton' ELSE 'Transient' END AS lifetime, type_name AS service, name AS implementation FROM v_method WHERE size % 4 <> 3 AND has_body")
def _registrations(spark, d):
    n = F.col("size") % 4
    member = F.when(n == 0, "AddScoped").when(n == 1, "AddSingleton").when(n == 2, "AddTransient").otherwise("AddScopedFactory")
    return frameworks.registrations(view(spark, d, "v_method").select(F.col("method_id").alias("operation"), member.alias("member"), F.col("type_name").alias("service"), F.col("name").alias("implementation"), (~F.col("has_body")).alias("has_factory")))


@query("cache_regions", f"""{with_views('v_inv')}, c AS (SELECT owner, method_id, count(*) AS n, min(op_ord) AS fact FROM v_inv WHERE kind = 'R' GROUP BY ALL), b AS (SELECT owner, method_id, count(*) AS n, min(op_ord) AS boundary FROM v_inv GROUP BY ALL)
  SELECT c.owner, c.method_id, fact, boundary FROM c JOIN b ON b.owner = c.owner AND b.method_id = c.method_id WHERE c.n = 1 AND b.n = 1""")
def _caches(spark, d):
    rows = view(spark, d, "v_inv")
    return frameworks.cache_regions(rows.where("kind = 'R'").withColumnRenamed("op_ord", "fact"), rows.withColumnRenamed("op_ord", "boundary"), ["owner", "method_id"])


@query("callback_cardinality", f"""{with_views('v_inv')}, u AS (SELECT owner, bool_or(line = 7) AS esc, count(*) FILTER (line < 3) AS n, coalesce(bool_or(kind = 'R') FILTER (line < 3), false) AS in_loop, coalesce(bool_or(op_ord % 5 = 4) FILTER (line < 3), false) AS in_region, coalesce(bool_or(status = 'F') FILTER (line < 3), false) AS cond, coalesce(bool_or(kind = 'N') FILTER (line < 3), false) AS always FROM v_inv GROUP BY owner)
  SELECT owner AS callback, CASE WHEN esc OR n = 0 THEN 'Unbounded' WHEN in_region THEN 'Unknown' WHEN n > 1 OR in_loop THEN 'RepeatedOrUnknown' WHEN NOT cond AND always THEN 'ExactlyOnce' WHEN cond THEN 'ZeroOrOne' ELSE 'Unknown' END AS cardinality FROM u""")
def _callbacks(spark, d):
    kind = F.when(F.col("line") == 7, "escape").when(F.col("line") < 3, "invoke").otherwise("read")
    return frameworks.callback_cardinality(view(spark, d, "v_inv").select(F.col("owner").alias("callback"), kind.alias("kind"), (F.col("kind") == "R").alias("in_loop"), (F.col("op_ord") % 5 == 4).alias("in_region"), (F.col("status") == "F").alias("conditional"), (F.col("kind") == "N").alias("on_every_path")))


def _claims(spark, d):
    """Two models that agree on some facts and not on others."""
    m = view(spark, d, "v_method")

    def first(rows):
        return rows.select(F.concat(F.lit("f"), "method_id").alias("fact_id"), F.lit("Query").alias("kind"), F.when(F.col("size") % 10 != 0, F.col("project")).alias("owner"), F.col("type_name").alias("payload"), F.lit(0).alias("certainty"))

    def second(rows):
        return first(rows.where("size % 2 = 0")).withColumn("payload", F.when(F.expr("crc32(fact_id) % 3 = 0"), F.lit("other")).otherwise(F.col("payload")))

    models = [frameworks.Model("b", 200, frozenset({"p"}), second), frameworks.Model("a", 100, frozenset(), first), frameworks.Model("never", 1, frozenset({"absent"}), first)]
    return frameworks.run_models(models, {"p"}, m)


# crc32 is not at hand in DuckDB, so conflicts are told by counting there what both dialects can compute.
@query("model_facts_without_producer", f"{with_views('v_method')} SELECT 'f' || method_id AS fact_id, 'SEQFW001' AS code FROM v_method WHERE size % 10 = 0 UNION ALL SELECT 'f' || method_id, 'SEQFW001' FROM v_method WHERE size % 10 = 0")
def _bare(spark, d):
    return _claims(spark, d)[1].where("code = 'SEQFW001'")


# Heap-shaped trees: comparisons of two leaves take numbers, all else booleans, and one leaf in sixty a string, which nothing here admits.
_NODES = """SELECT x.owner AS tree, x.op_ord AS node, CASE WHEN x.op_ord > 0 THEN (x.op_ord - 1) // 2 END AS parent, x.op_ord AS place,
  CASE WHEN x.op_ord * 2 + 2 < x.n THEN 'binary' WHEN x.op_ord * 2 + 1 < x.n THEN 'unary' WHEN x.target % 3 = 0 THEN 'local' ELSE 'constant' END AS kind,
  CASE WHEN x.op_ord * 2 + 2 < x.n THEN x.operator WHEN x.op_ord * 2 + 1 < x.n THEN '!' END AS operator,
  CASE WHEN x.target % 60 = 7 THEN 'System.String' WHEN p.operator IN ('==', '<=') AND p.op_ord * 4 + 3 >= p.n AND p.op_ord * 2 + 2 < p.n THEN 'System.Int32' ELSE 'System.Boolean' END AS type,
  CASE WHEN x.target % 3 = 0 THEN 'local' || CAST(x.target AS VARCHAR) WHEN p.operator IN ('==', '<=') AND p.op_ord * 4 + 3 >= p.n AND p.op_ord * 2 + 2 < p.n THEN CAST(x.target AS VARCHAR) WHEN x.target % 2 = 0 THEN 'True' ELSE 'False' END AS constant
  FROM y AS x LEFT JOIN y AS p ON p.owner = x.owner AND x.op_ord > 0 AND p.op_ord = (x.op_ord - 1) // 2"""
_OPERATORS = "SELECT *, count(*) OVER (PARTITION BY owner) AS n, CASE method_id % 4 WHEN 0 THEN '&&' WHEN 1 THEN '||' WHEN 2 THEN '==' ELSE '<=' END AS operator FROM v_inv"


def _trees(spark, d):
    """The nodes of _NODES, without its join: a parent of two leaves answers them by its place, within their tree."""
    rows = joins.dealt(view(spark, d, "v_inv").select("owner", "op_ord", "method_id", "target"), "owner")
    rows = spark.sql(_OPERATORS.replace("v_inv", "{v_inv}"), v_inv=rows)
    ask = lambda key, answers: F.struct(F.expr(key).alias("parent"), F.lit(answers).alias("answers"))
    own, answer = ask("CASE WHEN op_ord > 0 THEN (op_ord - 1) div 2 END", False), ask("op_ord", True)
    both = F.expr("op_ord * 4 + 3 >= n and op_ord * 2 + 2 < n")
    rows = rows.select(F.col("owner").alias("tree"), F.col("op_ord").alias("node"), F.col("op_ord").alias("place"), "n", "target", "operator", F.inline(F.when(both, F.array(own, answer)).otherwise(F.array(own))))
    # Siblings and the answer to them, in the order in which trees are folded.
    siblings = Window.partitionBy("tree", "parent").orderBy("place", "node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = F.max(F.when(F.col("answers"), F.col("operator"))).over(siblings)
    rows = rows.withColumn("compares", F.coalesce(above.isin("==", "<="), F.lit(False)) & F.col("tree").isNotNull()).where("not answers")
    return rows.selectExpr(
        "tree", "node", "parent", "place",
        "CASE WHEN node * 2 + 2 < n THEN 'binary' WHEN node * 2 + 1 < n THEN 'unary' WHEN target % 3 = 0 THEN 'local' ELSE 'constant' END AS kind",
        "CASE WHEN node * 2 + 2 < n THEN operator WHEN node * 2 + 1 < n THEN '!' END AS operator",
        "CASE WHEN target % 60 = 7 THEN 'System.String' WHEN compares THEN 'System.Int32' ELSE 'System.Boolean' END AS type",
        "CASE WHEN target % 3 = 0 THEN 'local' || CAST(target AS STRING) WHEN compares THEN CAST(target AS STRING) WHEN target % 2 = 0 THEN 'True' ELSE 'False' END AS constant",
    )


def _fold_sql(leaf: str, unary: str, binary: str) -> str:
    """Levels from the deepest up: seven of them hold trees of 127 nodes, of which no owner here has half. t is null where a tree is withheld."""
    out = f"{with_views('v_inv')}, y AS MATERIALIZED ({_OPERATORS}), t AS MATERIALIZED ({_NODES}), l6 AS (SELECT tree, node, {leaf} AS x, type AS t, 9 AS r FROM t WHERE kind IN ('constant', 'local') AND node >= 63)"
    for k in range(5, -1, -1):
        below = f"l{k + 1}"
        out += f""", l{k} AS MATERIALIZED (SELECT t.tree, t.node, CASE WHEN kind IN ('constant', 'local') THEN {leaf} WHEN kind = 'unary' THEN {unary} ELSE {binary} END AS x,
          CASE WHEN kind IN ('constant', 'local') THEN type WHEN kind = 'unary' THEN CASE WHEN a.t = 'System.Boolean' THEN a.t END
            WHEN operator IN ('&&', '||') THEN CASE WHEN a.t = 'System.Boolean' AND b.t = 'System.Boolean' THEN a.t END
            WHEN a.t = b.t AND (a.t <> 'System.String' OR operator = '==') THEN 'System.Boolean' END AS t,
          CASE WHEN kind IN ('constant', 'local') THEN 9 WHEN kind = 'unary' THEN 7 ELSE CASE operator WHEN '||' THEN 1 WHEN '&&' THEN 2 WHEN '==' THEN 3 ELSE 4 END END AS r
          FROM t LEFT JOIN {below} a ON a.tree = t.tree AND a.node = 2 * t.node + 1 LEFT JOIN {below} b ON b.tree = t.tree AND b.node = 2 * t.node + 2 WHERE t.node >= {2**k - 1} AND t.node < {2 ** (k + 1) - 1})"""
    return out + " SELECT tree, CASE WHEN t IS NOT NULL THEN x END AS text, CASE WHEN t IS NULL THEN 'PRED001' END AS code FROM l0 WHERE node = 0"


_FR = "length({0}) || ':' || {0}"
_TYPED = _FR.format("type")
_LEAF = f"CASE WHEN kind = 'local' THEN CASE WHEN t.node = 0 AND type = 'System.Boolean' THEN 'truth(14:System.Boolean,sym(' ELSE 'sym(' END || {_TYPED} || ',' || {_FR.format('constant')} || CASE WHEN t.node = 0 AND type = 'System.Boolean' THEN '))' ELSE ')' END"
_LEAF += f" WHEN type = 'System.Int32' THEN 'num(' || {_TYPED} || ',' || {_FR.format('constant')} || ')' WHEN type = 'System.String' THEN 'str(' || {_TYPED} || ',' || {_FR.format('constant')} || ')' ELSE 'bool(' || {_TYPED} || ',' || {_FR.format('lower(constant)')} || ')' END"
_OP = "CASE operator WHEN '||' THEN 1 WHEN '&&' THEN 2 WHEN '==' THEN 3 ELSE 4 END"
_NAMED = "CASE operator WHEN '||' THEN 'or(14:System.Boolean' WHEN '&&' THEN 'and(14:System.Boolean' WHEN '==' THEN 'cmp(14:System.Boolean,5:Equal' ELSE 'cmp(14:System.Boolean,15:LessThanOrEqual' END"


@query("predicate_canonical", _fold_sql(_LEAF, "'neg(14:System.Boolean,' || a.x || ')'", f"{_NAMED} || ',' || a.x || ',' || b.x || ')'"))
def _canonical(spark, d):
    return predicates.canonical(_trees(spark, d))


@query("predicate_text", _fold_sql("constant", "'!' || CASE WHEN a.r < 7 THEN '(' || a.x || ')' ELSE a.x END", f"CASE WHEN a.r < {_OP} THEN '(' || a.x || ')' ELSE a.x END || ' ' || operator || ' ' || CASE WHEN b.r <= {_OP} THEN '(' || b.x || ')' ELSE b.x END"))
def _readable(spark, d):
    return predicates.readable(_trees(spark, d))
