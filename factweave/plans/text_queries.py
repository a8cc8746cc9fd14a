"""Queries on scalar functions, the catalog, lifecycle and rendering, and their DuckDB counterparts."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, facts, render
from .bind import view, with_views

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


_ENTITIES = {
    "Project": ("v_hier", "namespace_id", "namespace", "NULL", "'region'"),
    "Type": ("v_hier", "type_id", "name", "namespace", "'type'"),
    "Member": ("v_member", "member_id", "name", "NULL", "kind"),
    "Method": ("v_method", "method_id", "name", "type_name", "project"),
    "Invocation": ("v_inv", "owner * 1000 + op_ord", "kind", "status", "target"),
    "Run": ("v_run", "run_id", "state", "stage", "profile"),
}
_ALL = " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({i} AS VARCHAR) AS id, CAST({n} AS VARCHAR) AS name, CAST({c} AS VARCHAR) AS context, CAST({t} AS VARCHAR) AS detail FROM {v}" for k, (v, i, n, c, t) in _ENTITIES.items())
_CAT = f"{with_views('v_hier', 'v_member', 'v_method', 'v_inv', 'v_run')}, cat AS ({_ALL})"


def _catalog(spark, d, *kinds):
    chosen = {k: _ENTITIES[k] for k in kinds or _ENTITIES}
    return catalog.catalog({k: view(spark, d, v).select(F.expr(i).alias("id"), F.expr(n).alias("name"), F.expr(c).alias("context"), F.expr(t).alias("detail")) for k, (v, i, n, c, t) in chosen.items()})


@query("catalog_all", f"{_CAT} SELECT * FROM cat")
def _cat_all(spark, d):
    """The whole catalog in its order: kind, then id."""
    return _catalog(spark, d).orderBy("kind", "id", "name")


@query("catalog_kind", f"{_CAT} SELECT * FROM cat WHERE kind = 'Method'")
def _cat_kind(spark, d):
    return catalog.of_kind(_catalog(spark, d), "Method")


@query("catalog_text", f"{_CAT} SELECT * FROM cat WHERE contains(lower(id), 'promo') OR contains(lower(name), 'promo') OR coalesce(contains(lower(context), 'promo'), false) OR contains(lower(detail), 'promo')")
def _cat_text(spark, d):
    return catalog.with_text(_catalog(spark, d), "Promo")


@query("catalog_prefix_unique", f"{_CAT}, p AS (SELECT DISTINCT left(id, 3) AS prefix FROM cat WHERE kind = 'Method' UNION SELECT 'zz'), h AS (SELECT prefix, count(id) AS n, min(id) AS id, arg_min(name, id) AS name FROM p LEFT JOIN (SELECT * FROM cat WHERE kind = 'Method') ON left(id, length(prefix)) = prefix GROUP BY prefix) SELECT prefix, CASE WHEN n = 1 THEN id END AS id, CASE WHEN n = 1 THEN name END AS name, CASE WHEN n = 0 THEN 'SD4002' WHEN n > 1 THEN 'SD4003' END AS code FROM h")
def _cat_prefix(spark, d):
    methods = _catalog(spark, d, "Method")
    prefixes = methods.select(F.left("id", F.lit(3)).alias("prefix")).unionAll(spark.createDataFrame([("zz",)], "prefix string")).distinct()
    return catalog.by_prefix(methods, prefixes)


@query("index_counts", f"{_CAT} SELECT kind, count(*) AS n FROM cat GROUP BY kind")
def _counts(spark, d):
    return catalog.counts({k: view(spark, d, v) for k, (v, *_) in _ENTITIES.items()})


_DIAG = "CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Warning' ELSE 'Info' END"


@query("severity_counts", f"SELECT user_id, count(*) FILTER (s = 'Error') AS error, count(*) FILTER (s = 'Warning') AS warning, count(*) FILTER (s = 'Info') AS info FROM (SELECT user_id, {_DIAG} AS s FROM events) GROUP BY user_id")
def _severity(spark, d):
    return catalog.severity_counts(view(spark, d, "v_cfg").withColumn("severity", F.expr(_DIAG)), ["user_id"])


_TOLD = f"SELECT event_id AS id, {_DIAG} AS severity, event_type AS stage, 'SD' || (user_id % 4) AS code, 'message ' || (event_id % 3) AS message, props AS detail, 'p' || (user_id % 2) AS project, CASE WHEN event_id % 4 > 0 THEN 'd' || (event_id % 2) END AS document, event_id % 2 AS line FROM v_cfg"
_SHOWN = ["severity", "stage", "code", "message", "detail", "project", "document", "line"]


@query("shown_diagnostics", f"{with_views('v_cfg')} SELECT {', '.join(_SHOWN)}, min(id) AS id FROM ({_TOLD}) GROUP BY {', '.join(_SHOWN)} ORDER BY CASE severity WHEN 'Error' THEN 1 WHEN 'Warning' THEN 2 ELSE 3 END, stage, code, id LIMIT 20")
def _shown(spark, d):
    return catalog.shown_diagnostics(spark.sql(_TOLD.replace("v_cfg", "{c}"), c=view(spark, d, "v_cfg")), _SHOWN)


@query("active_runs", f"{with_views('v_run')} SELECT profile, arg_max(run_id, (started, run_id)) AS run_id FROM v_run WHERE state = 'Completed' GROUP BY profile")
def _active(spark, d):
    return catalog.run_actives(view(spark, d, "v_run"))


@query("pointer_upsert", f"{with_views('v_run')}, a AS (SELECT profile, arg_max(run_id, (started, run_id)) AS run_id FROM v_run WHERE state = 'Completed' GROUP BY profile), n AS (SELECT profile, max(run_id) AS run_id FROM v_run WHERE state = 'Staging' AND profile % 3 = 0 GROUP BY profile) SELECT * FROM n UNION ALL SELECT * FROM a WHERE profile NOT IN (SELECT profile FROM n)")
def _upsert(spark, d):
    runs = view(spark, d, "v_run")
    new = runs.where("state = 'Staging' and profile % 3 = 0").groupBy("profile").agg(F.max("run_id").alias("run_id"))
    return catalog.upsert(catalog.run_actives(runs), new, "profile")


@query("run_state_machine", f"{with_views('v_run')} SELECT profile, run_id, before, state FROM (SELECT *, lag(state) OVER (PARTITION BY profile ORDER BY started, run_id) AS before FROM v_run) WHERE before = 'Staging'")
def _states(spark, d):
    return catalog.illegal_transitions(view(spark, d, "v_run"))


@query("stable_id", f"""{with_views('v_method')} SELECT method_id, 'method:v1:' || sha256('{{"project":"' || project || '","type":"' || type_name || '","ordinal":' || method_id || ',"parent":null}}') AS stable_id FROM v_method""")
def _ids(spark, d):
    m = view(spark, d, "v_method")
    fields = {"project": F.col("project"), "type": F.col("type_name"), "ordinal": F.col("method_id"), "parent": F.lit(None).cast("string")}
    return m.select("method_id", text.stable_id("method", fields).alias("stable_id"))


_LINES = "SELECT project, method_id AS place, length(name) || ':' || name || length(CAST(method_id AS VARCHAR)) || ':' || method_id AS line FROM v_method"
_HASHED = "SELECT project, place // 4096 AS place, sha256(string_agg(line, chr(10) ORDER BY place, line)) AS line FROM ({}) GROUP BY project, place // 4096"


@query("snapshot_fingerprint", f"{with_views('v_method')} SELECT project, sha256(string_agg(line, chr(10) ORDER BY place)) AS fingerprint FROM ({_HASHED.format(_HASHED.format(_HASHED.format(_LINES)))}) GROUP BY project")
def _fingerprint(spark, d):
    line = text.framed([F.col("name"), F.col("method_id").cast("string")])
    return facts.fingerprint(view(spark, d, "v_method"), "project", "method_id", line)


@query("slug", f"{with_views('v_method')} SELECT method_id, regexp_replace(regexp_replace(lower(type_name || '.' || name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '-' || right('00000000' || method_id, 8) AS entry_key FROM v_method")
def _slug(spark, d):
    return view(spark, d, "v_method").select("method_id", text.entry_key(F.concat_ws(".", "type_name", "name"), F.concat(F.lit("00000000"), F.col("method_id").cast("string"))).alias("entry_key"))


@query("route_combine", f"{with_views('v_method')} SELECT method_id, '/' || replace(trim(CASE WHEN size % 4 = 0 THEN project ELSE 'api/[controller]/' || project END, '/'), '[controller]', type_name) AS route FROM v_method")
def _route(spark, d):
    template = F.when(F.col("size") % 4 == 0, F.concat(F.lit("/"), F.col("project"))).otherwise(F.concat(F.col("project"), F.lit("/")))
    route = text.rooted_route(text.route_combine(F.lit("api/[controller]/"), template), F.concat("type_name", F.lit("Controller")))
    return view(spark, d, "v_method").select("method_id", route.alias("route"))


# Five parts, each a name, a dot, two dots or nothing; SQL takes a name and the two dots behind it away until none is left.
_PARTS = " || '/' || ".join(f"CASE (method_id * {k} + size) % 7 WHEN 0 THEN '.' WHEN 1 THEN '..' WHEN 2 THEN '' ELSE 'n{k}' || (size % 3) END" for k in (1, 2, 3, 5, 8))
_STEP = "regexp_replace({}, '(^|/)n[^/]*/[.][.](/|$)', '\\1')"
_FLAT = "trim(regexp_replace(regexp_replace(regexp_replace(p, '(^|/)[.](/[.])*(/|$)', '\\1', 'g'), '/+', '/', 'g'), '(^|/)[.](/|$)', '\\1', 'g'), '/')"
for _ in range(5):
    _FLAT = f"trim(regexp_replace({_STEP.format(_FLAT)}, '/+', '/', 'g'), '/')"


@query("path_normalize", f"{with_views('v_method')}, t AS (SELECT method_id, {_PARTS} AS p FROM v_method), n AS (SELECT *, {_FLAT} AS flat FROM t) SELECT method_id, CASE WHEN NOT starts_with(p, '/') AND NOT regexp_matches(flat, '(^|/)[.][.](/|$)') THEN flat END AS path FROM n")
def _path(spark, d):
    raw = F.expr(_PARTS.replace("'/'", "if(method_id % 2 = 0, '/', '\\\\')"))
    return view(spark, d, "v_method").select("method_id", text.normalize_path(raw).alias("path"))


@query("placeholders", f"{with_views('v_method')} SELECT method_id, 'id,p' || (size % 3) AS names FROM v_method")
def _names(spark, d):
    route = F.concat(F.lit("/x/{id:int}/{*p"), (F.col("size") % 3).cast("string"), F.lit("?}/end"))
    return view(spark, d, "v_method").select("method_id", F.array_join(text.placeholders(route), ",").alias("names"))


@query("unquote", f"{with_views('v_method')} SELECT method_id, CASE WHEN size % 3 = 0 THEN NULL WHEN size % 3 = 1 THEN name || chr(10) || '\"' ELSE name || '\\n' END AS value FROM v_method")
def _unquote(spark, d):
    lit = F.when(F.col("size") % 3 == 0, F.concat(F.lit('"'), F.col("name"), F.lit('\\q"'))).when(F.col("size") % 3 == 1, F.concat(F.lit('"'), F.col("name"), F.lit('\\n\\""'))).otherwise(F.concat(F.lit('"'), F.col("name"), F.lit('\\\\n"')))
    return view(spark, d, "v_method").select("method_id", text.unquote(lit).alias("value"))


@query("json_boolean", f"{with_views('v_cfg')} SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS enabled FROM v_cfg")
def _json(spark, d):
    flag = F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, "false").otherwise('"maybe"')
    doc = F.concat(F.lit('{"A":{"B":{"Enabled":'), flag, F.lit('}},"p":'), F.col("props"), F.lit("}"))
    return view(spark, d, "v_cfg").select("event_id", text.json_boolean(doc, "A:B:Enabled").alias("enabled"))


@query("predicate_complement", f"{with_views('v_def')} SELECT event_id, ['!=','>=','>','<=','<','=='][(event_id % 6 + 1)::INT] AS complement FROM v_def")
def _complement(spark, d):
    ops = F.array(*map(F.lit, ["==", "<", "<=", ">", ">=", "!="]))
    return view(spark, d, "v_def").select("event_id", text.complement(F.element_at(ops, (F.col("event_id") % 6 + 1).cast("int"))).alias("complement"))


# A type in a wrapper: bare, a task, a nested generic, one of two arguments, a task of such a one, or nullable.
_PLAIN = "CASE size % 4 WHEN 0 THEN 'System.Int32' WHEN 1 THEN 'System.String' WHEN 2 THEN 'My.' || replace(name, ' ', '') ELSE 'A.B+' || replace(type_name, ' ', '') END"
_FORM = "method_id % 7"
_DISPLAY = f"CASE {_FORM} WHEN 0 THEN x WHEN 1 THEN 'System.Threading.Tasks.Task<' || x || '>' WHEN 2 THEN 'Out.Box`1<' || x || '>' WHEN 3 THEN 'Out.Pair`2<' || x || ',' || x || '>' WHEN 4 THEN 'System.Threading.Tasks.ValueTask<Out.Pair<' || x || ',' || x || '>>' WHEN 5 THEN x || '?' ELSE 'System.Threading.Tasks.Task<' || x || ',' || x || '>' END"
_SHORT = "CASE size % 4 WHEN 0 THEN 'Int32' WHEN 1 THEN 'String' WHEN 2 THEN replace(name, ' ', '') ELSE replace(type_name, ' ', '') END"


@query("type_display", f"""{with_views('v_method')}, t AS (SELECT *, {_PLAIN} AS x FROM v_method) SELECT method_id, CASE {_FORM} WHEN 0 THEN {_SHORT} WHEN 2 THEN 'Box' WHEN 3 THEN 'Pair' WHEN 4 THEN 'ValueTask' WHEN 5 THEN {_SHORT} || '?' ELSE 'Task' END AS simple,
  CASE WHEN {_FORM} IN (0, 1) THEN x WHEN {_FORM} = 4 THEN 'Out.Pair<' || x || ',' || x || '>' WHEN {_FORM} = 5 THEN x || '?' END AS effective, CASE WHEN {_FORM} IN (0, 5) THEN CASE size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'string' ELSE x END ELSE {_DISPLAY} END AS alias,
  CASE WHEN {_FORM} IN (1, 2) THEN x WHEN {_FORM} = 4 THEN 'Out.Pair<' || x || ',' || x || '>' END AS argument FROM t""")
def _types(spark, d):
    shown = view(spark, d, "v_method").withColumn("x", F.expr(_PLAIN)).withColumn("t", F.expr(_DISPLAY))
    c = F.col("t")
    return shown.select("method_id", text.simple_type_name(c).alias("simple"), text.effective_return_type(c).alias("effective"), text.aliased_type(c).alias("alias"), text.single_generic_argument(c).alias("argument"))


# A key and a value for each method, of which some are sensitive by each of the rules; the last is null.
_SECRET_KEY = "CASE size % 5 WHEN 0 THEN 'Auth:' ELSE 'Display.' END || name || CASE size % 7 WHEN 0 THEN '/Access_Key' WHEN 1 THEN ':Pass-Phrase' WHEN 2 THEN ':Certificate' ELSE '' END"
_SECRET_VALUE = """CASE method_id % 8 WHEN 0 THEN 'ASIA' || upper(substring(md5(name), 1, 12 + CAST(size % 6 AS INT))) WHEN 1 THEN 'my PassWord is ' || name WHEN 2 THEN 'github_pat_' || name
  WHEN 3 THEN substring(md5(name), 1, CAST(size % 32 AS INT)) WHEN 4 THEN 'sk-' || name WHEN 5 THEN replace(name, ' ', '.') WHEN 6 THEN replace(name, ' ', '') || '1' END"""


# looks_sensitive() on v, its lower case low and its parts between dots.
LOOKS_SENSITIVE = """v IS NULL OR len(list_filter(['password', 'secret', 'token', 'connection-string', 'connectionstring', 'api_key', 'apikey'], lambda f: contains(low, f))) > 0
    OR ((starts_with(v, 'AKIA') OR starts_with(v, 'ASIA')) AND length(v) = 20) OR len(list_filter(['ghp_', 'gho_', 'ghu_', 'ghs_', 'ghr_', 'github_pat_'], lambda f: starts_with(v, f))) > 0
    OR (starts_with(v, 'sk-') AND length(v) >= 20) OR (len(parts) = 3 AND len(list_filter(parts, lambda p: length(p) < 8 OR NOT regexp_full_match(p, '[A-Za-z0-9_-]*'))) = 0)
    OR (length(v) >= 16 AND regexp_full_match(v, '[A-Za-z0-9]*') AND len(list_distinct(string_split(v, ''))) >= 10 AND regexp_matches(v, '[0-9]'))"""


@query("sensitive_values", f"""{with_views('v_method')}, x AS (SELECT method_id, {_SECRET_KEY} AS k, {_SECRET_VALUE} AS v FROM v_method),
  y AS (SELECT *, upper(regexp_replace(k, '[^A-Za-z0-9]', '', 'g')) AS bare, lower(v) AS low, string_split(v, '.') AS parts FROM x)
  SELECT method_id, len(list_filter(['PASSWORD', 'PASSPHRASE', 'PWD', 'SECRET', 'TOKEN', 'APIKEY', 'ACCESSKEY', 'PRIVATEKEY', 'CONNECTIONSTRING', 'CREDENTIAL', 'AUTHORIZATION'], lambda f: contains(bare, f))) > 0 AS key_hit,
    {LOOKS_SENSITIVE} AS value_hit FROM y""")
def _sensitive(spark, d):
    rows = view(spark, d, "v_method").select("method_id", F.expr(_SECRET_KEY).alias("k"), F.expr(_SECRET_VALUE).alias("v"))
    return rows.select("method_id", text.sensitive_key(F.col("k")).alias("key_hit"), text.looks_sensitive(F.col("v")).alias("value_hit"))


@query("humanize", f"""{with_views('v_method')}, x AS (SELECT method_id, size, name, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || w[2:]), '') || CASE size % 3 WHEN 0 THEN 'HttpUrl' WHEN 1 THEN 'JSONParser' ELSE 'Id' END AS k FROM v_method),
  y AS (SELECT *, string_split(regexp_replace(regexp_replace(k, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' ') AS parts, name || CASE size % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'ay' WHEN 2 THEN 'sh' ELSE '' END AS noun FROM x)
  SELECT method_id, array_to_string(list_transform(parts, lambda w, i: CASE WHEN w IN ('Sql', 'Json', 'Id', 'Http', 'Url', 'Api', 'Db', 'Ef') THEN upper(w) WHEN i = 1 THEN upper(w[1]) || w[2:] ELSE lower(w[1]) || w[2:] END), ' ') AS words,
    CASE WHEN right(noun, 1) = 'y' AND substring(noun, length(noun) - 1, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(noun, -1) || 'ies' WHEN right(noun, 1) NOT IN ('s', 'x', 'z') AND right(noun, 2) NOT IN ('ch', 'sh') THEN noun || 's' END AS plural,
    'Wait ' || CASE WHEN size % 2 = 0 THEN size || ' seconds' ELSE (size * 1000 + 1) || ' milliseconds' END AS delay FROM y""")
def _humanize(spark, d):
    camel = F.concat(F.array_join(F.transform(F.split("name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), ""), F.when(F.col("size") % 3 == 0, "HttpUrl").when(F.col("size") % 3 == 1, "JSONParser").otherwise("Id"))
    noun = F.concat("name", F.when(F.col("size") % 4 == 0, "y").when(F.col("size") % 4 == 1, "ay").when(F.col("size") % 4 == 2, "sh").otherwise(""))
    ms = F.col("size") * 1000 + F.when(F.col("size") % 2 == 0, 0).otherwise(1)
    return view(spark, d, "v_method").select("method_id", text.humanize(camel).alias("words"), text.pluralize(noun).alias("plural"), text.delay_label(ms).alias("delay"))


@query("config_precedence", f"{with_views('v_cfg')} SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN 'c' END, CASE WHEN event_id % 3 = 0 THEN 'p' END, CASE WHEN event_id % 2 = 0 THEN 'f' END, 'd') AS value, CASE WHEN event_id % 5 = 0 THEN 'CommandLine' WHEN event_id % 3 = 0 THEN 'Profile' WHEN event_id % 2 = 0 THEN 'File' ELSE 'Default' END AS source FROM v_cfg")
def _config(spark, d):
    when = lambda n, v: F.when(F.col("event_id") % n == 0, v)
    value, source = catalog.resolve_setting(F.lit("d"), when(2, "f"), when(3, "p"), when(5, "c"))
    return view(spark, d, "v_cfg").select("event_id", value.alias("value"), source.alias("source"))


_HIDE = "SELECT DISTINCT type_name || '.*' AS pattern FROM v_method WHERE method_id % 700 = 0 UNION SELECT type_name || '.' || name FROM v_method WHERE method_id % 3 = 0"


@query("presentation_filter", f"{with_views('v_method')}, h AS ({_HIDE}) SELECT type_name, name AS member, method_id FROM v_method WHERE type_name || '.*' NOT IN (SELECT pattern FROM h) AND type_name || '.' || name NOT IN (SELECT pattern FROM h) AND type_name NOT IN (SELECT pattern FROM h)")
def _hide(spark, d):
    m = view(spark, d, "v_method")
    patterns = m.where("method_id % 700 = 0").select(F.concat("type_name", F.lit(".*")).alias("pattern")).unionAll(m.where("method_id % 3 = 0").select(F.concat_ws(".", "type_name", "name")))
    return catalog.unhidden(m.select("type_name", F.col("name").alias("member"), "method_id"), patterns)[0]


@query("label_disambiguation", f"""{with_views('v_method')}, n AS (SELECT method_id AS k, project || '.' || (size % 7) || '.' || (method_id % 50) AS path FROM v_method),
  s AS (SELECT k, path, i, array_to_string(list_slice(string_split(path, '.'), 4 - i, 3), '.') AS suffix FROM n, (SELECT unnest([1, 2, 3]) AS i)),
  a AS (SELECT suffix, i FROM s GROUP BY suffix, i HAVING count(DISTINCT path) = 1) SELECT n.k AS \"key\", coalesce(arg_min(x.suffix, x.i), max(n.path)) AS label FROM n LEFT JOIN (SELECT s.* FROM s JOIN a ON a.suffix = s.suffix AND a.i = s.i) x ON x.k = n.k GROUP BY n.k""")
def _labels(spark, d):
    named = view(spark, d, "v_method").select("method_id", F.concat_ws(".", "project", (F.col("size") % 7).cast("string"), (F.col("method_id") % 50).cast("string")).alias("path"))
    return catalog.label_suffixes(named, "method_id", "path")


_RANK = "CASE participant WHEN 'user' THEN 0 WHEN 'system' THEN 1 ELSE 2 END"


@query("participant_order", f"{with_views('v_msg')} SELECT plan, participant, row_number() OVER (PARTITION BY plan ORDER BY {_RANK}, participant) - 1 AS place FROM (SELECT DISTINCT plan, participant FROM v_msg)")
def _participants(spark, d):
    return render.participant_order(view(spark, d, "v_msg"), {"user": 0, "system": 1})


@query("message_order", f"{with_views('v_msg')} SELECT plan, ord, row_number() OVER (PARTITION BY plan ORDER BY {_RANK}, ord, participant, text) - 1 AS place FROM v_msg")
def _messages(spark, d):
    return render.message_order(view(spark, d, "v_msg"), {"user": 0, "system": 1}).select("plan", "ord", "place")


@query("mermaid_text", f"{with_views('v_msg')} SELECT plan, 'sequenceDiagram' || chr(10) || string_agg('  ' || participant || '->>' || CASE participant WHEN 'user' THEN 'assistant' ELSE 'user' END || ': turn ' || ord, chr(10) ORDER BY ord, participant) || chr(10) AS diagram FROM v_msg GROUP BY plan")
def _mermaid(spark, d):
    m = view(spark, d, "v_msg")
    other = F.when(F.col("participant") == "user", "assistant").otherwise("user")
    lines = m.select("plan", "ord", F.col("participant").alias("source"), other.alias("target"), F.concat(F.lit("turn "), F.col("ord").cast("string")).alias("label"), F.lit(0).alias("depth"))
    return render.diagram(lines)


@query("mermaid_validate", f"{with_views('v_def')}, l AS (SELECT method, ord, CASE local_name WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS step FROM v_def), r AS (SELECT *, sum(step) OVER (PARTITION BY method ORDER BY ord) AS depth FROM l) SELECT method, min(depth)::BIGINT AS lowest, max(depth)::BIGINT AS deepest, arg_max(depth, ord)::BIGINT AS open_at_end, min(depth) >= 0 AND max(depth) <= 3 AND arg_max(depth, ord) = 0 AS valid FROM r GROUP BY method")
def _validate(spark, d):
    rows = view(spark, d, "v_def").select("method", F.col("ord").alias("line"), F.when(F.col("local_name") == "view", 1).when(F.col("local_name") == "click", -1).otherwise(0).alias("step"))
    return render.block_depths(rows, "method")


_OLD, _NEW = "SELECT DISTINCT type_name || '/' || (size % 9) AS f FROM v_method WHERE has_body", "SELECT DISTINCT type_name || '/' || (size % 11) AS f FROM v_method WHERE NOT has_body"


def _files(spark, d):
    m = view(spark, d, "v_method")
    name = lambda n: F.concat_ws("/", "type_name", (F.col("size") % n).cast("string")).alias("f")
    return m.where("has_body").select(name(9)).distinct(), m.where("not has_body").select(name(11)).distinct()


@query("stale_outputs", f"{with_views('v_method')} SELECT f FROM ({_OLD}) EXCEPT SELECT f FROM ({_NEW})")
def _stale(spark, d):
    old, new = _files(spark, d)
    return old.join(new, "f", "left_anti")


@query("backup_union", f"{with_views('v_method')} SELECT f FROM ({_OLD}) UNION SELECT f FROM ({_NEW})")
def _backup(spark, d):
    old, new = _files(spark, d)
    return old.unionAll(new).distinct()


@query("critical_excluded", f"{with_views('v_method')} SELECT f FROM ({_OLD}) INTERSECT SELECT f FROM ({_NEW})")
def _critical(spark, d):
    old, new = _files(spark, d)
    return old.join(new, "f", "left_semi")


@query("hex_key", f"{with_views('v_method')} SELECT method_id, lower(hex(type_name || '<' || name || '>')) AS hex_key FROM v_method")
def _hex(spark, d):
    return view(spark, d, "v_method").select("method_id", text.hex_key(F.concat("type_name", F.lit("<"), "name", F.lit(">"))).alias("hex_key"))


_PATTERN = "CASE method_id % 5 WHEN 0 THEN type_name WHEN 1 THEN type_name || '.*' WHEN 2 THEN type_name || '.' || name WHEN 3 THEN type_name || '.other' ELSE name END"


@query("excluded_call", f"{with_views('v_method')} SELECT method_id, method_id % 5 < 3 OR name = type_name AS excluded FROM v_method")
def _excluded(spark, d):
    return view(spark, d, "v_method").select("method_id", text.excluded_call(F.col("type_name"), F.col("name"), F.expr(_PATTERN)).alias("excluded"))


# Roots by id: of indexed methods, of methods that are not, and of other forms.
_ROOTS = "SELECT DISTINCT CASE size % 5 WHEN 0 THEN 'method:v1:' || upper(sha256(name)) WHEN 1 THEN 'method:v2:' || sha256(name) WHEN 2 THEN 'method:v1:' || substring(sha256(name), 1, 63) ELSE 'method:v1:' || sha256(name) END AS root FROM v_method"


@query("root_validity", f"{with_views('v_method')}, r AS ({_ROOTS}) SELECT root, CASE WHEN NOT regexp_full_match(root, 'method:v1:[0-9a-f]{{64}}') THEN 'SD3012' ELSE 'SD3013' END AS code FROM r WHERE NOT regexp_full_match(root, 'method:v1:[0-9a-f]{{64}}') OR root NOT IN (SELECT 'method:v1:' || sha256(name) FROM v_method WHERE has_body)")
def _roots(spark, d):
    m = view(spark, d, "v_method")
    roots = spark.sql(_ROOTS.replace("sha256(name)", "sha2(name, 256)").replace("v_method", "{m}"), m=m)
    return catalog.validate_roots(roots, m.where("has_body").select(F.concat(F.lit("method:v1:"), F.sha2("name", 256)).alias("id")))


@query("markdown_documents", f"WITH g AS ({ORACLES['mermaid_text']}) SELECT plan, '# Plan \\[' || plan || '\\]' || chr(10) || chr(10) || '```mermaid' || chr(10) || diagram || '```' || chr(10) AS document FROM g")
def _documents(spark, d):
    drawn = _mermaid(spark, d)
    return render.markdown(drawn.select("plan", F.concat(F.lit("Plan ["), F.col("plan").cast("string"), F.lit("]")).alias("title")), drawn)
