"""Queries on models with several outputs, and their DuckDB counterparts."""

from pyspark.sql import functions as F

from ..operators import hints
from .bind import view, with_views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


# What one model says of operations and another, of which some of the same facts, of symbols; fields go blank, negative or foreign by turns.
_SAID = """SELECT CASE line WHEN 2 THEN 'resolution' WHEN 3 THEN 'suppression' WHEN 4 THEN 'summary' WHEN 5 THEN 'diagnostic' ELSE 'fact' END AS tag, CASE WHEN owner % 37 = 0 THEN ' ' WHEN line IN (1, 6, 7) THEN 'f' || (owner % 500) || '/' || line ELSE owner || '/' || op_ord END AS id,
  CASE target % 9 WHEN 0 THEN NULL WHEN 1 THEN 'other:1' ELSE '{model}' END AS producer, target % 17 > 0 AS direct, CASE WHEN owner % 500 < 250 THEN 'o' ELSE 'o' || (target % 2) END AS owner, kind, 'v' || (owner % 3) AS value, target % 4 AS certainty,
  CASE WHEN op_ord = 3 THEN '' ELSE 'op' || op_ord END AS operation, CASE target % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'm' || target END AS target_method, CASE WHEN target % 4 > 0 THEN 't' || target END AS target_type, CASE WHEN method_id % 13 > 0 THEN 'because' END AS reason, method_id % 7 - 1 AS ordinal,
  CASE WHEN method_id % 11 > 0 THEN 's' || (target % 3) ELSE ' ' END AS scope, 'D' || (target % 3) AS code, status AS detail FROM v_inv WHERE {where}"""
_MODELS = {"a:2": "owner % 2 = 0", "b:1": "owner % 3 = 0"}


def _output(name):
    sql = _SAID.format(model=name, where=_MODELS[name])

    def analyze(rows):
        said = rows.sparkSession.sql(sql.replace("v_inv", "{i}"), i=rows)
        one = F.array(F.struct(F.lit("e").alias("id"), "producer", "direct"))
        made = None
        for tag, fields in hints.FIELDS.items():
            made_of = hints.payload(**{c: F.col(c) for c in fields})
            made = F.when(F.col("tag") == tag, made_of) if made is None else made.when(F.col("tag") == tag, made_of)
        return said.select("tag", "id", made.alias("payload"), F.when(F.col("producer").isNotNull(), one).otherwise(F.array().cast("array<struct<id: string, producer: string, direct: boolean>>")).alias("evidence"))

    return analyze


def _run(spark, d):
    models = [hints.OutputModel("b", "1", 200, frozenset({"p"}), symbols=_output("b:1")), hints.OutputModel("a", "2", 100, frozenset(), operations=_output("a:2")), hints.OutputModel("never", "1", 1, frozenset({"absent"}), operations=_output("a:2"))]
    rows = view(spark, d, "v_inv")
    return hints.run_outputs(models, {"p"}, rows, rows)


_BLANK = "trim(coalesce({}, '')) = ''"
_ALL = f"""{with_views('v_inv')}, s AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, * FROM ({_SAID.format(model=m, where=w)})" for m, w in _MODELS.items())}),
  x AS (SELECT *, producer IS NULL AS bare, producer <> model OR NOT direct AS alien FROM s),
  y AS (SELECT *, CASE WHEN tag = 'diagnostic' THEN NULL WHEN tag = 'fact' THEN CASE WHEN bare OR {_BLANK.format('id')} THEN 'SEQFW001' WHEN alien THEN 'SEQFW005' END
    WHEN bare THEN 'SEQFW002' WHEN ordinal < 0 OR {_BLANK.format('reason')} OR CASE WHEN tag = 'resolution' THEN operation = '' OR (target_method IS NULL AND target_type IS NULL) OR coalesce(trim(target_method) = '', false) ELSE {_BLANK.format('scope')} END THEN 'SEQFW004' WHEN alien THEN 'SEQFW005' END AS why FROM x),
  g AS (SELECT id, count(DISTINCT (owner, kind, value, certainty)) AS forms FROM y WHERE tag = 'fact' AND why IS NULL GROUP BY id)"""


@query("framework_hints", f"{_ALL} SELECT tag, id, model AS producer, operation, target_method, target_type, CAST(NULL AS VARCHAR) AS scope, reason, ordinal, certainty FROM y WHERE tag = 'resolution' AND why IS NULL UNION ALL SELECT tag, id, model, NULL, NULL, NULL, scope, reason, ordinal, certainty FROM y WHERE tag IN ('suppression', 'summary') AND why IS NULL")
def _hints(spark, d):
    found, out = _run(spark, d), None
    for tag in ("resolution", "suppression", "summary"):
        rows = found[tag].withColumn("tag", F.lit(tag))
        for c in ("operation", "target_method", "target_type", "scope"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("output_facts", f"{_ALL} SELECT id, min(model) AS producer, min(owner) AS owner, min(kind) AS kind, min(value) AS value, min(certainty) AS certainty FROM y WHERE tag = 'fact' AND why IS NULL AND id IN (SELECT id FROM g WHERE forms = 1) GROUP BY id")
def _facts(spark, d):
    return _run(spark, d)["fact"]


@query("hint_errors", f"{_ALL} SELECT id, model AS producer, why AS code FROM y WHERE why IS NOT NULL UNION ALL SELECT id, NULL, 'SEQFW003' FROM g WHERE forms > 1")
def _codes(spark, d):
    return _run(spark, d)["codes"]
