"""Queries on sequence trees and their diagrams, and their DuckDB counterparts."""

from pyspark.sql import functions as F

from ..operators import render, sequence
from .bind import view, with_views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


# Fourteen events make an alt of two arms with a block and an alt inside them, a reference and a loop; one in three references is missing from
# the tree, and one in 331 names no message. Every eleventh method has no tree but branches.
_PARENT = "CASE ord % 14 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 1 WHEN 6 THEN 5 WHEN 7 THEN 1 WHEN 8 THEN 2 WHEN 9 THEN 2 WHEN 10 THEN 2 WHEN 13 THEN 1 END"
_ELEMENTS = f"""SELECT method AS plan, ord AS element, ord - {_PARENT} AS parent, ord AS place, CASE WHEN ord % 14 IN (3, 5, 9, 10, 11, 13) THEN 'message' WHEN ord % 14 IN (0, 6) THEN 'alt' WHEN ord % 14 IN (1, 2, 7, 8) THEN 'arm' WHEN ord % 14 = 12 THEN 'loop'
  ELSE CASE event_id % 3 WHEN 0 THEN 'opt' WHEN 1 THEN 'loop' ELSE 'break' END END AS kind, CASE WHEN event_id % 2 = 0 THEN 'same' ELSE local_name || ' "' || event_id || '"' END AS label, ord % 14 = 2 OR (ord % 14 = 7 AND event_id % 2 = 0) AS is_else, CASE WHEN ord % 14 IN (3, 5, 9, 10, 11, 13) THEN event_id END AS message
  FROM (SELECT method, event_id, local_name, ord - 1 AS ord FROM v_def) AS v WHERE method % 11 > 0 AND (ord % 14 NOT IN (3, 5, 9, 10, 11, 13) OR event_id % 3 > 0)"""
_MESSAGES = "SELECT method AS plan, event_id AS message, 'a' || (event_id % 5) AS source, 'a' || (ord % 5) AS target, local_name || ' \"' || ord || '\"' AS label, CASE WHEN event_id % 2 = 0 THEN 'Request' ELSE 'Response' END AS kind, ord AS place FROM (SELECT method, event_id, local_name, ord - 1 AS ord FROM v_def) AS v WHERE event_id % 331 > 0 AND (ord % 14 IN (3, 5, 9, 10, 11, 13) OR method % 11 = 0)"
_PARTICIPANTS = "SELECT DISTINCT method AS plan, event_id % 5 AS place, 'a' || (event_id % 5) AS key, 'Part;' || (event_id % 5) AS label FROM (SELECT method, event_id, local_name, ord - 1 AS ord FROM v_def) AS v"
_BRANCHES = "SELECT method AS plan, ord % 3 AS place, 'branch \"' || (ord % 3) AS label, event_id AS message FROM (SELECT method, event_id, local_name, ord - 1 AS ord FROM v_def) AS v WHERE method % 11 = 0 AND ord % 4 = 1"


def _tables(spark, d):
    read = lambda sql: spark.sql(sql.replace("v_def", "{d}"), d=view(spark, d, "v_def"))
    return read(_PARTICIPANTS), read(_MESSAGES), read(_ELEMENTS), read(_BRANCHES)


_LABEL = "replace({}, '\"', '#quot;')"
_SHOW = "repeat(' ', {}) || source || CASE kind WHEN 'Request' THEN '->>' ELSE '-->>' END || target || ': ' || " + _LABEL.format("label")
_DRAWN = f"""{with_views('v_def', recursive=True)}, el AS ({_ELEMENTS}), ms AS ({_MESSAGES}), br AS ({_BRANCHES}), pp AS ({_PARTICIPANTS}),
 w AS (SELECT plan, element, parent, kind, label, is_else, message, [place] AS path, []::BIGINT[] AS above, 0 AS blocks, kind = 'break' AS hidden FROM el WHERE parent IS NULL
   UNION ALL SELECT e.plan, e.element, e.parent, e.kind, e.label, e.is_else, e.message, list_append(w.path, e.place), list_append(w.above, w.element), w.blocks + CASE WHEN w.kind IN ('alt', 'opt', 'loop', 'break') THEN 1 ELSE 0 END, w.hidden OR e.kind = 'break' FROM w JOIN el e ON e.plan = w.plan AND e.parent = w.element),
 good AS (SELECT w.plan, w.path, w.above, w.blocks, m.source, m.target, m.kind, m.label FROM w JOIN ms m ON m.plan = w.plan AND m.message = w.message WHERE w.kind = 'message' AND NOT hidden),
 content AS (SELECT DISTINCT plan, unnest(above) AS element FROM good),
 bad AS (SELECT DISTINCT w.plan FROM w LEFT JOIN ms m ON m.plan = w.plan AND m.message = w.message WHERE w.kind = 'message' AND NOT hidden AND m.plan IS NULL AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(w.above) AS a) x WHERE x.a NOT IN (SELECT element FROM content c WHERE c.plan = w.plan))),
 sh AS (SELECT w.* FROM w JOIN content c ON c.plan = w.plan AND c.element = w.element WHERE NOT hidden),
 ar AS (SELECT *, row_number() OVER (PARTITION BY plan, parent ORDER BY path) AS rank, count(*) OVER (PARTITION BY plan, parent) AS arms FROM sh WHERE kind = 'arm'),
 al AS (SELECT s.*, a.arms, a.label AS arm_label, a.is_else AS arm_else, a.path AS arm_path FROM sh s JOIN ar a ON a.plan = s.plan AND a.parent = s.element AND a.rank = 1 WHERE s.kind = 'alt'),
 ln AS (SELECT plan, path AS key, {_SHOW.format('4 + 2 * blocks')} AS line FROM good
   UNION ALL SELECT plan, list_append(path, -1), repeat(' ', 4 + 2 * blocks) || kind || ' ' || {_LABEL.format('label')} FROM sh WHERE kind IN ('opt', 'loop')
   UNION ALL SELECT plan, list_append(path, 999999), repeat(' ', 4 + 2 * blocks) || 'end' FROM sh WHERE kind IN ('opt', 'loop', 'alt')
   UNION ALL SELECT plan, list_append(path, -1), repeat(' ', 4 + 2 * blocks) || CASE WHEN arms = 1 THEN 'opt ' || {_LABEL.format('arm_label')} ELSE 'alt ' || {_LABEL.format('label')} END FROM al
   UNION ALL SELECT plan, list_append(arm_path, -1), repeat(' ', 4 + 2 * blocks) || 'else ' || {_LABEL.format('arm_label')} FROM al WHERE arms > 1 AND arm_else AND arm_label <> label
   UNION ALL SELECT plan, list_append(path, -1), repeat(' ', 2 + 2 * blocks) || 'else ' || {_LABEL.format('label')} FROM ar WHERE rank > 1),
 tree AS (SELECT plan, 2 AS part, key, line FROM ln WHERE plan NOT IN (SELECT plan FROM bad)),
 fm AS (SELECT * FROM ms WHERE plan NOT IN (SELECT plan FROM el)), fb AS (SELECT DISTINCT plan, place, label FROM br WHERE plan NOT IN (SELECT plan FROM el)),
 flat AS (SELECT plan, 2 AS part, [0, place] AS key, {_SHOW.format('4')} AS line FROM fm WHERE (plan, message) NOT IN (SELECT (plan, message) FROM br)
   UNION ALL SELECT plan, 2, [1, place, -1], '    ' || CASE WHEN row_number() OVER (PARTITION BY plan ORDER BY place, label) = 1 THEN 'alt ' ELSE 'else ' END || {_LABEL.format('label')} FROM fb
   UNION ALL SELECT fm.plan, 2, [1, br.place, fm.place], {_SHOW.format('8').replace(" || label", " || fm.label").replace("replace(label", "replace(fm.label")} FROM fm JOIN br ON br.plan = fm.plan AND br.message = fm.message
   UNION ALL SELECT DISTINCT plan, 2, [2], '    end' FROM fb),
 al_lines AS (SELECT DISTINCT plan, 0 AS part, [0]::BIGINT[] AS key, 'sequenceDiagram' AS line FROM pp WHERE plan NOT IN (SELECT plan FROM bad)
   UNION ALL SELECT plan, 1, [place], '    participant ' || key || ' as ' || replace(label, ';', '#59;') FROM pp WHERE plan NOT IN (SELECT plan FROM bad) UNION ALL SELECT * FROM tree UNION ALL SELECT * FROM flat)"""


@query("diagram_lines", f"{_DRAWN} SELECT plan, row_number() OVER (PARTITION BY plan ORDER BY part, key, line) - 1 AS ordinal, line FROM al_lines")
def _lines(spark, d):
    return sequence.diagram_lines(*_tables(spark, d))[0]


@query("diagram_text", f"{_DRAWN} SELECT plan, string_agg(line, chr(10) ORDER BY part, key, line) AS diagram FROM al_lines GROUP BY plan")
def _text(spark, d):
    return sequence.diagram_text(sequence.diagram_lines(*_tables(spark, d))[0])


@query("diagram_codes", f"{_DRAWN} SELECT plan, 'UnresolvedReference' AS code FROM bad")
def _codes(spark, d):
    return sequence.diagram_lines(*_tables(spark, d))[1]


@query("diagram_errors", f"{_DRAWN}, one AS (SELECT plan, count(*) AS lines FROM al_lines GROUP BY plan) SELECT plan, lines, 0 AS errors FROM one")
def _errors(spark, d):
    """The rules of a diagram, line by line, on every diagram that is drawn: none of them is broken."""
    drawn = sequence.diagram_text(sequence.diagram_lines(*_tables(spark, d))[0])
    return drawn.select("plan", F.size(F.split("diagram", "\n")).cast("long").alias("lines"), F.size(render.diagram_errors(F.col("diagram"))).alias("errors"))
