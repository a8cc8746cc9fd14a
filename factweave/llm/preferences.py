"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

A pair's longest common prefix of turns is rendered once as the prompt; what follows in either conversation is rendered as
its completion, with the spans of the completion that training may learn from (the assistant's turns) as mask.

Turns are compared place by place by a join on (pair, turn number); neither conversation is gathered to find the prefix. A
conversation is gathered only to be rendered, as its text is one value of the result. Turns are keyed by pair, of which
there are as many as conversations, so a frequent first turn does not make any key frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the chat format: before a turn's role, between role and text, after a turn.
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def format_pairs(turns: DataFrame, dealt_by: tuple[str, ...] = ()) -> DataFrame:
    """turns(pair, side, turn, role, text), side 'chosen' or 'rejected': one row per pair that has a turn.

    dealt_by: columns of turns that pair determines and by which turns are shuffled already; all steps then stay in those
    partitions. Without them turns are shuffled once, by pair.

    Returns pair, n_shared (turns in the prompt), prompt, chosen, rejected (rendered) and chosen_mask, rejected_mask (arrays
    of start and finish, in code points of the completion, of the assistant's texts with their closing mark).

    Turns are ordered by turn number (nulls first), then role and text; repeated rows count once for each. A null role or
    text renders as empty and equals a null only. A side without turns has an empty completion, and then nothing is shared. Rows with null
    pair or another side are left out. Other columns are ignored whatever their names; an empty table gives an empty result.
    """
    keys = [*dealt_by, "pair"]
    rows = turns.where("pair is not null and side in ('chosen', 'rejected')").select(*keys, "side", "turn", "role", "text")
    rows = rows if dealt_by else rows.repartition("pair")
    order = Window.partitionBy(*keys, "side").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("place", F.row_number().over(order))
    # Both sides of a place meet in one row; the first place whose sides differ ends the prefix.
    side = lambda name: F.max(F.when(F.col("side") == name, F.struct("role", "text"))).alias(name)
    places = rows.groupBy(*keys, "place").agg(side("chosen"), side("rejected"))
    differs = F.col("chosen").isNull() | F.col("rejected").isNull() | ~F.col("chosen").eqNullSafe(F.col("rejected"))
    ends = Window.partitionBy(*keys)
    places = places.withColumn("shared", F.coalesce(F.min(F.when(differs, F.col("place"))).over(ends), F.max("place").over(ends) + 1) - 1)
    whole = places.groupBy(*keys).agg(
        F.first("shared").alias("n_shared"),
        F.array_sort(F.collect_list(F.struct("place", "chosen", "rejected"))).alias("turns"),
    )
    render = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(BETWEEN), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))
    text = lambda name, keep: F.array_join(F.transform(F.filter("turns", lambda x: keep(x) & x[name].isNotNull()), lambda x: render(x[name])), "")
    after = lambda x: x["place"] > F.col("n_shared")

    def mask(name: str):
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,finish:int>>").alias("out"))

        def step(s, x):
            start = s["at"] + F.length(F.lit(OPEN)) + F.length(F.coalesce(x[name]["role"], F.lit(""))) + F.length(F.lit(BETWEEN))
            finish = s["at"] + F.length(render(x[name]))
            learned = F.array(F.struct(start.alias("start"), finish.alias("finish")))
            return F.struct(finish.alias("at"), F.when(x[name]["role"] == "assistant", F.concat(s["out"], learned)).otherwise(s["out"]).alias("out"))

        return F.aggregate(F.filter("turns", lambda x: after(x) & x[name].isNotNull()), nothing, step, lambda s: s["out"])

    return whole.select(
        "pair",
        "n_shared",
        text("chosen", lambda x: x["place"] <= F.col("n_shared")).alias("prompt"),
        text("chosen", after).alias("chosen"),
        text("rejected", after).alias("rejected"),
        mask("chosen").alias("chosen_mask"),
        mask("rejected").alias("rejected_mask"),
    )


def paired(conversations: DataFrame) -> DataFrame:
    """Each conversation as chosen, and a copy whose last assistant turn is another's as rejected: couple, pair, side, turn, role, text.

    The other conversation is the one of the couple (2k, 2k + 1); its last assistant turn gives the text. Where it is missing or
    has none, that turn is left out of the rejected copy. A conversation without assistant turns is copied as it is. Turns are
    ordered as format_pairs() states; null conv_ids are left out; an empty table gives an empty result.
    """
    rows = conversations.where("conv_id is not null").select(F.shiftright("conv_id", 1).alias("couple"), F.col("conv_id").alias("pair"), "turn", "role", "text")
    rows = rows.repartition("couple")
    of_one = Window.partitionBy("couple", "pair")
    order = of_one.orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("is_last", F.coalesce(F.col("place") == F.max(F.when(F.col("role") == "assistant", F.col("place"))).over(of_one), F.lit(False)))
    of_couple = Window.partitionBy("couple")
    last = lambda odd: F.max(F.when(F.col("is_last") & (F.col("pair").bitwiseAND(F.lit(1)) == odd), F.struct("text"))).over(of_couple)
    rows = rows.withColumn("even", last(0)).withColumn("odd", last(1))
    other = F.when(F.col("pair").bitwiseAND(F.lit(1)) == 0, F.col("odd")).otherwise(F.col("even"))
    chosen = F.struct(F.lit("chosen").alias("side"), F.col("text"))
    rejected = F.struct(F.lit("rejected").alias("side"), F.when(F.col("is_last"), other["text"]).otherwise(F.col("text")).alias("text"))
    sides = F.when(F.col("is_last") & other.isNull(), F.array(chosen)).otherwise(F.array(chosen, rejected))
    return rows.select("couple", "pair", "turn", "role", F.explode(sides).alias("x")).select("couple", "pair", "x.side", "turn", "role", "x.text")


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs made of the whole table of conversations, formatted; masks as start:finish, joined by commas."""
    out = format_pairs(paired(table(spark, sf_dir, "conversations")), ("couple",))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["finish"].cast("string"))), ",").alias(c)
    return out.select("pair", F.col("n_shared").cast("long"), "prompt", "chosen", "rejected", flat("chosen_mask"), flat("rejected_mask"))


def _sql_side(name: str) -> str:
    return f"""{name} AS (SELECT pair, string_agg(r, '' ORDER BY place) AS {name}, string_agg(CASE WHEN role = 'assistant' THEN (stop - length(coalesce(text, '')) - {len(CLOSE)}) || ':' || stop END, ',' ORDER BY place) AS {name}_mask
  FROM (SELECT p.pair, place, role, text, r, (sum(length(r)) OVER (PARTITION BY p.pair ORDER BY place))::BIGINT AS stop FROM p JOIN e USING (pair) WHERE side = '{name}' AND place > n_shared) GROUP BY pair)"""


OP4_SQL = f"""
WITH c AS (SELECT conv_id, conv_id // 2 AS couple, turn, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(place) AS place FROM c WHERE role = 'assistant' GROUP BY conv_id),
t AS (SELECT c.conv_id, couple, place, text FROM c JOIN l USING (conv_id, place)),
d AS (SELECT conv_id AS pair, 'chosen' AS side, turn, role, text FROM c
  UNION ALL SELECT c.conv_id, 'rejected', c.turn, c.role, CASE WHEN t.place = c.place THEN o.text ELSE c.text END
  FROM c LEFT JOIN t ON t.conv_id = c.conv_id LEFT JOIN t o ON o.couple = c.couple AND o.conv_id <> c.conv_id
  WHERE t.place IS DISTINCT FROM c.place OR o.conv_id IS NOT NULL),
p AS (SELECT pair, side, role, text, row_number() OVER (PARTITION BY pair, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS r FROM d),
m AS (SELECT pair, place, count(*) = 2 AND bool_and(NOT EXISTS (SELECT 1 FROM p q WHERE q.pair = p.pair AND q.place = p.place AND q.side <> p.side AND (q.role IS DISTINCT FROM p.role OR q.text IS DISTINCT FROM p.text))) AS same FROM p GROUP BY pair, place),
e AS (SELECT pair, coalesce(min(CASE WHEN NOT same THEN place END), max(place) + 1) - 1 AS n_shared FROM m GROUP BY pair),
{_sql_side("chosen")}, {_sql_side("rejected")},
o AS (SELECT p.pair, string_agg(r, '' ORDER BY place) AS prompt FROM p JOIN e USING (pair) WHERE side = 'chosen' AND place <= n_shared GROUP BY p.pair)
SELECT e.pair, n_shared::BIGINT AS n_shared, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
       coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask
FROM e LEFT JOIN o USING (pair) LEFT JOIN chosen USING (pair) LEFT JOIN rejected USING (pair)
"""
