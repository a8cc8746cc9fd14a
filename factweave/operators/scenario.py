"""Facts joined into behaviour graphs: membership, inheritance along call trees, terminals, matching of throws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import calls


def either_key(left: DataFrame, right: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """left joined with right on first = key or second = key, each pair of rows once: two equi-joins instead of an OR."""
    one = left.join(right, left[first] == right[key])
    two = left.join(right, left[second] == right[key]).where(~F.coalesce(left[first] == right[key], F.lit(False)))
    return one.unionAll(two)


def caught(throws: DataFrame, catches: DataFrame, above: DataFrame) -> DataFrame:
    """Throws (method, ord, type) with whether an enclosing catch (method, start_block, end_block, caught_type) takes them.

    A catch without type takes all; else the thrown type, or a type above it (a base or an interface), must be caught.
    """
    types = throws.select(F.col("type").alias("start")).distinct()
    up = calls.closure(types, above.select(F.col("type").alias("source"), F.col("above").alias("target")))
    inside = throws.join(catches, "method").where(F.col("ord").between(F.col("start_block"), F.col("end_block")))
    untyped = inside.where("caught_type is null").select("method", "ord", "type")
    typed = inside.join(up, (F.col("type") == F.col("start")) & (F.col("caught_type") == F.col("node"))).select("method", "ord", "type")
    taken = untyped.unionAll(typed).distinct().withColumn("taken", F.lit(True))
    return throws.join(taken, ["method", "ord", "type"], "left").select("method", "ord", "type", F.coalesce("taken", F.lit(False)).alias("caught"))


def inherit_arms(tree: DataFrame, arms: DataFrame) -> DataFrame:
    """(root, path, arm): nodes of call trees (root, path: places joined by dots) under the arm of their first call.

    arms(root, place, arm) names the arms in which the root's own calls stand; the root itself has none.
    """
    first = F.when(F.col("path") != "", F.element_at(F.split("path", "[.]"), 1).cast("long"))
    return tree.withColumn("place", first).join(arms, ["root", "place"]).select("root", "path", "arm")


def summaries(calls_: DataFrame, writes: DataFrame, methods: DataFrame) -> DataFrame:
    """(method_id, n_calls, n_targets, writes_state, complete): complete if every callee has a body and nothing is unknown."""
    known = methods.select(F.col("method_id").alias("callee"), F.coalesce("has_body", F.lit(False)).alias("has_body"))
    per = calls_.join(known, "callee", "left").groupBy(F.col("caller").alias("method_id")).agg(F.count("*").alias("n_calls"), F.count_distinct("callee").alias("n_targets"), F.bool_and(F.coalesce("has_body", F.lit(False))).alias("complete"))
    state = writes.select("method_id").distinct().withColumn("writes_state", F.lit(True))
    out = methods.join(per, "method_id", "left").join(state, "method_id", "left")
    return out.select("method_id", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_targets", F.lit(0)).alias("n_targets"), F.coalesce("writes_state", F.lit(False)).alias("writes_state"), F.coalesce("complete", F.lit(True)).alias("complete"))


def nesting(handlers: DataFrame) -> DataFrame:
    """Handlers (method, ord, is_decision) with the decision before them and how many decisions that is deep."""
    w = Window.partitionBy("method").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("is_decision"), F.col("ord"))
    return handlers.select("method", "ord", F.last(mark, ignorenulls=True).over(before).alias("within"), F.coalesce(F.count(mark).over(before), F.lit(0)).alias("depth"))


def profile_matches(profiles: DataFrame, wanted: dict[str, str], properties: dict[str, str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """Profiles whose columns equal wanted (the framework whatever its case) and whose property map equals properties,
    keys of `ignored` aside."""
    out = profiles
    for c, v in wanted.items():
        out = out.where(F.lower(c) == v.lower() if c == "framework" else F.col(c) == v)
    entries = F.array_sort(F.map_entries(F.map_filter("properties", lambda k, _: ~k.isin(*ignored) if ignored else F.lit(True))))
    given = sorted((k, v) for k, v in properties.items() if k not in ignored)
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws("\x01", e["key"], e["value"])), "\x02")
    return out.where(text == "\x02".join(f"{k}\x01{v}" for k, v in given))


def focused(entries: DataFrame, wanted: str) -> DataFrame:
    """The entry whose operation key, else whose entry key, is exactly the wanted one; a code if that is none or several."""
    ranked = entries.select("id", F.when(F.col("operation_key") == wanted, 0).when(F.col("entry_key") == wanted, 1).alias("rank")).where("rank is not null")
    best = ranked.agg(F.min("rank").alias("best"))
    held = ranked.join(best, ranked["rank"] == best["best"]).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return held.select(F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n") == 0, "SD4004").when(F.col("n") > 1, "SD4005").alias("code"))
