"""Evidence, certainty, conflicts, ordinals: what all facts obey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calls import cut, reached

# Certainty from strongest to weakest.
CERTAINTY = ("Exact", "Conservative", "Heuristic", "Unknown")


def certainty_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CERTAINTY)), (level + 1).cast("int"))


def evidence_union(evidence: DataFrame, owner: str = "owner") -> DataFrame:
    """(owner, evidence, n_evidence, certainty): each owner's evidence ids as text, in order and each once, their number and the strongest certainty.

    Repeats go before an owner's ids meet, so what one task holds of an owner is the list that its row tells.
    """
    single = evidence.groupBy(owner, F.col("evidence_id").cast("string").alias("evidence_id")).agg(F.min("certainty").alias("certainty"))
    told = F.when(F.count("evidence_id") > 0, F.array_join(F.array_sort(F.collect_list("evidence_id")), ","))
    return single.groupBy(owner).agg(told.alias("evidence"), F.count("evidence_id").alias("n_evidence"), certainty_name(F.min("certainty")).alias("certainty"))


def combined_certainty(evidence: DataFrame, owner: str = "owner", weakest: bool = False) -> DataFrame:
    """(owner, n_evidence, certainty): of each owner the number of evidence ids and the strongest (or weakest) certainty.

    Ids are counted in two steps, so that an owner's ids never meet in one task.
    """
    pick = F.max if weakest else F.min
    single = evidence.groupBy(owner, "evidence_id").agg(pick("certainty").alias("certainty"))
    return single.groupBy(owner).agg(F.count("evidence_id").alias("n_evidence"), certainty_name(pick("certainty")).alias("certainty"))


#: Rows of a sequence that are hashed together.
SPAN = 4096


def fingerprint(rows: DataFrame, group: str, place: str, line: Column, levels: int = 3) -> DataFrame:
    """(group, fingerprint) of the lines of each group in order of place (a long, from 0).

    SPAN neighbouring places are hashed together, then the hashes of SPAN such ranges, and so on, so no task holds more than SPAN
    values of a group unless places repeat, and SPAN ** levels places have room before the last step holds more.
    """
    def digest() -> Column:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
        return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)

    out = rows.select(F.col(group).alias("group"), F.col(place).cast("long").alias("place"), line.alias("line"))
    for _ in range(levels):
        out = out.groupBy("group", F.floor(F.col("place") / SPAN).alias("range")).agg(digest().alias("line"))
        out = out.select("group", F.col("range").alias("place"), "line")
    return out.groupBy(F.col("group").alias(group)).agg(digest().alias("fingerprint"))


def resolve_conflicts(facts: DataFrame, key: list[str], payload: list[str], code: str) -> tuple[DataFrame, DataFrame]:
    """Facts of which all copies agree, once; and (key, code) of those that disagree, all copies of which are dropped.

    Nulls agree with nulls. Agreement is one aggregate: equal smallest and largest payload.
    """
    whole = F.struct(*payload)
    both = facts.groupBy(*key).agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    agree = F.col("lo").eqNullSafe(F.col("hi"))
    return both.where(agree).select(*key, "lo.*"), both.where(~agree).select(*key, F.lit(code).alias("code"))


def keep_first(facts: DataFrame, key: list[str], order: list[str], differs: str) -> DataFrame:
    """The first fact of each key in order, flagged where later ones differ in a column."""
    first = F.min_by(F.struct(*[c for c in facts.columns if c not in key]), F.struct(*order))
    return facts.groupBy(*key).agg(first.alias("f"), (F.count_distinct(differs) > 1).alias("differs")).select(*key, "f.*", "differs")


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def duplicate_families(families: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(family, value, copies): the keys that several rows of a family (its name, rows and key columns) share; a null part counts as a value."""
    out = None
    for name, rows, key in families:
        value = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key])
        found = rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1").select(F.lit(name).alias("family"), value.alias("value"), "copies")
        out = found if out is None else out.unionAll(found)
    return out


def agreement_codes(rows: DataFrame, key: list[str], columns: list[str], code: str) -> DataFrame:
    """(*key, copies, code): how many rows share a key, and the code where they differ in any of the columns; nulls equal nulls."""
    whole = F.struct(*columns)
    same = F.min(whole).eqNullSafe(F.max(whole))
    return rows.groupBy(*key).agg(F.count("*").alias("copies"), F.when(~same, code).alias("code"))


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def ordinal_gaps(rows: DataFrame, owner: str, ordinal: str) -> DataFrame:
    """Owners whose ordinals are not 0, 1, 2, ... each once."""
    seen = rows.groupBy(owner).agg(F.count("*").alias("n"), F.count_distinct(ordinal).alias("d"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    return seen.where("not (n = d and lo = 0 and hi = n - 1)").select(owner, "n", "lo", "hi")


def sibling_ordinal(by: list[str], order: list[str]) -> Column:
    return (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long")


def reaching_definition(by: list[str], local: str, order: list[str], definition: str) -> Column:
    """The latest definition of the same local before this row, in evaluation order (not along control flow)."""
    return F.last(definition, ignorenulls=True).over(Window.partitionBy(*by, local).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def terminal_fold(arms: DataFrame, key: list[str], terminal: str) -> DataFrame:
    """Terminates if all do, Rejoins if all do, else Unknown (a null counts as unknown)."""
    every = lambda t: F.bool_and(F.coalesce(F.col(terminal) == t, F.lit(False)))
    return arms.groupBy(*key).agg(F.when(every("Terminates"), "Terminates").when(every("Rejoins"), "Rejoins").otherwise("Unknown").alias("terminal"))


def evidence_layers(evidence: DataFrame, links: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, layer, code) of evidence(id): 0 for what rests on nothing, else one more than the highest layer that links(id, underlying) name.

    Layers are peeled off from below, a round each, by counting down how much of what an id rests on is still open, so a round costs
    what is open in it. Missing marks an id that rests on an unknown one, at any depth; Cycle one on, or above, a circle. Raises
    RuntimeError rather than return an unfinished result.
    """
    ids = evidence.select("id").distinct()
    links = cut(links.select("id", "underlying").distinct().join(ids, "id", "left_semi"))
    lost = links.join(ids.select(F.col("id").alias("underlying")), "underlying", "left_anti").select("id").distinct()
    counts = links.groupBy("id").agg(F.count("*").alias("open"))
    left = cut(ids.join(counts, "id", "left").select("id", F.coalesce("open", F.lit(0)).alias("open")))
    names = lambda frame: cut(frame).toDF(*frame.columns)
    done = new = names(left.where("open = 0").select("id", F.lit(0).cast("long").alias("layer")))
    left = names(left.where("open > 0"))
    for k in range(1, max_rounds):
        closed = links.join(new.select(F.col("id").alias("underlying")), "underlying").groupBy("id").agg(F.count("*").alias("closed"))
        left = names(left.join(closed, "id", "left").select("id", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")))
        new = names(left.where("open = 0").select("id", F.lit(k).cast("long").alias("layer")))
        if new.isEmpty():
            break
        done, left = done.unionAll(new), left.where("open > 0")
    else:
        raise RuntimeError(f"evidence has more than {max_rounds} layers")
    # What is left rests on something unknown, or on a circle.
    above = _resting(lost, links, left.select("id"), max_rounds)
    code = F.when(F.col("missing"), "Missing").otherwise("Cycle")
    rest = left.join(above.withColumn("missing", F.lit(True)), "id", "left").withColumn("missing", F.coalesce("missing", F.lit(False)))
    return done.select("id", "layer", F.lit(None).cast("string").alias("code")).unionAll(rest.select("id", F.lit(None).cast("long"), code))


def _resting(lost: DataFrame, links: DataFrame, open_ids: DataFrame, max_rounds: int) -> DataFrame:
    """(id): of the open ids those that rest on a lost one, however far below."""
    up = links.join(open_ids, "id", "left_semi").select(F.col("underlying").alias("source"), F.col("id").alias("target"))
    return reached(lost.select(F.col("id").alias("node")), up, max_rounds).select(F.col("node").alias("id"))
