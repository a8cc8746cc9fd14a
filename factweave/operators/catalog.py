"""The query surface: catalog, lookups, counts, filters of what is shown, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .calls import cut

# Severities from most to least severe.
SEVERITIES = ("Error", "Warning", "Info")


def catalog(entities: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, name, context, detail) of entity tables, each given with columns id, name, context and detail."""
    out = None
    for kind, rows in entities.items():
        rows = rows.select(F.lit(kind).alias("kind"), *[F.col(c).cast("string").alias(c) for c in ("id", "name", "context", "detail")])
        out = rows if out is None else out.unionByName(rows)
    return out


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind)


def with_text(rows: DataFrame, wanted: str) -> DataFrame:
    """Rows that hold the text, whatever its case, in id, name, context or detail; nulls hold nothing."""
    hit = F.lit(False)
    for c in ("id", "name", "context", "detail"):
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(wanted.lower())), F.lit(False))
    return rows.where(hit)


def by_prefix(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each prefix with the one row whose id starts with it; SD4002 without, SD4003 with several.

    Prefixes of a fixed length are looked up by equality on the start of the id, which keeps this an equi-join; lengths
    that occur are few and are the only thing brought to the driver.
    """
    out = None
    for (n,) in prefixes.select(F.length("prefix").alias("n")).distinct().collect():
        heads = rows.groupBy(F.substring("id", 1, n).alias("prefix")).agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min_by("name", "id").alias("name"))
        part = prefixes.where(F.length("prefix") == n).join(heads, "prefix", "left")
        out = part if out is None else out.unionAll(part)
    n = F.coalesce("n", F.lit(0))
    return out.select("prefix", F.when(n == 1, F.col("id")).alias("id"), F.when(n == 1, F.col("name")).alias("name"), F.when(n == 0, "SD4002").when(n > 1, "SD4003").alias("code"))


def counts(entities: dict[str, DataFrame]) -> DataFrame:
    out = None
    for kind, rows in entities.items():
        rows = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = rows if out is None else out.unionAll(rows)
    return out


def severity_counts(diagnostics: DataFrame, by: list[str]) -> DataFrame:
    return diagnostics.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])


def shown_diagnostics(diagnostics: DataFrame, distinct_on: list[str], most: int = 20) -> DataFrame:
    """What a report shows: distinct diagnostics, the most severe first, then by stage, code and id; `most` of them."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    first = diagnostics.groupBy(*distinct_on).agg(F.min("id").alias("id"))
    order = [rank, F.col("stage"), F.col("code"), F.col("id")]
    return first.orderBy(*order).limit(most)


def unhidden(calls: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls(type_name, member) that no pattern hides, and hidden ones counted by type.

    A pattern is a type, Type.Member or Type.*: each call has three keys to look up, so this is an equi-join.
    """
    keys = F.array("type_name", F.concat("type_name", F.lit(".*")), F.concat_ws(".", "type_name", "member"))
    wanted = patterns.select("pattern").distinct()
    numbered = calls.select("*", F.explode(keys).alias("pattern")).join(wanted, "pattern", "left_semi").drop("pattern").distinct()
    return calls.join(numbered, calls.columns, "left_anti"), numbered.groupBy("type_name").agg(F.count("*").alias("hidden"))


def label_suffixes(labels: DataFrame, key: str, path: str, separator: str = ".") -> DataFrame:
    """(key, label): the shortest suffix of a qualified name that no other name has; the whole name where none is unique."""
    parts = F.split(path, "[" + separator + "]")
    named = labels.select(F.col(key).alias("key"), F.col(path).alias("path"), parts.alias("parts"))
    suffixes = named.select("key", "path", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"), "parts")
    suffixes = suffixes.select("key", "path", "k", F.array_join(F.slice("parts", F.size("parts") - F.col("k") + 1, F.col("k")), separator).alias("suffix"))
    alone = suffixes.groupBy("suffix", "k").agg(F.count_distinct("path").alias("n")).where("n = 1").select("suffix", "k")
    best = suffixes.join(alone, ["suffix", "k"]).groupBy("key").agg(F.min_by("suffix", "k").alias("suffix"))
    return named.join(best, "key", "left").select("key", F.coalesce("suffix", "path").alias("label"))


def run_actives(runs: DataFrame) -> DataFrame:
    """The active run of each profile: its latest completed one, by start and id."""
    return runs.where("state = 'Completed'").groupBy("profile").agg(F.max_by("run_id", F.struct("started", "run_id")).alias("run_id"))


def upsert(pointers: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Pointers with those of new in place of their own."""
    return pointers.join(new.select(key), key, "left_anti").unionByName(new)


def illegal_transitions(runs: DataFrame) -> DataFrame:
    """Runs that follow, in their profile, a run still in staging: a profile has one open run at most."""
    before = F.lag("state").over(Window.partitionBy("profile").orderBy("started", "run_id"))
    return runs.withColumn("before", before).where("before = 'Staging'").select("profile", "run_id", "before", "state")


def resolve_setting(default, file, profile, command_line):
    """(value, source): the command line before the named profile before the file before the default."""
    value = F.coalesce(command_line, profile, file, default)
    source = F.when(command_line.isNotNull(), "CommandLine").when(profile.isNotNull(), "Profile").when(file.isNotNull(), "File").otherwise("Default")
    return value, source


def validate_roots(roots: DataFrame, methods: DataFrame) -> DataFrame:
    """(root, code): SD3012 for ids that are no method id, SD3013 for those of no indexed method."""
    shaped = F.col("root").rlike("^method:v1:[0-9a-f]{64}$")
    known = roots.join(methods.select(F.col("id").alias("root")).distinct().withColumn("known", F.lit(True)), "root", "left")
    return known.select("root", F.when(~shaped, "SD3012").when(F.col("known").isNull(), "SD3013").alias("code")).where("code is not null")


def entry_points(framework: DataFrame, configured: DataFrame) -> DataFrame:
    """Framework entries(entry, root, kind), and configured ones whose root no framework entry has already."""
    columns = ["entry", "root", "kind"]
    new = configured.join(framework.select("root").distinct(), "root", "left_anti")
    return framework.select(*columns).unionAll(new.select(*columns))


def symbols(types: DataFrame, members: DataFrame, methods: DataFrame) -> DataFrame:
    """Every symbol once, whichever of the three tables(symbol) name it; null symbols are none."""
    return types.select("symbol").unionAll(members.select("symbol")).unionAll(methods.select("symbol")).where("symbol is not null").distinct()


RESERVED_KEYS = ("client", "action", "dispatch", "handler", "service", "data")  # Fixed values.


def participant_keys(types: DataFrame) -> DataFrame:
    """(graph, type_name, key): a key for each type of a graph, of letters, digits and underscores.

    Keys that several types share, or that are reserved, are lengthened by the hex form of the type, again while any are equal.
    """
    bare, suffix = text.participant_key(F.col("type_name")), F.concat(F.lit("_"), text.hex_key(F.col("type_name")))
    same = F.count("*").over(Window.partitionBy("graph", "key"))
    out = types.where("trim(type_name) <> ''").select("graph", "type_name").distinct().withColumn("key", bare)
    out = cut(out.withColumn("n", same).withColumn("key", F.when((F.col("n") > 1) | F.col("key").isin(*RESERVED_KEYS), F.concat("key", suffix)).otherwise(F.col("key"))).drop("n"))
    while out.groupBy("graph", "key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        out = cut(out.withColumn("n", same).withColumn("key", F.when(F.col("n") > 1, F.concat("key", suffix)).otherwise(F.col("key"))).drop("n"))
    return out
