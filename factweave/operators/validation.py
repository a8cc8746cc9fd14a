"""Checks that name what is wrong: extracted bodies, expansions, exclusions, foreign keys. Each returns rows, none if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import orphans


def _lost(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows of a method whose non-null key is no `name` of the same method."""
    known = parent.select("method", F.col(name).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(known, ["method", key], "left_anti")


def extraction_errors(methods: DataFrame, ops: DataFrame, blocks: DataFrame, block_ops: DataFrame, regions: DataFrame) -> DataFrame:
    """(method, code, ordinal) of extracted bodies, BD1001 to BD1014.

    methods(method, place, fingerprint), ops(method, place, op, evaluation), blocks(method, place, ord, condition, fall, cond_succ),
    block_ops(method, ord, op), regions(method, place, region, ord, parent, kind, start_block, end_block); place is the row's
    place in its method's list (for methods in the whole list), ordinal the place of the faulty row.
    """

    def rows(code: str, frame: DataFrame, place: str = "place") -> DataFrame:
        return frame.select("method", F.lit(code).alias("code"), F.col(place).cast("long").alias("ordinal"))

    again = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    # Only neighbours in the list are compared, and only the first break of the whole order is told.
    neighbour = methods.select((F.col("place") + 1).alias("place"), F.col("method").alias("before"))
    unordered = methods.join(neighbour, "place").where("before >= method").agg(F.min_by("method", "place").alias("method"), F.min("place").alias("place"))
    size = blocks.groupBy("method").agg(F.count("*").alias("blocks"))
    ranged = regions.join(size, "method", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    outside = (F.col("kind") != "Root") & ((F.col("start_block") >= F.col("blocks")) | (F.col("end_block") >= F.col("blocks")))
    declared = regions.groupBy("method", F.col("region").alias("parent")).agg(F.min("place").alias("declared"))
    parents = regions.where("parent is not null").join(declared, ["method", "parent"], "left")
    found = [
        rows("BD1001", methods.withColumn("n", again("method")).where("n > 1")),
        rows("BD1002", unordered.where("method is not null")),
        rows("BD1003", methods.where("coalesce(trim(fingerprint), '') = ''")),
        rows("BD1004", ops.where("not (evaluation <=> place)")),
        rows("BD1005", ops.withColumn("n", again("method", "op")).where("n > 1")),
        rows("BD1006", blocks.where("not (ord <=> place)")),
        rows("BD1007", _lost(blocks, ops, "condition", "op")),
        rows("BD1008", _lost(block_ops, ops, "op", "op"), "ord"),
        rows("BD1009", _lost(blocks, blocks, "fall", "ord")),
        rows("BD1010", _lost(blocks, blocks, "cond_succ", "ord")),
        rows("BD1011", regions.where("not (ord <=> place)")),
        rows("BD1012", regions.withColumn("n", again("method", "region")).where("n > 1")),
        # A region that names itself counts as declared.
        rows("BD1013", parents.where("declared is null or declared > place")),
        rows("BD1014", ranged.where((F.col("start_block") < 0) | (F.col("end_block") < F.col("start_block")) | outside)),
    ]
    return reduce(DataFrame.unionAll, found)


def expansion_errors(steps: DataFrame) -> DataFrame:
    """(expansion, step, error) of steps(expansion, step, parent, place, depth, cycle, complete).

    Repeated: the id is not the step's alone. OpenCycle: a cycle that claims to be complete. Parent: there is none, it does not
    come before the step, or is not one level above it.
    """
    alone = steps.groupBy("expansion", "step").agg(F.count("*").alias("n")).where("n > 1").select("expansion", "step", F.lit("Repeated").alias("error"))
    open_cycle = steps.where("cycle and complete").select("expansion", "step", F.lit("OpenCycle").alias("error")).distinct()
    above = steps.groupBy("expansion", F.col("step").alias("parent")).agg(F.min("place").alias("before"), F.min_by("depth", "place").alias("level"))
    under = steps.where("parent is not null").join(above, ["expansion", "parent"], "left")
    wrong = under.where("before is null or before >= place or level <> depth - 1").select("expansion", "step", F.lit("Parent").alias("error")).distinct()
    return alone.unionAll(open_cycle).unionAll(wrong)


def foreign_key_errors(links: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(link, value, rows): values of foreign keys that no parent has, by (name, child, foreign key, parent, key)."""
    parts = []
    for name, child, foreign, parent, key in links:
        lost = orphans(child.select(foreign), parent, foreign, key)
        parts.append(lost.groupBy(F.col(foreign).cast("string").alias("value")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("link"), "value", "rows"))
    return reduce(DataFrame.unionAll, parts)


def structural_exclusions(exclusions: DataFrame, roots: DataFrame) -> DataFrame:
    """Exclusions(type_name) that would hide the type of a root(type_name); blank root types cannot be hidden."""
    types = roots.where("trim(type_name) <> ''").select("type_name").distinct()
    return exclusions.select("type_name").distinct().join(types, "type_name", "left_semi")


def severity_of_load(kind: Column, message: Column, promoted: Column) -> Column:
    """Warning for a Failure that is a package audit or support warning in disguise and not promoted to an error; else the kind."""
    disguised = F.coalesce(audit_code(message).isNotNull() | message.rlike(SUPPORT), F.lit(False))
    return F.when((kind == "Failure") & disguised & ~F.coalesce(promoted, F.lit(False)), "Warning").otherwise(kind)


# The forms of two warnings that the build reports as failures, and the codes of the first by severity.
_FAILED = r"^Msbuild failed when processing the file '[^\r\n]+' with message: "
AUDIT = _FAILED + r"Package '[^\r\n]+' [^\r\n]+ has a known (low|moderate|high|critical) severity vulnerability, https://github\.com/advisories/GHSA-[0-9A-Za-z-]+\z"
SUPPORT = _FAILED + (
    r"[^\r\n]+ doesn't support [^\r\n]+ and has not been tested with it\. Consider upgrading your TargetFramework to [^\r\n]+ or later\. You may also set "
    r"<SuppressTfmSupportBuildWarnings>true</SuppressTfmSupportBuildWarnings> in the project file to ignore this warning and attempt to run in this unsupported configuration at your own risk\.\z"
)
AUDIT_CODES = {"low": "NU1901", "moderate": "NU1902", "high": "NU1903", "critical": "NU1904"}


def audit_code(message: Column) -> Column:
    """The code of a package audit warning by its severity; null for other messages."""
    return F.create_map(*[F.lit(x) for pair in AUDIT_CODES.items() for x in pair])[F.regexp_extract(message, AUDIT, 1)]
