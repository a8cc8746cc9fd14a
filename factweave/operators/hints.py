"""Models that give more than facts: one pass over operations and one over symbols yields facts, hints and diagnostics as tagged rows.

An output is a row (tag, id, payload, evidence): tag is fact, resolution, suppression, summary or diagnostic, payload a VARIANT with the
fields of that tag, evidence an array of (id, producer, direct). The host runs the applicable models, splits their outputs by tag and checks
each in a fixed order of reasons; what fails is left out with a code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import facts

OUTPUT = "tag string, id string, payload variant, evidence array<struct<id: string, producer: string, direct: boolean>>"
# Why the host leaves an output out.
NO_EVIDENCE, HINT_WITHOUT_EVIDENCE, CONFLICT, INVALID, FOREIGN = "SEQFW001", "SEQFW002", "SEQFW003", "SEQFW004", "SEQFW005"
FIELDS = {
    "fact": {"owner": "string", "kind": "string", "value": "string", "certainty": "int"},
    "resolution": {"operation": "string", "target_method": "string", "target_type": "string", "reason": "string", "ordinal": "int", "certainty": "int"},
    "suppression": {"scope": "string", "reason": "string", "ordinal": "int", "certainty": "int"},
    "summary": {"scope": "string", "reason": "string", "ordinal": "int", "certainty": "int"},
    "diagnostic": {"code": "string", "detail": "string"},
}


@dataclass(frozen=True)
class OutputModel:
    """A model with its name and version, its place in the order, the packages it needs, and what it makes of operations and of symbols."""

    name: str
    version: str
    order: int
    packages: frozenset[str]
    operations: Callable[[DataFrame], DataFrame] | None = None
    symbols: Callable[[DataFrame], DataFrame] | None = None

    @property
    def producer(self) -> str:
        return f"{self.name}:{self.version}"


def payload(**fields: Column) -> Column:
    """A VARIANT object of the fields; nulls stay."""
    return F.to_variant_object(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _checked(tag: str) -> Column:
    """The first reason to leave an output of this tag out."""
    bare = F.coalesce(F.size("evidence") <= 0, F.lit(True))
    foreign = F.exists("evidence", lambda e: ~F.coalesce(e["producer"] == F.col("producer"), F.lit(False)) | ~F.coalesce(e["direct"], F.lit(False)))
    if tag == "diagnostic":
        return F.lit(None).cast("string")
    if tag == "fact":
        return F.when(bare | _blank("id"), NO_EVIDENCE).when(foreign, FOREIGN)
    odd = F.coalesce(F.col("ordinal") < 0, F.lit(True)) | _blank("reason")
    if tag == "resolution":
        target = lambda c: F.col(c).isNotNull() & _blank(c)
        odd = odd | _blank("operation") | (F.col("target_method").isNull() & F.col("target_type").isNull()) | target("target_method") | target("target_type")
    else:
        odd = odd | _blank("scope")
    return F.when(bare, HINT_WITHOUT_EVIDENCE).when(odd, INVALID).when(foreign, FOREIGN)


def run_outputs(models: list[OutputModel], packages: set[str], operations: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """The outputs of the models whose packages are all referenced, by tag, each a row (id, producer, the fields of its tag).

    Facts of one id and equal content count once, whichever models say so (producer: the first by name); of unequal content none
    counts (SEQFW003, once). codes(id, producer, code) holds what was left out and why; the models' own diagnostics are those of the tag.
    """
    found = operations.sparkSession.createDataFrame([], "tag string, id string, text string, evidence array<struct<id: string, producer: string, direct: boolean>>, producer string")
    found = found.select("tag", "id", F.parse_json("text").alias("payload"), "evidence", "producer")
    for m in sorted((m for m in models if m.packages <= packages), key=lambda m: (m.order, m.name)):
        for analyze, descriptors in ((m.operations, operations), (m.symbols, symbols)):
            if analyze is not None:
                found = found.unionByName(analyze(descriptors).select("tag", "id", "payload", "evidence", F.lit(m.producer).alias("producer")))
    # Each output is read and checked once, by its tag, as a field is of one type in all tags that have it. An explode of one row keeps the
    # fields apart from what refers to them, which else would read the payload again for each reference.
    kinds = {c: kind for fields in FIELDS.values() for c, kind in fields.items()}
    told = F.struct(*[F.try_variant_get("payload", f"$.{c}", kind).alias(c) for c, kind in kinds.items()])
    read = found.select("tag", "id", "producer", "evidence", F.explode(F.array(told)).alias("f")).select("tag", "id", "producer", "evidence", "f.*")
    read = read.withColumn("why", F.coalesce(*[F.when(F.col("tag") == tag, _checked(tag)) for tag in FIELDS]))
    codes = read.where("why is not null").select("id", "producer", F.col("why").alias("code"))
    out = {}
    for tag, fields in FIELDS.items():
        kept = read.where((F.col("tag") == tag) & F.col("why").isNull()).select("id", "producer", *fields)
        if tag == "fact":
            agreed, torn = facts.resolve_conflicts(kept, ["id"], list(fields), CONFLICT)
            first = kept.groupBy("id").agg(F.min("producer").alias("producer"))
            kept, codes = agreed.join(first, "id").select("id", "producer", *fields), codes.unionAll(torn.select("id", F.lit(None).cast("string"), "code"))
        out[tag] = kept
    return out | {"codes": codes}
