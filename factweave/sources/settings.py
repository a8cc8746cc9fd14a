"""Settings from a strict document, checked-in JSON values, and outputs activated as one set.

Documents are small and read on the driver; checked-in JSON files are read by Spark, however many there are.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the settings document with their types.
FIELDS = {
    "roots": list, "profiles": dict, "excludeParticipants": list, "excludeCalls": list, "critical": list,
    "maxMethods": int, "maxCalls": int, "maxMessages": int, "maxParticipants": int, "maxCharacters": int,
}
# Budgets where the document gives none.
DEFAULTS = {"maxMethods": 1024, "maxCalls": 4096, "maxMessages": 1024, "maxParticipants": 256, "maxCharacters": 45_000}


class SettingsError(ValueError):
    """Carries a diagnostic code as its first argument."""


def _no_repeats(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise SettingsError("SD3003", f"{k} is given twice")
        out[k] = v
    return out


def parse(document: str) -> dict:
    """Settings from a JSON document (YAML's subset): unknown or repeated fields, wrong types and bad budgets are errors."""
    try:
        found = json.loads(document, object_pairs_hook=_no_repeats) if document.strip() else {}
    except json.JSONDecodeError as e:
        raise SettingsError("SD3001", str(e)) from e
    if not isinstance(found, dict):
        raise SettingsError("SD3001", "a mapping is expected")
    for k, v in found.items():
        if k not in FIELDS:
            raise SettingsError("SD3002", f"{k} is unknown")
        if not isinstance(v, FIELDS[k]) or isinstance(v, bool):
            raise SettingsError("SD3004", f"{k} must be a {FIELDS[k].__name__}")
        if FIELDS[k] is int and v <= 0:
            raise SettingsError("SD3005", f"{k} must be positive")
    for pattern in found.get("excludeCalls", []):
        if not re.fullmatch(r"[A-Za-z_][\w.]*(\.\*)?", pattern):
            raise SettingsError("SD3014", f"{pattern} is no type, Type.Member or Type.*")
    both = set(found.get("critical", [])) & set(found.get("excludeParticipants", []))
    if both:
        raise SettingsError("SD3015", f"critical and excluded: {', '.join(sorted(both))}")
    return found


def resolve(default: dict, file: dict, profile: dict, command_line: dict) -> dict[str, tuple[object, str]]:
    """Each field's value and where it comes from; the command line goes before the named profile, the file, the default."""
    out = {}
    for name, given in (("Default", default), ("File", file), ("Profile", profile), ("CommandLine", command_line)):
        out |= {k: (v, name) for k, v in given.items() if v is not None}
    return out


def checked_in_booleans(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(path, key, value) of booleans at colon-parted keys of JSON files; comments and trailing commas are allowed.

    Files that are no JSON, and keys that are missing or hold anything but a boolean, give no row.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # A comment starts outside of strings; strings are matched first and put back.
    bare = F.regexp_replace("value", r'("(?:[^"\\]|\\.)*+")|//[^\n]*+|/\*(?s:.*?)\*/', "$1")
    bare = F.regexp_replace(bare, r'("(?:[^"\\]|\\.)*+")|,(?=\s*[}\]])', "$1")
    parsed = F.try_parse_json(bare)
    out = None
    for key in keys:
        at = "$" + "".join(f'["{k}"]' for k in key.split(":"))
        part = rows.select("path", F.lit(key).alias("key"), F.try_variant_get(parsed, at, "boolean").alias("value"), F.schema_of_variant(F.try_variant_get(parsed, at, "variant")).alias("kind"))
        part = part.where("kind = 'BOOLEAN'").drop("kind")
        out = part if out is None else out.unionAll(part)
    return out
