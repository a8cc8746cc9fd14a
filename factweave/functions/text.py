"""Column functions on identifiers, paths, routes, labels and literals. All are built of JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Framework type names and their language aliases.
TYPE_ALIASES = {
    "System.Boolean": "bool", "System.Byte": "byte", "System.SByte": "sbyte", "System.Char": "char", "System.Decimal": "decimal",
    "System.Double": "double", "System.Single": "float", "System.Int32": "int", "System.UInt32": "uint", "System.Int64": "long",
    "System.UInt64": "ulong", "System.Int16": "short", "System.UInt16": "ushort", "System.String": "string", "System.Object": "object",
}
# Comparison operators and their complements.
COMPLEMENTS = {"==": "!=", "!=": "==", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}
# Fragments that mark a configuration key as sensitive, after punctuation is stripped and case folded.
SENSITIVE_KEYS = ("PASSWORD", "PASSPHRASE", "PWD", "SECRET", "TOKEN", "APIKEY", "ACCESSKEY", "PRIVATEKEY", "CONNECTIONSTRING", "CREDENTIAL", "AUTHORIZATION")
# Words that make a value sensitive wherever they stand, in any case; beginnings of known tokens.
SENSITIVE_WORDS = ("password", "secret", "token", "connection-string", "connectionstring", "api_key", "apikey")
TOKEN_STARTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")
# Technical words that are written in capitals.
ACRONYMS = ("Sql", "Json", "Id", "Http", "Url", "Api", "Db", "Ef")


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with keys in the given order and explicit nulls; values are strings, numbers or booleans."""
    def value(c: Column) -> Column:
        quoted = F.to_json(F.array(c), {"ignoreNullFields": "false"})
        return F.coalesce(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("null"))

    parts = [F.concat(F.lit(f'"{k}":'), value(c)) for k, c in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def stable_id(kind: str, fields: dict[str, Column]) -> Column:
    return F.concat(F.lit(f"{kind}:v1:"), F.sha2(canonical_json(fields).cast("binary"), 256))


def framed(parts: list[Column]) -> Column:
    """Parts with their lengths, so that no two sequences share a text."""
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def normalize_path(path: Column) -> Column:
    """Forward slashes, no empty or '.' part, '..' resolved; null for rooted paths and those that leave the root."""
    flat = F.regexp_replace(path, r"\\", "/")
    parts = F.filter(F.split(flat, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("inside"))

    def step(s: Column, p: Column) -> Column:
        up = p == ".."
        kept = F.when(up, F.slice(s["kept"], 1, F.greatest(F.size(s["kept"]) - 1, F.lit(0)))).otherwise(F.concat(s["kept"], F.array(p)))
        return F.struct(kept.alias("kept"), (s["inside"] & ~(up & (F.size(s["kept"]) == 0))).alias("inside"))

    folded = F.aggregate(parts, start, step)
    rooted = flat.startswith("/") | flat.rlike("^[A-Za-z]:")
    return F.when(~rooted & folded["inside"], F.array_join(folded["kept"], "/"))


def slug(text: Column) -> Column:
    """Lower case, anything but letters and digits of ASCII as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def entry_key(name: Column, id_: Column) -> Column:
    return F.concat(slug(name), F.lit("-"), F.right(id_, F.lit(8)))


def route_combine(prefix: Column, template: Column) -> Column:
    """Prefix and template joined by one slash; a template that starts with '/' or '~/' stands alone."""
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", "")
    alone = F.coalesce(template.startswith("/") | template.startswith("~/"), F.lit(False))
    both = F.array_join(F.filter(F.array(trim(prefix), trim(template)), lambda p: p != ""), "/")
    return F.when(alone, trim(F.regexp_replace(template, "^~", ""))).otherwise(both)


def rooted_route(route: Column, controller: Column) -> Column:
    """A leading slash and the controller's name, without its ending, for its placeholder."""
    name = F.regexp_replace(controller, "Controller$", "")
    return F.concat(F.lit("/"), F.replace(F.regexp_replace(route, "^/+", ""), F.lit("[controller]"), name))


def placeholders(route: Column) -> Column:
    """Names in {name}, {name:constraint}, {name?}, {*name}, in order."""
    return F.regexp_extract_all(route, F.lit(r"\{\*{0,2}([A-Za-z_][A-Za-z0-9_]*)[^}]*\}"), F.lit(1))


def unquote(literal: Column) -> Column:
    """The value of a quoted literal with the escapes backslash, quote, n, r, t and 0; null for anything else."""
    valid = literal.rlike(r'^"([^"\\]|\\[\\"nrt0])*"$')
    # Escaped backslashes step aside first (as a character that no identifier or message holds), so that what follows
    # one is not taken for an escape.
    inner = F.replace(F.substring(literal, F.lit(2), F.length(literal) - 2), F.lit("\\\\"), F.lit("\ue000"))
    for code, char in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\0", "\0")):
        inner = F.replace(inner, F.lit(code), F.lit(char))
    return F.when(valid, F.replace(inner, F.lit("\ue000"), F.lit("\\")))


def simple_type_name(display: Column) -> Column:
    """The last name of a type's display text, without generic arguments and arity."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(display, "<.*>", ""), "`[0-9]+", ""), r"[.+]"), -1)


def single_generic_argument(display: Column) -> Column:
    """The argument of a type with exactly one that holds no comma outside of brackets; else null."""
    inner = F.regexp_extract(display, "^[^<]*<(.*)>$", 1)
    flat = inner
    for _ in range(8):  # from the innermost brackets out
        flat = F.regexp_replace(flat, "<[^<>]*>", "")
    return F.when((F.trim(inner) != "") & ~flat.rlike("[,<>]"), inner)


def effective_return_type(display: Column) -> Column:
    """The one type that a task carries, or a type without arguments itself; null for anything else."""
    task = display.rlike(r"^System\.Threading\.Tasks\.(?:Value)?Task<")
    return F.when(~display.rlike("[<>]") & (F.trim(display) != ""), display).when(task, single_generic_argument(display))


def aliased_type(display: Column) -> Column:
    bare = F.regexp_replace(display, r"\?$", "")
    table = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(table[bare], bare)


def humanize(key: Column) -> Column:
    """Words of a camel-case name, the first one as it stands with a capital, the others with a small letter, ACRONYMS in capitals."""
    words = F.split(key, r"(?<=\p{Ll})(?=\p{Lu})|(?<=.)(?=\p{Lu}\p{Ll})")
    first = lambda w, fold: F.concat(fold(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    said = F.transform(words, lambda w, k: F.when(w.isin(*ACRONYMS), F.upper(w)).when(k == 0, first(w, F.upper)).otherwise(first(w, F.lower)))
    return F.array_join(said, " ")


def pluralize(word: Column) -> Column:
    """With ies for a y after no vowel, else with s; null for endings (s, x, z, ch, sh) that want another plural, and for an empty word."""
    ies = F.regexp_replace(word, "[yY]$", "ies")
    return F.when(word.rlike("[^aeiouAEIOU][yY]$"), ies).when((F.length(word) > 0) & ~word.rlike("([sxz]|[cs]h)$"), F.concat(word, F.lit("s")))


def participant_key(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def diagram_label(text: Column) -> Column:
    """Text safe as a label: every line break (one for CR LF) a space, quotes as entities."""
    return F.replace(F.regexp_replace(text, r"\r\n|\r|\n", " "), F.lit('"'), F.lit("#quot;"))


def diagram_alias(text: Column) -> Column:
    """Text safe as a participant's unquoted name: control characters as spaces, quotes, semicolons and back-ticks as entities."""
    out = F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F]", " ")
    return F.replace(F.replace(F.replace(out, F.lit(";"), F.lit("#59;")), F.lit("`"), F.lit("#96;")), F.lit('"'), F.lit("#quot;"))


def markdown_text(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[\]])", r"\\$1")


def delay_label(milliseconds: Column) -> Column:
    """Whole seconds as seconds, else milliseconds."""
    seconds = F.concat(F.lit("Wait "), (milliseconds / 1000).cast("long").cast("string"), F.lit(" seconds"))
    return F.when(milliseconds % 1000 == 0, seconds).otherwise(F.concat(F.lit("Wait "), milliseconds.cast("string"), F.lit(" milliseconds")))


def json_boolean(json: Column, path: str) -> Column:
    """The boolean at a path of keys parted by colons; null if it is missing or not a boolean."""
    at = F.get_json_object(json, "$" + "".join(f"['{k}']" for k in path.split(":")))
    return F.when(F.lower(at) == "true", True).when(F.lower(at) == "false", False)


def observation_kind(comment: Column) -> Column:
    """Todo for comments whose text starts with TODO, FIXME or HACK, Note for NOTE, whatever the case and whatever follows; else null."""
    body = F.regexp_replace(comment, r"^\s*(//+|/\*+|\*|#)?\s*", "")
    return F.when(body.rlike(r"(?i)^(todo|fixme|hack)"), "Todo").when(body.rlike(r"(?i)^note"), "Note")


def complement(operator: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in COMPLEMENTS.items() for x in pair])[operator]


def hex_key(text: Column) -> Column:
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def sensitive_key(key: Column) -> Column:
    """Whether a key holds a sensitive fragment once everything but letters and digits is left out."""
    return F.upper(F.regexp_replace(key, r"[^\p{L}\p{Nd}]", "")).rlike("|".join(SENSITIVE_KEYS))


def looks_sensitive(value: Column) -> Column:
    """Null, a sensitive word, the form of a known token, or 16 and more letters and digits, ten of them different, with a digit."""
    word = F.lower(value).rlike("|".join(SENSITIVE_WORDS))
    known = value.rlike(r"(?s)^(AKIA|ASIA).{16}\z|(?s)^sk-.{17}") | value.rlike(f"^({'|'.join(TOKEN_STARTS)})")
    dotted = value.rlike(r"^[\p{L}\p{Nd}_-]{8,}(\.[\p{L}\p{Nd}_-]{8,}){2}\z")
    mixed = value.rlike(r"^[\p{L}\p{Nd}]{16,}\z") & value.rlike(r"\p{Nd}") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)
    return F.coalesce(word | known | dotted | mixed, F.lit(True))


def excluded_call(type_name: Column, member: Column, pattern: Column) -> Column:
    """A pattern is a type, Type.Member, or Type.* for all its members."""
    return (pattern == type_name) | (pattern == F.concat(type_name, F.lit(".*"))) | (pattern == F.concat_ws(".", type_name, member))


def output_path(path: Column) -> Column:
    """The path with forward slashes; null if it is blank, rooted, holds a scheme, or has a part that is . or .."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = (F.trim(flat) == "") | flat.startswith("/") | flat.contains("://") | flat.rlike(r"(^|/)\.\.?(/|\z)")
    return F.when(~bad, flat)


def target_framework(moniker: Column) -> Column:
    """The short name of a moniker such as .NETCoreApp,Version=v8.0 (net8.0); null for other families and forms."""
    family, version = (F.regexp_extract(moniker, r"(?is)^(.*?),Version=v(.*)\z", k) for k in (1, 2))
    short = F.when(F.lower(family) == ".netcoreapp", F.concat(F.lit("net"), version)).when(F.lower(family) == ".netstandard", F.concat(F.lit("netstandard"), version))
    return short.when(F.lower(family) == ".netframework", F.concat(F.lit("net"), F.replace(version, F.lit("."))))


def canonical_framework(moniker: Column, platform: Column, platform_version: Column, project_framework: Column) -> Column:
    """The framework with the platform that is given, else with the one that the project names for the same framework.

    A moniker of no known family gives the project's own framework.
    """
    framework = target_framework(moniker)
    named = F.trim(F.coalesce(platform, F.lit(""))) != ""
    given = F.concat(F.lit("-"), F.lower(platform), F.coalesce(platform_version, F.lit("")))
    own = F.when(F.lower(project_framework).startswith(F.lower(framework)), F.lower(F.regexp_extract(project_framework, "-.*", 0)))
    return F.when(framework.isNull(), project_framework).otherwise(F.concat(framework, F.when(named, given).otherwise(F.coalesce(own, F.lit("")))))
