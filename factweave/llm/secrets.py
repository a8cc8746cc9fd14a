"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is parsed and turned into a Boolean query over lower-case trigrams (trigrams.query_of: an OR of
ANDs that every text with a match fulfils). The index lists, for each trigram that some query names, the documents that
hold it; a rule's candidates are the intersections of its clauses' postings; only candidates are matched against the rule.
A rule without a mandatory trigram has no query and scans every document.

Scale: the index is built where texts are read and shuffles (trigram, doc_id) pairs only. One rare trigram of each clause is
looked for first, the others only in texts that hold it. Candidates (few rows) are counted and broadcast if few enough, else
joined. Texts stay where they are unless candidates are too many to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .trigrams import ANYTHING, query_of

#: Documents with candidates that are broadcast at most; matches walked at once, so that no long array grows one by one.
BROADCAST_IDS, WALK = 500_000, 256
# Letters from the most to the least frequent in English text.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


@dataclass(frozen=True)
class Rule:
    """kind; Java regular expression, scanned leftmost and non-overlapping; the group and length that make a match count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def clauses(self) -> list[list[str]]:
        """The pattern's trigram query; none, if no trigram is mandatory."""
        query = query_of(self.pattern)
        return [] if query == ANYTHING else sorted(map(sorted, query))


# The patterns of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Public formats of further secrets.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def anchors(clauses: list[list[str]]) -> dict[str, set[str]]:
    """Trigrams to look for first, so that every clause holds one, each with the trigrams of its clauses.

    One that serves most clauses is taken first, of those the one of the rarest letters (other characters are rarer still).
    """
    rarity = lambda t: sum(FREQUENT.find(c) if c in FREQUENT else len(FREQUENT) for c in t)
    left, found = [set(c) for c in clauses], {}
    while left:
        best = max({t for c in left for t in c}, key=lambda t: (sum(t in c for c in left), rarity(t), t))
        found[best] = set().union(*(c for c in left if best in c)) - {best}
        left = [c for c in left if best not in c]
    return found


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """The index: a row (trigram, doc_id) for each trigram of the rules' queries and each document that holds it.

    Documents are left out of a trigram's list where no clause with it can be whole, as its first trigram is missing.
    """
    first = anchors([c for r in rules for c in r.clauses()])
    holds = lambda t: F.when(F.contains(F.col("lower"), F.lit(t)), F.lit(t))
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("lower"))
    if not first:
        return rows.select(F.lit(None).cast("string").alias("trigram"), "doc_id").where("trigram is not null")
    # Exploding drops texts without any anchor; a filter on the array would search each text twice.
    rows = rows.select("doc_id", "lower", F.explode(F.array_compact(F.array(*map(holds, sorted(first))))).alias("anchor"))
    others = F.array().cast("array<string>")
    for t, more in first.items():
        if more:
            others = F.when(F.col("anchor") == t, F.array_compact(F.array(*map(holds, sorted(more))))).otherwise(others)
    return rows.select("doc_id", F.explode(F.concat(F.array("anchor"), others)).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, kinds): documents in the intersection of all postings of some clause of each kind's query."""
    spark = index.sparkSession
    clauses = [(r.kind, f"{r.kind}/{k}", t, len(c)) for r in rules for k, c in enumerate(r.clauses()) for t in c]
    named = spark.createDataFrame(clauses, "kind string, clause string, trigram string, size int")
    met = index.distinct().join(F.broadcast(named), "trigram").groupBy("doc_id", "kind", "clause", "size").agg(F.count("*").alias("met"))
    return met.where("met = size").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _walk(items: Column, state: Column, step, out) -> Column:
    """Fold `items` over a state, WALK of them at a time; out(state, block) gives a pair (state, value); the values in order.

    A growing array or string is copied at each step, so only a block's own grows item by item.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / WALK).cast("int")), lambda k: F.slice(items, k * WALK + 1, WALK))
    blocks = F.when(F.size(items) > 0, blocks)
    return F.aggregate(blocks, state, step, out)


def _spans(rule: Rule) -> Column:
    """Counting matches of a rule in `text` as structs (start, finish, size), by position; code points, end exclusive.

    Matches and the gaps between them (split keeps all, empty ones too) alternate, so a match starts where the lengths
    of the gaps up to it and the matches before it sum to.
    """
    # A fixed minimum length of the whole match can go into the pattern if it is one run: the scan then skips short runs.
    pattern, least = rule.pattern, rule.least
    if rule.group == 0 and least and pattern.endswith("]+"):
        fixed = 0 if pattern.startswith("[") else pattern.index("[")
        pattern, least = f"{pattern[:-1]}{{{least - fixed},}}", 0
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    checked = F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group)) if rule.group else found
    empty = F.array().cast("array<struct<start:int,finish:int,size:int>>")
    nothing = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def one(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["g"])
        span = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("finish"), F.length(x["c"]).alias("size"))
        return nothing(start + F.length(x["m"]), F.concat(s["out"], F.array(span)))

    def block(s: Column, items: Column) -> Column:
        done = F.aggregate(items, nothing(s["at"], empty), one)
        return _let(done, lambda d: nothing(d["at"], F.concat(s["out"], F.array(d["out"]))))

    items = F.arrays_zip(found.alias("m"), checked.alias("c"), F.split("text", pattern, -1).alias("g"))
    # The last gap has no match of its own.
    walk = lambda zipped: F.flatten(_walk(F.filter(zipped, lambda x: x["m"].isNotNull()), nothing(F.lit(0), F.array().cast("array<array<struct<start:int,finish:int,size:int>>>")), block, lambda s: s["out"]))
    spans = F.coalesce(_let(items, walk), empty)
    return F.filter(spans, lambda x: x["size"] >= least) if least else spans


def _ranked(rank: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["finish"].alias("finish"), F.lit(kind).alias("kind"))


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of docs: doc_id, text (empty for null), row (all of docs' columns) and spans by start and rank.

    spans: array of (start, rank, finish, kind) in code points, finish exclusive.
    rank is the rule's place among the rules. Null and empty texts have no spans. Rows with equal or null doc_ids are
    scanned each by itself (null ids for every rule, as no index names them). Other columns are ignored whatever their
    names; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    chosen = cut(candidates(postings(rows.where("doc_id is not null"), rules), rules))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    rows = rows.join(chosen, "doc_id", "left")
    none = F.array().cast("array<struct<start:int,rank:int,finish:int,kind:string>>")
    parts = []
    for rank, rule in enumerate(rules):
        ranked = F.transform(_spans(rule), _ranked(rank, rule.kind))
        if rule.clauses():
            may = F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        else:  # full scan; the cheap test for one long enough match comes first
            may = F.expr(f"text rlike '{rule.pattern[:-1]}{{{rule.least}}}'") if rule.least and rule.pattern.endswith("]+") else F.lit(True)
        parts.append(F.when(may, ranked).otherwise(none))
    return rows.select("doc_id", "text", "row", F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as kind:start:finish, joined by commas; no spans give an empty string."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["finish"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_secrets() rows: counts of base kinds, hash of base spans, all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE_RULES))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules=RULES, mask: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by a mask (overlapping spans by one); n_chars follows; other columns stay.

    Null and empty texts and texts without spans stay as they are, n_chars too. Rows with equal or null doc_ids are masked each by
    itself; other columns may have any name; an empty table gives an empty result.
    """
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def masked(s: Column, x: Column, text: Column, base: Column) -> Column:
        plain = F.substring(text, s["at"] - base + 1, x["start"] - s["at"])
        return state(F.greatest(s["at"], x["finish"]), F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], plain, F.lit(mask))))

    def block(s: Column, spans: Column) -> Column:
        stop = F.greatest(s["at"], F.array_max(F.transform(spans, lambda x: x["finish"])))
        text = F.substring(F.col("text"), s["at"] + 1, stop - s["at"])
        done = _let(text, lambda part: F.aggregate(spans, state(s["at"], F.lit("")), lambda z, x: masked(z, x, part, s["at"])))
        return _let(done, lambda d: state(d["at"], F.concat(s["out"], F.array(d["out"]))))

    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text")))
    walked = _walk(F.col("spans"), state(F.lit(0), F.array().cast("array<string>")), block, rest)
    found = find_secrets(docs, rules).withColumn("masked", F.when(F.size("spans") > 0, walked).otherwise(F.col("row")["text"]))
    new = {"text": F.col("masked"), "n_chars": F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest() of the secrets of the whole table of documents; nulls, repeats and empty tables as find_secrets() states."""
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind in DuckDB: matches and gaps alternate, as above."""
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start_at AS a, start_at + length(m) AS b FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(regexp_extract_all(text, '{pattern}', {group})) AS c,
             unnest(list_transform(range(1, len(g)), lambda i: (list_sum(list_transform(g[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(regexp_extract_all(text, '{pattern}')[1:i - 1], lambda x: length(x))), 0))::BIGINT)) AS start_at
      FROM (SELECT doc_id, text, regexp_split_to_array(text, '{pattern}') AS g FROM t)) WHERE length(c) >= {least}"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP3_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_sql_spans("assign", 0, _ASSIGN, 2, 6)} UNION ALL {_sql_spans("access", 1, "AKIA[A-Z0-9]{16,}", 0, 20)} UNION ALL {_sql_spans("hex", 2, "[0-9a-f]{24,}", 0, 24)}
  UNION ALL {_sql_spans("private_key", 3, "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0)} UNION ALL {_sql_spans("github", 4, "gh[pousr]_[A-Za-z0-9]{36,255}", 0, 0)}
  UNION ALL {_sql_spans("slack", 5, "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0)} UNION ALL {_sql_spans("jwt", 6, MORE_RULES[3].pattern, 0, 0)}),
j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN j USING (doc_id)
"""
