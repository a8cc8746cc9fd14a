"""Host-level quality rules: rule failures are aggregated by host, shrunk with an empirical beta prior, and joined back.

A document is measured in one pass over its whole text and fails some of RULES. A host's rate of failure of a rule is drawn to
the rate of all hosts by a beta prior, whose mean and spread are fitted by the method of moments to the rates of all hosts
(between-host variance less the binomial part): a host with few documents stays near the common rate, a large one speaks for itself.
A host whose shrunk rate reaches HOST_LIMIT in any rule is rejected with all its documents.

Scale: texts are read once; what is shuffled are one partial row a host and task, and narrow rows. Hosts with at least one
of HOT_SHARE rows, of which there are HOT_SHARE at most, are joined by broadcast; the rest, none of them that frequent, by a plain join;
rows without a host by none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table, tidied

#: Shrunk rate of failures at which a host is rejected; hosts with one of so many rows are joined by broadcast.
HOST_LIMIT, HOT_SHARE = 0.5, 1000
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: What a document fails, by name; the first two are the base rules.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "symbols": "100 * n_symbols > 10 * n_words",
    "letters": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 10 * n_words)",
}
BASE = ("short", "repeats")


def measures(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text: words, their code points, symbols, repeated lines, words in repeated windows of 3, lines with a word."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at exactly the characters of SPACES
    lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, until = Counter(windows), 0
        for k, window in enumerate(windows):
            if seen[window] > 1:
                repeated += k + 3 - max(k, until)
                until = k + 3
    return (
        len(words),
        len(text) - sum(data.count(bytes([c])) for c in SPACES),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
    )


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and COUNTS of every row's whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(batch):
            found = [measures(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*found)) or [()] * len(COUNTS)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "host", *COUNTS])

        yield from tidied(map(one, batches))

    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), "text")
    return rows.mapInArrow(measure, f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def beta_prior(n: int, failed: int, hosts: int, squares: float, rates: float) -> tuple[float, float]:
    """(alpha, beta) from the rows of all hosts, those that fail, the hosts, and the sums of n * n and failed * failed / n over hosts.

    Where hosts vary no more than chance explains, or nothing or everything fails, the prior is so strong that every host
    has the common rate; one host alone gives no variance and so the same.
    """
    mean = failed / n if n else 0.0
    chance = mean * (1 - mean)
    room = n - squares / n if n else 0.0
    between = ((rates - n * mean * mean) - (hosts - 1) * chance) / room if room > 0 else 0.0
    share = min(max(between / chance, 1e-9), 1 - 1e-9) if chance > 0 else 1e-9
    strength = 1 / share - 1
    return mean * strength, (1 - mean) * strength


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n_docs, shrunk_<rule> for each of RULES, of measured() rows that have a host."""
    sums = [F.sum(F.expr(rule).cast("long")).alias(f"fails_{name}") for name, rule in RULES.items()]
    hosts = cut(rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), *sums))
    n = F.col("n_docs").cast("double")
    whole = [F.sum("n_docs"), F.count("*"), F.sum(n * n)]
    total, count, squares, *by_rule = hosts.agg(*whole, *[x for name in RULES for x in (F.sum(f"fails_{name}"), F.sum(F.col(f"fails_{name}").cast("double") * F.col(f"fails_{name}") / n))]).first()
    shrunk = []
    for k, name in enumerate(RULES):
        alpha, beta = beta_prior(total or 0, by_rule[2 * k] or 0, count, squares or 0.0, by_rule[2 * k + 1] or 0.0)
        shrunk.append(((F.col(f"fails_{name}") + alpha) / (F.col("n_docs") + (alpha + beta))).alias(f"shrunk_{name}"))
    return hosts.select("host", "n_docs", *shrunk)


def host_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: doc_id, host, COUNTS, base_failed, host_docs, host_rate, host_kept and kept.

    host_rate is the largest of the host's shrunk rates (rounded to 9 places), host_kept whether it stays below limit; kept
    is host_kept and not base_failed. Null and empty texts have 0 words and fail the base rules, as texts without words.
    A null host is no host: its rows have host_docs 0, host_rate 0 and are judged by themselves; an empty string is a host. Repeated
    rows and equal or null doc_ids count and come out row by row; ties need no order. Other columns are ignored whatever
    their names. An empty table gives an empty result.
    """
    rows = cut(measured(docs, host))
    rates = host_rates(rows).select("host", F.col("n_docs").alias("host_docs"), F.round(F.greatest(*[f"shrunk_{name}" for name in RULES]), 9).alias("host_rate"))
    least = rows.count() / HOT_SHARE
    hot, rest = (cut(rates.where(F.col("host_docs") >= least)), rates.where(F.col("host_docs") < least))
    known = rows.where("host is not null")
    frequent = known.join(F.broadcast(hot), "host")
    others = known.join(F.broadcast(hot.select("host")), "host", "left_anti").join(rest, "host")
    alone = rows.where("host is null").withColumns({"host_docs": F.lit(0).cast("long"), "host_rate": F.lit(0.0)})
    failed: Column = F.expr(" or ".join(f"({RULES[name]})" for name in BASE))
    joined = frequent.unionByName(others).unionByName(alone).withColumns({"base_failed": failed, "host_kept": F.col("host_rate") < limit})
    return joined.select("doc_id", "host", *COUNTS, "base_failed", "host_docs", "host_rate", "host_kept", (F.col("host_kept") & ~F.col("base_failed")).alias("kept"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host_rules() of the whole table of documents, whose source is the host; nulls, repeats and empty tables as stated there."""
    return host_rules(table(spark, sf_dir, "documents")).drop("host")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
u AS (SELECT row, unnest(words) AS w1, unnest(range(1, len(words) + 1)) AS pos FROM w),
x AS (SELECT row, pos, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY row ORDER BY pos)),
m AS (SELECT row, pos, w3 IS NOT NULL AND count(*) OVER (PARTITION BY row, w1, w2, w3) > 1 AS again FROM x),
r AS (SELECT row, count(*) FILTER (again OR coalesce(lag1, false) OR coalesce(lag2, false)) AS n_repeat_words FROM (
  SELECT row, again, lag(again, 1) OVER o AS lag1, lag(again, 2) OVER o AS lag2 FROM m WINDOW o AS (PARTITION BY row ORDER BY pos)) GROUP BY row),
l AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
c AS (SELECT d.row, d.doc_id, d.source, len(w.words)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l.lines) - len(list_distinct(l.lines)))::BIGINT AS n_dup_lines,
             coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l.lines)::BIGINT AS n_lines
      FROM d JOIN w USING (row) JOIN l USING (row) LEFT JOIN r USING (row)),
f AS (SELECT *, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 100 * n_dup_lines > 30 * n_lines, 100 * n_symbols > 10 * n_words,
                        n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)]) AS fails, unnest(range(5)) AS rule FROM c WHERE source IS NOT NULL),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (fails) AS k FROM f GROUP BY ALL),
t AS (SELECT rule, sum(n)::DOUBLE AS n, sum(k)::DOUBLE / sum(n)::DOUBLE AS mean, count(*) AS hosts, sum(n::DOUBLE * n) AS squares, sum(k::DOUBLE * k / n) AS rates FROM h GROUP BY rule),
p AS (SELECT *, mean * (1 - mean) AS chance, CASE WHEN n - squares / n > 0 THEN ((rates - n * mean * mean) - (hosts - 1) * mean * (1 - mean)) / (n - squares / n) ELSE 0 END AS between FROM t),
s AS (SELECT rule, mean, 1 / CASE WHEN chance > 0 THEN least(greatest(between / chance, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) ELSE 1e-9::DOUBLE END - 1 AS strength FROM p),
g AS (SELECT source, max(n) AS host_docs, round(max((k + mean * strength) / (n + strength)), 9) AS host_rate FROM h JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       coalesce(host_docs, 0)::BIGINT AS host_docs, coalesce(host_rate, 0)::DOUBLE AS host_rate, coalesce(host_rate, 0) < 0.5 AS host_kept,
       coalesce(host_rate, 0) < 0.5 AND NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS kept
FROM c LEFT JOIN g USING (source)
"""
