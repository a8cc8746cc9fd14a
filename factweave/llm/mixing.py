"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source's weight is a schedule over training time t in [0, 1]; its integral is the source's target in words. A
document copy that covers words [c, c + n) of its source's stream is due when the source's cumulative demand reaches
the middle of that span, so inverting the integral gives its training position; documents are range-sorted by position.

Scale: texts are read once and only their word counts are shuffled. The running totals inside a source are taken in two
levels, first over at most BUCKETS hash ranges of the source and then inside each range, so that a source holding a
third of all rows is spread over BUCKETS tasks. The only unpartitioned windows run over one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

#: Weights by rank of the source, repeating; words to take as a share of all words; most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: By the same rank: a weight falls (or rises) linearly over training time from 1 + tilt to 1 - tilt times its mean.
TILTS = (0.5, 0.0, -0.5)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, tilts=TILTS) -> DataFrame:
    """sizes (no_source, source_key, source_size: one row per source) with rank, weight, tilt and target in words.

    Sources rank by code point, the missing source last. A target is min(passes * size, weight * level), where one
    level makes the targets sum to share * all sizes; that is where resharing the excess by weight comes to rest.
    """
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "source_key")) - 1)
    ranked = ranked.withColumn("weight", pick(weights)).withColumn("tilt", pick(tilts))
    ranked = ranked.withColumn("most", F.col("source_size") * passes)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    capped = F.coalesce(F.sum("most").over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("try", (total - capped) / left)
    level = F.max(F.when(F.col("try") <= F.col("most") / F.col("weight"), F.col("try"))).over(everything)
    # Without any uncapped source (rounding, or share = passes) every target is its cap.
    return ranked.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * level, F.col("most").cast("double"))))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, tilts=TILTS) -> DataFrame:
    """One row per document: what the mix takes of it and when.

    Returns doc_id, source, size, source_size, target, taken, the words taken in each pass (pass_words, array), the
    position in [0, 1] of each pass (positions, array, null where nothing is taken) and position (that of the first).
    A source's documents are taken in the order of the md5 of doc_id, size and text, passes times over, until floor(target + 0.5)
    words are taken; the document at the end is cut, so taken sums to the target to half a word.

    Null or empty text: size 0, nothing taken, no position. Null source: a source of its own, ranked last. Null
    doc_id: ordered as the empty string. Rows of equal doc_id and text tie and are interchangeable; repeated rows are documents
    of their own. Other columns are ignored whatever their names. An empty table gives an empty result.
    """
    return _plan(docs, [], weights, share, passes, tilts)


def _plan(docs: DataFrame, keys: list[str], weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, tilts=TILTS) -> DataFrame:
    """mix() with the columns `keys` of docs carried along; they also order rows of one doc_id and text.

    The order's hash takes in the text, so rows that share a doc_id, or lack one, are spread over all buckets unless they are copies.
    """
    rows = docs.select(*keys, "doc_id", F.col("source").isNull().cast("int").alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), word_count("text").alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = rows.withColumn("order_key", F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_hash"))).drop("text_hash")
    rows = rows.withColumn("bucket", F.substring("order_key", 1, 3))  # 4,096 ranges of the order key
    by = ["no_source", "source_key", "bucket"]
    rows = cut(rows)  # counts without texts: both uses below read them, and the texts are read once
    buckets = rows.groupBy(*by).agg(F.sum("size").alias("bucket_size"))
    of_source = Window.partitionBy("no_source", "source_key")
    buckets = buckets.withColumn("bucket_start", F.sum("bucket_size").over(of_source.orderBy("bucket")) - F.col("bucket_size"))
    sources = source_targets(buckets.groupBy("no_source", "source_key").agg(F.sum("bucket_size").alias("source_size")), weights, share, passes, tilts)
    buckets = buckets.join(sources, ["no_source", "source_key"]).drop("rank", "weight", "most", "try", "bucket_size")
    inside = Window.partitionBy(*by).orderBy("order_key", "size", *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(buckets, by)
    start, goal = F.col("inside") + F.col("bucket_start"), F.floor(F.col("target") + 0.5)
    begin = [start + F.col("source_size") * k for k in range(passes)]
    words = [F.greatest(F.lit(0), F.least("size", goal - b)).cast("long") for b in begin]
    part = [(b + w / 2) / F.col("target") for b, w in zip(begin, words)]
    tilt = F.col("tilt")
    # Demand up to t is target * (t + tilt * (t - t * t)); its inverse, in the form that has no division by tilt.
    when = [2 * q / ((1 + tilt) + F.sqrt(F.greatest(F.lit(0.0), (1 + tilt) * (1 + tilt) - 4 * tilt * q))) for q in part]
    rows = rows.withColumn("pass_words", F.array(*words))
    rows = rows.withColumn("positions", F.array(*[F.when(F.col("pass_words")[k] > 0, t) for k, t in enumerate(when)]))
    return rows.select(*keys, "doc_id", F.when(F.col("no_source") == 0, F.col("source_key")).alias("source"), "size", "source_size", "target", F.aggregate("pass_words", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"), "pass_words", "positions", F.col("positions")[0].alias("position"))


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """mix(), range-sorted by position; documents of which nothing is taken come last."""
    return mix(docs, **how).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row with docs' columns for each pass that takes words of a document, range-sorted by position.

    A document that a pass takes whole keeps its text; the one at which a source's target is met keeps the words taken,
    joined by single spaces (and n_chars follows). Each row has its own place in the plan, found by a hash of all its
    columns: rows that share a doc_id, or lack one, meet only their own places, and equal rows are interchangeable.
    """
    # Nulls are hashed as flags, as xxhash64 passes over them; two seeds make 128 bits.
    content = [*[F.col(c).isNull() for c in docs.columns], *[F.col(c) for c in docs.columns]]
    keys = [F.xxhash64(F.lit(seed), *content).alias(f"_key{seed}") for seed in (1, 2)]
    names = ["_key1", "_key2"]
    plan = _plan(docs.select("doc_id", "source", "text", *keys), names, **how)
    plan = plan.select(*names, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("size").alias("_size"), "pass_words", "positions")
    rows = docs.select(*keys, F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    # One of each set of equal rows is enough, as the plan has a row for each: no pairs are made of copies.
    rows = rows.groupBy(*names).agg(F.first("row").alias("row"))
    taken = rows.join(plan, names)
    taken = taken.select("_id", *names, "row", "_size", F.explode(F.arrays_zip("pass_words", "positions")).alias("pass")).where("pass.pass_words > 0")
    whole = F.col("pass")["pass_words"] >= F.col("_size")
    words = F.array_join(F.slice(F.regexp_extract_all(F.col("row")["text"], F.lit(WORD), F.lit(0)), 1, F.col("pass")["pass_words"].cast("int")), " ")
    text = F.when(whole, F.col("row")["text"]).otherwise(words)
    new = {"text": text, "n_chars": F.when(whole, F.col("row")["n_chars"]).otherwise(F.length(words).cast("long"))} if "n_chars" in docs.columns else {"text": text}
    taken = taken.orderBy(F.col("pass")["positions"], "_id", *names)
    return taken.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """curriculum() of the whole table of documents; nulls, repeats and empty tables as mix() states."""
    return curriculum(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


OP2_SQL = r"""
WITH d AS (
  SELECT *, md5(coalesce(doc_id::VARCHAR, '') || '/' || size::VARCHAR || '/' || text_hash) AS k FROM (
    SELECT doc_id, source, md5(coalesce(text, '')) AS text_hash, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS tilt, source_size * 2 AS most FROM r),
t AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS attempt FROM w),
g AS (SELECT *, least(most::DOUBLE, coalesce(weight * max(CASE WHEN attempt <= most / weight THEN attempt END) OVER (), most::DOUBLE)) AS target FROM t),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.tilt, floor(g.target + 0.5::DOUBLE)::BIGINT AS goal,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS begin1
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, greatest(0, least(size, goal - begin1)) AS take1, greatest(0, least(size, goal - begin1 - source_size)) AS take2 FROM c),
q AS (SELECT *, (begin1 + take1 / 2.0::DOUBLE) / target AS part FROM e)
SELECT doc_id, size, source_size, target, (take1 + take2)::BIGINT AS taken,
       CASE WHEN take1 > 0 THEN 2 * part / ((1 + tilt) + sqrt(greatest(0.0::DOUBLE, (1 + tilt) * (1 + tilt) - 4 * tilt * part))) END AS position
FROM q
"""
