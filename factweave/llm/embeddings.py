"""Embedding near-dedup by an epsilon grid order join.

Vectors of length one are within epsilon = sqrt(2 - 2 * threshold) of each other exactly if their cosine reaches the threshold.
They are sorted by grid cells of that width on leading principal dimensions (inside a cell by finer cells) and cut into sequence
intervals of bounded bytes. Pairs of intervals are joined recursively: spans of intervals first, then intervals, then, inside
a task, halves of intervals down to short runs; whatever has boxes provably more than epsilon apart is skipped. Boxes
are taken over all rotated dimensions (spans: the leading ones). Runs are compared by matrix products and, close to the
threshold, again in double precision.

Equal vectors are one class from the start, so a third of all rows being copies of one vector costs nothing further; rows
meet their class by class and salt. A task joins a square of up to SQUARE by SQUARE intervals, so that an interval goes to one task
for each strip of intervals that it is joined with, not for each interval; it returns link counts by class and the edges of a
spanning forest, never all pairs. The rotation is fitted on at most SAMPLE classes: any rotation gives the same links.

In vectors without clusters the boxes overlap and all pairs of intervals are compared, which is work of the square of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, small_batches, table

THRESHOLD = 0.9
#: Classes that the rotation is fitted on; leading dimensions of the grid; vectors in a run; parts that members of a class are dealt to.
SAMPLE, LEADING, RUN, SALTS = 4096, 8, 128, 4096
#: Bytes of an interval (in double precision); spans of intervals whose boxes the driver joins; rows that are broadcast at most.
INTERVAL_BYTES, SPANS, BROADCAST_ROWS = 4 << 20, 256, 500_000
#: Intervals on a side of the square that a task joins, at most, and squares for each shuffle partition below which they are smaller.
SQUARE, SQUARES = 8, 4


def units(vectors) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def grid_keys(led: np.ndarray, eps: float) -> list[bytes]:
    """Sort keys: the cell on each leading dimension, a byte each, then in the same order cells of an eighth of the width."""
    led = led[:, :LEADING]
    cells = [np.clip(np.floor(led / width) + 128, 1, 255).astype(np.uint8) for width in (eps, eps / 8)]
    return [row.tobytes() for row in np.concatenate(cells, axis=1)]


def apart(low1, high1, low2, high2) -> float:
    gap = np.maximum(0.0, np.maximum(low1 - high2, low2 - high1))
    return float(np.sqrt((gap * gap).sum()))


class Runs:
    """A sequence of unit vectors in runs, with the boxes of every run and, halving, of spans of runs."""

    def __init__(self, part: pd.DataFrame, rotation: np.ndarray, run: int):
        self.run = run
        self.cls, self.rep, self.copies, self.marked = (part[c].to_numpy() for c in ("cls", "rep", "copies", "marked"))
        self.x, u = units(part["vector"])
        led = u @ rotation
        self.u32 = u.astype(np.float32)
        cuts = np.arange(0, len(led), run)
        self.low, self.high = np.minimum.reduceat(led, cuts), np.maximum.reduceat(led, cuts)

    def __len__(self) -> int:
        return len(self.low)

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.low[a:b].min(axis=0), self.high[a:b].max(axis=0)


def joined_runs(left: Runs, right: Runs, eps: float) -> Iterator[tuple[int, int]]:
    """Pairs of runs that may hold a link, by recursion over halves; of a sequence with itself those with p <= q."""
    alone = left is right
    spans = [(0, len(left), 0, len(right))]
    while spans:
        a, b, c, d = spans.pop()
        if (alone and a >= d) or apart(*left.box(a, b), *right.box(c, d)) > eps:
            continue
        if b - a == d - c == 1:
            yield a, c
            continue
        halves = lambda p, q: [(p, q)] if q - p == 1 else [(p, (p + q) // 2), ((p + q) // 2, q)]
        spans += [(*x, *y) for x in halves(a, b) for y in halves(c, d)]


def _linked(a: Runs, p: slice, b: Runs, q: slice, same: bool, threshold: float) -> np.ndarray:
    """Which vectors of two runs are linked; of a run with itself without the diagonal."""
    s = a.u32[p] @ b.u32[q].T
    linked = s >= threshold
    close = np.abs(s - threshold) < 1e-4
    if close.any():
        for i, j in np.argwhere(close):
            x, y = a.x[p][i], b.x[q][j]
            linked[i, j] = float(x @ y) / (math.sqrt(float(x @ x)) * math.sqrt(float(y @ y))) >= threshold
    if same:
        np.fill_diagonal(linked, False)
    return linked


def _join_group(rotation: np.ndarray, threshold: float, run: int):
    eps = _eps(threshold)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        own = {(side, interval): Runs(part.sort_values("place"), rotation, run) for (side, interval), part in group.groupby(["side", "interval"])}
        sides = [[k for s, k in own if s == side] for side in (0, 1)]
        counts: dict[int, int] = {}
        edges: set[tuple[int, int]] = set()
        explicit: set[tuple[int, int]] = set()
        for i in sides[0]:
            for j in sides[1] or [k for k in sides[0] if k >= i]:  # of a strip with itself each pair once
                left, right = own[0, i], own[1 if sides[1] else 0, j]
                join_intervals(left, right, counts, edges, explicit)
        out = [(i, k, None, None, None) for i, k in counts.items()]
        out += [(None, 0, a, b, None) for a, b in edges]
        out += [(i, 0, None, None, j) for a, b in explicit for i, j in {(a, b), (b, a)}]
        columns = zip(*out) if out else [()] * 5
        return pd.DataFrame({c: pd.array(list(v), dtype="Int64") for c, v in zip(("cls", "links", "a", "b", "far"), columns)})

    def join_intervals(left: Runs, right: Runs, counts: dict[int, int], edges: set, explicit: set) -> None:
        alone = left is right
        for m, n in joined_runs(left, right, eps):
            p, q = slice(m * run, (m + 1) * run), slice(n * run, (n + 1) * run)
            same = alone and m == n
            linked = _linked(left, p, right, q, same, threshold)
            rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if not len(rows):
                continue
            linked = linked[np.ix_(rows, cols)]
            ids, jds = left.cls[p][rows], right.cls[q][cols]
            for i, k in zip(ids, linked @ right.copies[q][cols]):
                counts[int(i)] = counts.get(int(i), 0) + int(k)
            if not same:
                for j, k in zip(jds, left.copies[p][rows] @ linked):
                    counts[int(j)] = counts.get(int(j), 0) + int(k)
            if left.marked[p][rows].any() or right.marked[q][cols].any():
                one, two = np.nonzero(linked & (left.marked[p][rows][:, None] | right.marked[q][cols][None, :]))
                explicit.update((int(i), int(j)) for i, j in zip(ids[one], jds[two]))
            far = np.iinfo(np.int64).max
            own, other = left.rep[p][rows], right.rep[q][cols]
            mine, theirs = own.copy(), other.copy()
            while True:  # smallest name reachable inside the pair of runs
                new = np.minimum(mine, np.where(linked, theirs[None, :], far).min(axis=1))
                newer = np.minimum(theirs, np.where(linked, new[:, None], far).min(axis=0))
                if (new == mine).all() and (newer == theirs).all():
                    break
                mine, theirs = new, newer
            edges.update((int(i), int(k)) for i, k in zip((*own, *other), (*mine, *theirs)) if i != k)

    return join


def _eps(threshold: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id, are linked with
    nothing (component_id is their vec_id, kept). Vectors of different length are not linked. Rows of one vec_id are one
    vertex, whatever their vectors: it is linked with another vec_id if any of its vectors is with any of the other's, n_links
    counts the other vec_ids, and all its rows get the same values. Other columns are ignored whatever their names. An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    double = "double" in vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>" if double else "array<float>").alias("vector"))
    good = F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    key = ["size", "hash1", "hash2"]
    real = rows.where("good").select("vec_id", "vector", F.size("vector").alias("size"), F.xxhash64("vector").alias("hash1"), F.xxhash64(F.lit(1), "vector").alias("hash2"))
    # Classes in two levels: of a large class no more than SALTS rows ever meet in one task.
    own = cut(real.select(*key, "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")).distinct())
    salted = own.groupBy(*key, "salt").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(salted.groupBy(*key).agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies")).withColumn("cls", F.monotonically_increasing_id()))
    member = own.join(own.select(*key, "salt").distinct().join(classes.select(*key, "cls", "rep"), key), [*key, "salt"]).select("vec_id", "cls", "rep")
    several = cut(own.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
    repeats = not several.isEmpty()
    member = cut(member) if repeats else member
    multi = cut(member.join(several, "vec_id", "left_semi")) if repeats else None
    counted = classes.withColumn("marked", F.lit(False))
    if repeats:  # ids of several classes are counted apart
        here = multi.groupBy("cls").agg(F.count("*").alias("here"))
        counted = cut(classes.join(here, "cls", "left").select(*key, "cls", "rep", (F.col("copies") - F.coalesce("here", F.lit(0))).alias("copies"), F.col("here").isNotNull().alias("marked")))
    whole = real.groupBy(*key, "vec_id").agg(F.first("vector").alias("vector")).join(counted.withColumnRenamed("rep", "vec_id"), [*key, "vec_id"])
    whole = cut(whole.select("cls", F.col("vec_id").alias("rep"), "copies", "marked", "vector"))
    links = None
    for (size,) in sorted(classes.select("size").distinct().collect()):  # lengths of vectors, commonly one
        part = _linked_classes(whole.where(F.size("vector") == size), size, threshold)
        links = part if links is None else links.unionAll(part)
    links = cut(links if links is not None else spark.createDataFrame([], LINKS))
    edges = links.where("a is not null").select("a", "b")
    if repeats:
        edges = edges.unionAll(multi.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    found = components(edges)
    sums = links.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    sums = counted.join(sums, "cls", "left").select("cls", "rep", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("links"))
    named = sums.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("cls", "links", F.coalesce("component", "rep").alias("component"))
    if repeats:
        named, apart_ids = _repeated(links, counted, multi, named)
    by_salt = own.select(*key, "salt").distinct().join(classes.select(*key, "cls"), key).join(named, "cls").select(*key, "salt", "links", "component")
    of_id = own.join(by_salt, [*key, "salt"]).select("vec_id", (F.col("links") - 1).alias("links"), "component")
    if repeats:
        of_id = of_id.join(several, "vec_id", "left_anti").unionAll(apart_ids)
    with_id = rows.where("vec_id is not null").select("vec_id").join(of_id, "vec_id", "left")
    out = with_id.unionAll(rows.where("vec_id is null").select("vec_id", F.lit(None).cast("long"), F.lit(None).cast("long")))
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _repeated(links: DataFrame, counted: DataFrame, multi: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """named with ids of several classes added to links; and (vec_id, links, component) of those ids themselves.

    Links of the classes that hold such ids are there one by one (cls, far); an id met through several classes counts once.
    """
    pairs = links.where("far is not null").select("cls", "far").unionAll(counted.where("marked").select("cls", F.col("cls").alias("far"))).distinct()
    met = pairs.join(multi.select(F.col("cls").alias("far"), F.col("vec_id").alias("other")), "far").select("cls", "other").distinct()
    extra = met.groupBy("cls").agg(F.count("*").alias("extra"))
    reached = multi.select("vec_id", "cls").join(pairs, "cls").select("vec_id", F.col("far").alias("cls")).distinct()
    singles = reached.join(counted.select("cls", "copies"), "cls").groupBy("vec_id").agg(F.sum("copies").alias("singles"))
    others = reached.join(multi.select("cls", F.col("vec_id").alias("other")), "cls").where("other <> vec_id").select("vec_id", "other").distinct()
    others = others.groupBy("vec_id").agg(F.count("*").alias("others"))
    home = multi.join(named.select("cls", "component"), "cls").groupBy("vec_id").agg(F.min("component").alias("component"))
    apart_ids = home.join(singles, "vec_id", "left").join(others, "vec_id", "left")
    apart_ids = apart_ids.select("vec_id", (F.coalesce("singles", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("links"), "component")
    named = named.join(extra, "cls", "left").select("cls", (F.col("links") + F.coalesce("extra", F.lit(0))).alias("links"), "component")
    return named, apart_ids


LINKS = "cls long, links long, a long, b long, far long"
_PLACED = "part int, place long, cls long, rep long, copies long, marked boolean, vector array<double>"


def _linked_classes(classes: DataFrame, size: int, threshold: float) -> DataFrame:
    """Of vectors of one length: link counts (cls, links), edges (a, b) of names, and links (cls, far) of marked classes."""
    spark = classes.sparkSession
    eps = _eps(threshold)
    sample = units([r.vector for r in classes.orderBy(F.xxhash64("cls"), "cls").select("vector").limit(SAMPLE).collect()])[1]
    rotation = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]  # principal dimensions of the second moments, in descending order
    placed = _placed(classes, size, rotation, eps)
    boxes = cut(placed.select("interval", "span", "vector").mapInArrow(_boxes(rotation), "interval long, span int, low array<double>, high array<double>"))
    pairs = _joined_intervals(boxes, min(LEADING, size), eps)
    intervals = boxes.agg(F.max("interval")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    square = max(1, min(SQUARE, math.isqrt((intervals + 1) ** 2 // (2 * SQUARES * partitions))))
    # A square of strips (x <= y) gets the intervals that some pair of it needs; pairs in it that are apart are skipped there again.
    at = F.expr(f"i div {square}").alias("x"), F.expr(f"j div {square}").alias("y")
    pairs = pairs.select(*at, "i", "j")
    sides = pairs.select("x", "y", F.col("i").alias("interval"), F.lit(0).alias("side")).unionAll(pairs.select("x", "y", F.col("j").alias("interval"), F.when(F.col("x") < F.col("y"), 1).otherwise(0)))
    sides = cut(sides.distinct())
    sides = F.broadcast(sides) if sides.count() <= BROADCAST_ROWS else sides
    return placed.join(sides, "interval").groupBy("x", "y").applyInPandas(_join_group(rotation, threshold, RUN), LINKS)


def _placed(classes: DataFrame, size: int, rotation: np.ndarray, eps: float) -> DataFrame:
    """Classes with interval, place in grid order, and span (of neighbouring intervals).

    Intervals are of equal bytes whatever the partitions are; only the rows of each partition are counted on the driver.
    """

    @F.pandas_udf("binary")
    def grid_key(vectors: pd.Series) -> pd.Series:
        return pd.Series(grid_keys(units(vectors)[1] @ rotation, eps) if len(vectors) else [], dtype="object")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            columns = {c: batch.column(c) for c in ("cls", "rep", "copies", "marked", "vector")}
            numbers = {"part": pa.array(np.full(batch.num_rows, part, np.int32)), "place": pa.array(np.arange(at, at + batch.num_rows))}
            at += batch.num_rows
            yield pa.RecordBatch.from_pydict({**numbers, **columns})

    spark = classes.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(classes.count() * size * 8 / INTERVAL_BYTES)))
    keyed = classes.select("cls", "rep", "copies", "marked", F.col("vector").cast("array<double>").alias("vector"), grid_key("vector").alias("key"))
    ordered = keyed.repartitionByRange(parts, "key", "cls").sortWithinPartitions("key", "cls")
    placed = cut(ordered.mapInArrow(number, _PLACED))
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    offsets = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    most = max(1, INTERVAL_BYTES // (8 * size))
    intervals = -(-sum(n for _, n in sizes) // most)
    placed = placed.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part").withColumn("place", F.col("place") + F.col("offset"))
    placed = placed.withColumn("interval", F.expr(f"place div {most}")).drop("part", "offset")
    return placed.withColumn("span", F.expr(f"cast(interval * {SPANS} div {max(intervals, SPANS)} as int)"))


def _boxes(rotation: np.ndarray):
    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            led = units(batch.column("vector").to_pylist())[1] @ rotation
            interval, span = (np.array(batch.column(c).to_pylist()) for c in ("interval", "span"))
            for k in np.unique(interval):
                rows = led[interval == k]
                box = found.setdefault((int(k), int(span[interval == k][0])), [rows[0], rows[0]])
                box[0], box[1] = np.minimum(box[0], rows.min(axis=0)), np.maximum(box[1], rows.max(axis=0))
        yield pa.RecordBatch.from_pydict({
            "interval": pa.array([k for k, _ in found], pa.int64()),
            "span": pa.array([s for _, s in found], pa.int32()),
            "low": pa.array([b[0].tolist() for b in found.values()], pa.list_(pa.float64())),
            "high": pa.array([b[1].tolist() for b in found.values()], pa.list_(pa.float64())),
        })

    return boxes


def _joined_intervals(boxes: DataFrame, dims: int, eps: float) -> DataFrame:
    """Pairs (i <= j) of intervals that may hold a link: spans are joined on the driver, of which there are few, then intervals.

    An interval cut by a partition's end has a box for each part, any of which may bring the pair.
    """
    spark = boxes.sparkSession
    spans = boxes.groupBy("span").agg(*[f(F.col(c)[d]).alias(f"{c}{d}") for d in range(dims) for c, f in (("low", F.min), ("high", F.max))]).collect()
    outer = {r.span: [np.array([r[f"{c}{d}"] for d in range(dims)]) for c in ("low", "high")] for r in spans}
    near = [(s, t) for s in outer for t in outer if s <= t and apart(*outer[s], *outer[t]) <= eps]
    near = F.broadcast(spark.createDataFrame(near, "s int, t int"))
    one, two = (boxes.select(F.col("interval").alias(i), F.col("span").alias(s), F.col("low").alias(f"low_{i}"), F.col("high").alias(f"high_{i}")) for i, s in (("i", "s"), ("j", "t")))
    gap = lambda low, high: F.zip_with(low, high, lambda x, y: x - y)
    gaps = F.zip_with(gap("low_i", "high_j"), gap("low_j", "high_i"), lambda x, y: F.greatest(F.lit(0.0), x, y))
    square: Column = F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g * g)
    return one.join(near, "s").join(two, "t").where(F.col("i") <= F.col("j")).where(square <= eps * eps).select("i", "j").distinct()


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors() of the whole table of embeddings; nulls, repeats and empty tables as stated there."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9::DOUBLE),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) JOIN (SELECT id AS vec_id, min(reached) AS component_id FROM r GROUP BY id) c USING (vec_id)
"""
