"""Embedding whitening by a one-sided Jacobi SVD of a blockwise TSQR.

Entries become integers, whose sums are exact. Each task reduces its rows, less the mean, to a triangle R (QR of the stacked blocks);
triangles are reduced in groups of bounded size until one is left, and plane rotations make its columns orthogonal to each other.
The rotations, accumulated, are the components; the columns' lengths over sqrt(n) are the standard deviations, to the
relative accuracy of the triangle and without squaring its condition as a covariance would.

Scale: a task holds a batch and a triangle of d x d, the driver the model (COMPONENTS x d) of each length d of vectors. Tables are read in
four passes (sums, triangles, the check of the whitened covariance, the result); nothing but partial sums and triangles is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table, tidied

#: x = floor(SCALE * c) + OFFSET; components that are returned; rows stacked for one QR.
SCALE, OFFSET, COMPONENTS, STACK = 64, 1_000_000, 32, 4096
#: Triangles reduced by one task at most, and their entries (32 MB) unless two have more.
FAN, FAN_ENTRIES = 64, 1 << 22
#: Entries whose multiple by SCALE has no long: such a vector counts as one with a non-finite entry.
MOST = float(2**62 // SCALE)
#: Sweeps over all pairs of columns at most, and the cosine between columns under which they count as orthogonal.
SWEEPS, ORTHOGONAL = 60, 1e-15


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, components): singular values of r, falling, and its right singular vectors as columns.

    In each round the columns are paired by a round-robin, so that the rotations of a round are independent of each other
    and made together. Raises RuntimeError if the columns are not orthogonal after SWEEPS.
    """
    d = r.shape[1]
    a, v = np.array(r, dtype=np.float64), np.eye(d)
    scale = np.abs(a).max(initial=0.0)
    if d < 2 or scale == 0:
        return np.linalg.norm(a, axis=0), v
    a /= scale
    ring = [*range(d), *([-1] * (d % 2))]
    for _ in range(SWEEPS):
        off = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = np.array([(p, q) for p, q in zip(ring[:half], ring[half:][::-1]) if p >= 0 and q >= 0])
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = pairs[:, 0], pairs[:, 1]
            alpha, beta, gamma = ((x * y).sum(axis=0) for x, y in ((a[:, p], a[:, p]), (a[:, q], a[:, q]), (a[:, p], a[:, q])))
            length = np.sqrt(alpha * beta)
            cosine = np.divide(np.abs(gamma), length, out=np.zeros_like(gamma), where=length > 0)
            off = max(off, float(cosine.max()))
            turn = cosine > ORTHOGONAL
            if not turn.any():
                continue
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if off <= max(ORTHOGONAL * 10, d * 2.3e-16):
            break
    else:
        raise RuntimeError(f"columns are not orthogonal after {SWEEPS} sweeps")
    lengths = np.linalg.norm(a, axis=0)
    order = np.argsort(-lengths, kind="stable")
    return lengths[order] * scale, v[:, order]


@dataclass
class Whitening:
    """n vectors of one length with the exact sums of their x; components as columns, their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from the exact integer n * x - S."""
        return self.times_n(x).astype(np.float64) / self.n

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as long where that has room, else as Python's integers."""
        room = 2**62
        wide = self.n * (int(np.abs(x).max(initial=0)) + 1) >= room or max(map(abs, self.sums), default=0) >= room
        return x.astype(object) * self.n - np.array(self.sums, dtype=object) if wide else x * self.n - np.array(self.sums, dtype=np.int64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n * x - S) ** 2 of each row."""
        y = self.times_n(x)
        if y.dtype != object and x.shape[1] * int(np.abs(y).max(initial=0)) ** 2 >= 2**62:
            y = y.astype(object)
        return [int(v) for v in (y * y).sum(axis=1)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def usable(vector: Column) -> Column:
    good = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    return F.coalesce(good, F.lit(False))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, x) for each length of vectors in a batch."""
    lists = batch.column("vector")
    sizes = np.diff(np.asarray(lists.offsets))
    values = np.floor(SCALE * np.asarray(lists.flatten(), dtype=np.float64)).astype(np.int64) + OFFSET
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, values[starts[rows][:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, rows, x in by_length(batch):
            wide = int(np.abs(x).max(initial=0)) * len(x) >= 2**62
            found = [int(v) for v in (x.astype(object) if wide else x).sum(axis=0)]
            yield pa.RecordBatch.from_pydict({"size": pa.array([d] * d, pa.int32()), "dim": pa.array(range(d), pa.int32()), "n": pa.array([len(x)] * d, pa.int64()), "s": pa.array(found, pa.decimal128(38, 0))})


def triangle(stacked: np.ndarray) -> np.ndarray:
    """R of the QR of stacked rows, filled up to a square."""
    r = np.linalg.qr(stacked, mode="r")
    d = stacked.shape[1]
    return np.concatenate([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def _triangles(means: dict[int, Whitening]):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                for k in range(0, len(x), STACK):
                    rows = means[d].centred(x[k : k + STACK])
                    held[d] = triangle(np.concatenate([held[d], rows]) if d in held else rows)
        part = TaskContext.get().partitionId()
        if held:
            yield pa.RecordBatch.from_pydict({"size": pa.array(list(held), pa.int32()), "part": pa.array([part] * len(held), pa.int64()), "r": pa.array([r.ravel().tolist() for r in held.values()], pa.list_(pa.float64()))})

    return reduce


def _join_triangles(group: pd.DataFrame) -> pd.DataFrame:
    d, held = int(group["size"].iloc[0]), None
    for r in group["r"]:
        r = np.asarray(r).reshape(d, d)
        held = r if held is None else triangle(np.concatenate([held, r]))
    return pd.DataFrame({"size": [d], "part": [int(group["part"].iloc[0])], "r": [held.ravel().tolist()]})


_TRIANGLE = "size int, part long, r array<double>"


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A Whitening for each length of usable vectors(vector), commonly one.

    Components without variance (lengths below the rounding of the longest) are left out, as nothing scales them to one.
    """
    partial = vectors.mapInArrow(_sums, "size int, dim int, n long, s decimal(38,0)").groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found: dict[int, Whitening] = {}
    for r in sorted(partial.collect(), key=lambda r: (r["size"], r["dim"])):
        found.setdefault(r["size"], Whitening(r["n"], [], np.empty(0), np.empty(0), 0.0)).sums.append(int(r["s"]))
    triangles = cut(vectors.mapInArrow(_triangles(found), _TRIANGLE))
    fan = F.expr(f"greatest(2, least({FAN}, {FAN_ENTRIES} div (cast(size as long) * size)))")
    while triangles.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").count():
        triangles = cut(triangles.withColumn("part", F.floor(F.col("part") / fan)).groupBy("size", "part").applyInPandas(_join_triangles, _TRIANGLE))
    for row in triangles.collect():
        d, model = row["size"], found[row["size"]]
        lengths, v = jacobi(np.array(row["r"]).reshape(d, d))
        kept = lengths > lengths.max(initial=0.0) * d * 8 * np.finfo(float).eps
        model.trace = math.fsum(lengths * lengths) / model.n
        v = v[:, kept][:, :components]
        model.components = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0) if v.size else v
        model.eigenvalues = (lengths[kept] ** 2 / model.n)[:components]
    return found


def _moments(models: dict[int, Whitening]):
    """Of each task and length: the number, the mean and the centred second moments of the whitened rows."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                w = models[d].whiten(x)
                mean = w.mean(axis=0)
                held[d] = merged(held.get(d), (len(w), mean, (w - mean).T @ (w - mean)))
        if held:
            n, mean, m = zip(*held.values())
            yield pa.RecordBatch.from_pydict({"size": pa.array(list(held), pa.int32()), "n": pa.array(n, pa.int64()), "mean": pa.array([x.tolist() for x in mean], pa.list_(pa.float64())), "m": pa.array([x.ravel().tolist() for x in m], pa.list_(pa.float64()))})

    return reduce


def merged(one: tuple | None, two: tuple) -> tuple:
    """Number, mean and centred second moments of two sets of rows together."""
    if one is None:
        return two
    n, gap = one[0] + two[0], two[1] - one[1]
    return n, one[1] + gap * (two[0] / n), one[2] + two[2] + np.outer(gap, gap) * (one[0] * two[0] / n)


def identity_errors(vectors: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Of each length, the largest absolute entry of the whitened rows' covariance less the identity, measured on all rows."""
    moments = "size int, n long, mean array<double>, m array<double>"

    def join(group: pd.DataFrame) -> pd.DataFrame:
        held = None
        for n, mean, m in zip(group["n"], group["mean"], group["m"]):
            held = merged(held, (int(n), np.asarray(mean), np.asarray(m).reshape(len(mean), len(mean))))
        return pd.DataFrame({"size": [int(group["size"].iloc[0])], "n": [held[0]], "mean": [held[1].tolist()], "m": [held[2].ravel().tolist()]})

    partial = vectors.mapInArrow(_moments(models), moments).withColumn("part", F.spark_partition_id())
    partial = cut(partial.groupBy("size", F.floor(F.col("part") / FAN)).applyInPandas(lambda g: join(g.drop(columns="part")), moments))
    out = {}
    for r in partial.groupBy("size").applyInPandas(join, moments).collect():
        k = len(r["mean"])
        out[r["size"]] = float(np.abs(np.array(r["m"]).reshape(k, k) / r["n"] - np.eye(k)).max()) if k else 0.0
    return out


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of vectors(vec_id, embedding) and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Vectors that are null or empty, or hold an entry that is null, not finite or too large for a long once scaled, give no row and
    take no part in the fit. Vectors of different length are whitened apart, each length by its own fit, and n is that
    length's. Components whose variance is zero to rounding (constant or repeated dimensions, fewer vectors than
    dimensions) are left out: one vector alone, or equal vectors only, give no rows. Repeated rows and equal or null vec_ids
    count and come out row by row; equal eigenvalues may come in any order. Other columns are ignored whatever their
    names. An empty table gives an empty result. A deviation beyond 64 bits raises an error rather than lose digits.
    """
    small_batches(vectors.sparkSession)
    kind, rows = vectors.schema["vec_id"].dataType.simpleString(), vectors.where(usable(F.col("embedding")))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    models = fit(rows.select("vector"), components)
    errors = identity_errors(rows.select("vector"), models)

    def rows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for d, places, x in by_length(batch):
            model, k = models[d], len(models[d].eigenvalues)
            m = len(x)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(places, k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, model.n, dtype=np.int64)),
                "deviation": pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                "whitened": pa.array(model.whiten(x).ravel()),
                "explained": pa.array(np.tile(model.eigenvalues / model.trace if k else np.empty(0), m)),
                "identity_error": pa.array(np.full(m * k, errors.get(d, 0.0))),
            })

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tidied(out for batch in batches for out in rows_of(batch))

    return rows.mapInArrow(whiten, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whitened() of the whole table of embeddings; nulls, repeats and empty tables as stated there."""
    return whitened(table(spark, sf_dir, "embeddings"))
