"""Quality classifier by compression: one zstandard dictionary of good texts and one of bad texts.

A text is cut into blocks and each block compressed with either dictionary; the difference of the total sizes over their
sum, put through a logistic curve fitted on labelled texts, is the score. Dictionaries and curve are fitted on the driver from a
bounded sample of labelled documents; scoring is one pass in Arrow batches without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidied
from .toxicity import labelled_sample, marked

#: Labelled documents of each class that the model is fitted on, at most, and bytes of their whole texts, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8 << 20
#: Bytes of a dictionary and of a block, and zstandard's level.
DICTIONARY, BLOCK, LEVEL = 32768, 256, 3
THRESHOLD = 0.3


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "replace")
    return [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]


@dataclass
class Quality:
    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    bias: float = 0.0
    _pair: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_pair": None}

    def _compressors(self):
        if self._pair is None:
            import zstandard

            self._pair = [
                zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False)
                for d in (self.good, self.bad)
            ]
        return self._pair

    def difference(self, text: str | None) -> float:
        """(size with the bad dictionary - size with the good one) over their sum; 0 for an empty text."""
        good, bad = self._compressors()
        parts = blocks(text)
        a, b = (sum(len(c.compress(x)) for x in parts) for c in (good, bad))
        return (b - a) / (a + b) if parts else 0.0

    def score(self, text: str | None) -> float:
        x = self.slope * self.difference(text) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit_quality(good: list[str], bad: list[str], share_good: float | None = None) -> Quality:
    """Dictionaries and calibration from texts of both classes.

    The dictionaries come from three quarters of the texts and the curve from the rest, whose sizes the dictionaries
    cannot have memorised; both see whole texts. share_good: that of good texts among all labelled ones (default: among the given), to which the
    curve is calibrated. If a class is missing or too small for a dictionary, every text scores that share (0.5 without
    any label).
    """
    import zstandard

    prior = (len(good) + 1) / (len(good) + len(bad) + 2) if share_good is None else min(max(share_good, 0.01), 0.99)
    flat = Quality(bias=math.log(prior / (1 - prior)))
    trained = []
    for texts in (good, bad):
        parts = [b for k, t in enumerate(texts) if k % 4 for b in blocks(t)]
        try:
            trained.append(zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes())
        except (zstandard.ZstdError, ValueError):  # too few or too small samples
            return flat
    model = Quality(*trained)
    rest = [(model.difference(t), k) for k, texts in ((1, good), (0, bad)) for t in texts[::4] if t]
    if len({k for _, k in rest}) < 2:
        return flat
    x, y = (np.array(v, dtype=float) for v in zip(*rest))
    share = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum()) * len(y)
    a, b = 20.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = share * np.maximum(p * (1 - p), 1e-9)
        ga, gb = (share * (y - p) * x).sum() - 1e-3 * a, (share * (y - p)).sum()
        haa, hab, hbb = (w * x * x).sum() + 1e-3, (w * x).sum(), w.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + max(-20.0, min(20.0, da)), b + max(-2.0, min(2.0, db))
        if abs(da) + abs(db) < 1e-6:
            break
    model.slope, model.bias = float(max(a, 0.0)), float(b)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Quality:
    """A model from labels(doc_id, quality) whose crc32(doc_id as text) mod 5 is not 0."""
    rows = labelled_sample(docs, labels, "quality", 5, 0, sample_rows, sample_bytes)
    share = marked(labels, "quality", 5, 0).agg(F.avg("mark")).first()[0]
    return fit_quality([t for k, t in rows if k == 1], [t for k, t in rows if k == 0], share)


def scorer(model: Quality):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(pd.Series([model.score(t) for t in texts], dtype="float64") for texts in batches)

    return score


def score_quality(docs: DataFrame, model: Quality) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every row's whole text.

    Null and empty texts have difference 0. Repeated rows and equal ids are scored row by row; null ids stay null; other
    columns are ignored whatever their names; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", scorer(model)("text").alias("score"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole table of documents; a null doc_id has held_out null and is scored like any other row."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
