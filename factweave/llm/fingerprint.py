"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. On each level equal neighbours are first merged into runs; deterministic coin
tossing then labels every symbol from itself and its predecessor (the lowest bit in which they differ, and its value), and
is repeated until labels are small; symbols whose label is a local minimum start a phrase, and a phrase's name is a hash of
its symbols. A boundary depends on a few neighbouring symbols only, so equal substrings get equal phrases but near their
ends, wherever they stand. Levels follow until one phrase is left, whose name stands for the whole text. A fingerprint keeps
that name and, of the levels that a comparison uses, the smallest hashes of the set of phrase names.

The comparison stops at LEVELS, as coarser phrases (over a hundred characters) say little beyond the whole text's name: each edit
changes a phrase of every level, so the coarser the level, the less of two texts that share most of their characters it finds
in common. What keeping KEEP hashes of a level costs against all of them is measured in tests/llm.

Parsing runs on numpy arrays that hold many texts at once, in Arrow batches, and needs no shuffle. Pairing documents with their
successor takes one shuffle of the texts by ranges of doc_id.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidied

#: Levels of phrases compared, from the coarsest; hashes kept of a level; a finer level is kept below FEW names of this one.
LEVELS, KEEP, FEW = (3, 2, 1), 64, 32
#: Two fingerprints are compared on the coarsest level that both keep and where both have so many names, else the finest common one.
ENOUGH = 16
#: Where the name of the whole text is kept.
ROOT = 0
#: Characters parsed at once.
CHARS = 1 << 19

_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (Steele et al. 2014)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the characters; multipliers by place in a phrase; labels by previous and own label below 128."""
    with np.errstate(over="ignore"):
        names, places = mixed(np.arange(0x110000, dtype=np.uint64)), mixed(np.arange(1 << 20, (1 << 20) + 64, dtype=np.uint64)) | np.uint64(1)
    a, b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    low = (a ^ b) & -(a ^ b)
    k = np.where(low > 0, np.log2(np.maximum(low, 1)).astype(int), 0)
    return names, places, (2 * k + (b >> k & 1)).astype(np.uint8).ravel()


def coin_tossing(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 of symbols of which neighbours differ; the first of a text gets that of its lowest bit."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    low = x ^ before
    low &= np.uint64(0) - low
    k = np.maximum((low.astype(np.float64).view(np.int64) >> 52) - 1023, 0).astype(np.uint64)
    labels = (k << np.uint64(1) | (x >> k & np.uint64(1))).astype(np.uint8)
    toss = _tables()[2]
    for _ in range(3):  # 128 labels become 14, then 8, then 6
        at = labels.astype(np.int32)
        at[1:] += labels[:-1].astype(np.int32) << 7
        own = labels[first] & 1
        labels = toss[at]
        labels[first] = own
    return labels


def next_level(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names over symbols of many texts laid end to end, and which of them begin a text."""
    new = np.empty(len(sym), bool)
    new[0] = True
    np.not_equal(sym[1:], sym[:-1], out=new[1:])
    new |= first
    at = np.flatnonzero(new)
    run = np.diff(at, append=len(sym)).astype(np.uint64)
    s, first = sym[at], first[at]
    long = run > 1
    s[long] = mixed(s[long] ^ mixed(run[long]))
    labels = coin_tossing(s, first)
    left, right = np.empty_like(labels), np.empty_like(labels)
    left[1:], right[:-1], right[-1] = labels[:-1], labels[1:], 255
    left[first] = 255
    right[:-1][first[1:]] = 255
    starts = np.flatnonzero(((labels < left) & (labels < right)) | first)
    size = np.diff(starts, append=len(s))
    place = np.arange(len(s)) - np.repeat(starts, size)
    parts = s * _tables()[1][place & 63]
    return mixed(np.add.reduceat(parts, starts) ^ mixed(size.astype(np.uint64))), first[starts]


def _smallest(names: np.ndarray, doc: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each of n texts the KEEP smallest distinct 32-bit hashes of its names, ascending, and how many there are."""
    both = np.unique(doc.astype(np.uint64) << np.uint64(32) | names >> np.uint64(32))
    edge = np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    low = both.astype(np.uint32)
    return [low[a : min(b, a + KEEP)] for a, b in zip(edge, edge[1:])], np.diff(edge)


def _parse(texts: list[str]) -> list[dict[int, np.ndarray]]:
    """Of each text the kept hashes by level, and its name under ROOT."""
    full = [k for k, t in enumerate(texts) if t]
    out: list[dict[int, np.ndarray]] = [{} for _ in texts]
    if not full:
        return out
    codes = np.frombuffer("".join(texts[k] for k in full).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(codes), bool)
    first[np.cumsum([0, *(len(texts[k]) for k in full[:-1])])] = True
    with np.errstate(over="ignore"):
        levels, sym = {}, _tables()[0][codes]
        level, left = 0, np.arange(len(full))
        roots: dict[int, np.ndarray] = {}
        while len(left):
            sym, first = next_level(sym, first)
            level += 1
            if level <= max(LEVELS):
                levels[level] = _smallest(sym, np.cumsum(first) - 1, len(full))
            starts = np.flatnonzero(first)
            sizes = np.diff(starts, append=len(sym))
            done = sizes == 1
            for i, name in zip(left[done], sym[starts[done]]):
                roots.setdefault(int(i), np.array([name], np.uint64))
            if level >= max(LEVELS):  # texts of one phrase are ready
                go_on = np.repeat(~done, sizes)
                sym, first, left = sym[go_on], first[go_on], left[~done]
    for i, k in enumerate(full):
        out[k][ROOT] = roots[i]
        for level in LEVELS:
            kept, count = levels[level]
            out[k][level] = kept[i]
            if count[i] >= FEW:
                break
    return out


def phrases(texts: list[str]) -> list[dict[int, np.ndarray]]:
    """Of each text its kept hashes by level and its name; an empty text has neither."""
    out, some, size = [], [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= CHARS:
            out, some, size = out + _parse(some), [], 0
    return out + _parse(some)


def fingerprint(kept: dict[int, np.ndarray]) -> str:
    """The hashes of each level in hexadecimal, as level:hashes, and 0:name, joined by semicolons; empty for an empty text."""
    return ";".join(f"{level}:{kept[level].astype('>u8' if level == ROOT else '>u4').tobytes().hex()}" for level in sorted(kept, reverse=True))


def likeness(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> float:
    """Jaccard similarity of the phrase sets, estimated on the KEEP smallest of their union; exact if both are smaller.

    Texts of one name are equal (1).
    """
    if not a or not b:
        return float(not a and not b)
    if a[ROOT][0] == b[ROOT][0]:
        return 1.0
    both = [level for level in LEVELS if level in a and level in b]
    level = next((x for x in both if min(len(a[x]), len(b[x])) >= ENOUGH), both[-1])
    x, y = set(a[level].tolist()), set(b[level].tolist())
    union = x | y
    if len(x) >= KEEP or len(y) >= KEEP:
        union = sorted(union)[:KEEP]
    return sum(h in x and h in y for h in union) / len(union)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every row's whole text.

    Null and empty texts have the empty fingerprint. Rows with equal texts get equal fingerprints, whatever their ids; other
    columns are ignored whatever their names; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(k) for k in phrases([t or "" for t in texts])], dtype="object")

    small_batches(docs.sparkSession)
    return docs.select("doc_id", of("text").alias("fingerprint"))


def _edges(rows: DataFrame, ids: list, shares: dict) -> list[tuple]:
    """Where ranges begin, in order: (doc_id, hash), at the id's first row where hash is null.

    ids descend, a missing one (None) last; an id of `shares` is cut into so many parts of its hashes, of which those that occur count.
    """
    cuts: dict = {i: [] for i in ids}
    if shares:
        some = [i for i in shares if i is not None]
        share = F.lit(shares.get(None, 1))
        if some:
            share = F.coalesce(F.create_map(*[F.lit(x) for i in some for x in (i, shares[i])])[F.col("doc_id")], share)
        wanted = F.col("doc_id").isin(some) | (F.col("doc_id").isNull() if None in shares else F.lit(False))
        part = F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * share)
        for r in rows.where(wanted).groupBy("doc_id", part.alias("part")).agg(F.min("hash").alias("hash")).collect():
            cuts[r.doc_id].append(r.hash)
    return [(i, h) for i in ids for h in (sorted(cuts[i]) or [None])]


def _range_of(edges: list[tuple]) -> Column:
    """The last of the edges (doc_id, hash) that a row does not come before; ids descend, missing ones come last."""
    if not edges:
        return F.lit(0)
    begin, cuts = {}, {}
    for k, (i, h) in enumerate(edges):
        begin.setdefault(i, k)
        cuts.setdefault(i, []).append(h)
    ids = [i for i in begin if i is not None]

    def inside(i) -> Column:
        if len(cuts[i]) == 1:
            return F.lit(begin[i])
        return begin[i] + F.greatest(F.lit(0), F.size(F.filter(F.array(*map(F.lit, cuts[i])), lambda e: e <= F.col("hash"))) - 1)

    found = F.element_at(F.array(*[F.lit(begin[i] + len(cuts[i]) - 1) for i in ids]), _place_of(ids) + 1) if ids else F.lit(0)
    for i in ids:
        if len(cuts[i]) > 1:
            found = F.when(F.col("doc_id") == i, inside(i)).otherwise(found)
    return F.when(F.col("doc_id").isNull(), inside(None) if None in begin else F.lit(len(edges) - 1)).otherwise(found)


def _place_of(ids: list) -> Column:
    """The place of the smallest id not below doc_id among descending ids.

    Found in two steps, among the first ids of about sqrt(n) parts and then inside one part.
    """
    step = math.isqrt(len(ids) - 1) + 1
    parts = [ids[k : k + step] for k in range(0, len(ids), step)]
    above = lambda found: F.size(F.filter(found, lambda e: e >= F.col("doc_id"))) - 1
    part = above(F.array(*[F.lit(p[0]) for p in parts]))
    inside = above(F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in parts]), part + 1))
    return part * step + inside


def with_next(docs: DataFrame, work, schema: str) -> DataFrame:
    """Hand every document with the next one in descending doc_id order (the last with the first) to work.

    work gets lists: doc_ids, and texts with one more entry, of which texts[k + 1] is the document after texts[k]. The
    order is range by range: boundaries are ids that occur (percentiles over all ids), so that the first document of the
    next range is known and added to the end of the one before; there are no more boundaries than twice the shuffle
    partitions, about. Ties go by a hash of the text, then the text; null ids come last and count as a text's next too. An id
    (or its lack) that many rows share has further boundaries at hashes that occur, so its rows are dealt to several ranges;
    only equal texts of one id stay in one range whatever their number.
    """
    spark = docs.sparkSession
    parts = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts).alias("at"), F.max("doc_id").alias("top"), F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ids = sorted({got.top, *(got.at or [])}, reverse=True) if got.ids else []
    shares = {i: n for i, n in Counter(got.at or []).items() if n > 2}
    if got.n > got.ids:
        ids, shares = [*ids, None], shares | {None: max(1, math.ceil(parts * (got.n - got.ids) / got.n))}
    edges = _edges(rows, ids, shares)
    kind = rows.schema["doc_id"].dataType.simpleString()
    # The first row of each edge is known by (doc_id, hash); it goes to the end of the range before, too.
    before = spark.createDataFrame([(i, h, (k - 1) % len(edges)) for k, (i, h) in enumerate(edges)], f"edge_id {kind}, edge_hash long, range int")
    some = rows.where(F.col("doc_id").isin([i for i in ids if i is not None]) | F.col("doc_id").isNull()) if ids else rows.limit(0)
    heads = some.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("edge_id")) & (F.col("edge_hash").isNull() | (F.col("hash") == F.col("edge_hash"))))
    heads = heads.groupBy("doc_id", "range").agg(F.min(F.struct("hash", "text")).alias("least")).select("doc_id", "least.text", "least.hash", "range", F.lit(1).alias("head"))
    rows = rows.select("doc_id", "text", "hash", _range_of(edges).alias("range"), F.lit(0).alias("head")).unionAll(heads)
    # Range k is partition k: every range has a task of its own, and none shares one by chance.
    rows = rows.repartitionById(max(1, len(edges)), "range").sortWithinPartitions("range", "head", F.col("doc_id").desc_nulls_last(), "hash", "text").drop("hash")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (range, doc_id, text) of the row whose next has not come yet
        for batch in batches:
            ids: list = []
            texts: list[str] = []
            for r, head, i, t in zip(batch["range"], batch["head"], batch["doc_id"], batch["text"]):
                if last is not None and last[0] != r:
                    last = None
                if last is None and texts:
                    if ids:
                        yield work(ids, texts)
                    ids, texts = [], []
                if last is not None:
                    if not texts:
                        texts.append(last[2])
                    ids.append(None if pd.isna(last[1]) else int(last[1]))
                    texts.append(t)
                last = None if head else (r, i, t)
                if head and ids:
                    yield work(ids, texts)
                    ids, texts = [], []
            if ids:
                yield work(ids, texts)

    small_batches(spark)
    return rows.mapInPandas(lambda batches: tidied(follow(batches)), schema)


def compare_edits(ids: list, texts: list[str]) -> pd.DataFrame:
    """Per id the contract's columns of texts[k] with texts[k + 1] as its next; empty texts have an empty fingerprint.

    likeness() says what two empty fingerprints have in common; a null id stays null.
    """
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, texts[1:])]
    own, new = phrases(texts), phrases(edited)
    return pd.DataFrame({
        "doc_id": pd.Series(ids, dtype="Int64"),
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": [fingerprint(k) for k in own[:-1]],
        "edited_fingerprint": [fingerprint(k) for k in new],
        "near_edited": [likeness(a, b) for a, b in zip(own, new)],
        "near_next": [likeness(a, b) for a, b in zip(own, own[1:])],
    })


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compare_edits() over the whole table of documents; order, ties and nulls as with_next() states."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(table(spark, sf_dir, "documents"), compare_edits, schema)
