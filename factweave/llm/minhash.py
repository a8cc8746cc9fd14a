"""MinHash near-dedup with min-max hashing: both the minimum and the maximum under each permutation are kept.

64 permutations give 128 unbiased signature values (half the hash evaluations of plain MinHash); 16 bands of four minima and
16 of four maxima find a pair of similarity 0.75 with probability over 1 - 1e-5. Every link is confirmed on full sets.

1. One pass over the texts: set size, a 128-bit hash of the set, band keys. Equal sets form a class with an id of its own, named
   by its smallest doc_id; only classes go on, so exact copies cost nothing further. A document with several texts (a repeated
   doc_id) ties their classes together.
2. Each bucket's classes are compared with the bucket's smallest one (a star, found by an aggregate and a join: no bucket is ever
   gathered), first the head that a class meets most often, then other heads still in another component.
3. Members of a bucket that are then still in different components are compared: small buckets pair by pair, large ones in
   blocks, where a task holds two blocks of sets and returns at most one edge for each component that it joins. No link that
   could join two components is left out, and no more rows than the members times the number of blocks are made.

Sets are computed again only for classes that meet another in some bucket; their ids are broadcast if few enough (counted
first), else joined. Rows meet their class by class and salt, so that a class of a third of all rows is dealt to many tasks; joins on a frequent
bucket are plain equi-joins, which Spark splits where skewed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, small_batches, table, tidied
from .fingerprint import mixed

WORDS, PERCENT = 5, 75
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Ids of classes that are broadcast at most; beyond, the texts are joined with them.
BROADCAST_IDS = 500_000
#: Members of a bucket that are compared pair by pair, at most; sets in a block of a larger one, about.
SMALL, BLOCK_SETS = 8, 512
#: Bytes of the sets in a block, about.
BLOCK_BYTES = 8 << 20
#: Parts that the members of one class are dealt to before they meet its name.
SALTS = 4096
#: Bytes of text hashed at once.
CHUNK = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@lru_cache(maxsize=1)
def _constants():
    with np.errstate(over="ignore"):
        letters = mixed(np.arange(1 << 10, (1 << 10) + 256, dtype=np.uint64))
        places = mixed(np.arange(1 << 11, (1 << 11) + 8, dtype=np.uint64)) | np.uint64(1)
        factors = mixed(np.arange(1 << 12, (1 << 12) + PERMUTATIONS, dtype=np.uint64)) | np.uint64(1)
        masks = mixed(np.arange(1 << 13, (1 << 13) + PERMUTATIONS, dtype=np.uint64))
    return letters, places, factors, masks


_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    back = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, back):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(p))
    return out[0], out[1]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words in lower-cased bytes, and their hashes."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, stops = edge[::2], edge[1::2]
    ahead, back = _powers(1 << max(CHUNK.bit_length(), int(len(data) - 1).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_constants()[0][data] * ahead[: len(data)], out=total[1:])
    return starts, mixed((total[stops] - total[starts]) * back[starts] ^ mixed((stops - starts).astype(np.uint64)))


def _parts(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts, A-Z lower-cased, in order and in lists of about CHUNK bytes; a longer text makes a list of its own."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() folds A-Z only
        if part and size + len(data) >= CHUNK:
            yield part
            part, size = [], 0
        part.append(data)
        size += len(data) + 1
    if part:
        yield part


def shingle_sets(texts: list[str | None]) -> Iterator[list[np.ndarray]]:
    """Of each text the sorted distinct hashes of its five-word shingles, in lists over consecutive texts.

    A text of fewer words has one, of the whole sequence; one without words has none.
    """
    for part in _parts(texts):
        yield _sets(part)


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces of about CHUNK bytes, cut at white space only."""
    at = 0
    while at < len(data):
        found = _SPACE.search(data, at + CHUNK)
        stop = found.start() if found else len(data)
        yield data[at:stop]
        at = stop


def _sets(part: list[bytes]) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        if len(part) == 1:
            hashes = [_words(np.frombuffer(piece + b" ", np.uint8))[1] for piece in _pieces(part[0])]
            words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            edge = np.array([0, len(words)])
        else:
            starts, words = _words(np.frombuffer(b" ".join(part) + b" ", np.uint8))
            edge = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in part)]))
        place = _constants()[1]
        grams = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            grams += words[k : k + len(grams)] * place[k]
        grams = mixed(grams)
        sets = []
        for a, b in zip(edge, edge[1:]):
            if b - a >= WORDS:
                sets.append(np.unique(grams[a : b - WORDS + 1]))
            else:
                few = (words[a:b] * place[: b - a]).sum(dtype=np.uint64)
                sets.append(mixed(np.array([few ^ np.uint64(b - a)], np.uint64)) if b > a else np.zeros(0, np.uint64))
    return sets


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Per set (none of them empty) the keys of its bands: four minima, or four maxima, of neighbouring permutations."""
    flat, at = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    _, _, factors, masks = _constants()
    signs = np.empty((2, PERMUTATIONS, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PERMUTATIONS):
            h = (flat ^ masks[k]) * factors[k]
            h ^= h >> np.uint64(29)
            signs[0, k], signs[1, k] = np.minimum.reduceat(h, at), np.maximum.reduceat(h, at)
        keys = np.empty((BANDS, len(sets)), np.uint64)
        for band in range(BANDS):
            kind, first = divmod(band * ROWS, PERMUTATIONS)
            key = np.full(len(sets), band, np.uint64)
            for k in range(ROWS):
                key = mixed(key ^ signs[kind, first + k])
            keys[band] = key
    return keys.T


def _identity(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    """Size and 128-bit hash of each set."""
    with np.errstate(over="ignore"):
        return {
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "hash1": pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
            "hash2": pa.array([int(mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
        }


def _by_part(batches: Iterator[pa.RecordBatch], more: Callable[[list[np.ndarray]], pa.Array], name: str) -> Iterator[pa.RecordBatch]:
    """doc_id, the identity of the set and one more column, part by part, so that no more than a part's sets are held."""
    for batch in batches:
        ids, at = batch.column("doc_id"), 0
        for sets in shingle_sets(batch.column("text").to_pylist()):
            columns = {"doc_id": ids.slice(at, len(sets)), **_identity(sets), name: more(sets)}
            at += len(sets)
            yield pa.RecordBatch.from_pydict(columns)


def _bands(sets: list[np.ndarray]) -> pa.Array:
    full = [s for s in sets if len(s)]
    keys = band_keys(full).view(np.int64).ravel() if full else np.zeros(0, np.int64)
    sizes = np.cumsum([0, *(BANDS if len(s) else 0 for s in sets)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return tidied(_by_part(batches, _bands, "bands"), 256)


def _set_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return tidied(_by_part(batches, lambda sets: pa.array([s.tobytes() for s in sets], pa.binary()), "members"), 256)


def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
            out.append(False)
            continue
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        out.append(100 * both >= PERCENT * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def _linked_rows(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from tidied(_linked(a, b) for a, b in batches)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the documents that name the classes of pairs (a, b), where full sets are similar enough."""
    left, right = (sets.select(F.col("cls").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("members").alias(f"set_{c}")) for c in "ab")
    linked = pairs.join(left, "a").join(right, "b").where(F.pandas_udf(_linked_rows, "boolean")("set_a", "set_b"))
    return linked.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Null and empty texts and texts without words have n_shingles 0 and are linked with nothing by themselves; rows without
    doc_id have component_id null and are kept. Rows of one doc_id are one vertex, whatever their texts: a link of any of
    the texts is a link of the document, and all its rows get its component. Repeated rows change nothing. Extra columns are
    ignored whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text")
    key = ["n", "hash1", "hash2"]
    rows = cut(texts.mapInArrow(_digests, "doc_id long, n long, hash1 long, hash2 long, bands array<long>"))
    named = rows.where("doc_id is not null")
    real = named.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    # Classes in two levels: of a large class no more than SALTS rows ever meet in one task.
    salted = cut(real.groupBy(*key, "salt").agg(F.min("doc_id").alias("rep")))
    classes = cut(salted.groupBy(*key).agg(F.min("rep").alias("rep")).withColumn("cls", F.monotonically_increasing_id()))
    ties = _ties(named, salted, classes, key)
    heads_only = real.groupBy(*key, "doc_id").agg(F.first("bands").alias("bands")).join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"])
    banded = cut(heads_only.select("cls", "n", "bands")).select("cls", "n", F.explode("bands").alias("bucket"))
    heads = banded.groupBy("bucket").agg(F.min("cls").alias("head"), F.max("cls").alias("tail")).where("head < tail").drop("tail")
    meets = cut(banded.join(heads, "bucket").select("bucket", "cls", "n", "head"))
    stars = cut(meets.where("head <> cls").groupBy(F.col("head").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("times")))
    sets = _sets_of(texts, classes, stars, key)

    best = stars.groupBy("b").agg(F.max(F.struct("times", -F.col("a"))).alias("top")).select((-F.col("top")["col2"]).alias("a"), "b")
    links = cut(_confirm(best, sets).unionAll(ties))
    found, home = _homes(links, classes)
    more = cut(_confirm(_apart(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), home), sets))
    if not more.isEmpty():
        found, home = _homes(_joined(found, more), classes)
    more = cut(_rest(meets, stars, home, sets))
    if not more.isEmpty():
        found, home = _homes(_joined(found, more), classes)
    # Rows meet their component by class and salt; those without words by document, which only ties have put anywhere.
    salted = salted.join(classes.drop("rep"), key).join(home, "cls").select(*key, "salt", "component")
    worded = real.select("doc_id", "salt", *key).join(salted, [*key, "salt"]).select("doc_id", "n", "component")
    wordless = named.where("n = 0").select("doc_id", "n").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    lost = rows.where("doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("component"))
    out = worded.unionAll(wordless).unionAll(lost)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _ties(named: DataFrame, salted: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Edges (a, b) from a document with several texts to the documents that name its texts' classes; commonly none."""
    several = named.groupBy("doc_id").agg(*[f(c).alias(f"{n}_{c}") for c in key for n, f in (("low", F.min), ("high", F.max))])
    several = cut(several.where(" or ".join(f"low_{c} < high_{c}" for c in key)).select("doc_id"))
    if several.isEmpty():
        return named.sparkSession.createDataFrame([], "a long, b long")
    several = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    own = named.where("n > 0").join(several, "doc_id", "left_semi").select("doc_id", *key).distinct()
    own = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    named_by = salted.drop("rep").join(classes.select("rep", *key), key)
    return own.join(named_by, [*key, "salt"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def _sets_of(texts: DataFrame, classes: DataFrame, stars: DataFrame, key: list[str]) -> DataFrame:
    """cls, rep and members (the set's hashes as bytes) of the classes that meet another in some bucket."""
    involved = stars.select(F.col("b").alias("cls")).unionAll(stars.select(F.col("a").alias("cls"))).distinct()
    involved = cut(classes.join(involved, "cls", "left_semi"))
    few = involved.count() <= BROADCAST_IDS
    wanted = involved.select(F.col("rep").alias("doc_id"), "cls", *key)
    ids = wanted.select("doc_id").distinct()
    some = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    some = some.mapInArrow(_set_bytes, "doc_id long, n long, hash1 long, hash2 long, members binary")
    some = some.join(F.broadcast(wanted) if few else wanted, ["doc_id", *key]).select("cls", F.col("doc_id").alias("rep"), "members")
    return cut(some.dropDuplicates(["cls"]))


def _homes(links: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of documents (id, component), and of all classes (cls, component)."""
    found = cut(components(links))
    home = classes.select("cls", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    return found, cut(home.select("cls", F.coalesce("component", "rep").alias("component")))


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Edges of the components found so far, as stars, and of further links."""
    return found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more)


def _rest(meets: DataFrame, stars: DataFrame, home: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of a bucket, its head aside, that are still in different components.

    Buckets of equal members count once. Small buckets give pairs, of which there are at most (SMALL - 1) / 2 for each member;
    larger ones are compared block by block, and give no more edges than members. Blocks are bounded by sets and bytes.
    """
    named = meets.where("cls <> head").join(home, "cls").select("bucket", "cls", "n", "component")
    about = named.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("hashes"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("who")).where("low < high")
    about = about.groupBy("members", "hashes", "low", "high", "who").agg(F.min("bucket").alias("bucket")).select("bucket", "members", "hashes")
    named = cut(named.join(about, "bucket"))
    x = named.where(f"members <= {SMALL}").select("bucket", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    y = x.select("bucket", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ca").alias("cb"))
    pairs = x.join(y, "bucket").where(f"a < b and ca <> cb and 100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "b").distinct()
    links = _confirm(pairs.join(stars, ["a", "b"], "left_anti"), sets)
    large = named.where(f"members > {SMALL}").withColumn("blocks", F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("hashes") * 8 / BLOCK_BYTES)).cast("int"))
    large = large.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    large = large.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("bucket", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "cls", "component").join(sets, "cls")
    large = large.select("bucket", "i", "j", "block", "rep", "component", "members")
    return links.unionAll(large.groupBy("bucket", "i", "j").applyInPandas(_join_blocks, "a long, b long"))


def _join_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """Links of two blocks of sets (or of one with itself) as edges of a spanning forest over components."""
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    left = group[group["block"] == i]
    right = left if i == j else group[group["block"] == j]
    edges: list[tuple[int, int]] = []
    if len(left) and len(right) and (left["component"].nunique() > 1 or right["component"].nunique() > 1 or left["component"].iloc[0] != right["component"].iloc[0]):
        linked = _linked_sets(*([np.frombuffer(m, np.uint64) for m in part["members"]] for part in (left, right)))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        a, b, ca, cb = (part[c].to_numpy() for c in ("rep", "component") for part in (left, right))
        linked &= ca[:, None] != cb[None, :]
        for p, q in zip(*np.nonzero(linked)):
            x, y = root(int(ca[p])), root(int(cb[q]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((int(a[p]), int(b[q])))
    return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")


def _linked_sets(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of two lists are similar enough, by products of 0/1 matrices over the members that both lists hold."""
    sizes = [np.array([len(s) for s in part]) for part in (left, right)]
    flat = [np.concatenate(part) for part in (left, right)]
    shared = np.intersect1d(*flat)
    spots = []
    for size, values in zip(sizes, flat):
        at = np.searchsorted(shared, values)
        hit = (at < len(shared)) & (shared[np.minimum(at, max(0, len(shared) - 1))] == values) if len(shared) else np.zeros(len(values), bool)
        spots.append((np.repeat(np.arange(len(size)), size)[hit], at[hit]))
    both = np.zeros((len(left), len(right)), np.float32)  # exact: counts stay far below 2**24
    for start in range(0, len(shared), 4096):
        width = min(4096, len(shared) - start)
        sides = []
        for size, (row, col) in zip(sizes, spots):
            inside = (col >= start) & (col < start + width)
            m = np.zeros((len(size), width), np.float32)
            m[row[inside], col[inside] - start] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return 100 * both.astype(np.float64) >= PERCENT * union


def _apart(pairs: DataFrame, home: DataFrame) -> DataFrame:
    """The pairs of classes whose ends are in different components."""
    for end in "ab":
        pairs = pairs.join(home.select(F.col("cls").alias(end), F.col("component").alias(f"c{end}")), end)
    return pairs.where("ca <> cb").select("a", "b")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of the whole table of documents; nulls, repeats and empty tables as stated there."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(reached) AS component_id FROM r GROUP BY id) c USING (doc_id)
"""
