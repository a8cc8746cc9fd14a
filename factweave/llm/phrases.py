"""Phrase collocation mining: frequent words become ids, pieces break at all others, and phrases are counted by sorting keys.

1. Texts are cut into blocks of bounded tokens, each with its own small vocabulary (an Arrow pass without a shuffle). The
   vocabularies, added up, give the frequent words, which are numbered: the dictionary. It is joined to the
   vocabularies, never broadcast, so that each block gets the ids of its own words back.
2. Every position of a block gives one key: the ids of the up to LONGEST words from there to the next break, four bytes each,
   big-endian, filled up with zeros. A phrase's occurrences are the keys that begin with it, so one key a position
   counts the phrases of all lengths. A block sorts its keys (radix sort on 16-bit digits) and counts equal ones first, so that a key
   that a third of all rows hold comes at most once from each block.
3. Sorted runs of keys are dealt to ranges whose bounds come from a bounded sample; rows of a range are sorted by
   subrange, and each subrange is radix sorted and run-length counted for every length at once. Runs at the ends of a subrange
   are partial and added up by one aggregate.
4. Scores, the test against longer phrases and the ranks are joins and aggregates of the frequent phrases only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table, tidied

#: Least count of a phrase; longest phrase in words; phrases returned of a language; share (in %) at which a longer one stands for it.
LEAST, LONGEST, TOP, SHARE = 30, 4, 2000, 80
#: Tokens of a block; bytes of text split at once; keys aimed at in a subrange and in a range; subranges at most.
BLOCK_TOKENS, SLICE, SUBRANGE_KEYS, RANGE_KEYS, SUBRANGES = 1 << 20, 1 << 20, 1 << 15, 1 << 22, 1 << 20
#: Blocks that the bounds are taken from, keys of the sample a subrange, and parts of a language that are ranked apart first.
SAMPLE_BLOCKS, SAMPLE_KEYS, RANK_PARTS = 256, 64, 512
#: Whatever ends a piece becomes a comma, a tab a space, A to Z lower case: bytes.split() then cuts at spaces alone.
_TABLE = bytes(ord(",") if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK = b","


class Vocabulary(dict):
    """Numbers words by first occurrence; the break is 0."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def slices(text: str) -> Iterator[list[bytes]]:
    """The words and breaks of a text in order, in lists of bounded size unless one word is longer."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            stop = max(data.rfind(b" ", at, end), data.rfind(_BREAK, at, end))
            if stop <= at:
                found = re.compile(b"[ ,]").search(data, end)
                stop = found.start() if found else len(data)
            end = stop
        yield data[at:end].replace(_BREAK, b" , ").split()
        at = end


class Block:
    """Tokens of one language so far; a block that goes on from another begins with that one's last words, counted there."""

    def __init__(self, seed: list[bytes] = ()):
        self.words, self.parts, self.seed = Vocabulary(), [], len(seed)
        self.size = 0
        if seed:
            self.add(seed)

    def add(self, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens)

    def row(self, goes_on: bool) -> tuple[dict, list[bytes]]:
        """Its columns, and the words that the next block of the same text begins with."""
        tokens = np.concatenate(self.parts) if self.parts else np.empty(0, np.int32)
        words = list(self.words)
        counts = np.bincount(tokens[self.seed :], minlength=len(words))
        order = np.concatenate([[0], 1 + np.argsort(-counts[1:], kind="stable")])  # frequent words get small numbers, which compress
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        tail = [words[t] for t in tokens[-(LONGEST - 1) :]] if goes_on else []
        row = {"starts": len(tokens) - len(tail), "tokens": packed(place[tokens].astype("<u4").view(np.uint8).reshape(-1, 4)), "words": pa.compress(b" ".join(words[k] for k in order[1:]), "zstd", asbytes=True)}
        row["word_bytes"] = sum(len(words[k]) + 1 for k in order[1:]) - 1 if len(order) > 1 else 0
        return row | {"counts": counts[order[1:]].tolist(), "n_words": int(counts[1:].sum())}, tail


def packed(rows: np.ndarray) -> bytes:
    """Rows of bytes as one compressed string, column by column; unpacked() needs their width."""
    return pa.compress(np.ascontiguousarray(rows.T).tobytes(), "zstd", asbytes=True) if len(rows) else b""


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    raw = pa.decompress(data, n * width, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T)


_BLOCK = {"block": pa.int64(), "lang": pa.string(), "size": pa.int32(), "starts": pa.int32(), "n_words": pa.int64(), "tokens": pa.binary(), "words": pa.binary(), "word_bytes": pa.int32(), "counts": pa.binary(), "vocabulary": pa.int32()}
_BLOCK_SQL = "block long, lang string, size int, starts int, n_words long, tokens binary, words binary, word_bytes int, counts binary, vocabulary int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made, held = TaskContext.get().partitionId(), 0, 0
    blocks: dict[str, Block] = {}

    def done(lang: str, goes_on: bool = False) -> tuple[pa.RecordBatch | None, list[bytes]]:
        nonlocal made, held
        block = blocks.pop(lang)
        held -= block.size
        row, tail = block.row(goes_on)
        counts = np.array(row["counts"], "<u4")
        row |= {"block": part << 32 | made, "lang": lang, "size": block.size, "vocabulary": len(counts), "counts": packed(counts.view(np.uint8).reshape(-1, 4))}
        made += 1
        return pa.RecordBatch.from_pydict({c: pa.array([row[c]], kind) for c, kind in _BLOCK.items()}) if len(counts) else None, tail

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            for tokens in slices(text.as_py()):
                block = blocks.setdefault(lang, Block())
                block.add(tokens)
                held += len(tokens)
                if block.size >= BLOCK_TOKENS:
                    out, tail = done(lang, goes_on=True)
                    if out is not None:
                        yield out
                    blocks[lang] = Block(tail)
                    held += len(tail)
            if lang in blocks:
                blocks[lang].add([_BREAK])
                held += 1
            if held >= 2 * BLOCK_TOKENS:
                for name in list(blocks):
                    out, _ = done(name)
                    if out is not None:
                        yield out
    for name in list(blocks):
        out, _ = done(name)
        if out is not None:
            yield out


def _vocabularies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and word: block, k (from 1), lang, word, f."""
    for batch in batches:
        for r in batch.to_pylist():
            words = pa.decompress(r["words"], r["word_bytes"], "zstd", asbytes=True).decode("utf-8", "surrogatepass").split(" ")
            n = len(words)
            f = unpacked(r["counts"], n, 4).view("<u4").ravel().astype(np.int64)
            columns = {"block": pa.array(np.full(n, r["block"])), "k": pa.array(np.arange(1, n + 1, dtype=np.int32)), "lang": pa.array([r["lang"]] * n, pa.string()), "word": pa.array(words, pa.string()), "f": pa.array(f)}
            whole = pa.RecordBatch.from_pydict(columns)
            for k in range(0, n, 1 << 15):
                yield whole.slice(k, 1 << 15)


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """The order of rows by columns of 16-bit digits, the most significant first (numpy's stable sort of such digits is a radix sort)."""
    order = None
    for column in reversed(digits):
        if len(column) and (column != column[0]).any():
            step = np.argsort(column if order is None else column[order], kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(digits[0])) if order is None else order


def sorted_counts(ids: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ids in ascending order and how often they occur (or the sums of counts)."""
    if not len(ids):
        return ids, np.empty(0, np.int64)
    order = radix_order([d for c in range(ids.shape[1]) for d in ((ids[:, c] >> 16).astype(np.uint16), (ids[:, c] & 0xFFFF).astype(np.uint16))])
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
    sums = np.diff(np.append(first, len(ids))) if counts is None else np.add.reduceat(counts[order], first)
    return ids[first], sums.astype(np.int64)


def keys_of(tokens: np.ndarray, ids: np.ndarray, starts: int) -> np.ndarray:
    """The ids of the up to LONGEST words from each position up to `starts`, with zeros behind; those of a single word are left out."""
    w = np.concatenate([ids[tokens], np.zeros(LONGEST, np.uint32)])
    columns = [w[:starts]]
    for k in range(1, LONGEST):
        columns.append(np.where(columns[-1] != 0, w[k : k + starts], 0))
    return np.stack(columns, axis=1)[columns[1] != 0].astype(np.uint32)


def as_bytes(ids: np.ndarray) -> np.ndarray:
    """Rows of ids as fixed-width binary keys, whose order is that of the ids."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * LONGEST}").ravel()


def block_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.zeros(row["vocabulary"] + 1, np.uint32)
    known = np.array(row["ids"], np.int64)
    ids[known >> 32] = known & 0xFFFFFFFF
    tokens = unpacked(row["tokens"], row["size"], 4).view("<u4").ravel()
    return sorted_counts(keys_of(tokens, ids, row["starts"]))


def _sampled(each: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = as_bytes(block_keys(row)[0])
                keys = keys[:: len(keys) // each + 1]
                yield pa.RecordBatch.from_pydict({"key": pa.array([k.ljust(4 * LONGEST, b"\0") for k in keys.tolist()], pa.binary())})

    return sample


def _dealt(bounds: np.ndarray):
    """A row for each block and subrange that it has keys in: subrange, n, and the sorted keys with their counts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = block_keys(row)
                data = np.concatenate([ids.astype(">u4").view(np.uint8).reshape(-1, 4 * LONGEST), counts.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
                ends = np.concatenate([[0], np.searchsorted(as_bytes(ids), bounds, side="left"), [len(ids)]])
                held = np.flatnonzero(np.diff(ends))
                for some in np.array_split(held, len(held) // 256 + 1):
                    yield pa.RecordBatch.from_pydict({"subrange": pa.array(some, pa.int32()), "n": pa.array(np.diff(ends)[some], pa.int32()), "data": pa.array([packed(data[ends[s] : ends[s + 1]]) for s in some], pa.binary())})

    return lambda batches: tidied(deal(batches))


def prefix_counts(ids: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each length from 2 on: phrases (ids, with zeros behind) of sorted keys that reach `least`, and those at either end, with counts."""
    differs = np.cumsum(ids[1:] != ids[:-1], axis=1) > 0
    for length in range(2, LONGEST + 1):
        first = np.flatnonzero(np.concatenate([[True], differs[:, length - 1]]))
        sums = np.add.reduceat(counts, first)
        kept = sums >= least
        kept[[0, -1]] = True
        kept &= ids[first, length - 1] != 0
        phrases = ids[first[kept]].copy()
        phrases[:, length:] = 0
        yield phrases, sums[kept]


def _counted(least: int):
    """Runs over rows sorted by subrange: phrase as two longs, and count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for subrange, n, data in zip(batch.column("subrange").to_pylist(), batch.column("n").to_pylist(), batch.column("data")):
                if subrange != now and held:
                    yield from counted(held)
                    held = []
                now = subrange
                held.append(unpacked(data.as_py(), n, 4 * LONGEST + 4))
        if held:
            yield from counted(held)

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        ids = np.ascontiguousarray(rows[:, : 4 * LONGEST]).view(">u4").astype(np.uint32)
        counts = np.ascontiguousarray(rows[:, 4 * LONGEST :]).view("<u4").ravel().astype(np.int64)
        for phrases, sums in prefix_counts(*sorted_counts(ids, counts), least):
            wide = phrases.astype(np.uint64)
            high, low = (wide[:, a] << np.uint64(32) | wide[:, a + 1] for a in (0, 2))
            yield pa.RecordBatch.from_pydict({"high": pa.array(high.view(np.int64)), "low": pa.array(low.view(np.int64)), "a": pa.array(sums)})

    return lambda batches: tidied(count(batches))


def dictionary(words: DataFrame) -> DataFrame:
    """words(lang, word, f) with dense ids from 1; only the rows of each partition are counted on the driver."""
    words = cut(words.withColumn("at", F.monotonically_increasing_id()))
    place, part = F.col("at").bitwiseAND((1 << 33) - 1), F.shiftrightunsigned("at", 33)
    offsets, total = [], 0
    for r in sorted(words.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((r.part, total))
        total += r.n
    if total >= 2**32 - 1:
        raise ValueError(f"{total} frequent words do not fit into ids of four bytes")
    offsets = F.broadcast(words.sparkSession.createDataFrame(offsets, "part long, offset long"))
    return words.withColumn("part", part).join(offsets, "part").select("lang", "word", "f", (F.col("offset") + place + 1).alias("id"))


def vocabularies(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("block", "lang", "words", "word_bytes", "counts")
    return rows.mapInArrow(lambda b: tidied(_vocabularies(b)), "block long, k int, lang string, word string, f long")


def _encoded(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The tokens of each block with the ids of its frequent words; blocks without any are left out."""
    known = vocabularies(blocks).join(words, ["lang", "word"]).select("block", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("id")).alias("id"))
    return blocks.select("block", "size", "starts", "tokens", "vocabulary").join(known.groupBy("block").agg(F.collect_list("id").alias("ids")), "block")


def _picked(offsets: dict[int, int], places: np.ndarray):
    """Of keys in order, dealt to partitions that begin at offsets, those at places."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            lo, hi = np.searchsorted(places, [at, at + len(batch)])
            yield batch.take(pa.array(places[lo:hi] - at))
            at += len(batch)

    return pick


def range_bounds(sample: DataFrame, subranges: int) -> np.ndarray:
    """The distinct bounds that part sample(key) into equal ranges; it is sorted on the executors, and only bounds reach the driver."""
    keys = cut(sample.orderBy("key"))
    sizes = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    offsets, n = {}, 0
    for r in sizes:
        offsets[r.part], n = n, n + r.n
    places = np.unique(np.arange(1, subranges, dtype=np.int64) * n // subranges) if n else np.empty(0, np.int64)
    chosen = keys.mapInArrow(_picked(offsets, places), "key binary").toArrow()["key"].combine_chunks() if len(places) else pa.array([], pa.binary())
    # Keys have one width, so their bytes are an array already; numpy's order of them is that of the ranges.
    return np.unique(np.frombuffer(b"".join(chosen.to_pylist()), f"S{4 * LONGEST}"))


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases(high, low, a), words(lang, word, f, id), totals(lang, n)) of docs(lang, text); a phrase's ids fill two longs."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = cut(rows.mapInArrow(lambda b: tidied(_blocks(b)), _BLOCK_SQL))
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    words = cut(dictionary(vocabularies(blocks).groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)))
    tokens = words.agg(F.sum("f")).first()[0] or 0
    subranges = min(SUBRANGES, max(1, math.ceil(tokens / SUBRANGE_KEYS)))
    picked = [r.block for r in blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS).collect()]
    each = math.ceil(subranges * SAMPLE_KEYS / max(1, len(picked)))
    bounds = range_bounds(_encoded(blocks.where(F.col("block").isin(picked)), words).mapInArrow(_sampled(each), "key binary"), subranges)
    partitions = min(len(bounds) + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(tokens / RANGE_KEYS)))
    dealt = _encoded(blocks, words).mapInArrow(_dealt(bounds), "subrange int, n int, data binary")
    ranged = dealt.withColumn("range", F.expr(f"cast(cast(subrange as long) * {partitions} div {len(bounds) + 1} as int)"))
    ranged = ranged.repartitionById(partitions, "range").sortWithinPartitions("subrange").select("subrange", "n", "data")
    runs = ranged.mapInArrow(_counted(least), "high long, low long, a long")
    return cut(runs.groupBy("high", "low").agg(F.sum("a").alias("a")).where(F.col("a") >= least)), words, totals


def _key(*ids: Column) -> tuple[Column, Column]:
    ids = [*ids, *[F.lit(0).cast("long")] * (LONGEST - len(ids))]
    return tuple(F.shiftleft(ids[k], 32).bitwiseOR(ids[k + 1]) for k in (0, 2))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The best phrases of each language of docs(lang, text): lang, rank, phrase, a, l, r, n, score.

    A to Z are lower-cased, texts split into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words `[^\\x20\\x09]+`. Phrases of 2 to
    LONGEST words that occur at least `least` times score floor(2000000 * a / (l + r)) at their weakest cut, the first one of
    equals; those of which a longer frequent phrase holds `share` percent of the occurrences are dropped. The `top` best
    by score, count and phrase (by bytes) are returned. n counts all words of the language.

    Null and empty texts have no words; a null lang counts as `und`, with texts whose lang is `und`. Repeated rows count each. Ties
    end at the phrase, which is unique in its language. Other columns are ignored whatever their names. An empty table, or one
    without frequent phrases, gives an empty result.
    """
    phrases, words, totals = frequent_phrases(docs, least)
    low32 = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    ids = [F.shiftrightunsigned("high", 32), low32("high"), F.shiftrightunsigned("low", 32), low32("low")]
    phrases = phrases.withColumns({f"w{k}": w for k, w in enumerate(ids, 1)})
    w = [F.col(f"w{k}") for k in range(1, LONGEST + 1)]
    length = F.when(w[2] == 0, 2).when(w[3] == 0, 3).otherwise(4)

    def by_length(of) -> Column:
        out = None
        for n in range(2, LONGEST + 1):
            made = of(n)
            out = F.when(length == n, made) if out is None else out.when(length == n, made)
        return F.explode(out)

    def key(name: str, *ids: Column) -> list[Column]:
        return [x.alias(f"{name}_{part}") for part, x in zip(("high", "low"), _key(*ids))]

    cuts = phrases.select("high", "low", "a", by_length(lambda n: F.array(*[F.struct(F.lit(k).alias("k"), *key("left", *w[:k]), *key("right", *w[k:n])) for k in range(1, n)])).alias("cut")).select("high", "low", "a", "cut.*")
    parts = words.select(*key("part", F.col("id")), F.col("f").alias("count")).unionAll(phrases.select("high", "low", "a"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.toDF(f"{side}_high", f"{side}_low", name), [f"{side}_high", f"{side}_low"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products may pass 64 bits
    score = F.expr("2000000 * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + r)").cast("long")
    best = cuts.groupBy("high", "low", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("high", "low", "a", "cut.*")
    inner = phrases.where("w3 > 0").select("a", by_length(lambda n: F.array(*[F.struct(*key("in", *w[s : s + m])) for m in range(2, n) for s in range(n - m + 1)]) if n > 2 else F.expr("cast(null as array<struct<in_high: bigint, in_low: bigint>>)")).alias("x"))
    longer = inner.groupBy(F.col("x.in_high").alias("high"), F.col("x.in_low").alias("low")).agg(F.max("a").alias("longer"))
    left = best.join(longer, ["high", "low"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < share * wide("a"))).drop("longer")
    spelled = left.select("*", F.posexplode(F.array(*ids)).alias("pos", "id")).where("id > 0").join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("high", "low", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("spelled"))
    spelled = spelled.select("lang", F.array_join(F.col("spelled.word"), " ").alias("phrase"), "a", "l", "r", "score", F.pmod(F.xxhash64("high", "low"), F.lit(RANK_PARTS)).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", "part"], ["lang"]):  # the first parts in turn, so that no task ranks a whole language
        spelled = spelled.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return spelled.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collocations() of the whole table of documents; nulls, repeats and empty tables as stated there."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT row, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS piece, lang, words FROM (SELECT row, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p) WHERE len(words) > 0),
t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
x AS (SELECT lang, words[pos : pos + size - 1] AS phrase, size FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM w, range(1, 5) s(size) WHERE len(words) >= size)),
f AS (SELECT lang, phrase, size, count(*) AS f FROM x GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, size, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.phrase[1 : c.k] JOIN f r ON r.lang = c.lang AND r.phrase = c.phrase[c.k + 1 : c.size]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase[pos : pos + m - 1] AS phrase, max(a) AS longer FROM (
        SELECT lang, phrase, f AS a, size, m, unnest(range(1, size - m + 2)) AS pos FROM f, range(2, 4) q(m) WHERE m < size) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.phrase, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM k JOIN t USING (lang) WHERE rank <= 2000
"""
