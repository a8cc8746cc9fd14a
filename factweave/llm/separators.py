"""Token counts of documents in flat token files without an index, by a separator scan.

A flat file holds unsigned 16-bit little-endian token ids, each document followed by the end-of-document id. Files are cut into
blocks of equal length whatever documents they cut; each block is searched for separators by vector comparison on its
own, and a prefix scan over the blocks' summaries (position of the last separator so far, separators so far) stitches
documents that cross blocks. The scan has two levels, over groups of blocks of a file and inside each group, and sees no
separator places. A block is bounded whatever the lengths of files and documents are.

Files are read block by block where they lie, through Arrow's file systems (file, s3, gs, abfs, hdfs where their libraries are at
hand), whatever their size. Only files of a store that Arrow cannot open are read by Spark's binaryFile source, a file at a
time; that source takes no file above 2 GB. token_files() writes a file for each task of its input, far below that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, new_folder, small_batches, table, tidied

#: Tokens of a block, and bytes of a token.
BLOCK, WIDTH = 1 << 20, 2
#: The end-of-document id of the vocabulary that token_files() writes with.
END = 50256

#: Blocks of a file that the first level of the prefix scan takes together.
GROUP = 1024
_SUMMARY = "path string, block long, start long, tokens long, at array<int>, last long, separators long"


def _summary(path: str, block: int, ids: np.ndarray, size: int, end: int) -> tuple:
    """Of one block: its place, the separators' places inside it, the file position of the last, and their number."""
    at = np.flatnonzero(ids == end).astype(np.int32)
    start = block * size
    return path, block, start, len(ids), at, start + int(at[-1]) if len(at) else None, len(at)


def in_store(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path as Spark names it, and the path in there."""
    scheme, rest = path.split(":", 1)
    rest = rest if rest.startswith("//") else f"//{rest}"
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{quote(rest, safe='/:@')}")


def readable(path: str) -> bool:
    try:
        in_store(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def scan(spark: SparkSession, folder: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """Documents of the flat token files in a folder: path, doc_no (from 0 in its file), start, n_tokens, ended.

    start is the position in tokens of the document's first token. Tokens after the last separator of a file are a last document
    with ended false; without such tokens there is none. Adjacent separators mark documents of no tokens. An odd last byte
    is no token. Empty files and an empty folder give no rows.
    """
    files = spark.read.format("binaryFile").load(folder)
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"last": "Int64"})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, k in zip(batch["path"], batch["block"]):
                store, place = in_store(path)
                with store.open_input_file(place) as f:
                    f.seek(int(k) * block * WIDTH)
                    data = f.read(block * WIDTH)
                ids = np.frombuffer(data, "<u2", count=len(data) // WIDTH)
                yield frame([_summary(path, int(k), ids, block, end)])

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                ids = np.frombuffer(content, "<u2", count=len(content) // WIDTH)
                for k in range(0, -(-len(ids) // block)):
                    yield frame([_summary(path, k, ids[k * block : (k + 1) * block], block, end)])

    store = F.regexp_extract("path", "^[^:]+:(//[^/]*)?", 0)
    stores = {r.store: readable(r.store + "/") for r in files.select(store.alias("store")).distinct().collect()}
    ranged = store.isin([s for s, known in stores.items() if known])
    blocks = files.where(ranged & (F.col("length") >= WIDTH)).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length div {WIDTH} - 1) div {block}"))).alias("block"))
    blocks = blocks.repartition(max(2, 2 * spark.sparkContext.defaultParallelism), "path", "block")
    found = blocks.mapInPandas(near, _SUMMARY)
    if not all(stores.values()):
        found = found.unionAll(files.where(~ranged).select("path", "content").mapInPandas(far, _SUMMARY))
    found = cut(found)
    # The scan runs over narrow summaries, first over groups of blocks and then inside each; places are joined to its result.
    narrow = found.select("path", "block", F.expr(f"block div {GROUP}").alias("group"), "last", "separators", (F.col("start") + F.col("tokens")).alias("stop"))
    groups = narrow.groupBy("path", "group").agg(F.max("last").alias("last"), F.sum("separators").alias("separators"), F.max("stop").alias("stop"))
    over_file = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("last_before", F.max("last").over(over_file)).withColumn("docs", F.coalesce(F.sum("separators").over(over_file), F.lit(0)))
    groups = groups.select("path", "group", "last_before", "docs", F.max("stop").over(Window.partitionBy("path")).alias("file_end"))
    over_group = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    narrow = narrow.withColumn("last_here", F.max("last").over(over_group)).withColumn("docs_here", F.coalesce(F.sum("separators").over(over_group), F.lit(0)))
    narrow = narrow.join(groups, ["path", "group"])
    opened = F.coalesce(F.coalesce("last_here", "last_before") + 1, F.lit(0).cast("long"))
    narrow = narrow.select("path", "block", opened.alias("open"), (F.col("docs") + F.col("docs_here")).alias("docs_before"), "file_end", (F.col("stop") == F.col("file_end")).alias("is_last"))
    found = found.join(narrow, ["path", "block"])
    # Documents end at the block's separators, and what the last block of a file leaves open at the file's end.
    stops = F.transform("at", lambda x: F.col("start") + x)
    tail = F.col("is_last") & (F.col("file_end") > F.coalesce(F.col("last") + 1, F.col("open")))
    stops = F.when(tail, F.concat(stops, F.array("file_end"))).otherwise(stops)
    found = found.select("path", "open", "docs_before", "separators", stops.alias("stops"))
    starts = F.concat(F.array("open"), F.transform(F.slice("stops", 1, F.greatest(F.size("stops") - 1, F.lit(0))), lambda x: x + 1))
    found = found.where(F.size("stops") > 0).select("path", "docs_before", "separators", F.arrays_zip(starts.alias("start"), F.col("stops").alias("stop")).alias("docs"))
    rows = found.select("path", "docs_before", "separators", F.posexplode("docs").alias("k", "doc"))
    return rows.select("path", (F.col("docs_before") + F.col("k")).alias("doc_no"), F.col("doc")["start"].alias("start"), (F.col("doc")["stop"] - F.col("doc")["start"]).alias("n_tokens"), (F.col("k") < F.col("separators")).alias("ended"))


@lru_cache(maxsize=2)
def _ranks(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_files(docs: DataFrame, path: str, pattern: str, end: int = END) -> str:
    """Write the texts of docs, encoded with a rank file, as flat token files to a new shared folder; returns its path.

    Null and empty texts become documents of no tokens. Spark's text writer puts down each document's bytes and the
    end-of-document id as the line separator, so its commit protocol covers lost executors.
    """

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _ranks(path, pattern)
        yield from tidied(pd.Series([np.array(encoding.encode_ordinary(t or ""), "<u2").tobytes() for t in texts], dtype="object") for texts in batches)

    small_batches(docs.sparkSession)
    folder = new_folder(docs.sparkSession, "tokens")
    mark = end.to_bytes(WIDTH, "little").decode("latin-1")
    out = docs.select(encode("text").cast("string").alias("value")).write
    out.option("lineSep", mark).option("encoding", "ISO-8859-1").option("compression", "none").text(folder)
    return folder


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat token files written first: shard, doc_no, start, n_tokens, ended."""
    import public_tokenizers

    folder = token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = scan(spark, folder)
    return found.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "doc_no", "start", "n_tokens", "ended")
