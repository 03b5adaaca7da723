"""Token counts by separator scans of flat, unindexed token files.

A token file is nothing but ids of fixed width, documents divided by one id. Files are cut into blocks; a task
finds the separators of a block in one vectorised search, without knowing what the block begins in. A prefix scan
over the blocks of a file (a running sum of documents, a running maximum of the last separator's place) then gives
each block what it continues, and so every document's place and length.

``byte_token_files`` writes the files that the query scans: ids are UTF-8 bytes plus one (mod 256), 0 divides
documents. Bytes FF and FE never occur in UTF-8, so 0 and 255 are free: a document's decimal id and 255 come before
its text, so that files need no order and no index. Documents are written in turns, and a turn's files are
deleted when it is counted: no more than a part of the corpus is on disk twice.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.llm.common import shared_folder, small_batches, text_blocks, written
from weftwork.llm.files import Store

#: Bytes of a block, turns of writing and counting.
BLOCK_BYTES, TURNS = 2 << 20, 4
END, HEAD = 0, 255
_IDS = bytes((b + 1) % 256 for b in range(256))
_BYTES = bytes((b - 1) % 256 for b in range(256))


def byte_token_files(docs: DataFrame, folder: str) -> None:
    """Flat files of 8-bit ids of ``docs`` (doc_id, text) in ``folder``; null ids have an empty head, null texts no tokens."""
    small_batches(docs.sparkSession)

    def run(batches):
        for keys, raw, offsets in text_blocks(batches):
            coded, ends = raw.translate(_IDS), offsets.tolist()
            heads = [b"" if k is None else str(k).encode().translate(_IDS) for k in keys.to_pylist()]
            rows = [h + b"\xff" + coded[a:b] for h, a, b in zip(heads, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "value binary")
    # the writer puts the separator after each row: the file is ids alone
    rows.select(F.col("value").cast("string")).write.option("lineSep", chr(END)).text(folder)


def scan(spark: SparkSession, folder: str, end: int = END, dtype: str = "<u1", block_bytes: int = BLOCK_BYTES, heads: int | None = None) -> DataFrame:
    """One row per document of the token files in ``folder``: file, ordinal, start (in ids), n_tokens, ended, head.

    ``end`` divides documents; ids behind the last one are a document that has not ended, if there are any.
    ``dtype`` is a little-endian numpy type. With ``heads``, an id, what stands before its first occurrence in a
    document is its head, in bytes of the ids' low parts less one (null: none), and is not counted; heads have 40
    ids at most. Empty files have no documents. A file is read as one value, so files have up to 2 GB.
    """
    small_batches(spark)
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width
    files = spark.read.format("binaryFile").load(folder)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block_bytes).cast("long"))
    # a block comes with what heads behind its last separator need
    beyond = 41 * width if heads is not None else 0
    blocks = files.where("length > 0").select("path", "length", "content", F.explode(starts).alias("at"))
    content = F.substring(F.col("content"), (F.col("at") + 1).cast("int"), F.lit(block_bytes + beyond))
    blocks = blocks.select(F.col("path").alias("file"), (F.col("at") / block_bytes).cast("long").alias("block"), "length", content.alias("ids"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                file, block, length, raw = (batch.column(i)[row] for i in range(4))
                ids = np.frombuffer(raw.as_buffer(), dtype)
                first, total = block.as_py() * (block_bytes // width), length.as_py() // width
                own = ids[: block_bytes // width]
                at = np.flatnonzero(own == end)
                begins = at + 1
                if first == 0:
                    begins = np.concatenate([[0], begins])
                begins = begins[begins + first < total]
                marks = [_head(ids, b, heads) for b in begins.tolist()] if heads is not None else [None] * len(begins)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file.as_py()]),
                        pa.array([block.as_py()]),
                        pa.array([total]),
                        pa.array([(at + first).tolist()], pa.list_(pa.int64())),
                        pa.array([(begins + first).tolist()], pa.list_(pa.int64())),
                        pa.array([marks], pa.list_(pa.string())),
                    ],
                    ["file", "block", "total", "ends", "begins", "heads"],
                )

    schema = "file string, block long, total long, ends array<long>, begins array<long>, heads array<string>"
    found = written(blocks.mapInArrow(run, schema), "token-blocks")
    # documents begin in one block and end in it or a later one: the k-th beginning of a file meets its k-th end
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("file", "block", F.size("ends").alias("e"), F.size("begins").alias("b"), F.array_max("ends").alias("last"))
    sums = sums.select(
        F.col("file").alias("f"),
        F.col("block").alias("k"),
        F.coalesce(F.sum("e").over(before), F.lit(0)).alias("ended"),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("begun"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"),
    )
    placed = found.join(sums, (F.col("file") == F.col("f")) & (F.col("block") == F.col("k")))
    # the document that an end closes began behind the end before it, wherever that is
    closed = placed.select("file", "ended", "previous", "ends", F.posexplode("ends").alias("i", "to"))
    since = F.when(F.col("i") == 0, F.col("previous")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    closed = closed.select("file", (F.col("ended") + F.col("i")).alias("ordinal"), since.alias("start"), (F.col("to") - since).alias("size"))
    opened = placed.select("file", "total", "begun", F.posexplode(F.arrays_zip("begins", "heads")).alias("i", "b"))
    opened = opened.select(F.col("file").alias("f"), (F.col("begun") + F.col("i")).alias("o"), "total", F.col("b.begins").alias("begin"), F.col("b.heads").alias("head"))
    rows = opened.join(closed, (F.col("f") == F.col("file")) & (F.col("o") == F.col("ordinal")), "left")
    ended = F.col("size").isNotNull()
    size = F.when(ended, F.col("size")).otherwise(F.col("total") - F.col("begin"))
    headed = F.when(F.col("head").isNotNull(), F.length("head") + 1).otherwise(0)
    return rows.select(F.col("f").alias("file"), F.col("o").alias("ordinal"), F.col("begin").alias("start"), (size - headed).alias("n_tokens"), ended.alias("ended"), "head")


def _head(ids: np.ndarray, begin: int, mark: int) -> str | None:
    part = ids[begin : begin + 41]
    at = np.flatnonzero(part == mark)
    return bytes(part[: at[0]].astype(np.uint8)).translate(_BYTES).decode("ascii", "replace") if len(at) else None


def document_tokens(docs: DataFrame, turns: int = TURNS) -> DataFrame:
    """doc_id and n_tokens (byte-level) of every row of ``docs``, counted by scanning token files.

    Null and empty texts have none; null ids stay null; repeated rows are counted each; other columns are ignored.
    """
    spark = docs.sparkSession
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(turns))
    counts = []
    for t in range(turns):
        folder = shared_folder(spark, "tokens")
        byte_token_files(docs.where(turn == t), folder)
        found = scan(spark, f"{folder}/part-*", heads=HEAD)
        head = F.when(F.col("head") != "", F.col("head").cast("long"))
        counts.append(written(found.select(head.alias("doc_id"), "n_tokens"), "token-counts"))
        Store(spark, folder).delete("")
    return reduce(DataFrame.union, counts)
