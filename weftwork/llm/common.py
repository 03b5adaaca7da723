"""What the corpus operators share: tables, the shared folder, and word blocks over Arrow batches."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.files import Store

#: Type of what ``keyed`` tells rows apart by.
KEY = "struct<doc_id: long, mark: struct<a: long, b: int, c: int>>"
#: Keys that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: Bytes of text that a Python worker gathers before it computes; one longer document is a block alone.
BLOCK_BYTES = 1 << 20

#: ASCII letters lowered and digits kept, bytes of other code points kept, all else a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: ASCII letters lowered, nothing else changed.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, so rows of long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's spark.checkpoint.dir; where none is set, one of a single machine, which only a local session may use."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def released(*tables: DataFrame) -> None:
    """The tables that ``written`` made go from the shared folder; what was made of them has been written itself."""
    for df in tables:
        Store(df.sparkSession, df.written_at).delete("")


def text_mark(text: Column) -> Column:
    """What tells texts apart: 96 bits of hashes, and the length."""
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"), F.length(text).alias("c"))


def keyed(docs: DataFrame) -> DataFrame:
    """key (doc_id and the text's mark: a row up to repetition) and text of every row."""
    text = F.col("text").cast("string")
    return docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_mark(text).alias("mark")).alias("key"), text.alias("text"))


def few(keys: DataFrame) -> DataFrame:
    """``keys`` (a written table), broadcast if they are BROADCAST_ROWS at most, else joined by a shuffle."""
    return F.broadcast(keys) if counted(keys) <= BROADCAST_ROWS else keys


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``keys`` (key, as ``keyed`` makes them) name; null ids are ids, other columns stay."""
    gone = few(written(keys.select(F.col("key").alias("_gone")).distinct(), "gone"))
    text = docs["text"].cast("string")
    own = F.struct(docs["doc_id"].cast("long").alias("doc_id"), text_mark(text).alias("mark"))
    return docs.join(gone, own.eqNullSafe(F.col("_gone")), "left_anti")


def text_blocks(batches, limit: int = BLOCK_BYTES):
    """(ids, text bytes, offsets) of blocks of whole documents; batches hold an id and a text. Null texts are empty.

    ids is an Arrow array, offsets an int64 array of one more than the documents.
    """
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            text = part.column(1).fill_null("").cast(pa.large_string())
            ids.append(part.column(0))
            texts.append(text)
            size += _bytes_of(text)
            if size >= limit:
                yield _block(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield _block(ids, texts)


def _bytes_of(text) -> int:
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    return int(offsets[-1] - offsets[0])


def _block(ids, texts):
    text = pa.concat_arrays(texts)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = b"" if data is None else data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
    return pa.concat_arrays(ids), raw, offsets - offsets[0]


def word_spans(shown: np.ndarray, offsets: np.ndarray, space=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of a block, and the first word's number of each document (one more at the end).

    ``shown``: the block's bytes; bytes of words are those for which ``space`` (by byte, default: 32 only) is False.
    Words never span documents.
    """
    inside = shown != 32 if space is None else ~space[shown]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(shown))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def words_of(shown: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow binary array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lengths)
    at += np.arange(offsets[-1])
    return pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(shown[at]))]
    )


def counted(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
