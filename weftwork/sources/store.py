"""Preprocessed datasets: Parquet with a manifest of their parameters, discovery, random access, text sinks."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of stores and codecs, to Parquet codecs.
CODECS = {None: "uncompressed", "none": "uncompressed", "no": "uncompressed", "gzip": "gzip", "gz": "gzip", "zlib": "gzip", "snappy": "snappy", "lz4": "lz4", "lz4hc": "lz4", "lzma": "zstd", "xz": "zstd", "bz2": "zstd", "bzip2": "zstd", "xpress": "snappy", "zstd": "zstd"}
STORES = {"parquet", "dbm", "zip", "tar", "rocksdb"}


def identity(params) -> str:
    """A short name of parameters: SHA-1 of their sorted JSON."""
    return hashlib.sha1(dumped(params).encode()).hexdigest()[:20]


def dumped(params) -> str:
    return json.dumps(asdict(params) if is_dataclass(params) else params, sort_keys=True, indent=1)


class Store:
    """Datasets under ``root``, one folder each, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def write(self, rows: DataFrame, fold: str, params, store: str = "parquet", codec: str | None = "zstd", overwrite: bool = False, rows_per_file: int = 0, index: str = "example_idx") -> str:
        """The dataset of a fold and parameters; an existing one is an error unless ``overwrite``. The manifest comes last.

        Rows are sorted by ``index`` within files, so that point lookups skip row groups.
        """
        if store not in STORES:
            raise ValueError(f"no such store: {store}")
        name = f"{fold}-{identity(params)}"
        writer = rows.sortWithinPartitions(index).write.mode("overwrite" if overwrite else "errorifexists").option("compression", CODECS[codec])
        writer.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.root}/{name}")
        stream = self.fs.create(self._path(f"{name}/_params.json"), True)
        stream.write(bytearray(dumped(params).encode()))
        stream.close()
        return name

    def params(self, name: str) -> dict | None:
        """The manifest of a dataset; None if it is missing or malformed."""
        path = self._path(f"{name}/_params.json")
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def names(self, fold: str) -> list[str]:
        root = self.hadoop.Path(self.root)
        if not self.fs.exists(root):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(root)]
        return sorted(n for n in found if n.startswith(f"{fold}-"))

    def compatible(self, fold: str, params) -> str | None:
        """The dataset of exactly these parameters, else the smallest one whose parameters contain them."""
        exact = f"{fold}-{identity(params)}"
        wanted = asdict(params) if is_dataclass(params) else params
        fits = [n for n in self.names(fold) if (own := self.params(n)) is not None and contains(own, wanted)]
        return exact if exact in fits else min(fits, key=lambda n: (self.size(n), n), default=None)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def lookup(self, name: str, indices: list[int], index: str = "example_idx") -> DataFrame:
        """The rows of given indices; the filter reaches the files' statistics."""
        return self.read(name).where(F.col(index).isin([int(i) for i in indices]))


def contains(own, wanted) -> bool:
    """Whether parameters ``own`` give all that ``wanted`` asks for.

    True covers False, a value covers None, ranges (least, most) cover ranges inside, structures field by field.
    """
    if wanted is None or wanted is False:
        return True
    if own is None or own is False:
        return False
    if isinstance(wanted, dict):
        if {"least", "most"} == set(wanted):
            return own["least"] <= wanted["least"] and own["most"] >= wanted["most"]
        return all(contains(own.get(k), v) for k, v in wanted.items())
    return own == wanted or own is True


def columns_of(params) -> list[str]:
    """Dotted names of the columns that parameters ask for: true fields, and those of structures that are set."""
    out = []
    for f in fields(params):
        value = getattr(params, f.name)
        if is_dataclass(value) and "column" not in f.metadata:
            out += [f"{f.name}.{c}" for c in columns_of(value)]
        elif value not in (None, False):
            out.append(f.metadata.get("column", f.name))
    return out


def pruned(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Nested columns by dotted names, regrouped in structs; the scan reads no others."""
    tops: dict[str, list[str]] = {}
    for name in wanted:
        top, _, rest = name.partition(".")
        tops.setdefault(top, [])
        if rest:
            tops[top].append(rest)
    out = []
    for top, inner in tops.items():
        out.append(F.struct(*[F.col(f"{top}.{i}").alias(i.replace(".", "_")) for i in inner]).alias(top) if inner else F.col(top))
    return rows.select(*out)


def write_predictions(rows: DataFrame, folder: str, key: str, names: str) -> None:
    """predictions.txt (names joined by spaces) and predictions_hashes.txt, lines in the same order."""
    ordered = rows.orderBy(key)
    ordered.select(F.array_join(names, " ").alias("value")).write.text(f"{folder}/predictions.txt")
    ordered.select(F.col(key).cast("string").alias("value")).write.text(f"{folder}/predictions_hashes.txt")


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``; ``build()`` makes it first if it is not there. Vocabularies and word counts are kept so."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
