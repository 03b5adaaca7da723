"""Raw examples from aligned line files: one example per line, up to five files of JSON lines."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators.batching import sampled
from weftwork.sources.schema import decoded

#: Default names of the files.
FILES = {
    "hash": "hashes.txt",
    "logging_call": "logging_calls_json.txt",
    "method": "method.txt",
    "method_ast": "method_ast.txt",
    "method_pdg": "method_pdg.txt",
}


def paths(spark: SparkSession, folder: str, required: tuple = (), **explicit: str) -> dict[str, str]:
    """The file of each part: a given one must exist, a default one is taken if it does; none at all is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    found = {}
    for part, name in FILES.items():
        if part in explicit:
            if not there(explicit[part]):
                raise FileNotFoundError(explicit[part])
            found[part] = explicit[part]
        elif there(f"{folder}/{name}"):
            found[part] = f"{folder}/{name}"
    if not found:
        raise FileNotFoundError(f"no part of raw examples in {folder}")
    if missing := [p for p in required if p not in found]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return found


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0) and line (trimmed) of a text file.

    Line numbers need the order of the file, which zipWithIndex has: it counts partitions first, in a job of its own.
    """
    rows = spark.read.text(path).rdd.zipWithIndex().map(lambda r: (r[1], r[0][0]))
    return spark.createDataFrame(rows, "line_no long, line string").withColumn("line", F.trim("line"))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def aligned(spark: SparkSession, files: dict[str, str], rate: float = 1.0, salt: str = "") -> DataFrame:
    """line_no and a column per part, decoded; files of differing lengths are cut to the shortest, with a warning."""
    counts = {part: count_lines(spark, path) for part, path in files.items()}
    if len(set(counts.values())) > 1:
        warnings.warn(f"raw files differ in length: {counts}", stacklevel=2)
    parts = []
    for part, path in files.items():
        rows = lines(spark, path)
        parts.append(rows.select("line_no", (F.col("line") if part == "hash" else decoded(part, F.col("line"))).alias(part)))
    rows = reduce(lambda a, b: a.join(b, "line_no"), parts)
    return sampled(rows, rate, salt, "line_no") if rate < 1 else rows


def verified(rows: DataFrame) -> DataFrame:
    """Examples whose parts belong together; a wrong method hash is an error, a call without its nodes is left out."""
    own = F.col("logging_call.methodRef.hash")
    for part in ("method_ast", "method_pdg"):
        wrong = F.raise_error(F.concat(F.lit(f"{part} of another method: "), F.coalesce(own, F.lit("null"))))
        good = F.when(own.eqNullSafe(F.col(f"{part}.methodHash")), F.lit(True)).otherwise(wrong.cast("boolean"))
        rows = rows.where(good)
    return rows.where("logging_call.pdgNodeIdx is not null and logging_call.astNodeIdx is not null")


def write_parts(rows: DataFrame, folder: str, parts: list[str]) -> None:
    """JSON lines of each part, ordered by line_no; a fixture's way back to files."""
    for part in parts:
        line = F.col(part) if part == "hash" else F.to_json(part)
        rows.orderBy("line_no").coalesce(1).select(line.alias("value")).write.text(f"{folder}/{FILES[part]}")
