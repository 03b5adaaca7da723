"""op1: quality scores of all documents."""

from pyspark.sql import functions as F

from weftwork.llm import quality
from weftwork.llm.common import table


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def training_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1))
    return labels.select("doc_id", F.col("quality").alias("label"))


def op1_quality(spark, sf_dir):
    found = quality.scored(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
