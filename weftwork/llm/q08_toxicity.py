"""op8: toxicity scores of all documents."""

from pyspark.sql import functions as F

from weftwork.llm import toxicity
from weftwork.llm.common import table
from weftwork.llm.q01_quality import held_out


def op8_toxicity(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where(~held_out(4, 2)).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.scored(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
