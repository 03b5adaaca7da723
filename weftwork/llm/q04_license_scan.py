"""op4: license scan of all documents."""

from pyspark.sql import functions as F

from weftwork.llm import license_scan
from weftwork.llm.common import table


def _joined(labels):
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op4_license_scan(spark, sf_dir):
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base, own = F.col("base.label"), F.col("spans.label")
    sure = F.greatest(F.when(F.size("base") > 0, 0.9).otherwise(0.0), F.coalesce(F.array_max("spans.confidence"), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, own)).alias("labels"),
        sure.alias("score"),
    )
