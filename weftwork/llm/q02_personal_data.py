"""op2: personal data in all documents."""

from pyspark.sql import functions as F

from weftwork.llm import personal_data
from weftwork.llm.common import table


def _count(kind: int):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op2_personal_data(spark, sf_dir):
    found = personal_data.entities(table(spark, sf_dir, "documents"))
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(personal_data.KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(personal_data.listed(F.col("base")), 256).alias("base_sha256"),
        personal_data.listed(F.col("spans")).alias("spans"),
    )
