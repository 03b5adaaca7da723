"""op3: nearest neighbours of every vector whose id is divisible by 50."""

from pyspark.sql import functions as F

from weftwork.llm import hilbert_ann
from weftwork.llm.common import table


def op3_hilbert_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return hilbert_ann.neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)
