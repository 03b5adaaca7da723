"""op5: all documents, appended as small shards, compacted, and read back through the manifest."""

from pyspark.sql import functions as F

from weftwork.llm import compaction
from weftwork.llm.common import shared_folder, table

#: Arrivals of the query.
ARRIVALS = 6


def op5_compaction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    shards = compaction.ShardedTable(spark, shared_folder(spark, "shards"))
    for turn in range(ARRIVALS):
        shards.append(docs.where(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)), F.lit(0)) == turn))
        shards.compact()
    return shards.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text"), 256).alias("text_sha256"))


ORACLE = "select doc_id, lang, source, n_chars, sha256(text) as text_sha256 from documents"
