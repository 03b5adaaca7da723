from pyspark.sql import functions as F

from weftwork.operators.limits import Limit
from weftwork.streaming import examples

SF = "/root/testdata/sf0.001"


def test_stream_of_examples_counts_as_a_batch_does(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    source.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/in")
    bounds = [Limit("large", F.col("value"), None, 100), Limit("small", F.col("value"), 5, None)]
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    counts = examples.rejections(stream, bounds, "ts", late="400 days")
    query = counts.writeStream.format("memory").outputMode("complete").queryName("rejections").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = {r.reason: r.n for r in spark.sql("select reason, sum(n) n from rejections group by 1").collect()}
    assert got == {"large": source.where("value > 100").count(), "small": source.where("value < 5").count()}
    kept, rejected = examples.split(source, bounds)
    assert kept.count() + rejected.count() == source.count()
