"""Queries over learned operators with given weights, nested projections and stored datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftwork.functions import arrays, vectors
from weftwork.operators import models
from weftwork.plans.params import for_model
from weftwork.plans.tables import table
from weftwork.sources import store

Q, O = {}, {}  # noqa: E741


def query(sql=None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query("""with emb as (select vec_id, embedding::double[] as e from embeddings), r as (select l_orderkey, l_linenumber, l_partkey, l_partkey % 5 as i, l_suppkey % 20 as own from lineitem)
  select l_orderkey, l_linenumber, l_partkey, round(case when i = 0 then 0 when i = 1 then w.e[1] else v.e[1] end, 6) as replaced, round(case when i = 0 then 0 else v.e[1] + w.e[1] end, 6) as added
  from r left join emb v on v.vec_id = i left join emb w on w.vec_id = own + 2""")
def embedding_policies(spark, sf_dir):
    vecs = _vectors(spark, sf_dir).select(F.col("vec_id").alias("idx"), F.col("e").alias("value"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 5).alias("i"), (F.col("l_suppkey") % 20).alias("own"))
    found = models.embedded(rows, "i", vecs, "replace_oovs", "own", to="r")
    found = models.embedded(found, "i", vecs, "add_all", "own", to="a")
    one = lambda c: F.round(F.get(c, F.lit(0)), 6)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", one("r").alias("replaced"), one("a").alias("added"))


@query("""with emb as (select vec_id, embedding::double[] as e from embeddings), s as (select vec_id, e[:16] as s, e[17:32] as u, e[33:48] as f, e[49:64] as g from emb)
  select vec_id, round(list_sum(list_transform(range(1, 17), lambda i: s[i] / (1 + exp(-f[i])) + tanh(u[i]) / (1 + exp(-g[i])))), 6) as total from s""")
def gated_update(spark, sf_dir):
    part = lambda k: F.slice("e", 16 * k + 1, 16)
    rows = _vectors(spark, sf_dir).select("vec_id", vectors.gated(part(0), part(1), part(2), part(3)).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""with emb as (select vec_id, embedding::double[] as e from embeddings), m as (select vec_id, e, list_avg(e) as a, list_avg(list_transform(e, lambda x: (x - list_avg(e)) * (x - list_avg(e)))) as v from emb)
  select vec_id, round((e[1] - a) / sqrt(v + 1e-5), 6) as first, round((e[64] - a) / sqrt(v + 1e-5), 6) as last from m""")
def layer_norm(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", vectors.layer_norm(F.col("e")).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"))


@query("""with emb as (select vec_id, embedding::double[] as e from embeddings)
  select vec_id, round(e[1] + 2 * e[2], 6) as a, round(e[3] - e[4], 6) as b from emb""")
def linear_projection(spark, sf_dir):
    matrix = [[1.0, 2.0, 0.0, 0.0], [0.0, 0.0, 1.0, -1.0]]
    rows = _vectors(spark, sf_dir).select("vec_id", vectors.projected(matrix, F.slice("e", 1, 4)).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("a"), F.round(F.get("v", F.lit(1)), 6).alias("b"))


def _sequences(spark, sf_dir):
    """Vectors of a label in runs of eight."""
    rows = _vectors(spark, sf_dir).withColumn("k", F.floor(F.col("vec_id") / 50))
    return rows.groupBy("label", "k").agg(arrays.collected(F.slice("e", 1, 8), F.col("vec_id")).alias("items")).select((F.col("label") * 1000000 + F.col("k")).cast("long").alias("seq"), "items")


def _summed(rows):
    total = F.aggregate(F.flatten("states"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("seq", F.size("states").alias("n"), F.round(total, 6).alias("total"))


@query()
def lstm_sequences(spark, sf_dir):
    return _summed(models.encoded_sequences(_sequences(spark, sf_dir), "seq", "items", models.BiLstm(8, 4)))


@query()
def tree_lstm(spark, sf_dir):
    rows = _sequences(spark, sf_dir).withColumn("parents", F.transform("items", lambda x, i: F.when(i == 0, -1).otherwise(((i - 1) / 2).cast("int"))))
    return _summed(models.encoded_trees(rows, "seq", "items", "parents", models.TreeLstm(8, 4)))


@query()
def pointer_decoder(spark, sf_dir):
    rows = _sequences(spark, sf_dir)
    return models.decoded(rows, "seq", "items", "items", models.PointerDecoder(8), most=6)


@query("""with s as (select user_id, list(event_type order by event_id) as t, list(value order by event_id) as v from events group by 1)
  select user_id, round(coalesce(list_sum(list_transform(list_filter(list_zip(t, v), lambda p: p[1] = 'click'), lambda p: p[2])), 0), 4) as click,
    round(coalesce(list_sum(list_transform(list_filter(list_zip(t, v), lambda p: p[1] = 'error'), lambda p: p[2])), 0), 4) as error from s""")
def copy_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(arrays.collected(F.col("event_type"), F.col("event_id")).alias("t"), arrays.collected(F.col("value"), F.col("event_id")).alias("v"))
    rows = rows.select("user_id", models.copy_scores(F.col("t"), F.col("v"), F.array(F.lit("click"), F.lit("error"))).alias("s"))
    return rows.select("user_id", F.round(F.get("s", F.lit(0)), 4).alias("click"), F.round(F.get("s", F.lit(1)), 4).alias("error"))


@query("select doc_id, lang, n_chars from documents")
def column_prune(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", "n_chars", "source").alias("meta"))
    return store.pruned(rows, ["doc_id", "meta.lang", "meta.n_chars"]).select("doc_id", "meta.*")


@query()
def dataset_resolve(spark, sf_dir):
    """Three stored datasets, and which one each model reads."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file:///tmp/checkpoints"
    root = store.Store(spark, f"{base.rstrip('/')}/datasets-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_idx"), "o_orderpriority")
    asked = {"paths": for_model("ast-paths", "paths"), "graph": for_model("tokens", "graph")}
    large = type(asked["paths"]).full()
    names = {root.write(rows, "Train", large): "full", root.write(rows.where("example_idx % 2 = 0"), "Train", asked["paths"]): "paths"}
    found = [(k, names[root.compatible("Train", p)]) for k, p in asked.items()]
    return spark.createDataFrame(found, "model string, dataset string")
