"""Queries over context joins, folds, samples of paths, collation and embedders."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.functions import arrays, vectors
from weftwork.operators import batching, context, scatter, trees
from weftwork.plans.structure_queries import EMB, LINES, _emb, _line_nodes
from weftwork.plans.tables import table

Q, O = {}, {}  # noqa: E741


def query(sql=None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _mean(a, b):
    return vectors.scaled(vectors.added(a, F.slice(b, 1, F.size(a))), F.lit(0.5))


def _first(c, places=6):
    return F.round(F.get(c, F.lit(0)), places)


OWNED = EMB + """, r as (select l_orderkey, l_linenumber, l_partkey, l_quantity::double as q, case when l_returnflag <> 'R' then l_suppkey % 600 end as own from lineitem)"""


@query(f"""with {OWNED} select l_orderkey, l_linenumber, l_partkey, round(case when e is null then q else (q + e[1]) / 2 end, 6) as kept, round((q + coalesce(e[1], 0)) / 2, 6) as zeroed
  from r left join emb on vec_id = own""")
def macro_context(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "R", F.col("l_suppkey") % 600).alias("own"), F.array(F.col("l_quantity").cast("double")).alias("value"))
    side = _emb(spark, sf_dir).select(F.col("vec_id").alias("idx"), F.col("e").alias("value"))
    kept = context.with_context(lines.withColumn("old", F.col("value")), F.col("own"), side, _mean).withColumn("kept", _first("value"))
    both = context.with_context(kept.withColumn("value", F.col("old")), F.col("own"), side, _mean, "zero")
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "kept", _first("value").alias("zeroed"))


@query("""with l as (select l_orderkey, l_linenumber, sum(l_quantity)::double as q, sum(l_extendedprice)::double as p, max(l_returnflag) as f from lineitem group by 1, 2)
  select l_orderkey, l_linenumber, round(case when f = 'R' then p else q end, 4) as upper, round(case when f = 'R' then p * 2 end, 4) as back from l""")
def leaf_swap(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.max("l_returnflag").alias("f"))
    keys = ["l_orderkey", "l_linenumber"]
    outer = lines.where("f = 'R'").select(*keys, F.array("p").alias("value"))
    upper = context.swapped_leaves(lines.select(*keys, F.array("q").alias("value")), outer, keys)
    encoded = upper.select(*keys, vectors.scaled(F.col("value"), F.lit(2.0)).alias("value"))
    back = context.swapped_leaves(outer, encoded, keys).select(*keys, _first("value", 4).alias("back"))
    return upper.select(*keys, _first("value", 4).alias("upper")).join(back, keys, "left")


@query(f"""with {EMB}, t as (select user_id as expr, event_id as place, value, case when event_type = 'click' then user_id % 600 end as symbol from events)
  select expr, place, round(case when e is null then value else (value + e[1]) / 2 end, 6) as value from t left join emb on vec_id = symbol""")
def symbol_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("expr"), F.col("event_id").alias("place"), F.array("value").alias("value"), "event_type")
    occurrences = rows.where("event_type = 'click'").select("expr", "place", (F.col("expr") % 600).alias("symbol"))
    side = _emb(spark, sf_dir).select(F.col("vec_id").alias("symbol"), F.col("e").alias("value"))
    return context.updated_places(rows.drop("event_type"), occurrences, side, _mean).select("expr", "place", _first("value").alias("value"))


NAMED = LINES + """, nm as (select distinct l_orderkey as tree, 1 + 100 * (case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end)::bigint + l_linenumber::bigint as leaf, l_linestatus || l_suppkey % 4 as name from lineitem),
  up as (select tree, leaf, unnest([leaf, flag, 0::bigint]) as idx from p)"""


def _names(spark, sf_dir):
    flag = 1 + 100 * F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long")
    name = F.concat("l_linestatus", (F.col("l_suppkey") % 4).cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree"), (flag + F.col("l_linenumber")).alias("leaf"), name.alias("name")).distinct()


def _line_paths(spark, sf_dir):
    return trees.leaf_to_root(_line_nodes(spark, sf_dir))


@query(f"with {NAMED} select tree, idx as owner, name, leaf as idx from up join nm using (tree, leaf) where name in ('O1', 'F2') and idx > 0")
def symbol_occurrences(spark, sf_dir):
    members = _line_paths(spark, sf_dir).select("tree", F.col("leaf").alias("idx"), F.explode("path").alias("owner")).where("owner > 0")
    nodes = _names(spark, sf_dir).select("tree", F.col("leaf").alias("idx"), F.lit("line").alias("kind"), "name")
    wanted = spark.createDataFrame([("line", "O1"), ("line", "F2")], "kind string, name string")
    return context.symbol_occurrences(members, nodes, wanted)


@query(f"with {NAMED} select tree, idx, array_to_string(list_sort(list(distinct name)), ',') as names from up join nm using (tree, leaf) group by 1, 2")
def names_below(spark, sf_dir):
    found = context.names_below(_line_paths(spark, sf_dir), _names(spark, sf_dir))
    return found.select("tree", "idx", F.array_join("names", ",").alias("names"))


@query(f"with {NAMED} select tree, name, count(distinct idx) as n from up join nm using (tree, leaf) where idx > 0 and idx <> leaf group by 1, 2 having count(distinct idx) > 1")
def shared_members(spark, sf_dir):
    members = _line_paths(spark, sf_dir).select("tree", "leaf", F.get("path", F.lit(1)).alias("owner")).join(_names(spark, sf_dir), ["tree", "leaf"])
    return context.in_several(members, "owner", "tree", "name")


@query("""with s as (select user_id, list(event_type order by event_id) as k from events group by 1)
  select user_id, k[len(k)] = 'purchase' and len(list_filter(k, lambda x: x = 'purchase')) = 1 as last_only from s""")
def structure_limits(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(arrays.collected(F.col("event_type"), F.col("event_id")).alias("k"))
    return rows.select("user_id", context.only_last_is(F.col("k"), "purchase").alias("last_only"))


@query(f"""with {LINES}, fit as (select tree from p group by 1 having count(*) * (count(*) - 1) / 2 <= 10 and count(*) <= 5),
  pairs as (select a.tree, a.leaf as leaf_a, b.leaf as leaf_b from p a join p b on a.tree = b.tree and a.leaf < b.leaf where a.tree in (select tree from fit)),
  r as (select *, row_number() over (partition by tree order by md5(concat_ws('|', 'paths', tree, leaf_a, leaf_b)), leaf_a, leaf_b) as k from pairs)
  select tree, leaf_a, leaf_b from r where k <= 4""")
def path_caps_sample(spark, sf_dir):
    paths = context.within_caps(_line_paths(spark, sf_dir), "tree", 10, 5)
    pairs = trees.leaf_pairs(paths).select("tree", "leaf_a", "leaf_b")
    return context.sampled_paths(pairs, "tree", 4, "paths", "tree", "leaf_a", "leaf_b")


PLACED = LINES + """, nodes as (select distinct tree, leaf as idx, flag as parent from p union select distinct tree, flag, 0::bigint from p union select distinct tree, 0::bigint, null::bigint from p),
  w as (select tree, idx, case when parent is null or row_number() over (partition by tree, parent order by idx) > 4 then 'UNK' else (row_number() over (partition by tree, parent order by idx) - 1)::varchar end as w from nodes)"""


@query(f"""with {PLACED} select a.tree, a.leaf as leaf_a, b.leaf as leaf_b,
    case when a.flag = b.flag then concat_ws('>', wa.w, fa.w, wb.w) else concat_ws('>', wa.w, fa.w, 'UNK', fb.w, wb.w) end as places,
    case when a.flag = b.flag then 'UP>DOWN' else 'UP>UP>DOWN>DOWN' end as directions
  from p a join p b on a.tree = b.tree and a.leaf < b.leaf join w wa on wa.tree = a.tree and wa.idx = a.leaf join w wb on wb.tree = b.tree and wb.idx = b.leaf
  join w fa on fa.tree = a.tree and fa.idx = a.flag join w fb on fb.tree = b.tree and fb.idx = b.flag""")
def sub_tree_columns(spark, sf_dir):
    found = context.path_columns(trees.leaf_pairs(_line_paths(spark, sf_dir)), _line_nodes(spark, sf_dir))
    return found.select("tree", "leaf_a", "leaf_b", F.array_join("places", ">").alias("places"), F.array_join("directions", ">").alias("directions"))


@query(f"""with {LINES}, r as (select a.tree, a.leaf || '-' || b.leaf as k, case when a.flag = b.flag then a.flag::varchar else concat_ws('>', a.flag, 0, b.flag) end as v
    from p a join p b on a.tree = b.tree and a.leaf < b.leaf)
  select tree, string_agg(k || ':' || v, ',' order by k) as by_pair from r group by 1""")
def path_node_map(spark, sf_dir):
    found = context.node_map(trees.leaf_pairs(_line_paths(spark, sf_dir)))
    shown = F.transform(F.map_entries("by_pair"), lambda e: F.concat_ws(":", e["key"], F.array_join(e["value"].cast("array<string>"), ">")))
    return found.select("tree", F.array_join(F.array_sort(shown), ",").alias("by_pair"))


@query(f"""with {EMB}, s as (select a.label, a.vec_id, h, a.e[h * 16 + 1 : h * 16 + 16] as v, q.e[h * 16 + 1 : h * 16 + 16] as q from emb a join emb q on q.vec_id = a.label, range(4) t(h) where a.vec_id % 5 <> 0),
  z as (select *, list_sum(list_transform(range(1, 17), lambda i: v[i] * q[i])) / 4 as s from s),
  w as (select *, exp(s - max(s) over (partition by label, h)) as p from z), n as (select *, p / sum(p) over (partition by label, h) as w from w)
  select label as idx, (h * 16 + i)::int as dim, round(sum(w * v[i + 1]), 5) as x from n, range(16) u(i) group by 1, 2""")
def dense_attention(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    queries = emb.select(F.col("vec_id").alias("_l"), F.col("e").alias("q"))
    rows = emb.join(queries, F.col("label") == F.col("_l"))
    found = context.dense_attention(rows, "label", "e", "q", 4, F.col("vec_id") % 5 != 0)
    return found.select("idx", F.col("dim").cast("int").alias("dim"), F.round("x", 5).alias("x"))


@query("""with s as (select event_type, value, row_number() over (partition by user_id order by event_id) as r, count(*) over (partition by user_id) as c from events),
  o as (select event_type, value * n as v from s, (values (2), (3)) t(n), range(3) u(k) where k < n and r - k >= 1 and r - k + n - 1 <= c)
  select event_type as idx, round((1 + coalesce(avg(v), 0)) / 2, 5) as x from o group by 1""")
def ngram_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    found = [context.window_occurrences(events, "user_id", "event_id", n).select(F.col("event_type").alias("node"), F.array(F.col("value") * n).alias("value")) for n in (2, 3)]
    nodes = events.select(F.col("event_type").alias("idx")).distinct().withColumn("value", F.array(F.lit(1.0)))
    return context.folded(found, nodes, _mean).select("idx", _first("value", 5).alias("x"))


@query(f"""with {LINES}, o as (select tree, unnest([leaf, flag, 0::bigint]) as idx, generate_subscripts([1, 2, 3], 1) as place from p)
  select idx, round((1 + sum(place)) / 2, 5) as x from o group by 1""")
def path_fold(spark, sf_dir):
    paths = _line_paths(spark, sf_dir)
    value = F.transform("path", lambda _, i: F.array((i + 1).cast("double")))
    rows = scatter.path_occurrences(paths, F.col("path"), F.transform("path", lambda _: F.lit(True)), value)
    nodes = paths.select(F.explode("path").alias("idx")).distinct().withColumn("value", F.array(F.lit(1.0)))
    return context.folded([rows], nodes, _mean, "sum").select("idx", _first("value", 5).alias("x"))


@query("""select l_orderkey as tree, (1 + 100 * (case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end))::bigint as owner, round(avg(l_quantity), 5) as x
  from (select distinct l_orderkey, l_returnflag, l_linenumber, l_quantity from lineitem) group by 1, 2""")
def into_nodes(spark, sf_dir):
    flag = 1 + 100 * F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree"), (flag + F.col("l_linenumber")).alias("idx"), F.array("l_quantity").alias("value")).distinct()
    owners = _line_nodes(spark, sf_dir).where("parent > 0").select("tree", "idx", F.col("parent").alias("owner"))
    return context.into_nodes(lines, owners).select("idx.tree", "idx.owner", F.round("x", 5).alias("x"))


@query("select sum(len(embedding))::bigint as n_parameters from embeddings")
def parameter_count(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.sum(F.size("embedding")).alias("n_parameters"))


@query("""select l_orderkey, array_to_string(list(concat_ws(':', l_partkey % 7, l_linenumber, l_suppkey) order by l_partkey % 7, l_linenumber, l_suppkey), ',') as occurrences from lineitem group by 1""")
def occurrence_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 7).alias("s"), "l_linenumber", "l_suppkey")
    found = context.in_order(rows, "l_orderkey", "s", "l_linenumber", "l_suppkey")
    return found.select("l_orderkey", F.array_join(F.transform("occurrences", lambda o: F.concat_ws(":", o["symbol"], o["expr"], o["token"])), ",").alias("occurrences"))


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, l_tax * 10 as rate, l_discount * 10 as factor from lineitem), c as (select *, least(1, rate + (1 - rate) * (1 - factor)) as mean from r)
  select l_orderkey, l_linenumber, l_partkey, round(mean, 6) as mean, round(case when rate >= 1 then 0 else greatest(0.5 * sqrt((1 - mean) / (1 - rate)), 2.2e-16) end, 6) as spread from c""")
def rate_decay(spark, sf_dir):
    rate, factor = F.col("l_tax") * 10, F.col("l_discount") * 10
    mean, spread = context.closer_to_one(rate, factor), context.closer_spread(rate, F.lit(0.5), factor)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(mean, 6).alias("mean"), F.round(spread, 6).alias("spread"))


@query()
def range_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 1000).alias("seed"), (F.col("o_orderkey") % 6).alias("n"))
    return context.range_samples(rows, "o_orderkey", "seed", "n", 5, 15)


@query("""with o as (select *, row_number() over (order by o_orderkey) - 1 as rn from orders), k as (select *, o_orderstatus || o_custkey % 3 as key from o)
  select (rn // 16)::bigint as batch, array_to_string(list(o_custkey order by rn), ',') as stacked, array_to_string(list(o_orderstatus order by rn), ',') as strings,
    array_to_string(list_sort(list(distinct key)), ',') as keys, count(*)::int as n from k group by 1""")
def collate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows = batching.batched(orders, "o_orderkey")
    key = F.concat("o_orderstatus", (F.col("o_custkey") % 3).cast("string"))
    found = context.collated(rows.withColumn("m", F.create_map(key, F.lit(1))), "batch", "pos", ["o_custkey"], ["o_orderstatus"], ["m"])
    values = F.element_at(F.map_values("m"), 1)
    return found.select("batch", F.array_join(F.col("o_custkey").cast("array<string>"), ",").alias("stacked"), F.array_join("o_orderstatus", ",").alias("strings"), F.array_join(F.map_keys("m"), ",").alias("keys"), F.size(values).alias("n"))


@query("""with c as (select user_id, event_type, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from c)
  select user_id, string_agg(event_type, ',' order by k) as names from r where k <= 3 group by 1""")
def top_names(spark, sf_dir):
    found = context.top_names(table(spark, sf_dir, "events"), "user_id", "event_type", 3)
    return found.select("user_id", F.array_join("names", ",").alias("names"))


@query("""select * from (values ('doc_id', 'Numerical'), ('text', 'Categorical'), ('lang', 'Categorical'), ('source', 'Categorical'), ('n_chars', 'Numerical')) t(feature, kind)""")
def feature_catalogue(spark, sf_dir):
    return context.catalogue(table(spark, sf_dir, "documents")).select("feature", "kind")


@query(f"""with {EMB} select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(k.e[1], 0), 6) as of_kind, round(coalesce(v.e[1], 0), 6) as of_payload, round(coalesce(k.e[2], 0) + coalesce(v.e[2], 0), 6) as added
  from lineitem left join emb k on k.vec_id = l_linenumber left join emb v on v.vec_id = l_partkey % 700""")
def token_embedding(spark, sf_dir):
    side = _emb(spark, sf_dir).select(F.col("vec_id").alias("idx"), F.col("e").alias("value"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 700).alias("payload"))
    parts = {"l_linenumber": side, "payload": side}
    both = context.looked_up(lines, parts).withColumnRenamed("encoding", "c")
    both = context.looked_up(both, parts, "add")
    at = lambda c, i: F.round(F.get(c, F.lit(i)), 6)
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", at("c", 0).alias("of_kind"), at("c", 64).alias("of_payload"), at("encoding", 1).alias("added"))


@query(f"""with {EMB}, o as (select l_suppkey as symbol, sum(l_quantity) as q from lineitem group by 1)
  select s_suppkey as symbol, round(coalesce(e[1], 0), 6) as identifier, round(coalesce(q, 0), 4) as occurrences from supplier left join emb on vec_id = s_nationkey left join o on symbol = s_suppkey""")
def symbol_encodings(spark, sf_dir):
    symbols = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("identifier"))
    identifiers = _emb(spark, sf_dir).select(F.col("vec_id").alias("idx"), F.col("e").alias("value"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.array("l_quantity").alias("value"))
    found = context.symbol_encodings(symbols, identifiers, lines)
    return found.select("symbol", F.round(F.get("encoding", F.lit(0)), 6).alias("identifier"), F.round(F.get("encoding", F.lit(64)), 4).alias("occurrences"))
