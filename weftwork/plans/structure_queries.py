"""Queries over trees, graphs, batches, scatter and gather, metrics and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.functions import arrays, vectors
from weftwork.operators import batching, graphs, metrics, scatter, trees, viewer
from weftwork.plans.tables import table

Q, O = {}, {}  # noqa: E741


def query(sql=None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


# A hierarchy in pre-order: one tree for each region, nations below it, customers below these.
NODES = """cust as (select c_custkey, n_nationkey, n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey, c_custkey) as c_rank
    from nation left join customer on c_nationkey = n_nationkey),
  nat as (select n_nationkey, n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) as n_rank,
    coalesce(sum(cnt) over (partition by n_regionkey order by n_nationkey rows between unbounded preceding and 1 preceding), 0) as before
    from (select n_nationkey, n_regionkey, count(c_custkey) as cnt from nation left join customer on c_nationkey = n_nationkey group by 1, 2)),
  nodes as (select r_regionkey as tree, 0::bigint as idx, null::bigint as parent, 'region' as kind, 0 as depth from region
    union all select n_regionkey, (n_rank + before)::bigint, 0, 'nation', 1 from nat
    union all select c.n_regionkey, (n_rank + c_rank)::bigint, (n_rank + before)::bigint, 'customer', 2 from cust c join nat using (n_nationkey) where c_custkey is not null)"""


def _nodes(spark, sf_dir):
    for name in ("region", "nation", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"ww_{name}")
    sql = NODES.replace("::bigint", "").replace("from nation", "from ww_nation").replace("join customer", "join ww_customer").replace("from region", "from ww_region")
    rows = spark.sql(f"with {sql} select tree, cast(idx as bigint) as idx, cast(parent as bigint) as parent, kind, depth from nodes")
    return rows


PATHS = NODES + """, inner_nodes as (select distinct tree, parent as idx from nodes where parent is not null),
  leaves as (select n.* from nodes n anti join inner_nodes i on n.tree = i.tree and n.idx = i.idx),
  paths as (select l.tree, l.idx as leaf, case when l.parent is null then [l.idx] when p.parent is null then [l.idx, l.parent] else [l.idx, l.parent, p.parent] end as path
    from leaves l left join nodes p on p.tree = l.tree and p.idx = l.parent)"""


@query(f"with {PATHS} select tree, leaf, array_to_string(path, '>') as path from paths")
def tree_leaf_to_root(spark, sf_dir):
    return trees.leaf_to_root(_nodes(spark, sf_dir)).select("tree", "leaf", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


LINES = """f as (select distinct l_orderkey as tree, 1 + 100 * (case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end)::bigint as flag, l_linenumber from lineitem),
  p as (select tree, flag, flag + l_linenumber::bigint as leaf from f)"""


def _line_nodes(spark, sf_dir):
    """A tree for each order, in pre-order: the order is 0, return flags stand below it, their lines below them."""
    flag = 1 + 100 * F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree"), flag.alias("flag"), "l_linenumber").distinct()
    leaves = lines.select("tree", (F.col("flag") + F.col("l_linenumber")).cast("long").alias("idx"), F.col("flag").alias("parent"))
    flags = lines.select("tree", F.col("flag").alias("idx"), F.lit(0).cast("long").alias("parent")).distinct()
    return leaves.union(flags).union(lines.select("tree", F.lit(0).cast("long"), F.lit(None).cast("long")).distinct())


@query(f"""with {LINES} select a.tree, a.leaf as leaf_a, b.leaf as leaf_b, case when a.flag = b.flag then a.flag else 0 end as lca,
    case when a.flag = b.flag then concat_ws('>', a.leaf, a.flag, b.leaf) else concat_ws('>', a.leaf, a.flag, 0, b.flag, b.leaf) end as path
  from p a join p b on a.tree = b.tree and a.leaf < b.leaf""")
def leaf_pairs_lca(spark, sf_dir):
    paths = trees.leaf_to_root(_line_nodes(spark, sf_dir))
    return trees.leaf_pairs(paths).select("tree", "leaf_a", "leaf_b", "lca", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"with {NODES} select tree, parent, list_sum(c)::bigint as sum_children, len(c)::int as n from (select tree, parent, list(idx order by idx) as c from nodes where parent is not null group by 1, 2) where len(c) > 1")
def siblings(spark, sf_dir):
    rows = trees.siblings(_nodes(spark, sf_dir))
    return rows.select("tree", "parent", F.aggregate("children", F.lit(0).cast("long"), lambda a, b: a + b).alias("sum_children"), F.size("children").alias("n"))


@query(f"""with {NODES}, r as (select tree, idx, parent, row_number() over (partition by tree, parent order by idx) as a, row_number() over (partition by tree, parent order by idx desc) as b from nodes)
  select tree, idx, case when parent is null then '+ROOT' when a > 5 then '+MORE' else '+' || a end as from_left, case when parent is null then '-ROOT' when b > 5 then '-MORE' else '-' || b end as from_right from r""")
def child_positions(spark, sf_dir):
    return trees.child_places(_nodes(spark, sf_dir))


ENDS = PATHS + ", ends as (select tree, idx, max(leaf) as last from (select tree, leaf, unnest(path) as idx from paths) group by 1, 2)"


@query(f"with {ENDS} select tree, idx, last from ends")
def subtree_range(spark, sf_dir):
    return trees.subtree_ends(trees.leaf_to_root(_nodes(spark, sf_dir)))


@query(f"""with {ENDS}, second as (select tree, min(idx) as first from nodes where depth = 1 group by 1),
  r as (select tree, first, last from second join ends using (tree) where ends.idx = first)
  select tree, shown, count(*) as n from (select n.tree, case when idx = first then '<MASK>' when idx > first and idx <= last then '<PAD>' else kind end as shown from nodes n join r using (tree)) group by 1, 2""")
def sub_tree_mask(spark, sf_dir):
    nodes, ends = _roots(spark, sf_dir)
    rows = trees.masked_subtree(nodes.join(F.broadcast(ends), "tree"), F.col("idx"), F.col("kind"), F.col("first"), F.col("last"), "<MASK>")
    return rows.groupBy("tree", "shown").agg(F.count(F.lit(1)).alias("n"))


def _roots(spark, sf_dir):
    """Nodes, and of each tree the range of the first node of depth 1: one row per tree."""
    nodes = _nodes(spark, sf_dir)
    first = nodes.where("depth = 1").groupBy("tree").agg(F.min("idx").alias("first"))
    ends = trees.subtree_ends(trees.leaf_to_root(nodes)).withColumnRenamed("idx", "first")
    return nodes, first.join(ends, ["tree", "first"])


@query(f"""with {ENDS}, second as (select tree, min(idx) as first from nodes where depth = 1 group by 1),
  r as (select tree, first, last from second join ends using (tree) where ends.idx = first)
  select n.tree, n.idx, n.kind from nodes n join r using (tree) where not (n.idx > first and n.idx <= last)""")
def trimmed_tree(spark, sf_dir):
    nodes, ends = _roots(spark, sf_dir)
    return trees.trimmed(nodes, ends).select("tree", "idx", "kind")


@query(f"""with {ENDS}, r as (select tree, idx as owner, last from ends where idx in (select idx from nodes n where n.tree = ends.tree and depth = 1))
  select r.tree, owner, count(*) as n, max(n.idx) as most from r join nodes n on n.tree = r.tree and n.idx between owner and last group by 1, 2""")
def sub_tree_members(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    ends = trees.subtree_ends(trees.leaf_to_root(nodes))
    roots = nodes.where("depth = 1").join(ends, ["tree", "idx"]).select("tree", F.col("idx").alias("owner"), F.col("idx").alias("first"), "last")
    return trees.nodes_of_subtrees(nodes, roots).groupBy("tree", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("most"))


@query(f"with {NODES} select tree, kind, list_sum(list(idx))::bigint as sum_positions, count(*)::int as n from nodes group by 1, 2")
def typed_leaves(spark, sf_dir):
    rows = trees.typed_leaves(_nodes(spark, sf_dir), "tree", "idx", "kind", "depth")
    return rows.select("tree", "kind", F.aggregate("positions", F.lit(0).cast("long"), lambda a, b: a + b).alias("sum_positions"), F.size("values").alias("n"))


@query(f"with {NODES} select p.tree, p.idx as src, c.idx as dst from nodes c join nodes p on c.tree = p.tree and c.parent = p.idx where c.idx % 2 = 0 and p.idx % 2 = 0")
def child_edges(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return trees.child_edges(nodes, nodes.where("idx % 2 = 0"))


@query(f"""with {NODES}, s2 as (select tree, idx, parent, idx * 1.0 as state from nodes where depth = 2),
  s1 as (select n.tree, n.idx, n.parent, n.idx + coalesce(avg(s.state), 0) as state from nodes n left join s2 s on s.tree = n.tree and s.parent = n.idx where depth = 1 group by 1, 2, 3),
  s0 as (select n.tree, n.idx, n.parent, n.idx + coalesce(avg(s.state), 0) as state from nodes n left join s1 s on s.tree = n.tree and s.parent = n.idx where depth = 0 group by 1, 2, 3)
  select tree, idx, round(state, 6) as state from (select * from s0 union all select * from s1 union all select * from s2)""")
def tree_recurrence(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).withColumn("value", F.col("idx").cast("double"))
    return trees.mean_up(nodes, "value", levels=2).select("tree", "idx", F.round("state", 6).alias("state"))


@query(f"with {NODES} select tree, md5(string_agg(repeat('  ', depth) || kind || ' ' || idx, chr(10) order by idx)) as text_md5 from nodes group by 1")
def tree_print(spark, sf_dir):
    label = F.concat_ws(" ", "kind", F.col("idx").cast("string"))
    return trees.printed(_nodes(spark, sf_dir), F.col("depth"), label, "tree", "idx").select("tree", F.md5("text").alias("text_md5"))


@query()
def dom_paths(spark, sf_dir):
    return trees.dom_paths(table(spark, sf_dir, "pages").select("page_id", "html"))


EDGES = "edges as (select user_id, src, dst, count(*) as n from (select user_id, event_type as src, lead(event_type) over (partition by user_id order by event_id) as dst from events) where dst is not null group by 1, 2, 3)"


def _edges(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return graphs.transitions(rows, "user_id", ["event_id"], "event_type")


@query(f"with {EDGES} select user_id, src, dst, n from edges")
def transition_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


SIMPLE = EDGES + """, p as (select distinct user_id, 'signup' as cur, ['signup'] as path from edges where src = 'signup'
  union all select p.user_id, e.dst, p.path || [e.dst] from p join edges e on e.user_id = p.user_id and e.src = p.cur where p.cur <> 'purchase' and not list_contains(p.path, e.dst))"""


@query(f"with recursive {SIMPLE} select user_id, array_to_string(path, '>') as path from p where cur = 'purchase'")
def simple_paths(spark, sf_dir):
    paths = graphs.simple_paths(_edges(spark, sf_dir), F.lit("signup"), F.lit("purchase"), key="user_id")
    return paths.select("user_id", F.array_join("path", ">").alias("path"))


@query(f"""with recursive {SIMPLE}, few as (select * from p where cur = 'purchase' and len(path) <= 3), ends as (select user_id, src as node from edges union select user_id, dst from edges)
  select user_id, node from ends anti join (select distinct user_id, unnest(path) as node from few) c using (user_id, node)""")
def path_coverage(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    paths = graphs.simple_paths(edges, F.lit("signup"), F.lit("purchase"), key="user_id", longest=3)
    nodes = edges.select("user_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graphs.uncovered(nodes, paths, key="user_id").select("user_id", "node")


@query()
def loop_quota_paths(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    number = F.create_map(*[x for i, n in enumerate(("signup", "view", "click", "error", "purchase")) for x in (F.lit(n), F.lit(i))])
    pairs = F.collect_set(F.struct(number[F.col("src")].alias("src"), number[F.col("dst")].alias("dst")))
    rows = edges.groupBy("user_id").agg(pairs.alias("edges"))
    rows = rows.select("user_id", "edges", F.array(F.lit(1)).alias("loops"), F.lit(0).alias("source"), F.lit(4).alias("target"))
    return graphs.quota_paths(rows, "user_id")


@query("""with e as (select l_orderkey as graph, l_linenumber as src, l_linenumber + 1 as dst, l_partkey % 3 as symbol from lineitem),
  o as (select l_orderkey as graph, l_linenumber as node, l_partkey % 3 as symbol, l_suppkey as at from lineitem)
  select e.graph, e.src, e.dst, e.symbol, d.at as def_at, u.at as use_at from e join o d on d.graph = e.graph and d.node = e.src and d.symbol = e.symbol join o u on u.graph = e.graph and u.node = e.dst and u.symbol = e.symbol""")
def def_use_edges(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("node"), (F.col("l_partkey") % 3).alias("symbol"), F.col("l_suppkey").alias("at"))
    edges = item.select("graph", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"), "symbol")
    return graphs.def_use(edges, item, item)


BATCH = "b as (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 16 as batch, (row_number() over (order by o_orderkey) - 1) % 16 as pos from orders)"
SIZED = BATCH + ", s as (select b.*, coalesce(n, 0) as n from b left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey), o as (select *, coalesce(sum(n) over (partition by batch order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as off from s)"


def _batched(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = batching.batched(orders.join(counts, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0))), "o_orderkey")
    return batching.offsets(rows, F.col("n"))


@query(f"with {SIZED} select o_orderkey, batch::bigint as batch, pos::bigint as pos, n, off from o")
def batch_offsets(spark, sf_dir):
    return _batched(spark, sf_dir).withColumnRenamed("offset", "off")


ITEM = "item as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as local, l_quantity from lineitem)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1").cast("long").alias("local"), "l_quantity"
    )


@query(f"with {SIZED}, {ITEM} select l_orderkey, local, case when local >= 1 then local + off else local end as global_idx from item join o on l_orderkey = o_orderkey")
def rebase_index(spark, sf_dir):
    rows = _items(spark, sf_dir).join(_batched(spark, sf_dir).select("o_orderkey", "offset"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "local", batching.rebased(F.col("local"), F.col("offset"), start=1).alias("global_idx"))


@query(f"""with {SIZED}, {ITEM}, l as (select batch, l_orderkey, list(l_quantity order by local) as v from item join o on l_orderkey = o_orderkey group by 1, 2), w as (select *, max(len(v)) over (partition by batch) as width from l)
  select batch::bigint as batch, l_orderkey, len(v)::int as length, width::int as width, round(list_sum(v), 4) as total from w""")
def unflatten(spark, sf_dir):
    rows = batching.unflattened(_placed(spark, sf_dir), "batch", "l_orderkey", F.col("local"), F.col("l_quantity"), F.lit(0.0))
    return rows.select("batch", "l_orderkey", "length", F.size("values").alias("width"), F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


def _placed(spark, sf_dir):
    return _items(spark, sf_dir).join(_batched(spark, sf_dir).select("o_orderkey", "batch"), F.col("l_orderkey") == F.col("o_orderkey"))


@query(f"with {ITEM} select l_orderkey, local::int as item, l_quantity as value from item join orders on o_orderkey = l_orderkey")
def flatten_roundtrip(spark, sf_dir):
    rows = batching.unflattened(_placed(spark, sf_dir), "batch", "l_orderkey", F.col("local"), F.col("l_quantity"), F.lit(-1.0))
    return batching.flattened(rows).select("l_orderkey", "item", "value")


@query("select l_orderkey, min(l_linenumber) as first, max(l_linenumber) as last, count(*) as n from lineitem group by 1")
def group_boundaries(spark, sf_dir):
    return batching.group_bounds(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"""with {ITEM}, l as (select l_orderkey, list(l_quantity order by local) as v from item group by 1)
  select l_orderkey, array_to_string(list_transform(range(1, 6), lambda i: coalesce(v[i], -1)::int), ' ') as padded, array_to_string(list_transform(range(1, 6), lambda i: i <= len(v)), ' ') as mask from l""")
def pad_truncate_mask(spark, sf_dir):
    rows = _items(spark, sf_dir).groupBy("l_orderkey").agg(arrays.collected(F.col("l_quantity").cast("int"), F.col("local")).alias("v"))
    padded = arrays.pad_truncate(F.col("v"), 5, F.lit(-1))
    return rows.select("l_orderkey", F.array_join(padded.cast("array<string>"), " ").alias("padded"), F.array_join(arrays.length_mask(F.size("v"), 5).cast("array<string>"), " ").alias("mask"))


PERM = ITEM + ", perm as (select *, row_number() over (partition by l_orderkey order by md5('p|' || l_orderkey || '|' || local), local) - 1 as place from item)"


@query(f"with {PERM} select l_orderkey, array_to_string(list(place order by local), ' ') as places, array_to_string(list(local order by place), ' ') as inverse from perm group by 1")
def perm_inverse(spark, sf_dir):
    rows = batching.permutation(_items(spark, sf_dir), "l_orderkey", "local", "p")
    rows = rows.groupBy("l_orderkey").agg(arrays.collected(F.col("place").cast("int"), F.col("local")).alias("p"))
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return rows.select("l_orderkey", text(F.col("p")).alias("places"), text(arrays.inverse_permutation(F.col("p"))).alias("inverse"))


@query(f"with {ITEM} select l_orderkey, array_to_string(list(l_quantity::int order by local), ' ') as back from item group by 1")
def shuffle_roundtrip(spark, sf_dir):
    rows = batching.permutation(_items(spark, sf_dir), "l_orderkey", "local", "p").groupBy("l_orderkey")
    rows = rows.agg(arrays.collected(F.col("l_quantity").cast("int"), F.col("local")).alias("v"), arrays.collected(F.col("place").cast("int"), F.col("local")).alias("p"))
    back = arrays.permuted(arrays.permuted(F.col("v"), F.col("p")), arrays.inverse_permutation(F.col("p")))
    return rows.select("l_orderkey", F.array_join(back.cast("array<string>"), " ").alias("back"))


@query()
def fragmented_shuffle(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return batching.fragmented_order(sizes, "l_orderkey", "n", "f", 2, 4)


@query()
def numpy_sample(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return batching.numpy_samples(sizes, "l_orderkey", "n", 3, "s")


EMB = "emb as (select vec_id, label, embedding::double[] as e from embeddings)"


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def _rounded(parts, places=6):
    return parts.select("idx", F.col("dim").cast("int").alias("dim"), F.round("x", places).alias("x"))


@query(f"with {EMB} select l_orderkey, l_linenumber, l_partkey, round(e[1], 6) as first from lineitem left join emb on vec_id = l_partkey % 700")
def gather_join(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 700).alias("i"))
    rows = scatter.gathered(refs, "i", _emb(spark, sf_dir), "vec_id", "e")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.get("encoding", F.lit(0)), 6).alias("first"))


@query(f"""with {EMB}, r as (select l_orderkey, l_linenumber, l_partkey, l_orderkey % 7 as ex, l_partkey % 30 as i, l_quantity > 5 as m from lineitem),
  own as (select vec_id % 7 as ex, vec_id // 7 as idx, e from emb)
  select l_orderkey, l_linenumber, l_partkey, round(case when not m then -1 when i < 10 then c.e[1] else o.e[1] end, 6) as first
  from r left join emb c on c.vec_id = i and i < 10 left join own o on o.ex = r.ex and o.idx + 10 = i""")
def gather_common(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    common = emb.where("vec_id < 10").select(F.col("vec_id").alias("idx"), F.col("e").alias("value"))
    own = emb.select((F.col("vec_id") % 7).alias("example"), F.floor(F.col("vec_id") / 7).alias("idx"), F.col("e").alias("value"))
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_orderkey") % 7).alias("ex"), (F.col("l_partkey") % 30).alias("i"))
    rows = scatter.gathered_common(refs, "i", "ex", common, own, 10, F.col("l_quantity") > 5, F.array(F.lit(-1.0)))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.get("encoding", F.lit(0)), 6).alias("first"))


@query(f"with {EMB} select vec_id, round(case when vec_id % 3 = 0 then e[1] * 2 else e[1] end, 6) as overwritten, round(case when vec_id % 3 = 0 then e[1] * 3 else e[1] end, 6) as added from emb")
def scatter_update(spark, sf_dir):
    emb = _emb(spark, sf_dir).select("vec_id", "e")
    new = emb.where("vec_id % 3 = 0").select("vec_id", vectors.scaled(F.col("e"), F.lit(2.0)).alias("e"))
    over = scatter.scatter_updated(emb, new, "vec_id", "e").select("vec_id", F.round(F.get("e", F.lit(0)), 6).alias("overwritten"))
    plus = scatter.scatter_updated(emb, new, "vec_id", "e", add=True).select("vec_id", F.round(F.get("e", F.lit(0)), 6).alias("added"))
    return over.join(plus, "vec_id")


@query("""with m as (select user_id, event_id, event_type = 'click' as m from events), r as (select *, sum(m::int) over (partition by user_id order by event_id) as rk from m),
  d as (select user_id, row_number() over (partition by user_id order by event_id) as rk, value from events where event_type = 'view')
  select r.user_id, event_id, coalesce(d.value, 0) as value from r left join d on m and d.user_id = r.user_id and d.rk = r.rk""")
def masked_scatter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    dense = events.where("event_type = 'view'").selectExpr("user_id", "row_number() over (partition by user_id order by event_id) as rank", "value")
    rows = scatter.masked_scatter(events.drop("value"), "user_id", "event_id", F.col("event_type") == "click", dense, F.lit(0.0))
    return rows.select("user_id", "event_id", "value")


LONG = EMB + ", long as (select vec_id, label, unnest(e) as x, generate_subscripts(e, 1) - 1 as dim from emb)"


@query(f"with {LONG} select i as idx, d::int as dim, round(coalesce(sum(x), 0), 6) as x from range(12) t(i), range(64) u(d) left join long on label = i and dim = d group by 1, 2")
def scatter_sum(spark, sf_dir):
    return _rounded(scatter.scattered(_emb(spark, sf_dir), "label", "e", "sum", size=12))


@query(f"with {LONG} select label as idx, dim::int as dim, round(avg(x), 6) as x from long group by 1, 2")
def scatter_mean(spark, sf_dir):
    return _rounded(scatter.scattered(_emb(spark, sf_dir), "label", "e", "mean"))


def _attention_sql(q):
    return f"""with {LONG}, s as (select vec_id, label, list_sum(list_transform(list_zip(e, {q}), lambda p: p[1] * p[2])) / sqrt(64) as s from emb),
      m as (select label, max(s) as m from s group by 1), t as (select label, sum(exp(s - m)) as t from s join m using (label) group by 1)
      select label as idx, dim::int as dim, round(sum(x * exp(s - m) / t), 6) as x from long join s using (vec_id, label) join m using (label) join t using (label) group by 1, 2"""


@query(_attention_sql("list_transform(range(64), lambda i: ((i % 5) - 2)::double)"))
def general_attention(spark, sf_dir):
    ask = F.array(*[F.lit(float(i % 5 - 2)) for i in range(64)])
    return _rounded(scatter.attention(_emb(spark, sf_dir), "label", "e", ask))


@query(_attention_sql("list_transform(range(64), lambda i: ((i + label) % 3)::double)"))
def segment_softmax_attention(spark, sf_dir):
    ask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i + F.col("label")) % 3).cast("double"))
    return _rounded(scatter.attention(_emb(spark, sf_dir), "label", "e", ask))


@query("""with c as (select user_id, list(value order by event_id) as v from events group by 1)
  select user_id, round(v[len(v)], 6) as last, round(v[1] + v[len(v)], 6) as ends, round(list_avg(v), 6) as mean, round(list_sum(v), 6) as total from c""")
def seq_combine(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(arrays.collected(F.array("value"), F.col("event_id")).alias("v"))
    one = lambda how: F.round(F.get(scatter.combined(F.col("v"), how), F.lit(0)), 6)
    return rows.select("user_id", one("last").alias("last"), one("ends").alias("ends"), one("mean").alias("mean"), one("sum").alias("total"))


@query("""with s as (select user_id, list(event_type order by event_id) as t, (count(*) + 1) // 2 as k from events group by 1), h as (select user_id, t[:k] as a, t[k + 1:] as b from s)
  select user_id, array_to_string(flatten(list_transform(range(1, len(b) + 1), lambda i: [a[i], b[i]])) || a[len(b) + 1:], ' ') as woven, array_to_string(a, ' ') as first, array_to_string(b, ' ') as second from h""")
def weave_unweave(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(arrays.collected(F.col("event_type"), F.col("event_id")).alias("t"))
    half = F.ceil(F.size("t") / 2).cast("int")
    rows = rows.select("user_id", arrays.woven(F.slice("t", 1, half), F.slice("t", half + 1, F.size("t"))).alias("w"))
    return rows.select("user_id", F.array_join("w", " ").alias("woven"), F.array_join(arrays.every_other(F.col("w"), 0), " ").alias("first"), F.array_join(arrays.every_other(F.col("w"), 1), " ").alias("second"))


@query("""with n as (select n_nationkey as node, n_nationkey * 1.0 as value from nation), e as (select distinct c_nationkey as src, s_nationkey as dst from customer, orders, lineitem, supplier where o_custkey = c_custkey and l_orderkey = o_orderkey and s_suppkey = l_suppkey),
  m as (select dst, avg(value) as m from e join n on node = src group by 1) select node, round(case when m is null then value else (value + m) / 2 end, 6) as value from n left join m on dst = node""")
def message_pass_1(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_nationkey").cast("double").alias("value"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = edges.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = edges.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()
    return scatter.message_pass(nodes, edges).select("node", F.round("value", 6).alias("value"))


SETS = """t as (select l_orderkey, list_distinct(list(l_suppkey % 8)) as truth, list_distinct(list(l_partkey % 8)) as found from lineitem group by 1),
  o as (select l_orderkey, len(list_intersect(truth, found)) as tp, len(found) - len(list_intersect(truth, found)) as fp, len(truth) - len(list_intersect(truth, found)) as fn,
    (list_sort(truth) = list_sort(found))::int as same, len(truth) as n_truth from t)"""


def _outcomes(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    rows = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 8)).alias("truth"), F.array_sort(F.collect_set(F.col("l_partkey") % 8)).alias("found"))
    return rows.select("l_orderkey", *metrics.set_outcomes(F.col("truth"), F.col("found")))


def _set_metrics_sql(by):
    head = f"{by}, " if by else ""
    return f"""with {SETS}, s as (select {head} count(*) as n, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(same) as same from o {'group by ' + by if by else ''}),
      r as (select *, tp / (tp + fp + 1.1920929e-07) as p, tp / (tp + fn + 1.1920929e-07) as q from s)
      select {head.replace('n_truth', 'n_truth::int as n_truth')} n, tp, fp, fn, round(p, 6) as "precision", round(q, 6) as recall, round(2 * p * q / (p + q + 1.1920929e-07), 6) as f1, round(same / n, 6) as accuracy_any from r"""


def _measured(rows, by):
    found = metrics.set_metrics(rows, by)
    return found.select(*by, "n", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy_any")])


@query(_set_metrics_sql(""))
def set_metrics(spark, sf_dir):
    return _measured(_outcomes(spark, sf_dir), [])


@query(_set_metrics_sql("n_truth"))
def metrics_by_gt_count(spark, sf_dir):
    return _measured(_outcomes(spark, sf_dir), ["n_truth"])


@query(f"with {SETS} select tp::int as value, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 4) as percent from o group by 1")
def tp_distribution(spark, sf_dir):
    return metrics.distribution(_outcomes(spark, sf_dir), "tp")


@query("""with s as (select l_orderkey, list(l_partkey % 6 order by l_linenumber, l_partkey, l_suppkey) as ids from lineitem group by 1)
  select l_orderkey, array_to_string(list_transform(list_filter(ids, lambda x: x >= 3), lambda x: x - 3), ' ') as items, list_position(ids, list_max(ids)) - 1 as top from s""")
def predicted_items(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    rows = item.groupBy("l_orderkey").agg(arrays.collected(F.col("l_partkey") % 6, F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("ids"))
    return rows.select("l_orderkey", F.array_join(metrics.predicted_items(F.col("ids")).cast("array<string>"), " ").alias("items"), arrays.argmax(F.col("ids")).alias("top"))


@query(f"""with {EMB}, s as (select vec_id, e[:8] as a, e[9:16] as b from emb),
  n as (select vec_id, -( (a[1 + vec_id % 8] - list_max(a) - ln(list_sum(list_transform(a, lambda x: exp(x - list_max(a)))))) + (b[1 + vec_id % 3] - list_max(b) - ln(list_sum(list_transform(b, lambda x: exp(x - list_max(b)))))) ) / 2 as loss from s)
  select vec_id, round(loss, 6) as loss from n""")
def nll_loss(spark, sf_dir):
    rows = _emb(spark, sf_dir)
    steps = F.array(vectors.log_softmax(F.slice("e", 1, 8)), vectors.log_softmax(F.slice("e", 9, 8)))
    targets = F.array(F.lit(1), (F.col("vec_id") % 8).cast("int"), (F.col("vec_id") % 3).cast("int"))
    return rows.select("vec_id", F.round(metrics.nll(steps, targets), 6).alias("loss"))


@query("select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) as loss from lineitem group by 1")
def weighted_loss(spark, sf_dir):
    return metrics.weighted_loss(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"]).select("l_returnflag", F.round("loss", 8).alias("loss"))


@query("select user_id, event_id, round(avg(value) over (partition by user_id order by event_id rows between 49 preceding and current row) + 1e-9::double, 6) as avg50 from events")
def moving_avg_50(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(metrics.moving_average("user_id", "event_id", "value") + 1e-9, 6).alias("avg50"))


@query("""with w as (select user_id, event_id, list(value) over (partition by user_id order by event_id rows between 49 preceding and current row) as v from events),
  m as (select *, list_median(v) as med from w), k as (select user_id, event_id, list_sort(list_transform(v, lambda x: struct_pack(d := abs(x - med), x := x)))[:len(v) - len(v) * 3 // 50] as k from m)
  select user_id, event_id, round(list_avg(list_transform(k, lambda p: p.x)) + 1e-9::double, 5) as avg_kept from k""".replace("list_median(v)", "list_aggregate(v, 'median')"))
def moving_avg_wo_outliers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(metrics.moving_average_without_outliers("user_id", "event_id", "value") + 1e-9, 5).alias("avg_kept"))


@query("select user_id, event_id, round(avg(value) over (partition by user_id order by event_id rows unbounded preceding) + 1e-9::double, 6) as mean from events")
def running_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(metrics.running_mean("user_id", "event_id", "value") + 1e-9, 6).alias("mean"))


@query("""with s as (select user_id, list(value order by event_id) as v from events group by 1) select user_id, round(list_reduce(v, lambda a, x: a * 0.8::double + x * 0.2::double), 6) as ema from s""")
def ema(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(arrays.collected(F.col("value"), F.col("event_id")).alias("v"))
    return rows.select("user_id", F.round(metrics.ema(F.col("v")), 6).alias("ema"))


@query("select event_id from events where event_type not in ('error', 'view') and value >= 10 and value < 200 and user_id in (1, 2, 3, 5, 8, 13)")
def typed_filter(spark, sf_dir):
    test = viewer.all_of([("Categorical", "event_type", "NotIn", ["error", "view"]), ("Numerical", "value", "GreaterEqual", 10), ("Numerical", "value", "LowerThan", 200), ("Numerical", "user_id", "In", [1, 2, 3, 5, 8, 13])])
    return table(spark, sf_dir, "events").where(test).select("event_id")


@query("""select l_orderkey, bool_or(l_quantity > 45) as any_large, bool_and(l_discount <= 0.08) as all_small from lineitem group by 1""")
def quantifier_exists_forall(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_discount")).alias("s"))
    return rows.select("l_orderkey", viewer.quantified(F.col("s"), "Exists", lambda s: s["l_quantity"] > 45).alias("any_large"), viewer.quantified(F.col("s"), "ForAll", lambda s: s["l_discount"] <= 0.08).alias("all_small"))


@query("""select event_type, count(value) as n, round(avg(value), 5) as avg, max(value) as max, min(value) as min, round(median(value), 5) as median, round(stddev_samp(value), 5) as stddev,
  round(quantile_cont(value, 0.25), 5) as p25, round(quantile_cont(value, 0.75), 5) as p75, round(quantile_cont(value, 0.9), 5) as p90 from events group by 1""")
def numeric_stats(spark, sf_dir):
    found = viewer.numeric_stats(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_type", "n", "max", "min", *[F.round(c, 5).alias(c) for c in ("avg", "median", "stddev", "p25", "p75", "p90")])


@query("select 'lang' as feature, lang as value, count(*) as n from documents group by 2 union all select 'source', source, count(*) from documents group by 2")
def categorical_stats(spark, sf_dir):
    return viewer.categorical_stats(table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source")


@query("""select 'large' as feature, count(*) filter (l_quantity > 25) as n_true, count(*) filter (not l_quantity > 25) as n_false from lineitem
  union all select 'open', count(*) filter (l_linestatus = 'O'), count(*) filter (l_linestatus <> 'O') from lineitem""")
def boolean_stats(spark, sf_dir):
    return viewer.boolean_stats(table(spark, sf_dir, "lineitem"), large=F.col("l_quantity") > 25, open=F.col("l_linestatus") == "O")


@query("select case when quality = 1 then case when toxic = 0 then 'TP' else 'FN' end else case when toxic = 0 then 'FP' else 'TN' end end as outcome, count(*) as n from labels group by 1")
def confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(viewer.confusion(F.col("quality") == 1, F.col("toxic") == 0).alias("outcome"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as total, count(*) filter (o_totalprice > 100000) as filtered from orders")
def filtered_counts(spark, sf_dir):
    return viewer.filtered_counts(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 100000)
