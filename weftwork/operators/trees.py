"""Trees whose nodes are numbered in pre-order: (tree, idx, parent) rows; paths, ancestors, siblings, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.arrays import collected


def leaf_to_root(nodes: DataFrame, tree: str = "tree", idx: str = "idx", parent: str = "parent", depth: int = 100) -> DataFrame:
    """tree, leaf, path (leaf first, root last) of every leaf; one join per level, as many levels as the trees have.

    Levels end when no path grows; deeper trees than ``depth`` are an error rather than cut paths.
    """
    link = nodes.select(F.col(tree).alias("t"), F.col(idx).alias("i"), F.col(parent).alias("p"))
    inner = link.where("p is not null").select(F.col("t").alias("t2"), F.col("p").alias("i2")).distinct()
    leaves = link.join(inner, (F.col("t") == F.col("t2")) & (F.col("i") == F.col("i2")), "left_anti")
    paths = leaves.select(F.col("t").alias("tree"), F.col("i").alias("leaf"), F.array("i").alias("path"), F.col("p").alias("next"))
    found = [paths.where("next is null").drop("next")]
    open_ = paths.where("next is not null")
    for _ in range(depth):
        if open_.isEmpty():
            break
        step = open_.join(link, (F.col("tree") == F.col("t")) & (F.col("next") == F.col("i")))
        step = step.select("tree", "leaf", F.concat("path", F.array("i")).alias("path"), F.col("p").alias("next")).persist()
        found.append(step.where("next is null").drop("next"))
        open_ = step.where("next is not null")
    else:
        raise ValueError(f"a tree is deeper than {depth}")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def leaf_pairs(paths: DataFrame) -> DataFrame:
    """tree, leaf_a, leaf_b (a < b), lca and path (up from a, over the lca, down to b) of all pairs of a tree's leaves.

    Pairs meet by an equi-join on the tree; limits and samples on leaves come before it.
    """
    a = paths.select("tree", F.col("leaf").alias("leaf_a"), F.col("path").alias("up"))
    b = paths.select("tree", F.col("leaf").alias("leaf_b"), F.col("path").alias("down"))
    both = a.join(b, "tree").where("leaf_a < leaf_b")
    up = F.filter("up", lambda x: ~F.array_contains("down", x))
    down = F.filter("down", lambda x: ~F.array_contains("up", x))
    lca = F.get("up", F.size(up))
    return both.select("tree", "leaf_a", "leaf_b", lca.alias("lca"), F.concat(up, F.array(lca), F.reverse(down)).alias("path"))


def siblings(nodes: DataFrame, tree: str = "tree", idx: str = "idx", parent: str = "parent") -> DataFrame:
    """tree, parent, children (by idx) of the parents of more than one child."""
    rows = nodes.where(F.col(parent).isNotNull()).groupBy(F.col(tree).alias("tree"), F.col(parent).alias("parent"))
    return rows.agg(F.array_sort(F.collect_list(idx)).alias("children")).where(F.size("children") > 1)


def child_places(nodes: DataFrame, tree: str = "tree", idx: str = "idx", parent: str = "parent", most: int = 5) -> DataFrame:
    """tree, idx and the node's place among its siblings from the left (+1 ..) and from the right (-1 ..), as words.

    Places beyond ``most`` are +MORE and -MORE, roots +ROOT and -ROOT.
    """
    own = Window.partitionBy(tree, parent)
    left = F.row_number().over(own.orderBy(idx))
    right = F.count(F.lit(1)).over(own) - left + 1

    def word(sign: str, place: Column) -> Column:
        near = F.when(place > most, F.lit(f"{sign}MORE")).otherwise(F.concat(F.lit(sign), place.cast("string")))
        return F.when(F.col(parent).isNull(), F.lit(f"{sign}ROOT")).otherwise(near)

    return nodes.select(F.col(tree).alias("tree"), F.col(idx).alias("idx"), word("+", left).alias("from_left"), word("-", right).alias("from_right"))


def subtree_ends(paths: DataFrame) -> DataFrame:
    """tree, idx, last: a node's subtree is the range idx .. last, as numbers are in pre-order."""
    rows = paths.select("tree", "leaf", F.explode("path").alias("idx"))
    return rows.groupBy("tree", "idx").agg(F.max("leaf").alias("last"))


def masked_subtree(nodes: DataFrame, idx: Column, kind: Column, first: Column, last: Column, mask: str, pad: str = "<PAD>") -> DataFrame:
    """``nodes`` with ``shown``: the root of the range becomes ``mask``, what is below it ``pad``; a range test, no recursion."""
    inside = F.when(idx == first, F.lit(mask)).when((idx > first) & (idx <= last), F.lit(pad)).otherwise(kind)
    return nodes.withColumn("shown", inside)


def trimmed(nodes: DataFrame, roots: DataFrame, tree: str = "tree", idx: str = "idx") -> DataFrame:
    """``nodes`` without what lies below ``roots`` (tree, first, last): the upper tree with the roots as leaves."""
    below = roots.select(F.col("tree").alias("_t"), F.explode(F.when(F.col("last") > F.col("first"), F.sequence(F.col("first") + 1, F.col("last")))).alias("_i"))
    return nodes.join(below, (F.col(tree) == F.col("_t")) & (F.col(idx) == F.col("_i")), "left_anti")


def nodes_of_subtrees(nodes: DataFrame, roots: DataFrame, tree: str = "tree", idx: str = "idx") -> DataFrame:
    """owner and idx of the nodes in each of ``roots`` (tree, owner, first, last): ranges become rows, then an equi-join."""
    cells = roots.select(F.col("tree").alias("_t"), "owner", F.explode(F.sequence("first", "last")).alias("_i"))
    return cells.join(nodes, (F.col("_t") == F.col(tree)) & (F.col("_i") == F.col(idx))).select(F.col("_t").alias("tree"), "owner", F.col("_i").alias("idx"))


def child_edges(nodes: DataFrame, members: DataFrame, tree: str = "tree", idx: str = "idx", parent: str = "parent") -> DataFrame:
    """tree, src, dst: parent to child, where both are among ``members`` (tree, idx)."""
    edges = nodes.where(F.col(parent).isNotNull()).select(F.col(tree).alias("tree"), F.col(parent).alias("src"), F.col(idx).alias("dst"))
    for end in ("src", "dst"):
        edges = edges.join(members.select("tree", F.col("idx").alias(end)), ["tree", end], "left_semi")
    return edges.select("tree", "src", "dst")


def typed_leaves(nodes: DataFrame, tree: str, idx: str, kind: str, value: str) -> DataFrame:
    """tree, kind, positions, values: leaves of each kind by idx, in one aggregation."""
    order = F.col(idx)
    return nodes.groupBy(F.col(tree).alias("tree"), F.col(kind).alias("kind")).agg(
        collected(F.col(idx), order).alias("positions"), collected(F.col(value), order).alias("values")
    )


def printed(nodes: DataFrame, paths_depth: Column, label: Column, tree: str, idx: str) -> DataFrame:
    """tree and text: a line per node, indented by its depth."""
    line = F.concat(F.repeat(F.lit("  "), paths_depth), label)
    return nodes.groupBy(F.col(tree).alias("tree")).agg(F.array_join(collected(line, F.col(idx)), "\n").alias("text"))


def mean_up(nodes: DataFrame, value: str, levels: int, tree: str = "tree", idx: str = "idx", parent: str = "parent") -> DataFrame:
    """tree, idx, state: child-sum recurrence state = value + mean of the children's states, from the deepest level up.

    ``levels``: the depth of the deepest node; nodes carry ``depth``.
    """
    done = None
    for depth in range(levels, -1, -1):
        rows = nodes.where(F.col("depth") == depth).select(F.col(tree).alias("tree"), F.col(idx).alias("idx"), F.col(parent).alias("parent"), F.col(value).alias("value"))
        if done is not None:
            below = done.where(F.col("depth") == depth + 1).groupBy("tree", "parent").agg(F.avg("state").alias("of_children"))
            below = below.select(F.col("tree").alias("_t"), F.col("parent").alias("_p"), "of_children")
            rows = rows.join(below, (F.col("tree") == F.col("_t")) & (F.col("idx") == F.col("_p")), "left").drop("_t", "_p")
        else:
            rows = rows.withColumn("of_children", F.lit(None).cast("double"))
        rows = rows.select("tree", "idx", "parent", F.lit(depth).alias("depth"), (F.col("value") + F.coalesce("of_children", F.lit(0.0))).alias("state"))
        done = rows if done is None else done.union(rows)
    return done.select("tree", "idx", "state")


class DomPaths:
    """A UDTF: leaf, depth and path of tags of the text leaves of an HTML page."""

    def eval(self, html: str):
        from html.parser import HTMLParser

        void = {"meta", "link", "br", "img", "hr", "input"}
        found, stack = [], []

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag not in void:
                    stack.append(tag)

            def handle_endtag(self, tag):
                if tag in stack:
                    while stack.pop() != tag:
                        pass

            def handle_data(self, data):
                if data.strip():
                    found.append((len(found), len(stack), "/".join(stack)))

        Reader().feed(html or "")
        yield from found


def dom_paths(pages: DataFrame) -> DataFrame:
    """page_id, leaf, depth, path of the text leaves of ``pages`` (page_id, html); the parser has no relational form."""
    from pyspark.sql.functions import udtf

    spark = pages.sparkSession
    spark.udtf.register("weftwork_dom_paths", udtf(DomPaths, returnType="leaf int, depth int, path string"))
    pages.createOrReplaceTempView("weftwork_pages")
    return spark.sql("select p.page_id, d.leaf, d.depth, d.path from weftwork_pages p, lateral weftwork_dom_paths(p.html) d")
