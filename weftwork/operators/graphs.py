"""Graphs of examples: edges, simple paths, coverage, n-grams of paths, walks with visit quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import arrays


def transitions(rows: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """key, src, dst, n: how often a state follows another within a key."""
    after = F.lead(state).over(Window.partitionBy(key).orderBy(*order))
    edges = rows.select(key, F.col(state).alias("src"), after.alias("dst")).where("dst is not null")
    return edges.groupBy(key, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def simple_paths(edges: DataFrame, source: Column, target: Column, key: str = "graph", longest: int = 80) -> DataFrame:
    """key and path of all paths without repeats from ``source`` to ``target``, of at most ``longest`` nodes.

    One equi-join on (key, src) per length; the search of a graph ends when none of its paths grows. Paths grow
    exponentially with dense graphs: limits on graphs come first.
    """
    link = edges.select(F.col(key).alias("_k"), F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    now = link.where(F.col("_s") == source).select(F.col("_k").alias(key)).distinct().withColumn("path", F.array(source))
    done = None
    for _ in range(longest - 1):
        last = F.element_at("path", -1)
        grown = now.where(last != target).join(link, (F.col(key) == F.col("_k")) & (last == F.col("_s")))
        grown = grown.where(~F.array_contains("path", F.col("_d"))).select(key, F.concat("path", F.array("_d")).alias("path"))
        grown = grown.persist()
        ended = grown.where(F.element_at("path", -1) == target)
        done = ended if done is None else done.union(ended)
        now = grown
        if grown.isEmpty():
            break
    return done


def uncovered(nodes: DataFrame, paths: DataFrame, key: str = "graph", node: str = "node") -> DataFrame:
    """The nodes (key, node) that no path of their graph visits."""
    on = paths.select(F.col(key).alias("_k"), F.explode("path").alias("_n")).distinct()
    return nodes.join(on, (F.col(key) == F.col("_k")) & (F.col(node) == F.col("_n")), "left_anti")


def isolated(nodes: DataFrame, edges: DataFrame, key: str = "graph", node: str = "node") -> DataFrame:
    """The nodes that are no end of any edge."""
    ends = edges.select(F.col(key).alias("_k"), F.explode(F.array("src", "dst")).alias("_n")).distinct()
    return nodes.join(ends, (F.col(key) == F.col("_k")) & (F.col(node) == F.col("_n")), "left_anti")


def path_ngrams(rows: DataFrame, key: str, sequence: Column, least: int = 2, most: int = 6) -> DataFrame:
    """key, kind ("exact" or "partial"), n, grams (distinct, sorted).

    A sequence of least..most items is an exact n-gram of its length; each of its windows of a smaller n within the
    bounds is a partial one, and so are the windows of longer sequences.
    """
    s = F.col("_s")
    size = F.size(s)
    cells = []
    for n in range(least, most + 1):
        cells.append(F.struct(F.lit("exact").alias("kind"), F.lit(n).alias("n"), F.when(size == n, F.array(s)).alias("grams")))
        cells.append(F.struct(F.lit("partial").alias("kind"), F.lit(n).alias("n"), F.when(size > n, arrays.ngrams(s, n)).alias("grams")))
    found = rows.select(key, sequence.alias("_s")).select(key, F.explode(F.array(*cells)).alias("c"))
    grams = found.where("c.grams is not null").select(key, "c.kind", "c.n", F.explode("c.grams").alias("gram")).distinct()
    return grams.groupBy(key, "kind", "n").agg(F.array_sort(F.collect_list("gram")).alias("grams"))


def selected_ngrams(grams: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """What a model reads: exact n-grams in the bounds, and partial ones of the largest n under n + 1."""
    exact = (F.col("kind") == "exact") & F.col("n").between(least, most)
    partial = (F.col("kind") == "partial") & (F.col("n") == most)
    return grams.where(exact | partial).select(key, F.when(exact, F.col("n")).otherwise(F.col("n") + 1).alias("n"), "grams")


def def_use(edges: DataFrame, definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """graph, src, dst, symbol, def_at, use_at: data-dependency edges (graph, src, dst, symbol) with all occurrences at both ends."""
    d = definitions.select("graph", F.col("node").alias("src"), "symbol", F.col("at").alias("def_at"))
    u = uses.select("graph", F.col("node").alias("dst"), "symbol", F.col("at").alias("use_at"))
    return edges.join(d, ["graph", "src", "symbol"]).join(u, ["graph", "dst", "symbol"]).select("graph", "src", "dst", "symbol", "def_at", "use_at")


class QuotaPaths:
    """A UDTF: paths from source to target in which a node of ``loops`` occurs twice at most, others once.

    Edges are tried in order of target and kind; the walk ends at ``most`` paths, which then all are dropped.
    """

    def eval(self, edges: list, loops: list, source: int, target: int, longest: int, most: int):
        after: dict = {}
        for s, d in sorted({(e[0], e[1]) for e in edges or []}):
            after.setdefault(s, []).append(d)
        quota = {n: 2 for n in loops or []}
        found, stack = [], [(source, (source,))]
        while stack and len(found) < most:
            node, path = stack.pop()
            if node == target:
                found.append(path)
                continue
            if len(path) == longest:
                continue
            for d in reversed(after.get(node, [])):
                if path.count(d) < quota.get(d, 1):
                    stack.append((d, (*path, d)))
        if len(found) < most:
            yield from ((list(p),) for p in sorted(found))


def quota_paths(graphs: DataFrame, key: str, longest: int = 80, most: int = 400) -> DataFrame:
    """key and path; ``graphs`` has key, edges (array of src and dst), loops (array), source, target. One graph is one row."""
    from pyspark.sql.functions import udtf

    spark = graphs.sparkSession
    spark.udtf.register("weftwork_quota_paths", udtf(QuotaPaths, returnType="path array<int>"))
    graphs.createOrReplaceTempView("weftwork_graphs")
    return spark.sql(f"select g.{key}, p.path from weftwork_graphs g, lateral weftwork_quota_paths(g.edges, g.loops, g.source, g.target, {longest}, {most}) p")
