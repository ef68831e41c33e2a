"""Betweenness of graphs of any size: Brandes' algorithm as joins, level by level, for batches of sources.

Nodes with the same neighbours have the same score and the same paths to all others, so they are worked on as one node that
counts as often as they are many (`merged`); nothing is lost by that. Pages that link to the same targets, or leaves of
one node, are such. A node of a class is two steps from the others of it, by each neighbour once, and no shortest path
from it leads through them.

Rows are (source, node). Forward, a level's rows meet the edges, and the numbers of shortest paths are summed up for the
nodes that are in neither of the last two levels (in an undirected graph a neighbour can be in no other earlier one).
Backward, from the last level on, every row hands its share to those of the level before that it was reached from. Each
level is a written table, read twice, so lineage is one round long and reads do not grow with the rounds. A batch has
about STATE_ROWS rows in all levels together, which bounds the disk; neither the graph nor its nodes are collected.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators.tables import written

#: Rows (source, node) of one batch of sources
STATE_ROWS = 500_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """(here, there) both ways, each pair of different nodes once."""
    pairs = edges.select(F.least("source", "target").alias("here"), F.greatest("source", "target").alias("there")).filter("here <> there").distinct()
    return pairs.unionByName(pairs.select(F.col("there").alias("here"), F.col("here").alias("there")))


def merged(walk: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(of, nodes, links): the class of every node (node, rep), the classes (node, w, degree) and the edges between them.

    rep is the least node of a class, w the number of its nodes, degree that of each of them. links has (here, there, w),
    w of `there`. Classes are found by the neighbours' number and two sums of 64-bit hashes of them.
    """
    h = lambda salt: F.sum(F.xxhash64("there", F.lit(salt)).cast("decimal(38,0)"))
    said = written(walk.groupBy(F.col("here").alias("node")).agg(F.count("*").alias("degree"), h("a").alias("a"), h("b").alias("b")), "neighbours")
    found = said.groupBy("degree", "a", "b").agg(F.min("node").alias("rep"), F.count("*").cast("double").alias("w"))
    of = written(said.join(found, ["degree", "a", "b"]).select("node", "rep"), "classes")
    nodes = written(found.select(F.col("rep").alias("node"), "w", F.col("degree").cast("double").alias("degree")), "nodes")
    links = walk.join(nodes.select(F.col("node").alias("here")), "here", "left_semi").join(nodes.select(F.col("node").alias("there"), "w"), "there").select("here", "there", "w")
    return of, nodes, written(links, "walk")


def _levels(walk: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Tables (source, times, twins, node, w, paths) of the nodes at distance 0, 1, 2, ... from each source.

    times is how many nodes a source stands for, twins the share that a path to one of its others gives to each neighbour,
    times their number.
    """
    start = sources.select(F.col("node").alias("source"), F.col("w").alias("times"), ((F.col("w") - 1) / F.col("degree")).alias("twins"), "node", F.lit(1.0).alias("w"), F.lit(1.0).alias("paths"))
    levels = [written(start, "level")]
    while True:
        here = levels[-1].select("source", "times", "twins", F.col("node").alias("here"), (F.col("paths") * F.col("w")).alias("paths"))
        reached = here.join(walk, "here").groupBy("source", "times", "twins", F.col("there").alias("node"), "w").agg(F.sum("paths").alias("paths"))
        known = levels[-1].select("source", "node")
        if len(levels) > 1:
            known = known.unionByName(levels[-2].select("source", "node"))
        level = written(reached.join(known, ["source", "node"], "left_anti"), "level")
        if level.isEmpty():
            return levels
        levels.append(level)


def dependencies(walk: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, share): the sum over the sources of a node's share in their shortest paths; several rows for a node.

    walk has (here, there, w) and sources (node, w, degree), as `merged` gives them.
    """
    levels = _levels(walk, sources)
    later = found = None
    for k in range(len(levels) - 1, 0, -1):
        own = F.col("twins") if k == 1 else F.lit(0.0)  # the source's twins are at the end of paths over its neighbours
        if later is None:
            shared = levels[k].withColumn("share", own)
        else:
            handed = later.select("source", F.col("node").alias("here"), ((1 + F.col("share")) * F.col("w") / F.col("paths")).alias("part"))
            to = handed.join(walk.select("here", "there"), "here").groupBy("source", F.col("there").alias("node")).agg(F.sum("part").alias("part"))
            shared = levels[k].join(to, ["source", "node"], "left").withColumn("share", F.col("paths") * F.coalesce("part", F.lit(0.0)) + own).drop("part")
        later = written(shared, "share")
        sums = later.groupBy("node").agg(F.sum(F.col("share") * F.col("times")).alias("share"))
        found = sums if found is None else found.unionByName(sums)
    return found if found is not None else sources.select("node", F.lit(0.0).alias("share")).limit(0)


def betweenness(edges: DataFrame, state_rows: int = STATE_ROWS) -> DataFrame:
    """(node, score): normalised betweenness of an undirected graph (source, target), over all sources."""
    return of_classes(*merged(written(undirected(edges), "walk")), state_rows)


def of_classes(of: DataFrame, nodes: DataFrame, links: DataFrame, state_rows: int = STATE_ROWS) -> DataFrame:
    """The betweenness of a graph that `merged` has made smaller."""
    n, rows = nodes.count(), nodes.agg(F.sum("w")).first()[0] or 0
    batches = max(1, math.ceil(n * n / state_rows))
    shares = [dependencies(links, nodes.filter(F.pmod(F.xxhash64("node"), F.lit(batches)) == b)) for b in range(batches)]
    scores = _scored(nodes, shares, int(rows), 1.0)
    return of.join(scores.withColumnRenamed("node", "rep"), "rep").select("node", "score")


def sampled(edges: DataFrame, error: float = 0.05, failure: float = 0.01, seed: int = 0, state_rows: int = STATE_ROWS) -> DataFrame:
    """(node, score) estimated from some sources: all nodes' scores are within `error`, but for a chance of `failure`.

    A source's share of a node, over n - 2, is between 0 and 1, so by Hoeffding's inequality and a union over the nodes
    ln(2n / failure) / (2 error^2) sources are enough, whatever the graph; with no more nodes than that, all are taken.
    The sources are those of the least hash.
    """
    walk = written(undirected(edges), "walk")
    nodes = written(walk.select(F.col("here").alias("node")).distinct(), "nodes")
    n = nodes.count()
    take = min(n, math.ceil(math.log(2 * max(n, 1) / failure) / (2 * error * error)))
    chosen = written(nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(take).select("node", F.lit(1.0).alias("w"), F.lit(1.0).alias("degree")), "sources")
    walk = walk.withColumn("w", F.lit(1.0))
    batches = max(1, math.ceil(n * take / state_rows))
    return _scored(nodes, [dependencies(walk, chosen.filter(F.pmod(F.xxhash64("node"), F.lit(batches)) == b)) for b in range(batches)], n, n / max(take, 1))


def _scored(nodes: DataFrame, shares: list[DataFrame], n: int, scale: float) -> DataFrame:
    every = shares[0]
    for more in shares[1:]:
        every = every.unionByName(more)
    sums = every.groupBy("node").agg(F.sum("share").alias("share"))
    pairs = max(1.0, (n - 1) * (n - 2))
    return nodes.join(sums, "node", "left").select("node", F.round(F.coalesce("share", F.lit(0.0)) * scale / pairs, 9).alias("score"))
