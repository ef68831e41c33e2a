"""Searches over edge tables: neighbours, shortest paths, components, betweenness, layout.

Breadth-first search and relaxation are rounds of equi-joins; each round is a written table, so lineage stays short and
a lost executor costs at most one round. A round joins the frontier, not the whole distance table, with the edges.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators import centrality
from lorespark.operators.graph import degree, internal, weight
from lorespark.operators.tables import written

MAX_DEPTH = 5
MAX_BETWEENNESS_EDGES = 200_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end: here, there, edge_type, weight."""
    w = weight(F.col("edge_type"))
    there = edges.select(F.col("source").alias("here"), F.col("target").alias("there"), "edge_type", w.alias("weight"))
    return there.unionByName(edges.select(F.col("target").alias("here"), F.col("source").alias("there"), "edge_type", w.alias("weight")))


def neighbours(edges: DataFrame, center: str, depth: int, relation: str | None = None) -> DataFrame:
    """(node, level, edge_type, direction) up to `depth` hops (1 to 5) from center.

    A node is reached once, by the first edge in the order (frontier's rank, source, target, type, outgoing first).
    Edges of other types are walked too and use up the node; only matching ones are returned.
    """
    spark = edges.sparkSession
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("node"), "edge_type", F.lit("outgoing").alias("direction"), F.struct("source", "target", "edge_type", F.lit(0).alias("way")).alias("ord"))
    into = edges.select(F.col("target").alias("here"), F.col("source").alias("node"), "edge_type", F.lit("incoming").alias("direction"), F.struct("source", "target", "edge_type", F.lit(1).alias("way")).alias("ord"))
    walk = out.unionByName(into)
    empty = F.expr("named_struct('source', '', 'target', '', 'edge_type', '', 'way', 0)")
    seen = written(spark.range(1).select(F.lit(center).alias("node"), F.lit(0).alias("level"), F.lit("").alias("edge_type"), F.lit("").alias("direction"), F.array(empty).alias("rank")), "seen")
    frontier = seen
    for level in range(1, min(max(depth, 1), MAX_DEPTH) + 1):
        step = frontier.select(F.col("node").alias("here"), "rank").join(walk, "here").join(seen.select("node"), "node", "left_anti")
        first = F.min_by(F.struct("edge_type", "direction", F.concat("rank", F.array("ord")).alias("rank")), F.struct("rank", "ord"))
        fresh = step.groupBy("node").agg(first.alias("x")).select("node", F.lit(level).alias("level"), "x.edge_type", "x.direction", "x.rank")
        frontier = written(fresh, "frontier")
        if frontier.isEmpty():
            break
        seen = written(seen.unionByName(frontier), "seen")
    found = seen.filter("level > 0")
    found = found if relation is None else found.filter(F.col("edge_type") == relation)
    return found.select("node", "level", "edge_type", "direction")


def _relaxed(edges: DataFrame, source: str, target: str | None, keep_path: bool) -> DataFrame:
    """(node, dist, prev, edge_type, edge_cost[, path]) by rounds of relaxation until no node gets nearer.

    A round writes the nodes that got nearer, and only those; what is known of a node is the least of its rows in all
    rounds, looked up for the nodes that have an offer. Weights are positive, so the rounds end by themselves.
    """
    spark = edges.sparkSession
    walk = written(both_ways(internal(edges)).groupBy("here", "there").agg(F.min_by("edge_type", F.struct("weight", "edge_type")).alias("edge_type"), F.min("weight").alias("weight")), "walk")
    none = lambda kind: F.lit(None).cast(kind)
    hop = "array<struct<node: string, edge_type: string, edge_cost: double>>"
    path = F.expr(f"cast(array() as {hop})") if keep_path else none(hop)
    start = spark.range(1).select(F.lit(source).alias("node"), F.lit(0.0).alias("dist"), none("string").alias("prev"), none("string").alias("edge_type"), none("double").alias("edge_cost"), path.alias("path"))
    every = frontier = written(start, "dist")
    while True:
        step = frontier.select(F.col("node").alias("here"), "dist", "path").join(walk, "here")
        longer = F.concat("path", F.array(F.struct(F.col("here").alias("node"), "edge_type", F.col("weight").alias("edge_cost")))).alias("path")
        reach = F.struct((F.col("dist") + F.col("weight")).alias("dist"), F.col("here").alias("prev"), "edge_type", F.col("weight").alias("edge_cost"))
        offers = written(step.groupBy(F.col("there").alias("node")).agg(F.min_by(F.struct(reach.alias("x"), longer), reach).alias("y")).select("node", "y.x.*", "y.path"), "offers")
        old = every.select("node", "dist").join(offers.select("node"), "node", "left_semi").groupBy("node").agg(F.min("dist").alias("known"))
        better = offers.join(old, "node", "left").filter("known is null or dist < known").drop("known")
        if target is not None:
            limit = every.filter(F.col("node") == target).agg(F.min("dist").alias("limit"))  # one row
            better = better.join(F.broadcast(limit)).filter("limit is null or dist <= limit").drop("limit")
        frontier = written(better, "better")
        if frontier.isEmpty():
            return every.groupBy("node").agg(F.min_by(F.struct("dist", "prev", "edge_type", "edge_cost", "path"), F.struct("dist", "prev")).alias("x")).select("node", "x.*")
        every = every.unionByName(frontier)


def distances(edges: DataFrame, source: str, target: str | None = None) -> DataFrame:
    """(node, dist, prev, edge_type, edge_cost): least weights from source over internal edges, in both directions.

    With a target, nodes farther than its best distance so far are not expanded. Ties go to the lesser previous node.
    """
    return _relaxed(edges, source, target, keep_path=False).drop("path")


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(step, node, edge_type, edge_cost, total_cost): the path's nodes in order; each step has the edge that leaves it.

    No rows if there is none. Nodes carry their path along while they are relaxed, so it needs no walk back.
    """
    spark = edges.sparkSession
    schema = "step long, node string, edge_type string, edge_cost double, total_cost double"
    if source == target:
        return spark.createDataFrame([(0, source, None, None, 0.0)], schema)
    at = _relaxed(edges, source, target, keep_path=True).filter(F.col("node") == target)
    last = F.struct(F.col("node"), F.lit(None).cast("string").alias("edge_type"), F.lit(None).cast("double").alias("edge_cost"))
    steps = at.select(F.posexplode(F.concat("path", F.array(last))).alias("step", "x"), F.col("dist").alias("total_cost"))
    return steps.select(F.col("step").cast("long").alias("step"), "x.node", "x.edge_type", "x.edge_cost", "total_cost")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of every node's connected component.

    Large stars and small stars in turn: every node hands its larger neighbours, and then its smaller ones, to the least
    node it knows. Edges stay as many as nodes at most after the first round, a giant component is spread over its nodes
    while it shrinks to a star, and the rounds follow the logarithm of the longest chain.
    """
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    e = written(edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).filter("u > v").distinct(), "links")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
        e = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = written(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    return nodes.join(e, nodes.node == e.u, "left").select("node", F.coalesce("v", "node").alias("component"))


def component_counts(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, clusters (components of more than one node), isolated nodes."""
    sizes = components(edges).groupBy("component").agg(F.count("*").alias("n"))
    a = sizes.agg(F.sum("n").alias("nodes"), F.count_if(F.col("n") > 1).alias("clusters"), F.count_if(F.col("n") == 1).alias("isolated"))
    return a.join(edges.agg(F.count("*").alias("edges"))).select("nodes", "edges", "clusters", "isolated")


def betweenness(edges: DataFrame, parts: int = 64) -> DataFrame:
    """(node, score): normalised betweenness of an undirected graph.

    Brandes' algorithm, on classes of nodes with the same neighbours (see centrality). If they have at most
    MAX_BETWEENNESS_EDGES edges, which is checked, every task gets the whole adjacency and some of the sources; a larger
    graph is worked on by joins, level by level.
    """
    of, nodes, links = centrality.merged(written(centrality.undirected(edges), "walk"))
    pairs = links.filter("here < there").select("here", "there")
    if pairs.limit(MAX_BETWEENNESS_EDGES + 1).count() > MAX_BETWEENNESS_EDGES:
        return centrality.of_classes(of, nodes, links)
    spark = edges.sparkSession
    near: dict[str, list[str]] = defaultdict(list)
    for a, b in pairs.collect():
        near[a].append(b)
        near[b].append(a)
    names = sorted(near)
    index = {n: i for i, n in enumerate(names)}
    times = {r.node: (r.w, r.degree) for r in nodes.collect()}  # two for each edge at most
    adjacency = spark.sparkContext.broadcast(([[index[x] for x in near[n]] for n in names], [times[n] for n in names]))
    size = len(names)

    def brandes(frames):
        score = np.zeros(size)
        links, many = adjacency.value
        for frame in frames:
            for s in frame["id"]:
                order, before, paths, far = [], [[] for _ in range(size)], np.zeros(size), np.full(size, -1)
                paths[s], far[s] = 1, 0
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    each = paths[v] * (many[v][0] if v != s else 1)
                    for w in links[v]:
                        if far[w] < 0:
                            far[w] = far[v] + 1
                            queue.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] += each
                            before[w].append(v)
                share = np.zeros(size)
                share[links[s]] = (many[s][0] - 1) / many[s][1]  # the source's twins, reached over each neighbour
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w]) * many[w][0]
                    if w != s:
                        score[w] += share[w] * many[s][0]
        yield pd.DataFrame({"i": np.arange(size, dtype=np.int64), "score": score})

    sums = spark.range(0, size, 1, max(1, min(parts, size))).mapInPandas(brandes, "i long, score double").groupBy("i").agg(F.sum("score").alias("score"))
    known = spark.createDataFrame(list(enumerate(names)), "i long, rep string")
    n = sum(w for w, _ in times.values())
    scores = known.join(sums, "i").select("rep", F.round(F.col("score") / max(1.0, (n - 1) * (n - 2)), 9).alias("score"))
    return of.join(scores, "rep").select("node", "score")


def bridges(edges: DataFrame, k: int = 5, least: float = 0.01) -> DataFrame:
    return betweenness(edges).filter(F.col("score") > least).orderBy(F.desc("score"), "node").limit(k)


def articulation(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """Nodes of degree 2 or more and high betweenness: an approximation of articulation points."""
    return betweenness(edges).filter(F.col("score") > least).join(degree(edges).filter("degree >= 2"), "node").select("node", "score", "degree")


#: Nodes and edges of a graph whose layout is made on the driver; rounds in which a larger one's nodes find their places
LAYOUT_NODES, LAYOUT_EDGES, LAYOUT_REFINED = 50_000, 1_000_000, 6
_LENGTH, _PULL, _REPULSION, _GRAIN = 100.0, 0.45, 8000.0, 1000


def layout(edges: DataFrame, rounds: int = 200, seed: int = 7) -> DataFrame:
    """(node, x, y): a force-directed layout of a graph of any size, the same for the same graph.

    A graph of at most LAYOUT_NODES nodes and LAYOUT_EDGES edges, which is checked, is laid out on the driver. A larger
    one is made smaller until it is such a graph: every node goes with its neighbour of the highest degree. Its nodes
    are then spread about the places of those they went with, and moved by springs and by the repulsion of the centres
    of grid cells, in joins; no step holds the nodes or a group of them in one place.
    """
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).filter("node is not null").distinct()
    links = edges.select("source", "target").distinct()
    if nodes.limit(LAYOUT_NODES + 1).count() > LAYOUT_NODES or links.limit(LAYOUT_EDGES + 1).count() > LAYOUT_EDGES:
        at = _laid_out(written(links, "links"), rounds)
        least = at.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))  # one row
        return at.join(F.broadcast(least)).select("node", ((F.col("x") - F.col("x0")) / _GRAIN + 50).alias("x"), ((F.col("y") - F.col("y0")) / _GRAIN + 50).alias("y"))
    spark = edges.sparkSession
    names = sorted(r.node for r in nodes.collect())
    index = {n: i for i, n in enumerate(names)}
    ends = np.array(sorted((index[r.source], index[r.target]) for r in links.collect()), np.int64).reshape(-1, 2)
    xy = force_layout(len(names), ends, rounds)
    return spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in zip(names, xy, strict=True)], "node string, x double, y double")


def _coarser(links: DataFrame) -> DataFrame:
    """(node, component): each node with the one of the highest degree that its best neighbours lead to; lone nodes in groups by hash."""
    both = centrality.undirected(links)
    degrees = both.groupBy(F.col("here").alias("node")).agg(F.count("*").alias("n"))
    best = both.join(degrees, F.col("there") == F.col("node")).groupBy("here").agg(F.max(F.struct("n", "there")).alias("to"))
    up = best.join(degrees.select(F.col("node").alias("here"), F.col("n").alias("own")), "here").filter(F.col("to") > F.struct(F.col("own").alias("n"), F.col("here").alias("there")))
    moved = components(written(up.select(F.col("here").alias("source"), F.col("to.there").alias("target")), "up"))
    nodes = links.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    group = F.pmod(F.xxhash64("node"), F.lit(max(1, LAYOUT_NODES // 2)))
    alone = nodes.join(degrees, "node", "left_anti").withColumn("group", group)
    alone = alone.join(alone.groupBy("group").agg(F.min("node").alias("component")), "group").select("node", "component")
    linked = degrees.join(moved, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return written(linked.unionByName(alone), "coarser")


def _laid_out(links: DataFrame, rounds: int) -> DataFrame:
    """(node, x, y), places in whole thousandths, so that sums do not depend on the order of rows."""
    of = _coarser(links)
    end = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    small = written(links.join(end("source"), "source").join(end("target"), "target").select(F.col("source_of").alias("source"), F.col("target_of").alias("target")).distinct(), "small")
    sizes = of.groupBy("component").agg(F.count("*").alias("n"))
    wide = sizes.agg(F.greatest(F.lit(1.0), F.sqrt(F.avg("n"))).alias("wide"))  # one row: room for the members
    angle, out = (F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 20)) / (1 << 20) for k in ("angle", "out"))
    far = F.sqrt(F.col("n") - 1) * F.sqrt(out) * (_LENGTH / 2)
    start = of.join(layout(small, rounds).withColumnRenamed("node", "component"), "component").join(sizes, "component").join(F.broadcast(wide))
    whole = lambda c: F.round(c * _GRAIN).cast("long")
    at = written(start.select("node", whole(F.col("x") * F.col("wide") + far * F.cos(angle * 2 * np.pi)).alias("x"), whole(F.col("y") * F.col("wide") + far * F.sin(angle * 2 * np.pi)).alias("y")), "places")
    both = written(centrality.undirected(links), "walk")
    cell = [F.floor(F.col(c) / (_GRAIN * 2 * np.sqrt(_REPULSION))).alias(f"c{c}") for c in ("x", "y")]
    for _ in range(LAYOUT_REFINED):
        there = at.select(F.col("node").alias("there"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        pairs = both.join(there, "there").join(at.withColumnRenamed("node", "here"), "here")
        d = F.sqrt((F.col("tx") - F.col("x")) ** 2 + (F.col("ty") - F.col("y")) ** 2) + 1e-6
        spring = (d - _LENGTH * _GRAIN) / d * _PULL
        pulled = pairs.groupBy(F.col("here").alias("node")).agg(*[F.sum(F.round(spring * (F.col(f"t{c}") - F.col(c))).cast("long")).alias(f"p{c}") for c in ("x", "y")], F.count("*").alias("near"))
        placed = at.select("node", "x", "y", *cell)
        cells = placed.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
        j = placed.join(cells, ["cx", "cy"]).join(pulled, "node", "left")
        away = {c: (F.col(c) - F.col(f"s{c}") / F.col("n")) / _GRAIN for c in ("x", "y")}
        apart = F.sqrt(away["x"] ** 2 + away["y"] ** 2) + 1.0
        push = F.least(F.lit(_LENGTH / 4), _REPULSION * (F.col("n") - 1) / apart**2) / apart
        # a node with many neighbours moves by their mean, so that it does not leap over them
        at = written(j.select("node", *[(F.col(c) + whole(F.coalesce(F.col(f"p{c}") / F.col("near"), F.lit(0.0)) / _GRAIN + push * away[c])).alias(c) for c in ("x", "y")]), "places")
    return at


def force_layout(n: int, ends: np.ndarray, rounds: int, repulsion: float = 8000.0, length: float = 100.0, pull: float = 0.45, gravity: float = 0.1, heat: float = 200.0, cooling: float = 0.95) -> np.ndarray:
    """Positions after rounds of repulsion within grid cells, springs along edges and gravity, with falling steps."""
    if n == 0:
        return np.zeros((0, 2))
    angle = 2 * np.pi * np.arange(n) / n
    radius = max(length, length * n / (2 * np.pi) / 4)
    xy = np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1)
    cell = np.sqrt(4 * repulsion)
    for _ in range(rounds):
        force = -gravity * xy
        grid = np.floor(xy / cell).astype(np.int64)
        order = np.lexsort((grid[:, 1], grid[:, 0]))
        for at in np.split(order, np.flatnonzero(np.any(np.diff(grid[order], axis=0) != 0, axis=1)) + 1):
            for part in np.array_split(at, max(1, len(at) // 500)):  # large cells in blocks, against bounded memory
                d = xy[part][:, None] - xy[part][None]
                far = (d**2).sum(-1) + 1e-3
                force[part] += (d * (repulsion / far / np.sqrt(far))[..., None]).sum(1)
        d = xy[ends[:, 1]] - xy[ends[:, 0]]
        far = np.sqrt((d**2).sum(1)) + 1e-6
        f = d * (pull * (far - length) / far)[:, None]
        np.add.at(force, ends[:, 0], f)
        np.add.at(force, ends[:, 1], -f)
        size = np.sqrt((force**2).sum(1)) + 1e-9
        move = force * (np.minimum(size, heat) / size)[:, None]
        xy = xy + move
        heat = max(1.0, heat * cooling)
        if np.abs(move).max() < 0.5:
            break
    return xy - xy.min(0) + 50
