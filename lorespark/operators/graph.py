"""Graph operators on edge tables (source, target, edge_type) and entity tables: build, filters, degree, statistics.

Everything is joins and hash aggregates on node ids. The OR-join of files and entities is a union of two equi-joins,
and the prioritised lookup of a relation's end is an equi-join on candidate names followed by min_by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark import constants as K
from lorespark.functions import paths

EXTERNAL = "external:"


def is_external(c: str) -> Column:
    return F.startswith(F.col(c), F.lit(EXTERNAL))


def internal(edges: DataFrame) -> DataFrame:
    """edges without those that touch an external node."""
    return edges.filter(~is_external("source") & ~is_external("target"))


def weight(edge_type: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in K.EDGE_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, edge_type), F.lit(K.EDGE_WEIGHT_DEFAULT))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): how often a node is an end of an edge; a loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def nodes_of_degree(edges: DataFrame, least: int) -> DataFrame:
    """Nodes of a degree, 1 at least: isolated nodes never stay."""
    return degree(edges).filter(F.col("degree") >= max(least, 1))


def edges_between_degree(edges: DataFrame, least: int) -> DataFrame:
    """Edges both of whose ends have a degree."""
    d = degree(edges)
    j = edges.join(d.select(F.col("node").alias("source"), F.col("degree").alias("d1")), "source", "left").join(d.select(F.col("node").alias("target"), F.col("degree").alias("d2")), "target", "left")
    return j.filter((F.coalesce("d1", F.lit(0)) >= least) & (F.coalesce("d2", F.lit(0)) >= least)).select("source", "target", "edge_type")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among nodes (node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns)


def edge_display(edges: DataFrame) -> DataFrame:
    """Short id and label of every edge. The id is for display and not unique."""
    short = lambda c, n: F.left(F.col(c), F.lit(n))
    return edges.select("source", "target", "edge_type", F.concat_ws("-", F.lit("e"), short("source", 8), short("target", 8), short("edge_type", 4)).alias("id"), F.replace("edge_type", F.lit("_"), F.lit(" ")).alias("label"))


def visible(edges: DataFrame, shown: dict[str, bool]) -> DataFrame:
    """Edges whose type is switched on; types without a switch are always shown."""
    off = [k for k, on in shown.items() if not on]
    return edges.filter(~F.col("edge_type").isin(*off)) if off else edges


def by_relation(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def stats(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: nodes, edges and entities in all."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().agg(F.count("*").alias("total_nodes"))
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    return nodes.join(one(edges, "total_edges")).join(one(entities, "total_entities"))


def entity_language(path: Column) -> Column:
    ext = paths.extension(path)
    return F.when(ext == "py", "python").when(ext.isin("ts", "tsx"), "typescript").when(ext.isin("js", "jsx"), "javascript").when(ext == "rs", "rust").when(ext == "go", "go").otherwise("other")


def by_language(entities: DataFrame) -> DataFrame:
    return entities.groupBy(entity_language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))


def top_connected(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of the largest degree; ties go to the lesser id."""
    return degree(edges).orderBy(F.desc("degree"), "node").limit(k)


def valid_entities(raw: DataFrame) -> DataFrame:
    """Entities with a file and a type; a missing name is the last part of the key."""
    return raw.dropna(subset=["file_path", "entity_type"]).withColumn("name", F.coalesce("name", F.element_at(F.split("entity_key", "::"), -1)))


def file_entities(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(node_id, entity_key, ...) where an entity's file is the document's path or name: two equi-joins, united."""
    e = entities.withColumnRenamed("file_path", "of")
    cols = ["node_id", "file_path", "file_name", *[c for c in e.columns if c != "of"]]
    d = docs.select("node_id", "file_path", "file_name")
    by_path = d.join(e, F.col("file_path") == F.col("of")).select(*cols)
    by_name = d.filter("file_name <> file_path").join(e, F.col("file_name") == F.col("of")).select(*cols)
    return by_path.unionByName(by_name)


def child_counts(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(node_id, function_count, class_count, total_children) of every code document."""
    code = docs.filter(paths.is_code(F.col("file_name")) == "code")
    n = file_entities(code, entities).groupBy("node_id").agg(F.count_if(F.col("entity_type") == "function").alias("f"), F.count_if(F.col("entity_type") == "class").alias("c"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return code.select("node_id").join(n, "node_id", "left").select("node_id", z(F.col("f")).alias("function_count"), z(F.col("c")).alias("class_count"), (z(F.col("f")) + z(F.col("c"))).alias("total_children"))


def module_children(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(node_id, entity_key, name, entity_type): the functions and classes of every document."""
    return file_entities(docs, entities).filter(F.col("entity_type").isin("function", "class")).select("node_id", "entity_key", "name", "entity_type")


def method_edges(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(node_id, source, target): from a document's methods to their classes, where the class is among its children."""
    kids = module_children(docs, entities).filter("entity_type = 'class'").select("node_id", F.col("entity_key").alias("target"))
    m = file_entities(docs, entities).filter("entity_type = 'method' and class_name is not null")
    m = m.select("node_id", F.col("entity_key").alias("source"), F.concat("file_path", F.lit("::"), "class_name").alias("target"))
    return m.join(kids, ["node_id", "target"], "left_semi").select("node_id", "source", "target")


def suffix_index(docs: DataFrame) -> DataFrame:
    """(suffix, id): every suffix of every path, with the document that has the least path."""
    s = docs.select(F.explode(paths.suffixes(F.col("file_path"))).alias("suffix"), "file_path", "node_id")
    return s.groupBy("suffix").agg(F.min_by("node_id", "file_path").alias("id"))


def resolve(ends: DataFrame, docs: DataFrame) -> DataFrame:
    """(ref, id) for the distinct relation ends (ref): a document's id, else `entity:` and the dotted reference.

    The candidates of the whole reference come before those of its file part; external references that match no
    document are left out.
    """
    refs = ends.select("ref").distinct()
    names = F.concat(paths.lookup_candidates(F.col("ref")), paths.lookup_candidates(F.element_at(F.split("ref", "::"), 1)))
    tries = refs.select("ref", F.posexplode(names).alias("prio", "suffix"))
    found = tries.join(suffix_index(docs), "suffix").groupBy("ref").agg(F.min_by("id", "prio").alias("id"))
    made = F.concat(F.lit("entity:"), F.replace("ref", F.lit("::"), F.lit(".")))
    out = refs.join(found, "ref", "left").filter(F.col("id").isNotNull() | ~F.startswith("ref", F.lit(EXTERNAL)))
    return out.select("ref", F.coalesce(F.col("id").cast("string"), made).alias("id"))


def build(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges between documents and entities from relations (source, target, edge_type)."""
    ends = relations.select(F.explode(F.array("source", "target")).alias("ref"))
    ids = resolve(ends, docs)
    as_ = lambda c: ids.select(F.col("ref").alias(c), F.col("id").alias(f"{c}_id"))
    return relations.join(as_("source"), "source").join(as_("target"), "target").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "edge_type")


def labels(nodes: DataFrame, docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(node, label, file_path) of nodes (node): a document's name, an entity's, an external tail, or the id itself."""
    d = docs.select(F.col("node_id").cast("string").alias("node"), F.col("file_name").alias("d_label"), F.col("file_path").alias("d_path"))
    e = entities.groupBy(F.col("entity_key").alias("node")).agg(F.min("name").alias("e_label"), F.min("file_path").alias("e_path"))
    tail = F.when(is_external("node"), F.element_at(F.split(F.substring("node", len(EXTERNAL) + 1, 1 << 30), r"\."), -1))
    return nodes.join(d, "node", "left").join(e, "node", "left").select("node", F.coalesce("d_label", "e_label", tail, "node").alias("label"), F.coalesce("d_path", "e_path").alias("file_path"))


def first_by_path(docs: DataFrame) -> DataFrame:
    """One document for each path, that of the least id."""
    return docs.groupBy("file_path").agg(F.min("node_id").alias("node_id"))


def highlighted(docs: DataFrame, said: str) -> DataFrame:
    return docs.filter(F.contains("file_path", F.lit(said)) | (F.col("file_name") == said)).select("node_id", "file_name")


def node_size(degree: Column) -> Column:
    return F.least(F.lit(120), 40 + 8 * degree)


def density(n: Column, e: Column) -> Column:
    return F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(F.lit(0.0))


def insight(counts: DataFrame) -> DataFrame:
    """The sentence over one row (nodes, edges, clusters, isolated)."""
    n, e, c, i = F.col("nodes"), F.col("edges"), F.col("clusters"), F.col("isolated")
    parts = F.concat_ws(
        " ",
        F.when(c > 1, F.concat(c.cast("string"), F.lit(" connected clusters."))).when(c == 1, "Fully connected codebase."),
        F.when(i > 0, F.concat(i.cast("string"), F.lit(" isolated node"), F.when(i != 1, "s").otherwise(""), F.lit(" have no connections."))),
        F.concat(F.lit("Graph density: "), F.when(n > 1, F.format_string("%.3f", density(n, e))).otherwise(F.lit("0")), F.lit(".")),
    )
    return counts.select(F.when(n == 0, F.lit("No nodes loaded yet.")).otherwise(parts).alias("insight"))
