"""Change detection and incremental maintenance over snapshot tables.

A snapshot is (path, sha256). Comparing two is one full outer join on path; applying changes is an anti join and a union,
the form that MERGE takes on plain tables. Both shuffle on the path alone, and texts only move where rows are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(prev: DataFrame, cur: DataFrame, unchanged: bool = False) -> DataFrame:
    """(path, change, old, new): added, modified and deleted paths."""
    p, c = prev.select("path", F.col("sha256").alias("old")), cur.select("path", F.col("sha256").alias("new"))
    j = p.join(c, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    out = j.select("path", change.alias("change"), "old", "new")
    return out if unchanged else out.filter("change <> 'unchanged'")


def added(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return cur.select("path").join(prev.select("path"), "path", "left_anti")


def modified(prev: DataFrame, cur: DataFrame) -> DataFrame:
    c = cur.select("path", F.col("sha256").alias("new"))
    return prev.select("path", F.col("sha256").alias("old")).join(c, "path").filter("old <> new").select("path")


def purge_set(changes: DataFrame) -> DataFrame:
    """Paths whose derived rows must go: deleted and modified ones."""
    return changes.filter(F.col("change").isin("deleted", "modified")).select("path")


def upsert(base: DataFrame, fresh: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """base without the purged keys, with the fresh rows of added and modified ones; changes has `path`."""
    gone = purge_set(changes).withColumnRenamed("path", key)
    new = changes.filter(F.col("change").isin("added", "modified")).select(F.col("path").alias(key))
    return base.join(gone, key, "left_anti").unionByName(fresh.join(new, key, "left_semi"))


def remove(base: DataFrame, ref: str, id_col: str = "node_id", path_col: str = "file_path") -> DataFrame:
    """base without one document, named by its id or its path."""
    return base.filter((F.col(id_col).cast("string") != ref) & (F.col(path_col) != ref))


def under(base: DataFrame, directory: str, path_col: str = "path") -> DataFrame:
    """The rows of paths below a directory."""
    return base.filter(F.startswith(F.col(path_col), F.lit(directory.rstrip("/") + "/")))


def remove_directory(base: DataFrame, directory: str, path_col: str = "path") -> DataFrame:
    return base.filter(~F.startswith(F.col(path_col), F.lit(directory.rstrip("/") + "/")))


def manifest(docs: DataFrame) -> DataFrame:
    """(directory, file_count, document_count): what is indexed below each directory."""
    where = F.regexp_replace("file_path", "/[^/]*$", "")
    return docs.groupBy(where.alias("directory")).agg(F.count_distinct("file_path").alias("file_count"), F.count("*").alias("document_count"))


def manifest_update(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """counts (directory, document_count) after delta (directory, change); counts stop at zero, empty directories go."""
    j = counts.join(delta.groupBy("directory").agg(F.sum("change").alias("change")), "directory", "full_outer")
    n = F.greatest(F.lit(0), F.coalesce("document_count", F.lit(0)) + F.coalesce("change", F.lit(0)))
    return j.select("directory", n.cast("long").alias("document_count")).filter("document_count > 0")


def merge_graph(entities: DataFrame, relations: DataFrame, changes: DataFrame, new_entities: DataFrame, new_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations after a change: those of purged files go, freshly extracted ones come in.

    A relation belongs to the file part of its source, so edges of classes and methods go with their file.
    """
    gone = purge_set(changes)
    kept = entities.join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(*entities.columns)
    file = F.element_at(F.split("source", "::"), 1)
    left = relations.withColumn("_file", file).join(gone.withColumnRenamed("path", "_file"), "_file", "left_anti").select(*relations.columns)
    return kept.unionByName(new_entities), left.unionByName(new_relations)
