"""Reports and registries as tables: Markdown documents, project status, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchor(title: Column) -> Column:
    return F.translate(F.lower(title), " /", "--")


def handoff(sections: DataFrame, title: str) -> DataFrame:
    """One row, a Markdown document: sections (doc_id, priority, title, body) in the order of priority, with contents.

    The sections of one document meet in one row, which the document is.
    """
    g = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("priority", "title", "body"))).alias("s"))
    toc = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- ["), x["title"], F.lit("](#"), anchor(x["title"]), F.lit(")"))), "\n")
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["body"])), "\n\n")
    return g.select("doc_id", F.concat(F.lit(f"# {title}\n\n"), toc, F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))


def project_status(projects: DataFrame) -> DataFrame:
    """One row of counts over projects (exists, has_index, has_config)."""
    n = F.count_if
    return projects.agg(F.count("*").alias("total"), n(F.col("exists")).alias("existing"), n(F.col("exists") & F.col("has_index")).alias("indexed"), n(F.col("exists") & ~F.col("has_index")).alias("unindexed"), n(~F.col("exists")).alias("missing"))


def discovered(files: DataFrame, marker: str) -> DataFrame:
    """The distinct project folders among files (path): those that hold the marker file."""
    return files.filter(F.endswith("path", F.lit("/" + marker))).select(F.substring("path", F.lit(1), F.length("path") - len(marker) - 1).alias("project")).dropDuplicates()


def library_listing(docs: DataFrame, as_of: int) -> DataFrame:
    """(library, fresh, topics, docs) of cached library documents (library, topic, fetched_at, ttl_days)."""
    age = F.lit(as_of) - F.max("fetched_at")
    return docs.groupBy("library").agg((age < F.max("ttl_days") * 86400).alias("fresh"), F.count_distinct("topic").alias("topics"), F.count("*").alias("docs"))
