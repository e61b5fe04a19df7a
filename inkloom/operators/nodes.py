"""A flat tree of a document's elements: one row a node, with its reference, parent and properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T

# Prefixes of references by kind of element.
PREFIXES = {"paragraph": "p", "table": "tbl", "row": "row", "cell": "cell"}
COLUMNS = ["doc_id", "ref", "parent_ref", "depth", "element_type", "ordinal", "text", "level", "properties"]


def tree(paragraphs: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Nodes of body paragraphs, tables, rows and cells.

    paragraphs: as the package reader gives them. changed (doc_id, p_idx) marks paragraphs with
    tracked changes in properties.has_changes.
    """
    body = paragraphs.where("part = 'word/document.xml'")
    if changed is None:
        body = body.withColumn("has_changes", F.lit(False))
    else:
        marks = changed.select("doc_id", "p_idx", F.lit(True).alias("has_changes")).distinct()
        body = body.join(marks, ["doc_id", "p_idx"], "left").withColumn("has_changes", F.coalesce("has_changes", F.lit(False)))
    none, level = F.lit(None).cast("string"), T.style_level(F.col("style"))
    props = F.map_from_arrays(F.array(F.lit("style"), F.lit("has_changes")), F.array(F.coalesce("style", F.lit("")), F.col("has_changes").cast("string")))
    ref = lambda kind, c: F.concat(F.lit(PREFIXES[kind] + ":"), F.col(c))
    lines = body.where("tbl_idx is null").select("doc_id", ref("paragraph", "body_p_idx").alias("ref"), none.alias("parent_ref"), F.lit(0).alias("depth"), F.when(level.isNotNull(), "heading").otherwise("paragraph").alias("element_type"), F.col("body_p_idx").alias("ordinal"), "text", level.alias("level"), props.alias("properties"))
    inside = body.where("tbl_idx is not null")
    table = ref("table", "tbl_idx")
    row = F.concat(table, F.lit("/"), ref("row", "row_idx"))
    cell = F.concat(row, F.lit("/"), ref("cell", "cell_idx"))

    def group(keys: list[str], name: Column, parent: Column, depth: int, kind: str) -> DataFrame:
        texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_idx", "text"))), lambda x: x["text"]), " ")
        some = inside.groupBy("doc_id", *keys).agg(texts.alias("text"), F.max("has_changes").alias("has_changes")).withColumn("style", F.lit(""))
        return some.select("doc_id", name.alias("ref"), parent.alias("parent_ref"), F.lit(depth).alias("depth"), F.lit(kind).alias("element_type"), F.col(keys[-1]).alias("ordinal"), "text", F.lit(None).cast("int").alias("level"), props.alias("properties"))

    out = lines.unionByName(group(["tbl_idx"], table, none, 0, "table"))
    out = out.unionByName(group(["tbl_idx", "row_idx"], row, table, 1, "row"))
    return out.unionByName(group(["tbl_idx", "row_idx", "cell_idx"], cell, row, 2, "cell"))


def find(nodes: DataFrame, element_type: str | None = None, level: int | None = None, has_changes: bool | None = None, contains: str | None = None) -> DataFrame:
    """Nodes that meet every condition given."""
    test = F.lit(True)
    if element_type is not None:
        test &= F.col("element_type") == element_type
    if level is not None:
        test &= F.coalesce(F.col("level") == level, F.lit(False))
    if has_changes is not None:
        test &= F.col("properties")["has_changes"] == str(has_changes).lower()
    if contains is not None:
        test &= F.contains("text", F.lit(contains))
    return nodes.where(test)


def counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", "element_type").agg(F.count("*").alias("n"))


def search_tree(nodes: DataFrame, pattern: str, case_sensitive: bool = False, chars: int = 30, most: int = 20) -> DataFrame:
    """(doc_id, ref, found, context, total): the first `most` hits of each document in order of references, and how many there are."""
    from pyspark.sql import Window

    java = ("" if case_sensitive else "(?iu)") + pattern
    found = F.regexp_extract("text", java, 0)
    hits = nodes.where(F.col("text").rlike(java)).select("doc_id", "ref", "depth", "ordinal", found.alias("found"), T.context(F.col("text"), found, chars).alias("context")).where("found <> ''")
    w = Window.partitionBy("doc_id")
    out = hits.withColumn("total", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("depth", "ordinal", "ref")))
    return out.where(F.col("rank") <= most).select("doc_id", "ref", "found", "context", "total")


def lookup(nodes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of wanted (doc_id, ref), those of wanted that no node has)."""
    return nodes.join(wanted.select("doc_id", "ref").distinct(), ["doc_id", "ref"], "left_semi"), wanted.join(nodes.select("doc_id", "ref"), ["doc_id", "ref"], "left_anti")
