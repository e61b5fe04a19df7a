"""Rules over entity tables: a row for each breach, and a verdict for each document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def breaches(runs: DataFrame, changes: DataFrame, errors: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(doc_id, rule, detail): unreadable parts, text in deletions, deleted text outside them, ids and names that repeat."""
    row = lambda df, rule, detail: df.select("doc_id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    twice = lambda df, *keys: df.groupBy("doc_id", *keys).agg(F.count("*").alias("n")).where("n > 1")
    parts = [
        row(errors, "readable", F.coalesce("part", F.lit("package"))),
        row(runs.where("in_del and text <> ''"), "no_text_in_deletion", F.col("text")),
        row(runs.where("not in_del and del_text <> ''"), "deleted_text_in_deletion", F.col("del_text")),
        row(twice(changes.where("change_id is not null"), "part", "change_id", "change_type"), "unique_change_ids", F.col("change_id")),
        row(twice(bookmarks, "name"), "unique_bookmark_names", F.col("name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def verdicts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_breaches, is_valid) for every document."""
    n = found.groupBy("doc_id").agg(F.count("*").alias("n_breaches"))
    out = docs.select("doc_id").distinct().join(n, "doc_id", "left").withColumn("n_breaches", F.coalesce("n_breaches", F.lit(0)).cast("long"))
    return out.withColumn("is_valid", F.col("n_breaches") == 0)


def only_tracked(old: DataFrame, new: DataFrame, author: str) -> DataFrame:
    """(doc_id, same): whether a revision differs from the original by one author's tracked changes alone.

    old: paragraphs (doc_id, p_idx, text) of the original; new: runs (doc_id, p_idx, r_idx, text,
    del_text, in_ins, in_del, author) of the revision. Taking the author's changes back must give the original.
    """
    own = F.col("author") == author
    back = new.where(~(F.coalesce(own, F.lit(False)) & F.col("in_ins")))
    piece = F.when(F.col("in_del") & F.coalesce(own, F.lit(False)), F.col("del_text")).otherwise(F.col("text"))
    lines = back.groupBy("doc_id", "p_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_idx", piece.alias("t")))), lambda x: x["t"]), "").alias("b"))
    both = old.select("doc_id", "p_idx", F.col("text").alias("a")).join(lines, ["doc_id", "p_idx"], "full")
    return both.groupBy("doc_id").agg(F.bool_and(F.coalesce("a", F.lit("")) == F.coalesce("b", F.lit(""))).alias("same"))


def unpreserved(texts: DataFrame) -> DataFrame:
    """Texts (doc_id, text, preserved) with white space at an edge that nothing keeps."""
    return texts.where("not preserved and text rlike '^\\\\s|\\\\s$'")
