"""Edits by reference: a paragraph, cell, row or table as a range of the document's paragraphs.

Paragraphs are numbered in document order, those in cells where their table stands, so every element
is an interval of numbers: a paragraph one, a cell, row or table from its first to its last. Before and
after, start and end, and all that lies within are then comparisons of numbers, in joins on doc_id.

References: p:N (of the body), tbl:T, tbl:T/row:R, tbl:T/row:R/cell:C, and p:N below a cell, N counted there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators import blocks, entity_edits, tracked

POSITIONS = ("before", "after", "start", "end")


def elements(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, ref, element_type, first, last): each element of the body with the numbers of its first and last paragraph."""
    body = paragraphs.where(F.col("part") == tracked.BODY) if "part" in paragraphs.columns else paragraphs
    for c in ("tbl_idx", "row_idx", "cell_idx"):
        if c not in body.columns:
            body = body.withColumn(c, F.lit(None).cast("int"))
    body = body.select("doc_id", "p_idx", "tbl_idx", "row_idx", "cell_idx")
    parts = {"tbl": "tbl_idx", "row": "row_idx", "cell": "cell_idx"}
    path = lambda n: F.array_join(F.array(*(F.concat(F.lit(f"{k}:"), F.col(c)) for k, c in list(parts.items())[:n])), "/")
    inside = F.col("tbl_idx").isNotNull()
    number = F.row_number().over(Window.partitionBy("doc_id", "tbl_idx", "row_idx", "cell_idx").orderBy("p_idx")) - 1
    lines = body.withColumn("k", number).select("doc_id", F.when(inside, F.concat(path(3), F.lit("/p:"), F.col("k"))).otherwise(F.concat(F.lit("p:"), F.col("k"))).alias("ref"), F.lit("paragraph").alias("element_type"), F.col("p_idx").alias("first"), F.col("p_idx").alias("last"))
    out = lines
    for n, kind in ((1, "table"), (2, "row"), (3, "cell")):
        some = body.where(inside).groupBy("doc_id", path(n).alias("ref")).agg(F.min("p_idx").alias("first"), F.max("p_idx").alias("last"))
        out = out.unionByName(some.withColumn("element_type", F.lit(kind)))
    return out


def located(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (doc_id, ref, …) with element_type, first and last; null where nothing has the reference."""
    found = elements(paragraphs).join(edits.select("doc_id", "ref").distinct(), ["doc_id", "ref"], "left_semi")
    return edits.join(found, ["doc_id", "ref"], "left")


def _said(at: DataFrame, wrong, done: str) -> DataFrame:
    return at.select("doc_id", "seq", wrong.isNull().alias("success"), F.coalesce(wrong, F.lit(done)).alias("message"))


def insert(paragraphs: DataFrame, runs: DataFrame, edits: DataFrame, author: str = "Inkloom", date: str = "2024-01-01T00:00:00Z", changes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, runs, changes made, results) of edits (doc_id, seq, ref, text, position, track): all at once, references as of now.

    Before or after a paragraph the text is a paragraph of its own; at the start or end of one, and at the near end of a cell, row or table, a run.
    Texts put in the same place stand in the order of seq. changes: the documents' changes so far, whose ids are taken.
    """
    at = located(paragraphs, edits.withColumn("position", F.coalesce("position", F.lit("after"))).withColumn("track", F.coalesce("track", F.lit(False))))
    wrong = F.when(~F.col("position").isin(*POSITIONS), F.concat(F.lit("position must be one of before, after, start, end, not "), F.col("position"))).when(F.col("first").isNull(), F.concat(F.lit("nothing has the reference "), F.col("ref"))).when(F.col("text").isNull(), "no text given")
    at = at.withColumn("wrong", wrong)
    fit = at.where("wrong is null")
    outer = (F.col("element_type") == "paragraph") & F.col("position").isin("before", "after")
    # What stands next to a paragraph is put there last by `blocks`: texts after one go in from the last on.
    behind = F.col("position") == "after"
    todo = fit.where(outer).select("doc_id", F.when(behind, -F.col("seq")).otherwise(F.col("seq")).cast("int").alias("seq"), F.lit("insert_paragraph").alias("type"), "text", F.when(behind, "").alias("after"), F.when(~behind, "").alias("before"), F.concat(F.lit("p:"), F.col("first")).alias("ref"), "track")
    lines, made, _ = blocks.apply(paragraphs, todo, author, date, changes)
    whole = tracked.prepared(runs)
    ahead = F.col("position").isin("before", "start")
    spots = fit.where(~outer).select("doc_id", F.lit(tracked.BODY).alias("part"), F.when(ahead, F.col("first")).otherwise(F.col("last")).alias("p_idx"), "seq", ahead.alias("ahead"), "text", "track")
    size = tracked.visible(whole).select(*tracked.KEYS, F.length("text").alias("size"))
    null = lambda kind: F.lit(None).cast(kind)
    at_ = F.when(F.col("ahead"), 0).otherwise(F.coalesce("size", F.lit(0)))
    spans = spots.join(size, tracked.KEYS, "left").select(
        *tracked.KEYS, at_.alias("start"), at_.alias("end"), "seq", F.when(F.col("ahead"), F.col("seq")).otherwise(F.col("seq")).cast("int").alias("order"), null("string").alias("kind"), F.col("text").alias("new"), F.lit("insertion").alias("new_kind"),
        F.lit(author).alias("author"), "track", F.lit("").alias("found"), null("boolean").alias("bold"), null("boolean").alias("italic"),
    )
    tops = tracked.top_ids(*(m for m in (whole, changes, made) if m is not None))
    spans = tracked.written(tracked.numbered(spans, tops, date), "ref-spans")
    changed = made.select("doc_id", "part", "change_id", "change_type", "author", "date", "text").unionByName(tracked.change_rows(spans).select("doc_id", "part", "change_id", "change_type", "author", "date", "text"))
    return lines, tracked.rewritten(whole, spans), changed, _said(at, F.col("wrong"), "inserted 1")


def delete(paragraphs: DataFrame, runs: DataFrame, edits: DataFrame, author: str = "Inkloom", date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, changes made, results) of edits (doc_id, seq, ref, track): the text of every paragraph within each element is deleted.

    A paragraph within several elements is deleted once, tracked if one of them asks for it.
    """
    at = located(paragraphs, edits.withColumn("track", F.coalesce("track", F.lit(False))))
    wrong = F.when(F.col("first").isNull(), F.concat(F.lit("nothing has the reference "), F.col("ref")))
    body = (paragraphs.where(F.col("part") == tracked.BODY) if "part" in paragraphs.columns else paragraphs).select("doc_id", "p_idx")
    hit = body.join(at.where("first is not null").select("doc_id", "first", "last", "track"), "doc_id").where("p_idx between first and last")
    hit = hit.groupBy("doc_id", "p_idx").agg(F.bool_or("track").alias("track")).withColumn("part", F.lit(tracked.BODY)).withColumn("new", F.lit(None).cast("string"))
    after, made = tracked.replaced_whole(runs, hit.where("track"), True, author, date)
    after, _ = tracked.replaced_whole(after, hit.where("not track"), False, author, date)
    return after, made, _said(at, wrong, "deleted 1")


def comment(paragraphs: DataFrame, comments: DataFrame, ranges: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(comments, ranges, results) with a comment on the whole of each element: edits (doc_id, seq, ref, text, author)."""
    at = located(paragraphs, edits)
    wrong = F.when(F.col("first").isNull(), F.concat(F.lit("nothing has the reference "), F.col("ref"))).when(F.col("text").isNull(), "no text given")
    body = (paragraphs.where(F.col("part") == tracked.BODY) if "part" in paragraphs.columns else paragraphs).select("doc_id", "p_idx", F.col("text").alias("t"))
    fit = at.withColumn("wrong", wrong).where("wrong is null")
    marked = body.join(fit.select("doc_id", "seq", "first", "last"), "doc_id").where("p_idx between first and last")
    marked = marked.groupBy("doc_id", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_idx", "t"))), lambda x: F.coalesce(x["t"], F.lit(""))), "").alias("marked_text"))
    new = fit.join(marked, ["doc_id", "seq"]).select("doc_id", F.col("first").alias("p_idx"), "last", "marked_text", "author", "text")
    # Both tables are made from these rows, and each is read more than once.
    comments, ranges = entity_edits.add_comments(comments, ranges, tracked.written(new, "ref-comments"))
    return comments, ranges, _said(at, wrong, "commented 1")
