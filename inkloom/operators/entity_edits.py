"""Edits of entity tables: notes, links, comments, contents, bookmarks, headers, styles.

Each takes the tables and a table of edits keyed by document, and returns the tables after them; all
documents are edited by one join. Ids that are new follow the greatest of their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTE = ["doc_id", "note_kind", "note_id"]
# What a cross-reference shows, and the field switches for it.
DISPLAY = {"text": "", "page": "", "number": "\\r", "number_no_context": "\\n", "number_full": "\\w", "above_below": "\\p"}


def updated(rows: DataFrame, edits: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with column replaced by that of edits (keys, value), where there is one."""
    new = edits.select(*keys, F.col("value").alias("_value"), F.lit(True).alias("_hit"))
    return rows.join(new, keys, "left").withColumn(column, F.when(F.col("_hit"), F.col("_value")).otherwise(F.col(column))).drop("_value", "_hit")


def edit_notes(notes: DataFrame, edits: DataFrame, track: bool = False) -> DataFrame:
    """Notes whose text is replaced by edits (doc_id, note_kind, note_id, text); tracked as change markup."""
    both = notes.join(edits.select(*NOTE, F.col("text").alias("_new")), NOTE, "left")
    new = F.concat(F.lit("{--"), F.col("text"), F.lit("--}{++"), F.col("_new"), F.lit("++}")) if track else F.col("_new")
    return both.withColumn("text", F.when(F.col("_new").isNull(), F.col("text")).otherwise(new)).drop("_new")


def insert_notes(notes: DataFrame, refs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds notes new (doc_id, note_kind, p_idx, text) with ids above all there are, separators included."""
    top = notes.groupBy("doc_id", "note_kind").agg(F.max(F.expr("try_cast(note_id as int)")).alias("_top"))
    w = Window.partitionBy("doc_id", "note_kind").orderBy("p_idx", "text")
    made = new.join(top, ["doc_id", "note_kind"], "left").withColumn("note_id", (F.coalesce("_top", F.lit(0)) + F.row_number().over(w)).cast("string"))
    return notes.unionByName(made.select(*NOTE, F.lit(None).cast("string").alias("w_type"), "text"), True), refs.unionByName(made.select(*NOTE, "p_idx"), True)


def delete_notes(notes: DataFrame, refs: DataFrame, gone: DataFrame, renumber: bool = True) -> tuple[DataFrame, DataFrame]:
    """Drops notes (doc_id, note_kind, note_id) and their references; those left are numbered anew by their first references."""
    from inkloom.operators.links import renumbered

    notes, refs = (df.join(gone.select(*NOTE), NOTE, "left_anti") for df in (notes, refs))
    if not renumber:
        return notes, refs
    new = renumbered(notes.where("w_type is null"), refs).select(*NOTE, F.col("new_id").cast("string").alias("_new"))
    swap = lambda df: df.join(new, NOTE, "left").withColumn("note_id", F.coalesce("_new", "note_id")).drop("_new")
    return swap(notes), swap(refs)


def link_targets(links: DataFrame, relationships: DataFrame, edits: DataFrame) -> DataFrame:
    """Relationships whose target is replaced by edits (doc_id, link_idx, value); internal links are left alone."""
    named = links.join(edits.select("doc_id", "link_idx", "value"), ["doc_id", "link_idx"]).where("rel_id is not null")
    return updated(relationships, named, ["doc_id", "rel_id"], "target")


def link_anchors(links: DataFrame, edits: DataFrame) -> DataFrame:
    """Links whose anchor is replaced; external links are left alone."""
    inner = links.where("rel_id is null").select("doc_id", "link_idx").join(edits, ["doc_id", "link_idx"])
    return updated(links, inner, ["doc_id", "link_idx"], "anchor")


def remove_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select("doc_id", "link_idx"), ["doc_id", "link_idx"], "left_anti")


def add_comments(comments: DataFrame, ranges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds comments new (doc_id, p_idx, marked_text, author, text; last, if its range ends in another paragraph), from id 0 where a document has none."""
    top = comments.groupBy("doc_id").agg(F.max(F.expr("try_cast(comment_id as int)")).alias("_top"))
    w = Window.partitionBy("doc_id").orderBy("p_idx", "marked_text", "text")
    made = new.join(top, "doc_id", "left").withColumn("comment_id", (F.coalesce("_top", F.lit(-1)) + F.row_number().over(w)).cast("string"))
    none = F.lit(None).cast("string")
    from inkloom.functions.text import initials

    rows = made.select("doc_id", "comment_id", "author", initials(F.col("author")).alias("initials"), none.alias("date"), "text", none.alias("para_id"))
    places = made.select("doc_id", "comment_id", F.col("p_idx").alias("start_p_idx"), F.col("last" if "last" in new.columns else "p_idx").alias("end_p_idx"), "marked_text")
    return comments.unionByName(rows, True), ranges.unionByName(places, True)


def delete_comments(comments: DataFrame, ranges: DataFrame, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Without the comments given (doc_id, comment_id), or without any."""
    if gone is None:
        return comments.limit(0), ranges.limit(0)
    return tuple(df.join(gone.select("doc_id", "comment_id"), ["doc_id", "comment_id"], "left_anti") for df in (comments, ranges))


def resolve_comments(extended: DataFrame, comments: DataFrame, chosen: DataFrame, done: bool = True) -> DataFrame:
    ids = comments.join(chosen.select("doc_id", "comment_id"), ["doc_id", "comment_id"]).select("doc_id", "para_id", F.lit(done).alias("value"))
    return updated(extended, ids, ["doc_id", "para_id"], "done")


def create_bookmarks(bookmarks: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bookmarks with new (doc_id, name, p_idx, preview) added, those refused): names must be valid and not yet there."""
    from inkloom.functions.text import valid_bookmark

    once = Window.partitionBy("doc_id", "name").orderBy("p_idx")
    fresh = new.withColumn("_n", F.row_number().over(once)).join(bookmarks.select("doc_id", "name", F.lit(True).alias("_known")).distinct(), ["doc_id", "name"], "left")
    good = valid_bookmark(F.col("name")) & F.col("_known").isNull() & (F.col("_n") == 1)
    top = bookmarks.groupBy("doc_id").agg(F.max(F.expr("try_cast(bookmark_id as int)")).alias("_top"))
    made = fresh.where(good).join(top, "doc_id", "left").withColumn("bookmark_id", (F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy("doc_id").orderBy("p_idx", "name"))).cast("string"))
    return bookmarks.unionByName(made.select("doc_id", "name", "bookmark_id", "p_idx", "preview"), True), fresh.where(~good).drop("_n", "_known")


def reference_code(target: Column, display: str = "text", linked: bool = True, kind: str = "REF") -> Column:
    """Instruction of a cross-reference field."""
    if display not in DISPLAY:
        raise ValueError(f"display must be one of {sorted(DISPLAY)}")
    name = "PAGEREF" if display == "page" else kind
    return F.concat(F.lit(name + " "), target, F.lit("".join(f" {s}" for s in (DISPLAY[display], "\\h" if linked else "") if s)))


def contents(paragraphs: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """(doc_id, entry_idx, level, title, p_idx): entries of a table of contents over heading styles."""
    from inkloom.functions.text import style_level

    heads = paragraphs.withColumn("level", style_level(F.col("style"))).where(F.col("level").between(low, high) & (F.trim("text") != ""))
    return heads.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("p_idx")) - 1).alias("entry_idx"), "level", F.trim("text").alias("title"), "p_idx")


def replace_in_parts(paragraphs: DataFrame, role: str, find: str, new: str, track: bool = True) -> DataFrame:
    """Paragraphs with a text replaced in headers or footers only."""
    changed = F.lit(f"{{--{find}--}}{{++{new}++}}" if track else new)
    return paragraphs.withColumn("text", F.when(F.col("location") == role, F.replace("text", F.lit(find), changed)).otherwise(F.col("text")))


def ensure_styles(styles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Styles with those of wanted (doc_id, style_id, style_type, name) that weren't there."""
    new = wanted.join(styles.select("doc_id", "style_id"), ["doc_id", "style_id"], "left_anti")
    return styles.unionByName(new.select("doc_id", "style_id", "style_type", "name", F.lit(None).cast("string").alias("based_on"), F.lit(False).alias("hidden")))


def format_runs(runs: DataFrame, matches: DataFrame, track: bool = True, **props) -> DataFrame:
    """Runs that matches touch (doc_id, p_idx, run_start, run_end) with bold, italic or color set; tracked keeps the old values."""
    hit = matches.select("doc_id", "p_idx", F.explode(F.sequence("run_start", "run_end")).alias("r_idx")).distinct().withColumn("_hit", F.lit(True))
    out = runs.join(hit, ["doc_id", "p_idx", "r_idx"], "left")
    for name, value in props.items():
        if track:
            out = out.withColumn(f"old_{name}", F.when(F.col("_hit"), F.col(name)).otherwise(F.col(f"old_{name}")))
        out = out.withColumn(name, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(name)))
    return out.drop("_hit")


def copy_format(runs: DataFrame, source: DataFrame, matches: DataFrame) -> DataFrame:
    """Bold, italic and color of source (doc_id, bold, italic, color), one row a document, onto the runs that matches touch; what it lacks is removed."""
    hit = matches.select("doc_id", "p_idx", F.explode(F.sequence("run_start", "run_end")).alias("r_idx")).distinct()
    new = hit.join(source.select("doc_id", *(F.col(c).alias(f"_{c}") for c in ("bold", "italic", "color"))), "doc_id").withColumn("_hit", F.lit(True))
    out = runs.join(new, ["doc_id", "p_idx", "r_idx"], "left")
    for c in ("bold", "italic", "color"):
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c))).drop(f"_{c}")
    return out.drop("_hit")
