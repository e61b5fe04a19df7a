"""Joins between entities: comments, notes, links, bookmarks, cross-references, parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def places(left: DataFrame, right: DataFrame, *names: str) -> list[str]:
    """Keys of a join by place: doc_id, the names given, and the part where both sides name it."""
    return ["doc_id", *names, *(["part"] if "part" in left.columns and "part" in right.columns else [])]


def anti(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def comments_with_ranges(comments: DataFrame, ranges: DataFrame, extended: DataFrame | None = None) -> DataFrame:
    """Comments with where they stand; with `extended` also resolved and the comment they answer."""
    out = comments.join(ranges, ["doc_id", "comment_id"], "left")
    if extended is None:
        return out
    out = out.join(extended.select("doc_id", "para_id", "parent_para_id", F.col("done").alias("resolved")), ["doc_id", "para_id"], "left")
    parent = comments.select("doc_id", F.col("para_id").alias("parent_para_id"), F.col("comment_id").alias("parent_id"))
    return out.join(parent, ["doc_id", "parent_para_id"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def filter_comments(comments: DataFrame, paragraphs: DataFrame | None = None, author: str | None = None, scope: Column | None = None) -> DataFrame:
    """By author, and by the paragraph where the range starts; comments without a range are in no scope."""
    out = comments if author is None else comments.where(F.col("author") == author)
    if scope is not None:
        inside = paragraphs.where(scope).withColumnRenamed("p_idx", "start_p_idx")
        on = places(out, inside, "start_p_idx")
        out = out.join(inside.select(*on), on, "left_semi")
    return out


def threads(comments: DataFrame) -> DataFrame:
    """(doc_id, comment_id, n_replies, replies): direct answers of each comment, in order."""
    answers = comments.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("comment_id")).agg(F.count("*").alias("n_replies"), F.sort_array(F.collect_list("comment_id")).alias("replies"))
    return comments.select("doc_id", "comment_id").join(answers, ["doc_id", "comment_id"], "left").withColumn("n_replies", F.coalesce("n_replies", F.lit(0)).cast("long"))


def orphan_notes(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """Notes that no reference points at; separators aside."""
    return anti(notes.where("w_type is null"), refs, ["doc_id", "note_kind", "note_id"])


def first_references(notes: DataFrame, refs: DataFrame) -> DataFrame:
    first = refs.groupBy("doc_id", "note_kind", "note_id").agg(F.min("p_idx").alias("p_idx"))
    return notes.join(first, ["doc_id", "note_kind", "note_id"])


def renumbered(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, note_kind, note_id, new_id): 1, 2, … in the order of first references."""
    w = Window.partitionBy("doc_id", "note_kind").orderBy("p_idx", F.expr("try_cast(note_id as int)"), "note_id")
    return first_references(notes, refs).select("doc_id", "note_kind", "note_id", F.row_number().over(w).alias("new_id"))


def merged_notes(notes: DataFrame, ids: list[str], separator: str = "\n") -> DataFrame:
    """(doc_id, note_kind, note_id, text): the notes of ids as one, in the order given, under the first id there is."""
    order = F.array_position(F.array(*map(F.lit, ids)), F.col("note_id"))
    chosen = notes.where(F.col("note_id").isin(ids)).groupBy("doc_id", "note_kind").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "note_id", "text"))).alias("xs"))
    return chosen.select("doc_id", "note_kind", F.col("xs")[0]["note_id"].alias("note_id"), F.array_join(F.transform("xs", lambda x: x["text"]), separator).alias("text"))


def resolved_links(links: DataFrame, relationships: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Links with their target and status: external, internal or broken."""
    rels = relationships.select("doc_id", "rel_id", "target")
    names = bookmarks.select("doc_id", F.col("name").alias("anchor"), F.lit(True).alias("known")).distinct()
    out = links.join(rels, ["doc_id", "rel_id"], "left").join(names, ["doc_id", "anchor"], "left")
    status = F.when(F.col("target").isNotNull(), "external").when(F.col("known"), "internal").otherwise("broken")
    return out.withColumn("status", status).drop("known")


def orphan_bookmarks(bookmarks: DataFrame, links: DataFrame, xrefs: DataFrame) -> DataFrame:
    """Bookmarks that neither a link nor a cross-reference uses; hidden ones (with _) aside."""
    used = links.where("anchor is not null").select("doc_id", F.col("anchor").alias("name")).unionByName(xrefs.select("doc_id", F.col("target").alias("name")))
    return anti(bookmarks.where(~F.col("name").startswith("_")), used, ["doc_id", "name"])


def broken_references(xrefs: DataFrame, bookmarks: DataFrame) -> DataFrame:
    return anti(xrefs.withColumn("name", F.col("target")), bookmarks, ["doc_id", "name"]).drop("name")


def validated(links: DataFrame, xrefs: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(doc_id, broken_links, broken_xrefs, orphan_bookmarks, is_valid): of documents with any of these entities."""
    named = links.where("anchor is not null").withColumn("name", F.col("anchor"))
    parts = [
        ("broken_links", anti(named, bookmarks, ["doc_id", "name"])), ("broken_xrefs", broken_references(xrefs, bookmarks)), ("orphan_bookmarks", orphan_bookmarks(bookmarks, links, xrefs)),
        ("any", links), ("any", xrefs), ("any", bookmarks),
    ]
    rows = None
    for kind, df in parts:
        part = df.select("doc_id", F.lit(kind).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    out = rows.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("broken_links", "broken_xrefs", "orphan_bookmarks")))
    return out.withColumn("is_valid", (F.col("broken_links") == 0) & (F.col("broken_xrefs") == 0))


def cross_references(fields: DataFrame) -> DataFrame:
    """Fields that refer to bookmarks: type and target."""
    kind = F.upper(F.regexp_extract("code", r"^\s*(\w+)", 1))
    rows = fields.withColumn("field_type", kind).where(F.col("field_type").isin("REF", "PAGEREF", "NOTEREF"))
    return rows.withColumn("target", F.regexp_extract("code", r"^\s*\w+\s+([^\s\\]+)", 1))


def reference_targets(bookmarks: DataFrame, paragraphs: DataFrame, fields: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, kind, target, text): what cross-references may point at."""
    heads = paragraphs.where(F.col("style").startswith("Heading") & (F.trim("text") != ""))
    row = lambda df, kind, target, text: df.select("doc_id", F.lit(kind).alias("kind"), F.col(target).cast("string").alias("target"), F.col(text).alias("text"))
    on = places(paragraphs, fields, "p_idx")
    captions = fields.select(*on, F.regexp_extract("code", r"^\s*SEQ\s+(Figure|Table)", 1).alias("what")).where("what <> ''")
    named = paragraphs.where(F.lower("style") == "caption").join(captions, on)
    out = row(bookmarks, "bookmark", "name", "preview").unionByName(row(heads, "heading", "p_idx", "text"))
    for what in ("Figure", "Table"):
        out = out.unionByName(row(named.where(F.col("what") == what), what.lower(), "p_idx", "text"))
    for kind in ("footnote", "endnote"):
        out = out.unionByName(row(notes.where((F.col("note_kind") == kind) & F.col("w_type").isNull()), kind, "note_id", "text"))
    return out


def headers_of(headers: DataFrame, relationships: DataFrame) -> DataFrame:
    """Header and footer parts that the main part refers to, once each."""
    rels = relationships.where(F.col("rel_type").isin("header", "footer")).select("doc_id", F.concat(F.lit("word/"), F.col("target")).alias("part")).distinct()
    return headers.join(rels, ["doc_id", "part"])


def unmatched_parts(parts: DataFrame, relationships: DataFrame) -> DataFrame:
    """(doc_id, part, problem): targets without a part, and parts that nothing refers to."""
    inner = relationships.where("coalesce(mode, '') <> 'External'")
    folder = F.regexp_extract("source_part", r"^(.*/)[^/]*$", 1)
    target = F.when(F.col("target").startswith("/"), F.substring("target", 2, 1 << 20)).otherwise(F.concat(folder, F.col("target")))
    targets = inner.select("doc_id", target.alias("part")).distinct()
    own = parts.where(~F.col("part").endswith(".rels") & (F.col("part") != "[Content_Types].xml"))
    return anti(targets, own, ["doc_id", "part"]).withColumn("problem", F.lit("missing")).unionByName(anti(own.select("doc_id", "part"), targets, ["doc_id", "part"]).withColumn("problem", F.lit("unreferenced")))


def content_type(parts: DataFrame, types: DataFrame) -> DataFrame:
    """Parts with their declared type: by name, else by extension."""
    by_name = types.where("part is not null").select("doc_id", F.substring("part", 2, 1 << 20).alias("part"), F.col("content_type").alias("own"))
    by_extension = types.where("extension is not null").select("doc_id", F.lower("extension").alias("ext"), F.col("content_type").alias("usual"))
    rows = parts.withColumn("ext", F.lower(F.regexp_extract("part", r"\.([^.]+)$", 1)))
    return rows.join(by_name, ["doc_id", "part"], "left").join(by_extension, ["doc_id", "ext"], "left").select("doc_id", "part", F.coalesce("own", "usual").alias("content_type"))


def links_json(resolved: DataFrame) -> DataFrame:
    """(doc_id, links): external, internal and broken links of each document as JSON lists in order."""
    one = F.struct("link_idx", "text", "anchor", "target")
    lists = [F.array_sort(F.collect_list(F.when(F.col("status") == s, one))).alias(s) for s in ("external", "internal", "broken")]
    return resolved.groupBy("doc_id").agg(*lists).select("doc_id", F.to_json(F.struct("external", "internal", "broken")).alias("links"))


def references_json(xrefs: DataFrame) -> DataFrame:
    """(doc_id, references): cross-references of each document as a JSON list in order."""
    one = F.struct("field_idx", "field_type", "target", "display")
    return xrefs.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("references"))
