"""Sections, outlines, ordinals, sizes and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from inkloom.functions import text as T

# Tokens estimated for a paragraph and a table, and the tiers of a document's size.
PARAGRAPH_TOKENS, TABLE_TOKENS = 100, 200
TIERS = [(100, "small"), (300, "medium"), (500, "large")]


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("p_idx")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def section_ids(paragraphs: DataFrame, heading: Column) -> DataFrame:
    """Adds section_id: 0 before the first heading, then one more at each; a heading is in its own section."""
    return paragraphs.withColumn("section_id", F.sum(F.coalesce(heading, F.lit(False)).cast("int")).over(so_far()).cast("int"))


def sections(paragraphs: DataFrame, heading: Column, preview: int = 100) -> DataFrame:
    """(doc_id, section_id, heading, start_idx, end_idx, n_paragraphs, preview): end is exclusive, the introduction has no heading."""
    rows = section_ids(paragraphs, heading).withColumn("_h", F.coalesce(heading, F.lit(False)))
    body = F.when(~F.col("_h") & (F.trim("text") != ""), F.struct("p_idx", F.substring("text", 1, preview).alias("t")))
    out = rows.groupBy("doc_id", "section_id").agg(
        F.min(F.when(F.col("_h"), F.struct("p_idx", "text")))["text"].alias("heading"), F.min("p_idx").alias("start_idx"), (F.max("p_idx") + 1).alias("end_idx"), F.count("*").alias("n_paragraphs"), F.min(body)["t"].alias("preview"),
    )
    return out


def section_bounds(paragraphs: DataFrame, heading: Column, micro: int = 1) -> DataFrame:
    """(doc_id, heading, start_idx, end_idx) by the next heading; sections of fewer than micro paragraphs are joined to the one before."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    heads = paragraphs.withColumn("n", n).where(F.coalesce(heading, F.lit(False)))
    if micro > 1:  # one pass: what it removes isn't looked at again
        heads = heads.withColumn("_next", F.lead("p_idx").over(in_order())).where(F.coalesce("_next", F.col("n").cast("int")) - F.col("p_idx") >= micro).drop("_next")
    end = F.coalesce(F.lead("p_idx").over(in_order()), F.col("n").cast("int"))
    return heads.select("doc_id", F.col("text").alias("heading"), F.col("p_idx").alias("start_idx"), end.alias("end_idx"))


def blank_line_blocks(paragraphs: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, start_idx, end_idx, n): runs of paragraphs between blank ones, of at least `least`."""
    blank = F.trim("text") == ""
    rows = paragraphs.withColumn("island", F.sum(blank.cast("int")).over(so_far())).where(~blank)
    return rows.groupBy("doc_id", "island").agg(F.min("p_idx").alias("start_idx"), (F.max("p_idx") + 1).alias("end_idx"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def chunks(paragraphs: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, start_idx, end_idx): fixed chunks, or one where a document has no more than two."""
    rows = paragraphs.withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    which = F.when(F.col("n") <= 2 * size, 0).otherwise(F.floor(F.col("p_idx") / size))
    return rows.groupBy("doc_id", which.alias("chunk")).agg(F.min("p_idx").alias("start_idx"), (F.max("p_idx") + 1).alias("end_idx")).drop("chunk")


def heading_tiers(paragraphs: DataFrame, longest: int = 100) -> DataFrame:
    """Adds tier: 1 heading style, 2 outline level, 3 heuristics (bold, capitals, numbers), null otherwise. style, outline_lvl and all_bold may be absent."""
    has = lambda c, kind: F.col(c) if c in paragraphs.columns else F.lit(None).cast(kind)
    text = F.trim("text")
    short = (text != "") & (F.length(text) <= longest)
    guess = short & (F.coalesce(has("all_bold", "boolean"), F.lit(False)) | T.all_caps(text) | T.numbered_pattern(text).isNotNull())
    tier = F.when(T.style_level(has("style", "string")).isNotNull(), 1).when(has("outline_lvl", "int").isNotNull(), 2).when(guess, 3)
    return paragraphs.withColumn("tier", tier)


def detect_sections(paragraphs: DataFrame, least: int = 2, size: int = 10) -> DataFrame:
    """(doc_id, heading, start_idx, end_idx, method): the best tier with any heading decides for a document; then blank lines, then chunks."""
    names = F.array(F.lit("heading_style"), F.lit("outline_level"), F.lit("heuristic"))
    found = heading_tiers(paragraphs).withColumn("best", F.min("tier").over(Window.partitionBy("doc_id")))
    styled = section_bounds(found.where("best is not null"), F.col("tier") == F.col("best"))
    best = found.where("best is not null").select("doc_id", "best").distinct()
    one = styled.join(best, "doc_id").withColumn("method", F.element_at(names, F.col("best"))).where((F.col("best") < 3) | (F.col("end_idx") - F.col("start_idx") >= least)).drop("best")
    rest = paragraphs.join(best, "doc_id", "left_anti")
    blank = F.trim("text") == ""
    blocks = blank_line_blocks(rest, least).withColumn("k", F.count("*").over(Window.partitionBy("doc_id"))).where("k > 1")
    split = rest.where(blank).select("doc_id").distinct().join(blocks.select("doc_id").distinct(), "doc_id", "left_semi")
    two = blocks.join(split, "doc_id", "left_semi").select("doc_id", F.lit(None).cast("string").alias("heading"), "start_idx", "end_idx", F.lit("blank_lines").alias("method"))
    three = chunks(rest.join(split, "doc_id", "left_anti"), size).select("doc_id", F.lit(None).cast("string").alias("heading"), "start_idx", "end_idx", F.lit("chunks").alias("method"))
    return one.unionByName(two).unionByName(three)


def size_info(paragraphs: DataFrame, tables: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_tables, n_changes, tokens, tier)."""
    out = paragraphs.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"))
    for name, rows in (("n_tables", tables), ("n_changes", changes)):
        if rows is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
        else:
            out = out.join(rows.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    tier = F.lit("very_large")
    for most, name in reversed(TIERS):
        tier = F.when(F.col("n_paragraphs") < most, name).otherwise(tier)
    return out.withColumn("tokens", F.col("n_paragraphs") * PARAGRAPH_TOKENS + F.col("n_tables") * TABLE_TOKENS).withColumn("tier", tier)


def document_stats(**entities: DataFrame) -> DataFrame:
    """(doc_id, n_<name> …): rows of each entity per document, 0 where there are none."""
    rows = None
    for name, df in entities.items():
        part = df.select("doc_id", F.lit(name).alias("entity"))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy("doc_id").agg(*(F.count_if(F.col("entity") == n).alias(f"n_{n}") for n in entities))
    return counts


def document_text(paragraphs: DataFrame, skip_deleted: bool = True) -> DataFrame:
    """(doc_id, text): paragraphs joined by a blank line; empty ones whose mark is deleted are skipped."""
    rows = paragraphs
    if skip_deleted and "mark_deleted" in paragraphs.columns:
        rows = rows.where(~((F.col("text") == "") & F.coalesce("mark_deleted", F.lit(False))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_idx", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def char_map(runs: DataFrame) -> DataFrame:
    """Adds char_start and char_end of each run in its paragraph."""
    w = Window.partitionBy("doc_id", "p_idx").orderBy("r_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("text")).over(w)
    return runs.withColumn("char_end", end.cast("int")).withColumn("char_start", (F.col("char_end") - F.length("text")).cast("int"))


def runs_of_matches(matches: DataFrame, runs: DataFrame) -> DataFrame:
    """Matches with the first and last run they touch and the offsets there: a join by paragraph, then by range."""
    parts = char_map(runs).select("doc_id", "p_idx", "r_idx", "char_start", "char_end")
    touched = matches.join(parts, ["doc_id", "p_idx"]).where((F.col("char_start") < F.col("pos") + F.col("len")) & (F.col("char_end") > F.col("pos")))
    return touched.groupBy("doc_id", "p_idx", "index", "pos", "len").agg(
        F.min("r_idx").alias("run_start"), F.max("r_idx").alias("run_end"),
        (F.first("pos") - F.min_by("char_start", "r_idx")).alias("offset_start"), (F.first("pos") + F.first("len") - F.max_by("char_start", "r_idx")).alias("offset_end"),
    )


def token_budget(paragraphs: DataFrame, budget: int, heading: Column) -> DataFrame:
    """Paragraphs that fit a budget of tokens in order, up to the first that doesn't; headings always stay."""
    spent = F.sum(F.when(heading, 0).otherwise(T.token_estimate(F.col("text")))).over(so_far())
    rows = paragraphs.withColumn("spent", spent)
    return rows.withColumn("kept", heading | (F.col("spent") <= budget)).drop("spent")


def page(rows: DataFrame, number: int, size: int, order: str = "row_idx") -> DataFrame:
    """One page of each table's rows, from 1, with has_more."""
    w = Window.partitionBy("doc_id", "tbl_idx")
    n = F.count("*").over(w)
    return rows.withColumn("_n", n).where((F.col(order) >= (number - 1) * size) & (F.col(order) < number * size)).withColumn("has_more", F.col("_n") > number * size).drop("_n")


def find_cell(cells: DataFrame, text: str, case_sensitive: bool = True) -> DataFrame:
    """First cell of each table that contains text, row by row."""
    low = F.col("text") if case_sensitive else F.lower("text")
    hits = cells.where(F.contains(low, F.lit(text if case_sensitive else text.lower())))
    return hits.groupBy("doc_id", "tbl_idx").agg(F.min(F.struct("row_idx", "cell_idx", "text")).alias("x")).select("doc_id", "tbl_idx", "x.*")


def refs(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, p_idx, ref, fingerprint): addresses of paragraphs by ordinal and by content."""
    style = F.col("style") if "style" in paragraphs.columns else F.lit(None).cast("string")
    return paragraphs.select("doc_id", "p_idx", F.concat(F.lit("p:"), F.col("p_idx")).alias("ref"), T.fingerprint(F.col("text"), style, F.lit("body")).alias("fingerprint"))


def resolve(paragraphs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ref, p_idx): wanted (doc_id, ref) by ordinal or p:~fingerprint; p_idx null if nothing is there, the first if several are."""
    known = refs(paragraphs)
    by_name = known.select("doc_id", "ref", "p_idx").unionByName(known.select("doc_id", F.concat(F.lit("p:~"), F.col("fingerprint")).alias("ref"), "p_idx"))
    found = by_name.join(wanted.select("doc_id", "ref").distinct(), ["doc_id", "ref"], "left_semi").groupBy("doc_id", "ref").agg(F.min("p_idx").alias("p_idx"))
    return wanted.join(found, ["doc_id", "ref"], "left").select("doc_id", "ref", "p_idx")
