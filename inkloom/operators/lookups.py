"""Point lookups and small derived tables over entities: tables, rows, sections, notes, links, references, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators.structure import section_ids


def holds(column: Column, text: str, case_sensitive: bool = True) -> Column:
    """Whether a column contains a text, false for null."""
    low = (lambda c: c) if case_sensitive else F.lower
    return F.coalesce(F.contains(low(column), low(F.lit(text))), F.lit(False))


def containing(rows: DataFrame, text: str, case_sensitive: bool = True, column: str = "text") -> DataFrame:
    """Rows (notes, headers, cells, …) whose text contains a text."""
    return rows.where(holds(F.col(column), text, case_sensitive))


# Tables


def table_shapes(cells: DataFrame) -> DataFrame:
    """(doc_id, tbl_idx, n_rows, n_cols): n_cols is the number of cells in the first row."""
    first = F.when(F.col("row_idx") == 0, F.col("cell_idx"))
    return cells.groupBy("doc_id", "tbl_idx").agg((F.max("row_idx") + 1).cast("long").alias("n_rows"), F.count_distinct(first).alias("n_cols"))


def first_table(cells: DataFrame, text: str, case_sensitive: bool = True) -> DataFrame:
    """(doc_id, tbl_idx): each document's first table with a cell that contains text."""
    return containing(cells, text, case_sensitive).groupBy("doc_id").agg(F.min("tbl_idx").alias("tbl_idx"))


def rows_containing(cells: DataFrame, text: str, case_sensitive: bool = True) -> DataFrame:
    """(doc_id, tbl_idx, row_idx, found): whether any cell of each row contains text."""
    return cells.groupBy("doc_id", "tbl_idx", "row_idx").agg(F.bool_or(holds(F.col("text"), text, case_sensitive)).alias("found"))


def cells_at(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, tbl_idx, row_idx, cell_idx) with the text that stands there; found is false beyond a table's edge."""
    on = ["doc_id", "tbl_idx", "row_idx", "cell_idx"]
    return wanted.join(cells.select(*on, "text", F.lit(True).alias("found")), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def column_inserted(cells: DataFrame, new: DataFrame) -> DataFrame:
    """Cells with a column more: new (doc_id, tbl_idx, after_col, row_idx, text), after_col -1 for the left edge."""
    at = new.select("doc_id", "tbl_idx", "row_idx", (F.col("after_col") + 0.5).alias("at"), "text")
    both = cells.select("doc_id", "tbl_idx", "row_idx", F.col("cell_idx").cast("double").alias("at"), "text").unionByName(at)
    order = Window.partitionBy("doc_id", "tbl_idx", "row_idx").orderBy("at")
    return both.withColumn("cell_idx", (F.row_number().over(order) - 1).cast("int")).drop("at")


# Sections


def sections_containing(paragraphs: DataFrame, heading: Column, text: str, case_sensitive: bool = True) -> DataFrame:
    """(doc_id, section_id, found, first_idx): whether a section has text, and its first paragraph that does."""
    hit = holds(F.col("text"), text, case_sensitive)
    return section_ids(paragraphs, heading).groupBy("doc_id", "section_id").agg(F.bool_or(hit).alias("found"), F.min(F.when(hit, F.col("p_idx"))).alias("first_idx"))


def expanded_sections(paragraphs: DataFrame, heading: Column, wanted: DataFrame) -> DataFrame:
    """Paragraphs of the sections of wanted (doc_id, section_id)."""
    return section_ids(paragraphs, heading).join(wanted.select("doc_id", "section_id"), ["doc_id", "section_id"], "left_semi")


def expanded_refs(resolved: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Resolved references (doc_id, ref, p_idx) with their text; found is false where nothing is."""
    out = resolved.join(paragraphs.select("doc_id", "p_idx", "text"), ["doc_id", "p_idx"], "left")
    return out.select("doc_id", "ref", "p_idx", "text", F.col("text").isNotNull().alias("found"))


def paragraph_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, n_old, n_new, delta): numbers of paragraphs of two versions."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    both = count(old, "n_old").join(count(new, "n_new"), "doc_id", "full").fillna(0, ["n_old", "n_new"])
    return both.withColumn("delta", F.col("n_new") - F.col("n_old"))


# Notes, links, styles, references


def note_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, part, note_id, runs): a note's runs with their look, those of white space left out."""
    own = runs.where("note_id is not null and trim(text) <> ''")
    one = F.struct("p_idx", "r_idx", "text", F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("italic", F.lit(False)).alias("italic"))
    packed = own.groupBy("doc_id", "part", "note_id").agg(F.array_sort(F.collect_list(one)).alias("runs"))
    return packed.withColumn("runs", F.transform("runs", lambda x: F.struct(x["text"].alias("text"), x["bold"].alias("bold"), x["italic"].alias("italic"), x["p_idx"].alias("paragraph_index"))))


def note_html(notes: DataFrame) -> DataFrame:
    """note_runs() as HTML."""
    plain = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    wrap = lambda test, tag, t: F.when(test, F.concat(F.lit(f"<{tag}>"), t, F.lit(f"</{tag}>"))).otherwise(t)
    return notes.withColumn("html", F.array_join(F.transform("runs", lambda x: wrap(x["bold"], "b", wrap(x["italic"], "i", plain(x["text"])))), "")).drop("runs")


def note_matches(matches: DataFrame) -> DataFrame:
    """Matches in notes (with note_id) numbered within their note, and their paragraphs too."""
    note = Window.partitionBy("doc_id", "note_id").orderBy("p_idx", "pos")
    first = F.min("p_idx").over(Window.partitionBy("doc_id", "note_id"))
    return matches.withColumn("index", F.row_number().over(note) - 1).withColumn("note_p_idx", F.col("p_idx") - first)


def by_url(resolved: DataFrame, text: str) -> DataFrame:
    """Links whose target contains text; links without a target aren't found."""
    return containing(resolved, text, column="target")


def by_name(rows: DataFrame, name: str, column: str = "name", case_sensitive: bool = False) -> DataFrame:
    """Styles (or bookmarks) of a name."""
    return rows.where(F.col(column) == name) if case_sensitive else rows.where(F.lower(column) == name.lower())


def references_to(xrefs: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Bookmarks with the number of references that point at them."""
    n = xrefs.groupBy("doc_id", F.col("target").alias("name")).agg(F.count("*").alias("n_refs"))
    return bookmarks.join(n, ["doc_id", "name"], "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)).cast("long"))


def surroundings(text: Column, start: Column, length: Column, chars: int = 50) -> Column:
    """(before, matched, after): a match with up to chars characters on each side."""
    least = F.greatest(start - chars, F.lit(0))
    return F.struct(F.substring(text, least + 1, start - least).alias("before"), F.substring(text, start + 1, length).alias("matched"), F.substring(text, start + length + 1, F.lit(chars)).alias("after"))


# Links, contents, bookmarks and images that come and go


def links_inserted(links: DataFrame, relationships: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, relationships) with new ones: (doc_id, p_idx, text, url, anchor), either url or anchor. Ids go on from the greatest there are."""
    order = Window.partitionBy("doc_id").orderBy("p_idx", "text")
    top = links.groupBy("doc_id").agg(F.max("link_idx").alias("top"))
    rel = relationships.groupBy("doc_id").agg(F.max(F.expr("try_cast(regexp_extract(rel_id, '(\\\\d+)$', 1) as int)")).alias("rid"))
    rows = new.join(top, "doc_id", "left").join(rel, "doc_id", "left").withColumn("link_idx", F.coalesce("top", F.lit(-1)) + F.row_number().over(order))
    outside = F.sum(F.col("url").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("rel_id", F.when(F.col("url").isNotNull(), F.concat(F.lit("rId"), F.coalesce("rid", F.lit(0)) + outside)))
    more = rows.select("doc_id", "link_idx", "p_idx", "text", F.when(F.col("url").isNull(), F.col("anchor")).alias("anchor"), "rel_id")
    rels = rows.where("url is not null").select("doc_id", "rel_id", F.col("url").alias("target"))
    return links.select(*more.columns).unionByName(more), relationships.select(*rels.columns).unionByName(rels)


def link_texts(links: DataFrame, edits: DataFrame) -> DataFrame:
    """Links whose text is replaced by edits (doc_id, link_idx, value)."""
    out = links.join(edits.select("doc_id", "link_idx", "value"), ["doc_id", "link_idx"], "left")
    return out.withColumn("text", F.coalesce("value", "text")).drop("value")


def _contents(code: Column) -> Column:
    return F.upper(F.regexp_extract(code, r"^\s*(\w+)", 1)) == "TOC"


def contents_updated(fields: DataFrame, low: int | None = None, high: int | None = None, linked: bool | None = None) -> DataFrame:
    """Fields whose tables of contents take new levels or link switch, None keeps one, and are marked dirty."""
    code = F.col("code")
    if low is not None and high is not None:
        bare = F.trim(F.regexp_replace(code, r'\\o\s+"[^"]*"\s*', ""))
        code = F.concat(F.regexp_replace(bare, r"(?i)^(\s*TOC)\b", f'$1 \\\\o "{low}-{high}"'))
    if linked is not None:
        bare = F.trim(F.regexp_replace(code, r"\\h\b\s*", ""))
        code = F.concat(bare, F.lit(" \\h")) if linked else bare
    return fields.withColumn("dirty", F.col("dirty") | _contents(F.col("code"))).withColumn("code", F.when(_contents(F.col("code")), code).otherwise(F.col("code")))


def contents_removed(fields: DataFrame) -> DataFrame:
    return fields.where(~_contents(F.col("code")))


def marked_dirty(fields: DataFrame, kinds: tuple[str, ...] = ("REF", "PAGEREF", "NOTEREF")) -> tuple[DataFrame, DataFrame]:
    """(fields, (doc_id, n)): fields of some kinds marked to be computed anew, and how many; ("TOC",) for tables of contents."""
    mine = F.upper(F.regexp_extract("code", r"^\s*(\w+)", 1)).isin(*kinds)
    return fields.withColumn("dirty", F.col("dirty") | mine), fields.where(mine).groupBy("doc_id").agg(F.count("*").alias("n"))


def heading_bookmarks(paragraphs: DataFrame, bookmarks: DataFrame, prefix: str = "_Ref") -> DataFrame:
    """Bookmarks with one more for each heading paragraph that has none: a name from the heading's words, numbered where it repeats."""
    heads = paragraphs.where(F.col("style").startswith("Heading") & (F.trim("text") != "")).join(bookmarks.select("doc_id", "p_idx"), ["doc_id", "p_idx"], "left_anti")
    stem = F.substring(F.concat(F.lit(prefix), F.replace(F.initcap(F.regexp_replace("text", "[^A-Za-z0-9 ]", "")), F.lit(" "), F.lit(""))), 1, 32)
    k = F.row_number().over(Window.partitionBy("doc_id", "stem").orderBy("p_idx"))
    named = heads.withColumn("stem", stem).withColumn("name", F.when(k == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), k)))
    return bookmarks.select("doc_id", "name", "p_idx").unionByName(named.select("doc_id", "name", "p_idx"))


def images_inserted(images: DataFrame, relationships: DataFrame, parts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, relationships, parts) with new (doc_id, p_idx, name, extension, width_inches, height_inches): sizes in EMU, media numbered on."""
    number = F.expr("try_cast(regexp_extract(part, 'media/image(\\\\d+)', 1) as int)")
    media = parts.groupBy("doc_id").agg(F.max(number).alias("m"))
    rel = relationships.groupBy("doc_id").agg(F.max(F.expr("try_cast(regexp_extract(rel_id, '(\\\\d+)$', 1) as int)")).alias("r"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("p_idx", "name"))
    rows = new.join(media, "doc_id", "left").join(rel, "doc_id", "left").withColumn("k", k)
    rows = rows.withColumn("part", F.concat(F.lit("word/media/image"), F.coalesce("m", F.lit(0)) + F.col("k"), F.lit("."), "extension")).withColumn("rel_id", F.concat(F.lit("rId"), F.coalesce("r", F.lit(0)) + F.col("k")))
    emu = lambda c: F.round(F.col(c) * 914400).cast("long")
    image = rows.select("doc_id", "p_idx", "rel_id", emu("width_inches").alias("width"), emu("height_inches").alias("height"), "name")
    rels = rows.select("doc_id", "rel_id", F.substring("part", 6, 1 << 20).alias("target"))
    return images.select(*image.columns).unionByName(image), relationships.select(*rels.columns).unionByName(rels), parts.select("doc_id", "part").unionByName(rows.select("doc_id", "part"))


def image_json(images: DataFrame) -> DataFrame:
    """(doc_id, p_idx, image): an image's name and size in inches as JSON."""
    inches = lambda c: F.round(F.col(c) / 914400, 2)
    return images.select("doc_id", "p_idx", F.to_json(F.struct("name", inches("width").alias("width_inches"), inches("height").alias("height_inches"))).alias("image"))


# YAML of parts of a document


def table_yaml(cells: DataFrame, chars: int = 40) -> DataFrame:
    """(doc_id, tbl_idx, text): rows of a table as YAML lists, texts cut."""
    from inkloom.operators.export import quoted

    short = F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("..."))).otherwise(F.col("text"))
    row = cells.groupBy("doc_id", "tbl_idx", "row_idx").agg(F.array_sort(F.collect_list(F.struct("cell_idx", quoted(short).alias("t")))).alias("xs"))
    line = F.concat(F.lit("  - ["), F.array_join(F.transform("xs", lambda x: x["t"]), ", "), F.lit("]"))
    whole = row.select("doc_id", "tbl_idx", F.struct("row_idx", line.alias("line")).alias("r")).groupBy("doc_id", "tbl_idx").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return whole.select("doc_id", "tbl_idx", F.concat(F.lit("rows:\n"), F.array_join(F.transform("rs", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def section_yaml(members: DataFrame) -> DataFrame:
    """(doc_id, section_id, text): the paragraphs of a section (expanded_sections) by reference."""
    from inkloom.operators.export import quoted

    line = F.concat(F.lit("  - ref: p:"), F.col("p_idx"), F.lit("\n    text: "), quoted(F.col("text")))
    one = members.groupBy("doc_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("p_idx", line.alias("line")))).alias("xs"))
    return one.select("doc_id", "section_id", F.concat(F.lit("section: "), F.col("section_id"), F.lit("\ncontent:\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def refs_yaml(expanded: DataFrame) -> DataFrame:
    """(doc_id, text): expanded references, then those that weren't found."""
    from inkloom.operators.export import quoted

    line = F.when(F.col("found"), F.concat(F.lit("  - ref: "), F.col("ref"), F.lit("\n    text: "), quoted(F.col("text"))))
    lost = F.when(~F.col("found"), F.concat(F.lit("  - "), F.col("ref")))
    lines = lambda c: F.array_sort(F.collect_list(c))
    one = expanded.groupBy("doc_id").agg(lines(line).alias("xs"), lines(lost).alias("ys"))
    missing = F.when(F.size("ys") > 0, F.concat(F.lit("not_found:\n"), F.array_join("ys", "\n"), F.lit("\n"))).otherwise("")
    return one.select("doc_id", F.concat(F.lit("refs:\n"), F.array_join("xs", "\n"), F.lit("\n"), missing).alias("text"))
