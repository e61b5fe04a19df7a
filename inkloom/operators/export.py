"""Documents as text: plain, Markdown, YAML outlines; built by ordered string aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T


def joined(rows: DataFrame, line: Column, order: list[str], separator: str = "\n") -> DataFrame:
    """(doc_id, text): the lines of each document in order."""
    one = F.struct(*order, line.alias("_line"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["_line"]), separator).alias("text"))


def table_lines(cells: DataFrame) -> DataFrame:
    """(doc_id, tbl_idx, row_idx, line, n): rows as pipe tables, with a rule below the first."""
    row = cells.groupBy("doc_id", "tbl_idx", "row_idx").agg(F.array_sort(F.collect_list(F.struct("cell_idx", "text"))).alias("xs"))
    bar = F.concat(F.lit("| "), F.array_join(F.transform("xs", lambda x: F.replace(F.replace(x["text"], F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size("xs")))
    return row.select("doc_id", "tbl_idx", "row_idx", F.concat(bar, F.when(F.col("row_idx") == 0, rule).otherwise("")).alias("line"), F.size("xs").alias("n"))


def _with_tables(paragraphs: DataFrame, line: Column) -> DataFrame:
    """(doc_id, p_idx, line): lines of body paragraphs, and each table where its first paragraph stands."""
    body = paragraphs.where("tbl_idx is null").select("doc_id", "p_idx", line.alias("line"))
    cells = paragraphs.where("tbl_idx is not null").groupBy("doc_id", "tbl_idx", "row_idx", "cell_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    place = paragraphs.where("tbl_idx is not null").groupBy("doc_id", "tbl_idx").agg(F.min("p_idx").alias("p_idx"))
    tables = table_lines(cells).groupBy("doc_id", "tbl_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n").alias("line"))
    return body.unionByName(tables.join(place, ["doc_id", "tbl_idx"]).select("doc_id", "p_idx", "line"))


def markdown(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, text): headings with #, list items with -, pipe tables; a line break at the end."""
    level = T.style_level(F.col("style"))
    line = F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text"))).when(F.col("style") == "ListParagraph", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    out = joined(_with_tables(paragraphs, line).where("line <> ''"), F.col("line"), ["p_idx"], "\n\n")
    return out.select("doc_id", F.concat("text", F.lit("\n")).alias("text"))


def plain(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, text): first-level headings underlined with =, others with -."""
    level = T.style_level(F.col("style"))
    line = F.when(level.isNotNull(), F.concat(F.col("text"), F.lit("\n"), F.repeat(F.when(level == 1, "=").otherwise("-"), F.length("text")))).otherwise(F.col("text"))
    out = joined(_with_tables(paragraphs, line).where("line <> ''"), F.col("line"), ["p_idx"], "\n\n")
    return out.select("doc_id", F.concat("text", F.lit("\n")).alias("text"))


def quoted(text: Column) -> Column:
    """A text as a YAML scalar in double quotes."""
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def outline_yaml(sections: DataFrame) -> DataFrame:
    """(doc_id, text): sections (as structure.sections gives them) with their extent and preview."""
    item = F.concat(F.lit("  - heading: "), quoted(F.col("heading")), F.lit("\n    paragraphs: "), F.col("n_paragraphs"), F.lit("\n    start: p:"), F.col("start_idx"), F.lit("\n    preview: "), quoted(F.col("preview")))
    out = joined(sections, item, ["section_id"])
    return out.select("doc_id", F.concat(F.lit("sections:\n"), F.col("text"), F.lit("\n")).alias("text"))


def tree_yaml(nodes: DataFrame, verbose: bool = False) -> DataFrame:
    """(doc_id, text): nodes by reference; verbose adds their properties."""
    item = F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), F.lit("- "), F.col("element_type"), F.lit(" "), quoted(F.col("text")), F.lit(" [ref="), F.col("ref"), F.lit("]"))
    if verbose:
        item = F.concat(item, F.lit(" "), F.to_json("properties"))
    out = joined(nodes, item, ["ref"])
    return out.select("doc_id", F.concat(F.lit("document:\n"), F.col("text"), F.lit("\n")).alias("text"))


def search_yaml(matches: DataFrame) -> DataFrame:
    item = F.concat(F.lit("  - paragraph: "), F.col("p_idx"), F.lit("\n    found: "), quoted(F.col("found")), F.lit("\n    context: "), quoted(F.col("context")))
    out = joined(matches, item, ["index"])
    return out.select("doc_id", F.concat(F.lit("matches:\n"), F.col("text"), F.lit("\n")).alias("text"))


def table_from(rows: DataFrame, columns: list[str], key: str, order: list[str]) -> DataFrame:
    """(doc_id, tbl_idx, row_idx, cell_idx, text): the rows of a DataFrame as a table for each key, with a header row."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    cells = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    numbered = rows.select(F.col(key).alias("doc_id"), F.row_number().over(w).alias("row_idx"), cells.alias("cells"))
    body = numbered.select("doc_id", "row_idx", F.posexplode("cells").alias("cell_idx", "text"))
    head = rows.select(F.col(key).alias("doc_id")).distinct().select("doc_id", F.lit(0).alias("row_idx"), F.posexplode(F.array(*map(F.lit, columns))).alias("cell_idx", "text"))
    return head.unionByName(body).select("doc_id", F.lit(0).alias("tbl_idx"), "row_idx", "cell_idx", "text")
