"""Paragraph formatting with typed properties: read, merged, compared, changed as tracked rows.

Properties of a paragraph are columns of one row: alignment (left, center, right, justify), spacing before and
after in points, line spacing as a multiple, indents in inches, and tab stops as an array of (position in
inches, kind, leader). A null is a property that isn't set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators import tracked
from inkloom.sources import parts
from inkloom.sources.parts import attribute, joined

NUMBERS = ("spacing_before", "spacing_after", "line_spacing", "indent_left", "indent_right", "indent_first_line", "indent_hanging")
TABS = "array<struct<position: double, kind: string, leader: string>>"
PROPERTIES = {"alignment": "string", **dict.fromkeys(NUMBERS, "double"), "tab_stops": TABS}
ALIGNMENTS = ("left", "center", "right", "justify")


def complete(rows: DataFrame) -> DataFrame:
    """rows with all columns of PROPERTIES; both is another word for justify."""
    for c, kind in PROPERTIES.items():
        rows = rows.withColumn(c, (F.col(c) if c in rows.columns else F.lit(None)).cast(kind))
    return rows.withColumn("alignment", F.when(F.col("alignment") == "both", "justify").otherwise(F.col("alignment")))


def merged_tabs(base: Column, update: Column) -> Column:
    """Tab stops of both in order of position, those of the update where both have one; a stop of kind clear takes one away."""
    none = F.array().cast(TABS)
    base, update = F.coalesce(base, none), F.coalesce(update, none)
    kept = F.filter(base, lambda t: ~F.exists(update, lambda u: u["position"] == t["position"]))
    out = F.filter(F.array_sort(F.concat(kept, update)), lambda t: t["kind"] != "clear")
    return F.when(F.size(out) > 0, out)


def merged(base: dict[str, Column], update: dict[str, Column]) -> dict[str, Column]:
    """Properties of base with those that update sets."""
    return {c: merged_tabs(base[c], update[c]) if c == "tab_stops" else F.coalesce(update[c], base[c]) for c in PROPERTIES}


def differing(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Map of the properties that differ, to (old, new) as texts."""
    text = lambda c, v: F.to_json(F.struct(v.alias("v"))) if c == "tab_stops" else v.cast("string")
    pairs = F.array(*(F.when(~old[c].eqNullSafe(new[c]), F.struct(F.lit(c).alias("name"), F.struct(text(c, old[c]).alias("old"), text(c, new[c]).alias("new")).alias("change"))) for c in PROPERTIES))
    return F.map_from_entries(F.array_compact(pairs))


def format_paragraphs(paragraphs: DataFrame, properties: DataFrame, edits: DataFrame, author: str = "Inkloom", date: str = "2024-01-01T00:00:00Z", changes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(formatted, changes made, results): edits (doc_id, seq, containing, starting_with, ending_with, index, track, the columns of PROPERTIES).

    An edit formats the first paragraph of the body that meets all its conditions. formatted holds, for each paragraph that was formatted, its
    properties before (old) and after all edits, and the last tracked change of it: (doc_id, part, p_idx, old, change_id, …). An edit that
    changes nothing succeeds and makes no change. properties: (doc_id, part, p_idx, …) as packages have them; paragraphs without have none.
    """
    for c, kind in {"containing": "string", "starting_with": "string", "ending_with": "string", "index": "int", "track": "boolean"}.items():
        edits = edits.withColumn(c, (F.col(c) if c in edits.columns else F.lit(None)).cast(kind))
    e = complete(edits).withColumn("track", F.coalesce("track", F.lit(True)))
    wrong = (
        F.when(F.coalesce("containing", "starting_with", "ending_with", F.col("index").cast("string")).isNull(), "give containing, starting_with, ending_with or index")
        .when(F.coalesce(*(F.col(c).cast("string") if c != "tab_stops" else F.to_json(c) for c in PROPERTIES)).isNull(), "no property given")
        .when(F.col("alignment").isNotNull() & ~F.col("alignment").isin(*ALIGNMENTS), joined("unknown alignment: ", F.col("alignment")))
    )
    e = e.withColumn("wrong", wrong)
    body = (paragraphs if "part" in paragraphs.columns else paragraphs.withColumn("part", F.lit(tracked.BODY))).where(F.col("part") == tracked.BODY)
    asked = e.where("wrong is null").groupBy("doc_id").agg(F.collect_list(F.struct("seq", "containing", "starting_with", "ending_with", "index")).alias("asked"))

    def meets(x: Column) -> Column:
        text = F.coalesce("text", F.lit(""))
        tests = (F.contains(text, x["containing"]), F.startswith(text, x["starting_with"]), F.endswith(text, x["ending_with"]), F.col("p_idx") == x["index"])
        out = F.lit(True)
        for test in tests:
            out &= F.coalesce(test, F.lit(True))
        return out

    hits = body.select("doc_id", "p_idx", "text").join(asked, "doc_id").select("doc_id", "p_idx", F.explode(F.transform(F.filter("asked", meets), lambda x: x["seq"])).alias("seq"))
    at = hits.groupBy("doc_id", "seq").agg(F.min("p_idx").alias("p_idx"))
    e = e.join(at, ["doc_id", "seq"], "left").withColumn("wrong", F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.col("p_idx").isNull(), joined("no such paragraph: ", F.coalesce("containing", "starting_with", "ending_with", F.col("index").cast("string")))))
    fit = e.where("wrong is null")
    had = complete(properties.where(F.col("part") == tracked.BODY) if "part" in properties.columns else properties).select("doc_id", "p_idx", *(F.col(c).alias(f"had_{c}") for c in PROPERTIES))
    rows = fit.join(had, ["doc_id", "p_idx"], "left")
    # What a paragraph has after each of its edits: the last that was set up to then, or what it had.
    upto = Window.partitionBy("doc_id", "p_idx").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("doc_id", "p_idx").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    for c in PROPERTIES:
        if c == "tab_stops":
            fold = lambda w: F.aggregate(F.collect_list(F.coalesce("tab_stops", F.array().cast(TABS))).over(w), F.col("had_tab_stops"), merged_tabs)
        else:
            fold = lambda w, c=c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"had_{c}"))
        rows = rows.withColumns({f"new_{c}": fold(upto), f"was_{c}": fold(before)})
    changed = ~F.lit(True)
    for c in PROPERTIES:
        changed |= ~F.col(f"was_{c}").eqNullSafe(F.col(f"new_{c}"))
    rows = rows.withColumn("changed", changed)
    tops = fit.select("doc_id").distinct().withColumn("top", F.lit(0)) if changes is None else fit.select("doc_id").distinct().join(tracked.top_ids(changes), "doc_id", "left").withColumn("top", F.coalesce("top", F.lit(0)))
    number = F.sum((F.col("changed") & F.col("track")).cast("int")).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.join(tops, "doc_id").withColumn("change_id", F.when(F.col("changed") & F.col("track"), (F.col("top") + number).cast("string")))
    rows = tracked.written(rows.drop("top"), "formatted")
    made = rows.where("change_id is not null").select("doc_id", F.lit(tracked.BODY).alias("part"), "p_idx", "seq", "change_id", F.lit("format_paragraph").alias("change_type"), F.lit(author).alias("author"), F.lit(date).alias("date"), F.lit("").alias("text"))
    every = ("seq", "changed", *(f"new_{c}" for c in PROPERTIES), *(f"had_{c}" for c in PROPERTIES))
    last = rows.groupBy("doc_id", "p_idx").agg(F.max_by(F.struct(*every), "seq").alias("x"), F.max_by("change_id", F.when(F.col("change_id").isNotNull(), F.col("seq"))).alias("change_id"), F.bool_or("changed").alias("any"))
    formatted = last.where("any").select("doc_id", F.lit(tracked.BODY).alias("part"), "p_idx", F.struct(*(F.col(f"x.had_{c}").alias(c) for c in PROPERTIES)).alias("old"), "change_id", F.lit(author).alias("author"), F.lit(date).alias("date"), *(F.col(f"x.new_{c}").alias(c) for c in PROPERTIES))
    said = e.join(rows.select("doc_id", "seq", "changed"), ["doc_id", "seq"], "left")
    return formatted, made, said.select("doc_id", "seq", F.col("wrong").isNull().alias("success"), F.coalesce("wrong", F.when(F.col("changed"), "formatted 1").otherwise("nothing to change")).alias("message"))


def saved(formatted: DataFrame) -> DataFrame:
    """Patches (sources.parts) that bring paragraphs of packages to their new properties, tracked where they have a change_id."""
    twips = lambda c, per: F.round(F.col(c) * per).cast("long").cast("string")
    one = lambda name, c, per: F.when(F.col(c).isNotNull(), joined(f' w:{name}="', twips(c, per), '"')).otherwise("")
    tag = lambda name, attributes: F.when(attributes != "", joined(f"<w:{name}", attributes, "/>")).otherwise("")
    jc = F.when(F.col("alignment").isNotNull(), joined('<w:jc w:val="', F.when(F.col("alignment") == "justify", "both").otherwise(F.col("alignment")), '"/>')).otherwise("")
    spacing = joined(one("before", "spacing_before", 20), one("after", "spacing_after", 20), one("line", "line_spacing", 240), F.when(F.col("line_spacing").isNotNull(), ' w:lineRule="auto"').otherwise(""))
    indent = joined(one("left", "indent_left", 1440), one("right", "indent_right", 1440), one("firstLine", "indent_first_line", 1440), one("hanging", "indent_hanging", 1440))
    stop = lambda t: joined('<w:tab w:val="', attribute(F.coalesce(t["kind"], F.lit("left"))), '"', F.when(t["leader"].isNotNull(), joined(' w:leader="', attribute(t["leader"]), '"')).otherwise(""), ' w:pos="', F.round(t["position"] * 1440).cast("long").cast("string"), '"/>')
    tabs = F.when(F.size("tab_stops") > 0, joined("<w:tabs>", F.array_join(F.transform("tab_stops", stop), ""), "</w:tabs>")).otherwise("")
    change = F.when(F.col("change_id").isNotNull(), joined('<w:pPrChange w:id="', F.col("change_id"), '" w:author="', attribute(F.col("author")), '" w:date="', F.col("date"), '"/>')).otherwise("")
    xml = joined("<w:pPr>", tabs, tag("spacing", spacing), tag("ind", indent), jc, change, "</w:pPr>")
    return parts.patches(formatted, "properties", part="part", p_idx="p_idx", seq=F.lit(0), xml=xml)
