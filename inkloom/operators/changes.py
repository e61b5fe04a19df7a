"""Tracked changes: listing, statistics, accepting and rejecting, groups and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of changes in the order of listings, and their short names.
ORDER = ["insertion", "deletion", "move_from", "move_to", "format_run", "format_paragraph"]
SHORT = {"insertion": "insert", "deletion": "delete", "move_from": "move_from", "move_to": "move_to", "format_run": "format", "format_paragraph": "format"}


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def listing(changes: DataFrame, change_type: str | None = None, author: str | None = None) -> DataFrame:
    """Changes by kind, then in document order, with rank (from 0) within their document."""
    if change_type is not None and change_type not in ORDER:
        raise ValueError(f"change_type must be one of {ORDER}")
    rows = changes.where(test(change_type, author))
    kind = F.array_position(F.array(*map(F.lit, ORDER)), F.col("change_type"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(kind, "change_id")) - 1)


def test(change_type: str | None = None, author: str | None = None) -> Column:
    out = F.lit(True)
    if change_type is not None:
        out &= F.col("change_type") == change_type
    if author is not None:
        out &= F.col("author") == author
    return out


def containing(text: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    """Changes whose text holds or matches a text; format changes have none."""
    if not text:
        raise ValueError("nothing to look for")
    body = F.when(F.col("change_type").startswith("format"), F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    if regex:
        return body.rlike(("" if case_sensitive else "(?iu)") + "(?U)" + text)
    return F.contains(body if case_sensitive else F.lower(body), F.lit(text if case_sensitive else text.lower()))


def parsed_date(date: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(date, F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp(date))


def has_changes(changes: DataFrame) -> DataFrame:
    """(doc_id): documents with insertions, deletions or moves; format changes don't count."""
    return changes.where(~F.col("change_type").startswith("format")).select("doc_id").distinct()


def statistics(changes: DataFrame) -> DataFrame:
    """(doc_id, insertions, deletions, moves, formats, total)."""
    short = lookup(SHORT, F.col("change_type"))
    return changes.groupBy("doc_id").agg(
        F.count_if(short == "insert").alias("insertions"), F.count_if(short == "delete").alias("deletions"),
        F.count_if(short == "move_from").alias("moves"), F.count_if(short == "format").alias("formats"), F.count("*").alias("total"),
    )


def grouped(changes: DataFrame, by: str) -> DataFrame:
    """(doc_id, key, n, ids): changes by author (null is Unknown) or by kind, ids in order."""
    key = F.coalesce("author", F.lit("Unknown")) if by == "author" else lookup(SHORT, F.col("change_type"))
    return changes.groupBy("doc_id", key.alias("key")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("change_id")).alias("ids"))


def report_sets(changes: DataFrame) -> DataFrame:
    """(author, kind, n): totals by author, by kind, and of all, in one pass."""
    rows = changes.select(F.coalesce("author", F.lit("Unknown")).alias("author"), lookup(SHORT, F.col("change_type")).alias("kind"))
    return rows.groupingSets([["author"], ["kind"], []], "author", "kind").agg(F.count("*").alias("n"))


def next_id(changes: DataFrame) -> DataFrame:
    """(doc_id, next_id): one above the greatest numeric id."""
    return changes.groupBy("doc_id").agg((F.coalesce(F.max(F.expr("try_cast(change_id as int)")), F.lit(0)) + 1).alias("next_id"))


def duplicate_ids(changes: DataFrame) -> DataFrame:
    return changes.groupBy("doc_id", "change_id").agg(F.count("*").alias("n")).where("n > 1")


def decided(runs: DataFrame, accept: bool, chosen: Column | None = None) -> DataFrame:
    """Runs once changes are accepted or rejected; chosen limits which (a predicate on runs).

    runs: (…, text, del_text, in_ins, in_del, change_id) and perhaps bold, italic, color with their
    old_ values. Accepting keeps insertions and drops deletions; rejecting is the reverse, and takes
    formats back.
    """
    chosen = F.lit(True) if chosen is None else F.coalesce(chosen, F.lit(False))
    gone = F.col("in_del") if accept else F.col("in_ins")
    kept = runs.where(~(chosen & gone))
    back = chosen & (F.col("in_ins") if accept else F.col("in_del"))
    out = kept.withColumns({
        "text": F.when(back & F.col("in_del"), F.col("del_text")).otherwise(F.col("text")), "del_text": F.when(back, F.lit("")).otherwise(F.col("del_text")),
        "in_ins": F.col("in_ins") & ~back, "in_del": F.col("in_del") & ~back, "change_id": F.when(back, F.lit(None)).otherwise(F.col("change_id")),
    })
    for name in ("bold", "italic", "color"):
        if f"old_{name}" in runs.columns:
            # A run whose format changed has an old value; rejecting restores it.
            if not accept:
                out = out.withColumn(name, F.when(chosen, F.coalesce(f"old_{name}", name)).otherwise(F.col(name)))
            out = out.withColumn(f"old_{name}", F.when(chosen, F.lit(None)).otherwise(F.col(f"old_{name}")))
    return out


def decided_changes(changes: DataFrame, accept: bool, chosen: Column | None = None, moves: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changes left, (doc_id, n) decided). Moves stay unless asked for."""
    chosen = F.lit(True) if chosen is None else F.coalesce(chosen, F.lit(False))
    if not moves:
        chosen &= ~F.col("change_type").startswith("move")
    return changes.where(~chosen), changes.where(chosen).groupBy("doc_id").agg(F.count("*").alias("n"))


def decided_groups(runs: DataFrame, members: DataFrame, accept: bool, *names: str) -> tuple[DataFrame, DataFrame]:
    """(runs, (doc_id, group_name, n) decided) once the changes of some groups are accepted or rejected.

    members: (doc_id, change_id, group_name), as edits record it (tracked.members) or as it was saved; ids that the runs no longer have count for nothing.
    """
    chosen = members.where(F.col("group_name").isin(*names)).select("doc_id", F.col("change_id").cast("string").alias("change_id"), "group_name").distinct()
    mine = chosen.select("doc_id", "change_id").distinct().withColumn("_mine", F.lit(True))
    marked = runs.join(mine, ["doc_id", "change_id"], "left").withColumn("_mine", F.coalesce("_mine", F.lit(False)))
    counted = runs.where("change_id is not null").select("doc_id", F.col("change_id").cast("string").alias("change_id")).distinct().join(chosen, ["doc_id", "change_id"]).groupBy("doc_id", "group_name").agg(F.count("*").alias("n"))
    return decided(marked, accept, F.col("_mine")).drop("_mine").select(*runs.columns), counted


def groups(changes: DataFrame) -> DataFrame:
    """(doc_id, group_name, ids, n) of changes with a group_name."""
    return changes.where("group_name is not null").groupBy("doc_id", "group_name").agg(F.sort_array(F.collect_list("change_id")).alias("ids"), F.count("*").alias("n"))


def escaped(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _lines(changes: DataFrame, line: Column, by: str | None) -> DataFrame:
    key = F.lit("") if by is None else F.coalesce("author", F.lit("Unknown")) if by == "author" else lookup(SHORT, F.col("change_type"))
    rows = changes.select("doc_id", F.struct(key.alias("key"), F.col("change_id").alias("id"), line.alias("line")).alias("x"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("x")).alias("xs"))


def report_json(changes: DataFrame, title: str | None = None) -> DataFrame:
    """(doc_id, report): title, total_changes, summary and changes as JSON."""
    one = F.struct("change_id", lookup(SHORT, F.col("change_type")).alias("type"), F.coalesce("author", F.lit("Unknown")).alias("author"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "text")
    rows = changes.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("changes"), F.count("*").alias("n"))
    count = lambda k: F.size(F.filter("changes", lambda c: c["type"] == k)).alias(k)
    kinds = ("insert", "delete", "move_from", "move_to", "format")
    return rows.select("doc_id", F.to_json(F.struct(F.lit(title or "Change report").alias("title"), F.col("n").alias("total_changes"), F.struct(*map(count, kinds)).alias("summary"), "changes")).alias("report"))


def report_markdown(changes: DataFrame, by: str | None = None, title: str = "Change report") -> DataFrame:
    """(doc_id, report)."""
    line = F.concat(F.lit("- **"), lookup(SHORT, F.col("change_type")), F.lit("** by "), F.coalesce("author", F.lit("Unknown")), F.lit(" on "), F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("unknown date")), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 100))
    rows = _lines(changes, line, by)
    heads = F.transform(F.col("xs"), lambda x, i: F.concat(F.when((F.lit(by is not None)) & ((i == 0) | (x["key"] != F.get("xs", i - 1)["key"])), F.concat(F.lit("\n## "), x["key"], F.lit("\n"))).otherwise(""), x["line"]))
    return rows.select("doc_id", F.concat(F.lit(f"# {title}\n\nTotal changes: "), F.col("n"), F.lit("\n"), F.array_join(heads, "\n"), F.lit("\n")).alias("report"))


def report_html(changes: DataFrame, by: str | None = None, title: str = "Change report") -> DataFrame:
    """(doc_id, report)."""
    line = F.concat(F.lit('<li class="'), lookup(SHORT, F.col("change_type")), F.lit('"><b>'), escaped(F.coalesce("author", F.lit("Unknown"))), F.lit("</b> "), escaped(F.coalesce("text", F.lit(""))), F.lit("</li>"))
    rows = _lines(changes, line, by)
    body = F.array_join(F.transform("xs", lambda x: x["line"]), "")
    return rows.select("doc_id", F.concat(F.lit(f"<html><body><h1>{title}</h1><p>"), F.col("n"), F.lit(" changes</p><ul>"), body, F.lit("</ul></body></html>")).alias("report"))
