"""Edits as rows: runs split at the edges of what an edit touches, and a row for each tracked change.

An edit is joined with the paragraphs of its document, its matches become spans (places in the visible
text), and spans split runs. What a tracked edit deletes stays as a deleted run, what it inserts is a
run of its own; untracked edits drop and insert. Everything is a join, an explode or a window within a
paragraph. An edit sees what those before it left, yet most edits of a batch don't meet: `apply` makes, in
one round, all edits of a document up to the first that one before it may touch (conflicts), then looks for
the rest in what it wrote. Documents without edits left aren't written again.

Literal text is searched by built-in functions; regular expressions are Python's, over the paragraphs in
their scope, so that look-around sees the whole paragraph and a pattern that can't be read fails alone.

Runs come from sources.docx (or any table of doc_id, part, p_idx, r_idx, text, del_text, in_ins, in_del,
change_id, author, date, bold, italic); part tells the body from headers, footers and notes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkloom.operators import diff
from inkloom.sources.tables import written

KEYS = ["doc_id", "part", "p_idx"]
BODY = "word/document.xml"
RUN = {
    "text": "string", "del_text": "string", "in_ins": "boolean", "in_del": "boolean", "change_id": "string", "author": "string", "date": "string", "bold": "boolean", "italic": "boolean",
    "old_bold": "boolean", "old_italic": "boolean",
    # Where an edited run comes from: the run's number as read, whether it is unchanged, only a copy of its look, newly marked, with what, newly formatted.
    "src": "int", "same": "boolean", "copied": "boolean", "fresh": "boolean", "mark": "string", "formatted": "boolean",
}
EDIT = {"minimal": "boolean", "seq": "int", "type": "string", "find": "string", "replace": "string", "text": "string", "after": "string", "before": "string", "occurrence": "string", "regex": "boolean", "track": "boolean", "author": "string", "scope": "string", "ref": "string"}
TYPES = ("insert", "delete", "replace", "move", "format")
#: Scopes that name a kind of part.
PARTS = {"body": BODY, "headers": "word/header%", "footers": "word/footer%", "footnotes": "word/footnotes.xml", "endnotes": "word/endnotes.xml"}


#: Tables of more rows aren't broadcast. Spark takes their size from their files, which are small where rows are alike: 670,000 edits of 0.5 MB were 100 MB once broadcast.
MANY = 100_000


def unsent(df: DataFrame, rows: int) -> DataFrame:
    """df as one side of a join: merged instead of broadcast if what it is made from has many rows."""
    return df.hint("merge") if rows > MANY else df


def prepared(runs: DataFrame) -> DataFrame:
    """Runs with all columns of RUN, as they are before any edit."""
    out = runs.withColumn("part", F.lit(BODY)) if "part" not in runs.columns else runs
    fresh = {"src": F.col("r_idx"), "same": F.lit(True), "copied": F.lit(False), "fresh": F.lit(False), "mark": F.lit(None), "formatted": F.lit(False)}
    for c, kind in RUN.items():
        if c not in out.columns:
            out = out.withColumn(c, fresh.get(c, F.lit(None)).cast(kind))
    extra = ["note_id"] if "note_id" in out.columns else []
    return out.select(*KEYS, "r_idx", *extra, *(F.col(c).cast(k).alias(c) for c, k in RUN.items()))


def visible(runs: DataFrame) -> DataFrame:
    """(doc_id, part, p_idx, text): what a reader sees of each paragraph that has runs."""
    one = F.struct("r_idx", F.coalesce("text", F.lit("")).alias("t"))
    note = [F.first("note_id").alias("note_id")] if "note_id" in runs.columns else []
    return runs.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "").alias("text"), *note)


def in_scope(scope: Column, text: Column, part: Column, note: Column, section: Column, table: Column) -> Column:
    """Whether a paragraph lies in an edit's scope: null is the body; body, headers, footers, footnotes, endnotes, footnote:N,
    endnote:N name parts; tables, table:N the tables of the body; section:NAME, paragraph_containing:TEXT and plain texts choose paragraphs of the body."""
    body = part == BODY
    rest = F.regexp_replace(scope, "^[a-z_]+:", "")
    out = F.when(scope.isNull(), body)
    for name, pattern in PARTS.items():
        out = out.when(scope == name, part.like(pattern))
    for kind in ("footnote", "endnote"):
        out = out.when(scope.startswith(kind + ":"), (part == f"word/{kind}s.xml") & note.eqNullSafe(rest))
    out = out.when(scope == "tables", body & table.isNotNull()).when(scope.startswith("table:"), body & table.cast("string").eqNullSafe(rest))
    out = out.when(scope.startswith("section:"), body & F.coalesce(F.contains(section, rest), F.lit(False)))
    return out.when(scope.startswith("paragraph_containing:"), body & F.contains(text, rest)).otherwise(body & F.contains(text, scope))


_STEPS = "array<struct<gap: int, found: string, new: string>>"


def _regex_steps(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds steps to (…, t, find, new): each match that isn't empty, the characters since the one before it, and what goes in its place."""
    for d in rows:
        steps = []
        for text, find, new in zip(d["t"], d["find"], d["new"], strict=True):
            at, found = 0, []
            for m in re.finditer(find, text):
                if m.group():
                    found.append((m.start() - at, m.group(), None if new is None else m.expand(new)))
                    at = m.end()
            steps.append(found)
        yield d.assign(steps=steps).drop(columns=["t", "find", "new"])


@F.pandas_udf(StringType())
def unreadable(find: pd.Series, new: pd.Series) -> pd.Series:
    """Why a regular expression or its replacement can't be read; null if both can."""

    def why(f: str | None, n: str | None) -> str | None:
        try:
            if f is not None:
                re.compile(f).sub(n or "", "")
        except (re.error, IndexError, OverflowError, RecursionError) as error:
            return f"regular expression can't be read: {error}"
        return None

    return pd.Series([why(f, n) for f, n in zip(find, new, strict=True)], dtype=object)


def quoted(find: Column) -> Column:
    """A pattern that matches a text as it is."""
    return F.concat(F.lit("\\Q"), F.replace(find, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def matches(paragraphs: DataFrame, edits: DataFrame, regex: bool = True, many: int = 0) -> DataFrame:
    """(doc_id, seq, part, p_idx, start, end, found, new, n, of): places of each edit's search text that don't overlap, numbered in document order.

    edits: (doc_id, seq, find, regex, scope, ref, new); ref (p:N) keeps the search to one paragraph. new has \\1 and \\g<name> filled from
    the groups of a regular expression. regex: whether any edit has one; many: how many edits there are, if known. A paragraph meets its document's edits in one row and leaves with those it contains.
    """
    for c, kind in (("note_id", "string"), ("section", "string"), ("tbl_idx", "int")):
        if c not in paragraphs.columns:
            paragraphs = paragraphs.withColumn(c, F.lit(None).cast(kind))
    asked = edits.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "find", "regex", "scope", "ref", "new")).alias("asked"))
    lines = paragraphs.select(*KEYS, F.col("text").alias("t"), "note_id", "section", "tbl_idx").join(unsent(asked, many), "doc_id")

    def wanted(e: Column) -> Column:
        there = F.contains("t", e["find"]) | e["regex"]
        here = e["ref"].isNull() | (e["ref"] == F.concat(F.lit("p:"), F.col("p_idx")))
        return there & here & in_scope(e["scope"], F.col("t"), F.col("part"), F.col("note_id"), F.col("section"), F.col("tbl_idx"))

    near = lines.select(*KEYS, "t", F.explode(F.filter("asked", wanted)).alias("e")).select(*KEYS, "t", "e.seq", "e.find", "e.regex", "e.new")
    plain = near.where(~F.col("regex")).withColumn("pattern", quoted(F.col("find")))
    gaps = F.transform(F.expr("split(t, pattern, -1)"), F.length)
    steps = F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda g: F.struct(g.alias("gap"), F.col("find").alias("found"), F.col("new").alias("new")))
    rows = plain.select(*KEYS, "seq", steps.alias("steps"))
    if regex:
        kind = dict(paragraphs.dtypes)
        some = near.where("regex").select(*KEYS, "seq", "t", "find", "new")
        rows = rows.unionByName(some.mapInPandas(_regex_steps, f"doc_id {kind['doc_id']}, part string, p_idx {kind['p_idx']}, seq int, steps {_STEPS}"))
    rows = rows.select(*KEYS, "seq", F.posexplode("steps").alias("k", "x"))
    ahead = F.sum(F.col("x.gap") + F.length("x.found")).over(Window.partitionBy("doc_id", "seq", "part", "p_idx").orderBy("k"))
    order = Window.partitionBy("doc_id", "seq").orderBy(F.col("part") != BODY, "part", "p_idx", "end")
    rows = rows.withColumn("end", ahead.cast("int")).select("doc_id", "seq", "part", "p_idx", (F.col("end") - F.length("x.found")).alias("start"), "end", "x.found", "x.new")
    return rows.withColumn("n", F.row_number().over(order)).withColumn("of", F.count("*").over(Window.partitionBy("doc_id", "seq")).cast("int"))


def numbers(occurrence: Column) -> Column:
    """The numbers that an occurrence lists: 2, or [1, 3]; null for what is no number."""
    return F.transform(F.split(F.regexp_replace(occurrence, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("int"))


def picked(occurrence: Column) -> Column:
    """Whether a match (n, of) is one that an edit's occurrence names: first (by default), last, all, a number from 1 or a list of them."""
    which = F.coalesce(occurrence, F.lit("first"))
    return F.when(which == "first", F.col("n") == 1).when(which == "last", F.col("n") == F.col("of")).when(which == "all", True).otherwise(F.coalesce(F.array_contains(numbers(which), F.col("n")), F.lit(False)))


def beyond(occurrence: Column, of: Column) -> Column:
    """Whether an occurrence names a match that isn't there."""
    listed = ~F.coalesce(occurrence, F.lit("first")).isin("first", "last", "all")
    return listed & F.exists(numbers(occurrence), lambda i: i.isNull() | (i < 1) | (i > of))


def chosen(hits: DataFrame, occurrence: Column) -> DataFrame:
    """The matches that an edit's occurrence names."""
    return hits.where(picked(occurrence))


#: Stands between stretches that no edit touched; no text holds it.
_SEPARATOR = "\uffff"


def conflicts(lines: DataFrame, asked: DataFrame, spans: DataFrame, many: int = 0) -> DataFrame:
    """(doc_id, cut): the least number of an edit that may have to see what one before it does; documents without such aren't there.

    lines: (doc_id, part, p_idx, text); asked: (doc_id, seq, find, regex, minimal, scope, ref), a move's two texts under one number; spans: what each edit would
    change now. Within a paragraph an edit is clear of those before it if all places of its text, overlapping ones too, lie in stretches
    that they leave alone, and the text as they leave it has no more of them. Spans that touch are conflicts, as are regular expressions and scopes
    that look for text, once anything before them changes, and a minimal edit once its paragraph does. What is left out is only what can't matter, so rounds may be more than needed, never fewer.
    """
    reach = F.array_sort(F.collect_list(F.struct("start", "end", "seq", F.when(F.col("kind") == "format", F.col("found")).otherwise(F.coalesce("new", F.lit(""))).alias("new"))))
    touched = spans.groupBy(*KEYS).agg(reach.alias("spans"))
    static = F.col("scope").isNull() | F.col("scope").isin(*PARTS, "tables") | F.col("scope").rlike("^(footnote|endnote|table|section):")
    edits = asked.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "find", "ref", "minimal", F.coalesce(F.col("regex") | ~static, F.lit(True)).alias("late"))).alias("edits"))
    edits, touched = unsent(edits, many), unsent(touched, many)
    first = spans.groupBy("doc_id").agg(F.min("seq").alias("first"))
    # Regular expressions and scopes that look for text wait for whatever comes before them, in any paragraph.
    late = edits.join(first, "doc_id").select("doc_id", F.array_min(F.transform(F.filter("edits", lambda e: e["late"] & (e["seq"] > F.col("first"))), lambda e: e["seq"])).alias("cut"))
    rows = touched.join(lines.select(*KEYS, "text"), KEYS).join(edits, "doc_id")

    def meets(e: Column) -> Column:
        before = F.filter("spans", lambda x: x["seq"] < e["seq"])
        start = lambda i: F.coalesce(F.get(before, i - 1)["end"], F.lit(0))
        stretch = lambda x, i: F.substr("text", start(i) + 1, F.greatest(x["start"] - start(i), F.lit(0)))
        tail = F.substr("text", start(F.size(before)) + 1)
        left = F.concat(F.array_join(F.transform(before, lambda x, i: F.concat(stretch(x, i), F.lit(_SEPARATOR))), ""), tail)
        now = F.concat(F.array_join(F.transform(before, lambda x, i: F.concat(stretch(x, i), x["new"])), ""), tail)
        pattern = F.concat(F.lit("(?="), quoted(e["find"]), F.lit(")"))
        count = lambda text: F.regexp_count(text, pattern)
        some = F.contains("text", e["find"]) | F.contains(now, e["find"])
        return (F.size(before) > 0) & some & (e["minimal"] | (count(F.col("text")) != count(left)) | (count(now) != count(left)))

    here = lambda e: (e["ref"].isNull() | (e["ref"] == F.concat(F.lit("p:"), F.col("p_idx")))) & ~e["late"]
    seqs = lambda xs: F.transform(xs, lambda x: x["seq"])
    met = seqs(F.filter("edits", lambda e: here(e) & meets(e)))
    nearest = lambda x, i: F.array_min(F.transform(F.filter(F.slice("spans", F.lit(1), i), lambda y: (y["end"] >= x["start"]) & (y["seq"] != x["seq"])), lambda y: F.greatest(x["seq"], y["seq"])))
    cuts = rows.select("doc_id", F.array_min(F.concat(met, F.transform("spans", nearest))).alias("cut"))
    return cuts.unionByName(late).groupBy("doc_id").agg(F.min("cut").alias("cut")).where("cut is not null")


def _cut(runs: DataFrame, spans: DataFrame, many: int = 0) -> DataFrame:
    """Runs of the paragraphs of spans, split at the spans' edges; adds a, b (place in the visible text) and span (the one that covers it)."""
    upto = F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.partitionBy(*KEYS).orderBy("r_idx"))
    packed = spans.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "end", "seq", "order", "kind", "id", "author", "date", "track", "bold", "italic"))).alias("spans"))
    placed = runs.join(unsent(packed, many), KEYS).withColumn("b", upto.cast("int")).withColumn("a", F.col("b") - F.length(F.coalesce("text", F.lit(""))))
    edges = F.expr("filter(flatten(transform(spans, s -> array(s.start, s.end))), e -> e > a and e < b)")
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("a"), edges, F.array("b"))))
    bits = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda x, i: F.struct(x.alias("a"), F.get(cuts, i + 1).alias("b"))))
    one = placed.withColumn("bit", F.explode(bits)).withColumn("whole", (F.col("bit.a") == F.col("a")) & (F.col("bit.b") == F.col("b")))
    one = one.withColumn("text", F.when(F.col("a") == F.col("b"), F.col("text")).otherwise(F.expr("substring(text, bit.a - a + 1, bit.b - bit.a)")))
    over = F.expr("get(filter(spans, s -> s.start < s.end and s.start <= bit.a and bit.b <= s.end and bit.a < bit.b), 0)")
    return one.withColumn("span", over).withColumn("a", F.col("bit.a")).withColumn("b", F.col("bit.b")).withColumn("same", F.col("same") & F.col("whole")).drop("bit", "whole", "spans")


def rewritten(runs: DataFrame, spans: DataFrame, many: int = 0) -> DataFrame:
    """Runs once spans are deleted, inserted or formatted, r_idx numbered anew.

    spans: (doc_id, part, p_idx, start, end, seq, order, kind, new, new_kind, id, new_id, author, date, track, bold, italic), of which no two
    of a paragraph overlap. kind: deletion, move_from, format or null; new goes after the span, marked as new_kind (insertion, move_to). many: how many spans there are, if known.
    """
    rest = runs.join(unsent(spans.select(*KEYS).distinct(), many), KEYS, "left_anti")
    bits = _cut(runs, spans, many)
    gone = F.col("span.kind").isin("deletion", "move_from")
    kept = bits.where(~F.coalesce(gone & ~F.col("span.track"), F.lit(False)))
    gone = F.coalesce(gone, F.lit(False))
    looks = F.coalesce(F.col("span.kind") == "format", F.lit(False))
    marked = F.coalesce(F.col("span.track"), F.lit(False))
    set_ = {
        "del_text": F.when(gone, F.col("text")).otherwise(F.col("del_text")), "text": F.when(gone, "").otherwise(F.col("text")), "in_del": gone | F.coalesce("in_del", F.lit(False)),
        "change_id": F.when(gone | (looks & marked), F.col("span.id")).otherwise(F.col("change_id")), "author": F.when(gone | (looks & marked), F.col("span.author")).otherwise(F.col("author")),
        "date": F.when(gone | (looks & marked), F.col("span.date")).otherwise(F.col("date")), "same": F.col("same") & ~gone & ~looks, "fresh": gone | F.col("fresh"),
        "mark": F.when(F.col("span.kind") == "deletion", "del").when(F.col("span.kind") == "move_from", "moveFrom").otherwise(F.col("mark")), "formatted": looks | F.col("formatted"),
        "old_bold": F.when(looks & marked, F.col("bold")).otherwise(F.col("old_bold")), "old_italic": F.when(looks & marked, F.col("italic")).otherwise(F.col("old_italic")),
        "bold": F.when(looks, F.coalesce("span.bold", "bold")).otherwise(F.col("bold")), "italic": F.when(looks, F.coalesce("span.italic", "italic")).otherwise(F.col("italic")),
    }
    extra = ["note_id"] if "note_id" in runs.columns else []
    kept = kept.select(*KEYS, *extra, F.struct("a", F.lit(1).alias("late"), "r_idx", F.lit(0).alias("order")).alias("at"), *(set_.get(c, F.col(c)).alias(c) for c in RUN))
    new = spans.where("new <> ''")
    put = {
        "text": F.col("new"), "del_text": F.lit(""), "in_ins": F.col("track"), "in_del": F.lit(False), "change_id": F.when(F.col("track"), F.col("new_id")), "author": F.when(F.col("track"), F.col("author")),
        "date": F.when(F.col("track"), F.col("date")), "same": F.lit(False), "copied": F.lit(True), "fresh": F.col("track"), "mark": F.when(F.col("track"), F.when(F.col("new_kind") == "move_to", "moveTo").otherwise("ins")), "formatted": F.lit(False),
    }
    new = new.select(*KEYS, *(F.lit(None).cast("string").alias(c) for c in extra), F.struct(F.col("end").alias("a"), F.lit(0).alias("late"), F.lit(0).alias("r_idx"), "order").alias("at"), *(put.get(c, F.lit(None)).cast(k).alias(c) for c, k in RUN.items()))
    both = kept.unionByName(new)
    # A new run looks like the one before it, or like the first.
    order = Window.partitionBy(*KEYS).orderBy("at")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    for c in ("src", "bold", "italic", *extra):
        own = F.when(~F.col("copied") | F.col("src").isNotNull(), F.struct(F.col(c).alias("v")))
        near = F.coalesce(F.last(own, ignorenulls=True).over(before), F.first(own, ignorenulls=True).over(after))["v"]
        both = both.withColumn(f"_{c}", F.when(F.col("copied") & F.col("src").isNull(), near).otherwise(F.col(c)))
    for c in ("src", "bold", "italic", *extra):
        both = both.withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    both = both.withColumn("src", F.coalesce("src", F.lit(0)))
    return rest.unionByName(both.withColumn("r_idx", F.row_number().over(order) - 1).drop("at"))


def _round(runs: DataFrame, edits: DataFrame, kinds: set[str], regex: bool, minimal: bool, places: DataFrame | None, unfit: DataFrame | None, tops: DataFrame, date: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, results, cuts): what all edits up to a document's first conflict change; cuts (doc_id, cut) names the edit that waits, with all after it.

    kinds, regex and minimal: the kinds of edits there are, and whether any has a regular expression or is to change only the words that differ.
    """
    lines = visible(runs)
    if places is not None:
        lines = lines.join(places, KEYS, "left")
    kind = F.regexp_replace("type", "_tracked$", "")
    e = edits.withColumn("track", F.col("track") | F.col("type").endswith("_tracked")).withColumn("kind", kind)
    anchor = F.coalesce("after", "before")
    find = F.when(F.col("kind") == "insert", anchor).when(F.col("kind").isin("delete", "move", "format"), F.coalesce("text", "find")).otherwise(F.col("find"))
    no_anchor = F.col("kind").isin("insert", "move") & (F.col("after").isNull() == F.col("before").isNull())
    wrong = (
        F.when(~F.col("kind").isin(*TYPES), F.concat(F.lit("unknown edit type: "), F.col("type")))
        .when(no_anchor, "give either after or before").when((F.col("kind") == "replace") & F.col("replace").isNull(), "no replacement given")
        .when((F.col("kind") == "insert") & F.col("text").isNull(), "no text given").when(F.coalesce(find, F.lit("")) == "", "no search text given")
    )
    if regex:
        given = lambda c: F.when(F.col("regex"), c)
        wrong = F.coalesce(wrong, unreadable(given(find), given(F.when(F.col("kind") == "replace", F.col("replace")))))
    e = e.withColumn("wrong", wrong).withColumn("seek", find).withColumn("new", F.when(F.col("kind") == "replace", F.col("replace")).when(F.col("kind") == "insert", F.col("text")))
    fit = e.where("wrong is null")
    ask = fit.select("doc_id", "seq", F.col("seek").alias("find"), "regex", "minimal", "scope", "ref", F.when(F.col("kind") == "replace", F.col("new")).alias("new"))
    null = lambda kind: F.lit(None).cast(kind)
    if "move" in kinds:  # a move also looks for its destination, under a number of its own
        ask = ask.unionByName(fit.where("kind = 'move'").select("doc_id", (-F.col("seq") - 1).alias("seq"), anchor.alias("find"), F.lit(False).alias("regex"), F.lit(False).alias("minimal"), "scope", "ref", null("string").alias("new")))
    n = edits.count()
    hits = written(matches(lines, ask, regex, n), "matches")
    source = hits.where("seq >= 0").join(unsent(fit.select("doc_id", "seq", "occurrence", "kind"), n), ["doc_id", "seq"])
    got = chosen(source, F.when(F.col("kind") != "move", F.col("occurrence")))
    done = F.when(picked(F.col("occurrence")) | (F.col("kind") == "move"), 1)
    e = e.join(unsent(source.groupBy("doc_id", "seq").agg(F.max("of").alias("of"), F.nullif(F.count(done), F.lit(0)).alias("done")), n), ["doc_id", "seq"], "left")
    short = lambda c: F.substring(c, 1, 80)
    many = lambda n, c: F.concat(F.lit("text is ambiguous: "), F.col(n), F.lit(" occurrences of "), short(c))
    wrong = F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.col("of").isNull(), F.concat(F.lit("text not found: "), short("seek")))
    moves = None
    if "move" in kinds:
        target = hits.where("seq < 0").select("doc_id", (-F.col("seq") - 1).alias("seq"), F.col("part").alias("q_part"), F.col("p_idx").alias("q"), F.col("start").alias("c"), F.col("end").alias("d"), F.col("of").alias("to_of"))
        moves = got.where("kind = 'move' and of = 1").join(target.where("to_of = 1"), ["doc_id", "seq"]).join(fit.select("doc_id", "seq", F.col("after").isNotNull().alias("behind")), ["doc_id", "seq"])
        moves = moves.withColumn("spot", F.when(F.col("behind"), F.col("d")).otherwise(F.col("c")))
        inside = moves.where("part = q_part and p_idx = q and spot > start and spot < end").select("doc_id", "seq", F.lit(True).alias("inside"))
        e = e.join(inside, ["doc_id", "seq"], "left").join(target.groupBy("doc_id", "seq").agg(F.max("to_of").alias("to_of")), ["doc_id", "seq"], "left")
        move = F.col("kind") == "move"
        wrong = (
            wrong.when(move & (F.col("of") > 1), many("of", "seek")).when(move & F.col("to_of").isNull(), F.concat(F.lit("text not found: "), short(anchor)))
            .when(move & (F.col("to_of") > 1), many("to_of", anchor)).when(F.col("inside"), "destination lies within what moves")
        )
    wrong = wrong.when((F.col("kind") != "move") & (F.col("done").isNull() | beyond(F.col("occurrence"), F.col("of"))), F.concat(F.lit("occurrence "), F.col("occurrence"), F.lit(" of "), F.col("of")))
    e = e.withColumn("wrong", wrong)
    word = F.create_map(*(F.lit(x) for kv in {"insert": "inserted ", "delete": "deleted ", "replace": "replaced ", "move": "moved ", "format": "formatted "}.items() for x in kv))
    results = e.select("doc_id", "seq", "type", F.col("wrong").isNull().alias("success"), F.coalesce("wrong", F.concat(word[F.col("kind")], F.col("done"))).alias("message"))
    ok = e.where("wrong is null").select("doc_id", "seq", "kind", "track", (F.col("minimal") & F.col("track")).alias("minimal"), "author", F.col("after").isNotNull().alias("behind"), F.col("new").alias("put"), F.col("replace").alias("look"))
    at = got.drop("kind", "occurrence").join(unsent(ok, n), ["doc_id", "seq"])
    none, text = F.lit(None), lambda c: F.col(c).cast("string")
    place = F.when(F.col("behind"), F.col("end")).otherwise(F.col("start"))
    row = lambda df, start, end, kind, new, new_kind: df.select(*KEYS, start.alias("start"), end.alias("end"), "seq", F.lit(0).alias("order"), kind.cast("string").alias("kind"), new.cast("string").alias("new"), F.lit(new_kind).cast("string").alias("new_kind"), "author", "track", "found", "look")
    fine = lambda: [by_hunks(row(at.where("kind = 'replace' and minimal"), F.col("start"), F.col("end"), F.lit("deletion"), text("new"), "insertion"), revised(runs, unfit))] if minimal else []
    made = {
        "insert": lambda: [row(at.where("kind = 'insert'"), place, place, none, text("put"), "insertion")],
        "delete": lambda: [row(at.where("kind = 'delete'"), F.col("start"), F.col("end"), F.lit("deletion"), none, None)],
        "replace": lambda: [row(at.where("kind = 'replace' and not minimal"), F.col("start"), F.col("end"), F.lit("deletion"), text("new"), "insertion"), *fine()],
        "format": lambda: [row(at.where("kind = 'format'"), F.col("start"), F.col("end"), F.lit("format"), none, None)],
    }
    rows = [r for kind, f in made.items() if kind in kinds for r in f()]
    if moves is not None:
        going = moves.drop("behind").join(ok.select("doc_id", "seq", "track", "author", "look"), ["doc_id", "seq"])
        rows.append(row(going, F.col("start"), F.col("end"), F.lit("move_from"), none, None))
        rows.append(row(going.withColumn("part", F.col("q_part")).withColumn("p_idx", F.col("q")), F.col("spot"), F.col("spot"), none, F.col("found"), "move_to"))
    spans = reduce(DataFrame.unionByName, rows or [row(at, place, place, none, none, None).where("false")])
    look = F.coalesce("look", F.lit("bold"))
    spans = spans.withColumn("bold", F.when(F.col("kind") == "format", F.when(look == "bold", True).when(look == "not bold", False))).withColumn("italic", F.when(F.col("kind") == "format", F.when(look == "italic", True).when(look == "not italic", False)))
    spans = written(spans.drop("look"), "wanted")
    asked = ask.withColumn("seq", F.when(F.col("seq") < 0, -F.col("seq") - 1).otherwise(F.col("seq")))
    cuts = written(conflicts(lines, asked, spans, max(n, spans.count())), "cuts")
    cut = unsent(cuts, cuts.count())
    due = lambda df: df.join(cut, "doc_id", "left").where("cut is null or seq < cut").drop("cut")
    return written(numbered(due(spans), tops, date, n), "spans"), due(results), cuts


def top_ids(*marks: DataFrame | None) -> DataFrame:
    """(doc_id, top): the greatest change id of each document in tables of (doc_id, change_id), 0 if none is a number."""
    ids = [m.select("doc_id", F.col("change_id").cast("string").alias("change_id")) for m in marks if m is not None]
    return reduce(DataFrame.unionByName, ids).groupBy("doc_id").agg(F.coalesce(F.max(F.expr("try_cast(change_id as int)")), F.lit(0)).alias("top"))


def numbered(spans: DataFrame, top: DataFrame, date: str, many: int = 0) -> DataFrame:
    """Spans with the ids of their changes: on from the document's greatest, edit by edit and in document order, a deletion before what replaces it."""
    old, new = F.col("kind").isNotNull().cast("int"), F.coalesce(F.col("new") != "", F.lit(False)).cast("int")
    order = Window.partitionBy("doc_id").orderBy("seq", "part", "p_idx", "start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("top") + F.sum(F.when(F.col("track"), old + new).otherwise(0)).over(order)
    out = spans.join(unsent(top, many), "doc_id").withColumn("last", last)
    out = out.withColumn("id", F.when(F.col("track") & (old == 1), F.col("last") - new).cast("string")).withColumn("new_id", F.when(F.col("track") & (new == 1), F.col("last")).cast("string"))
    return out.withColumn("date", F.lit(date)).drop("top", "last")


def change_rows(spans: DataFrame) -> DataFrame:
    """(doc_id, part, p_idx, seq, change_id, change_type, author, date, text): what tracked spans changed, by the edit that did."""
    gone = spans.where("track and kind is not null").select(*KEYS, "seq", F.col("id").alias("change_id"), F.when(F.col("kind") == "format", "format_run").otherwise(F.col("kind")).alias("change_type"), "author", "date", F.when(F.col("kind") == "format", "").otherwise(F.col("found")).alias("text"))
    come = spans.where("track and new <> ''").select(*KEYS, "seq", F.col("new_id").alias("change_id"), F.col("new_kind").alias("change_type"), "author", "date", F.col("new").alias("text"))
    return gone.unionByName(come)


def members(made: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, change_id, group_name): which group each change belongs to, by the edit that made it: edits (doc_id, seq, group_name)."""
    return made.join(edits.where("group_name is not null").select("doc_id", "seq", "group_name").distinct(), ["doc_id", "seq"]).select("doc_id", "change_id", "group_name")


def revised(runs: DataFrame, unfit: DataFrame | None = None) -> DataFrame:
    """(doc_id, part, p_idx, unfit): paragraphs that hold tracked changes, and those given (diff.viability); they are changed as a whole, not by hunks."""
    marks = runs.where(F.coalesce("in_ins", F.lit(False)) | F.coalesce("in_del", F.lit(False)) | F.col("change_id").isNotNull()).select(*KEYS)
    rows = marks if unfit is None else marks.unionByName(unfit.select(*KEYS))
    return rows.distinct().withColumn("unfit", F.lit(True))


def by_hunks(spans: DataFrame, revisions: DataFrame) -> DataFrame:
    """Spans that replace found by new, cut to the words that differ: a span for each hunk, deleted before what is put in its place.

    A paragraph that isn't fit, and a text with too many hunks, is replaced whole; a difference in white space alone is none.
    """
    rows = spans.join(revisions, KEYS, "left").withColumn("h", diff.hunks(F.when(F.col("unfit").isNull(), F.col("found")), F.col("new")))
    whole = rows.where("h is null").select(*spans.columns)
    fine = rows.where("h is not null").withColumn("h", F.explode("h"))
    part = {
        "start": F.col("start") + F.col("h.start"), "end": F.col("start") + F.col("h.end"), "kind": F.when(F.col("h.old") != "", F.lit("deletion")), "found": F.col("h.old"), "new": F.col("h.new"),
    }
    return whole.unionByName(fine.select(*(part.get(c, F.col(c)).alias(c) for c in spans.columns)))


def completed(edits: DataFrame, author: str) -> DataFrame:
    """Edits with all columns of EDIT; those without an author get the one given."""
    for c, kind in EDIT.items():
        if c not in edits.columns:
            edits = edits.withColumn(c, F.lit(None).cast(kind))
    flags = {c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in ("regex", "track", "minimal")} | {"author": F.coalesce("author", F.lit(author))}
    return edits.select("doc_id", *(flags.get(c, F.col(c).cast(k)).alias(c) for c, k in EDIT.items()))


def apply(runs: DataFrame, edits: DataFrame, author: str = "Inkloom", date: str = "2024-01-01T00:00:00Z", places: DataFrame | None = None, changes: DataFrame | None = None, unfit: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs after, changes made, results): edits of each document in the order of seq.

    edits: (doc_id, seq, type, find, replace, text, after, before, occurrence, regex, track, author, scope, ref), further columns
    ignored, missing ones null; occurrence is first, last, all, a number or a list of numbers ([1, 3]); types insert, delete, replace, move and format, each with _tracked. An edit that can't be made
    changes nothing and says why; documents without edits pass by. places: (doc_id, part, p_idx) with section or tbl_idx, for scopes
    of sections and tables. changes: the documents' changes so far, whose ids are taken. A tracked replacement that is minimal marks
    only the words that differ, where its paragraph has no changes yet and isn't among unfit (doc_id, part, p_idx).
    """
    todo = written(completed(edits, author), "edits")
    due = unsent(todo.select("doc_id").distinct(), todo.count())
    whole = prepared(runs)
    now = written(whole.join(due, "doc_id", "left_semi"), "runs")
    tops = written(top_ids(now, changes), "tops")
    kind = F.regexp_replace("type", "_tracked$", "")
    given = todo.agg(F.collect_set(F.when(kind.isin(*TYPES), kind)).alias("kinds"), F.max("regex").alias("regex"), F.max("minimal").alias("minimal")).head()
    finished, made, results = [whole.join(due, "doc_id", "left_anti")], [], []
    while todo.head(1):
        spans, said, cuts = _round(now, todo, set(given.kinds), bool(given.regex), bool(given.minimal), places, unfit, tops, date)
        made.append(change_rows(spans))
        results.append(said)
        after = written(rewritten(now, spans, spans.count()), "runs")
        # What waits for another round; documents that have nothing left are done.
        cuts = unsent(cuts, cuts.count())
        waiting = cuts.select("doc_id")
        todo = written(todo.join(cuts, "doc_id").where("seq >= cut").drop("cut"), "edits")
        finished.append(after.join(waiting, "doc_id", "left_anti"))
        tops = written(top_ids(tops.withColumnRenamed("top", "change_id"), made[-1]), "tops")
        now = after.join(waiting, "doc_id", "left_semi")
    if not made:
        none = whole.where("false")
        return whole, none.select(*KEYS, F.lit(0).alias("seq"), "change_id", F.lit("").alias("change_type"), "author", "date", "text"), none.select("doc_id", F.lit(0).alias("seq"), F.lit("").alias("type"), F.lit(True).alias("success"), F.lit("").alias("message"))
    return tuple(reduce(DataFrame.unionByName, rows) for rows in (finished, made, results))


def changed_paragraphs(after: DataFrame, before: DataFrame) -> DataFrame:
    """Runs of the paragraphs that edits changed, which is what `docx.saved` needs; a paragraph that lost all its runs has an empty one."""
    was = before.groupBy(*KEYS).agg(F.count("*").alias("n")) if "part" in before.columns else prepared(before).groupBy(*KEYS).agg(F.count("*").alias("n"))
    now = after.groupBy(*KEYS).agg(F.count("*").alias("m"), F.bool_and("same").alias("same"))
    differ = was.join(now, KEYS, "full").where("n is null or m is null or n <> m or not same")
    emptied = differ.where("m is null").select(*KEYS)
    for c in after.columns:
        if c not in KEYS:
            value = {"src": -1, "r_idx": 0, "text": "", "del_text": ""}.get(c, False if dict(after.dtypes)[c] == "boolean" else None)
            emptied = emptied.withColumn(c, F.lit(value).cast(dict(after.dtypes)[c]))
    return after.join(differ.select(*KEYS), KEYS, "left_semi").unionByName(emptied.select(*after.columns))


def replaced_whole(runs: DataFrame, targets: DataFrame, track: bool = True, author: str = "Inkloom", date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """(runs, changes) once all that is visible of some paragraphs is something else: targets (doc_id, part, p_idx, new), null or empty to delete it.

    This is how a paragraph is replaced or emptied by its reference, and a table cell by its address. Targets without text get it inserted.
    """
    whole = prepared(runs)
    text = visible(whole).join(targets.select(*KEYS, "new"), KEYS)
    kind = F.when(F.col("text") != "", "deletion")
    spans = text.select(*KEYS, F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(0).alias("seq"), F.lit(0).alias("order"), kind.alias("kind"), "new", F.lit("insertion").alias("new_kind"), F.lit(author).alias("author"), F.lit(track).alias("track"), F.col("text").alias("found"))
    spans = numbered(spans.withColumn("bold", F.lit(None).cast("boolean")).withColumn("italic", F.lit(None).cast("boolean")), top_ids(whole), date)
    return rewritten(whole, spans), change_rows(spans)


def replaced_minimal(runs: DataFrame, targets: DataFrame, unfit: DataFrame | None = None, author: str = "Inkloom", date: str = "2024-01-01T00:00:00Z", changes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, changes) once some paragraphs read as another version of them does, only the words that differ marked: targets (doc_id, part, p_idx, new)."""
    whole = prepared(runs)
    text = visible(whole).join(targets.select(*KEYS, F.coalesce("new", F.lit("")).alias("new")), KEYS).where("text <> new")
    null = F.lit(None).cast("boolean")
    spans = text.select(
        *KEYS, F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(0).alias("seq"), F.lit(0).alias("order"), F.when(F.col("text") != "", F.lit("deletion")).alias("kind"), "new", F.lit("insertion").alias("new_kind"),
        F.lit(author).alias("author"), F.lit(True).alias("track"), F.col("text").alias("found"), null.alias("bold"), null.alias("italic"),
    )
    spans = written(numbered(by_hunks(spans, revised(whole, unfit)), top_ids(whole, changes), date), "hunks")
    return rewritten(whole, spans), change_rows(spans)


def in_cells(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """Targets for replaced_whole from cells (doc_id, tbl_idx, row_idx, cell_idx, new): the text goes to a cell's first paragraph, its others are emptied."""
    first = F.row_number().over(Window.partitionBy("doc_id", "tbl_idx", "row_idx", "cell_idx").orderBy("p_idx")) == 1
    return paragraphs.join(cells, ["doc_id", "tbl_idx", "row_idx", "cell_idx"]).withColumn("new", F.when(first, F.col("new")).otherwise("")).select(*KEYS, "new")


def edits_of_markup(operations: DataFrame) -> DataFrame:
    """Edits for `apply` from parsed change markup (functions.critic.parse): in the order of the text, insertions anchored on what stands before them."""
    kind = F.when(F.col("kind") == "insertion", "insert").when(F.col("kind") == "deletion", "delete").when(F.col("kind") == "substitution", "replace")
    rows = operations.where(F.col("kind").isin("insertion", "deletion", "substitution")).withColumn("type", kind)
    ahead = (F.col("type") == "insert") & (F.coalesce("before", F.lit("")) != "")
    return rows.select(
        "doc_id", F.col("op_idx").alias("seq"), "type", F.when(F.col("type") == "replace", F.col("text")).alias("find"), F.col("replacement").alias("replace"), F.when(F.col("type") != "replace", F.col("text")).alias("text"),
        F.when(ahead, F.col("before")).alias("after"), F.when((F.col("type") == "insert") & ~ahead, F.col("after")).alias("before"), F.lit(True).alias("track"),
    )
