"""Inline change markup: {++ins++} {--del--} {~~old~>new~~} {>>comment<<} {==mark==}."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markup, the most specific first.
PATTERNS = [
    ("highlight_comment", r"\{==(.+?)==\{>>(.+?)<<\}\}"),
    ("substitution", r"\{~~(.+?)~>(.+?)~~\}"),
    ("insertion", r"\{\+\+(.+?)\+\+\}"),
    ("deletion", r"\{--(.+?)--\}"),
    ("comment", r"\{>>(.+?)<<\}"),
    ("highlight", r"\{==(.+?)==\}"),
]
OPERATION = "array<struct<kind: string, start: int, end: int, text: string, replacement: string, comment: string, before: string, after: string>>"
_ACCEPT = {"highlight_comment": "$1", "substitution": "$2", "insertion": "$1", "deletion": "", "comment": "", "highlight": "$1"}
_REJECT = _ACCEPT | {"substitution": "$1", "insertion": "", "deletion": "$1"}


def stripped(text: Column, accept: bool = True) -> Column:
    """The text with every change accepted (or rejected) and comments gone."""
    for kind, pattern in PATTERNS:
        text = F.regexp_replace(text, "(?s)" + pattern, (_ACCEPT if accept else _REJECT)[kind])
    return text


def parse_one(text: str, context: int = 50) -> list[tuple]:
    """Operations of a text in its order; one that overlaps an earlier kind's is dropped."""
    taken: list[tuple[int, int]] = []
    found = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text, re.DOTALL):
            if any(m.start() < e and a < m.end() for a, e in taken):
                continue
            taken.append(m.span())
            second = m[2] if m.re.groups > 1 else None
            found.append((kind, m.start(), m.end(), None if kind == "comment" else m[1], second if kind == "substitution" else None, m[1] if kind == "comment" else second if kind == "highlight_comment" else None))
    strip = lambda t: stripped_text(t)
    return [(*o, strip(text[max(0, o[1] - context) : o[1]]), strip(text[o[2] : o[2] + context])) for o in sorted(found, key=lambda o: o[1])]


def stripped_text(text: str) -> str:
    for kind, pattern in PATTERNS:
        text = re.sub(pattern, _ACCEPT[kind].replace("$", "\\"), text, flags=re.DOTALL)
    return text


def operations(text: Column) -> Column:
    """Parsed operations of each text, positions in code points."""
    names = ("kind", "start", "end", "text", "replacement", "comment", "before", "after")

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [dict(zip(names, o, strict=True)) for o in parse_one(t)] for t in texts])

    return F.pandas_udf(run, OPERATION)(text)


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each operation: the columns of df but text, op_idx, and the operation's."""
    rest = [c for c in df.columns if c != text]
    # Texts without markup don't go through Python.
    marked = df.where(F.col(text).rlike(r"\{(\+\+|--|~~|>>|==)"))
    return marked.select(*rest, F.posexplode(operations(F.col(text))).alias("op_idx", "op")).select(*rest, "op_idx", "op.*")


def rendered(kind: Column, text: Column, replacement: Column, comment: Column) -> Column:
    """Markup of one operation."""
    return (
        F.when(kind == "insertion", F.concat(F.lit("{++"), text, F.lit("++}")))
        .when(kind == "deletion", F.concat(F.lit("{--"), text, F.lit("--}")))
        .when(kind == "substitution", F.concat(F.lit("{~~"), text, F.lit("~>"), replacement, F.lit("~~}")))
        .when(kind == "comment", F.concat(F.lit("{>>"), comment, F.lit("<<}")))
        .when(kind == "highlight", F.concat(F.lit("{=="), text, F.lit("==}")))
        .when(kind == "highlight_comment", F.concat(F.lit("{=="), text, F.lit("=={>>"), comment, F.lit("<<}}")))
    )


def spliced(base: Column, operations: Column) -> Column:
    """base with (start, end, markup) put in at their places, which don't overlap."""
    done = F.aggregate(
        F.array_sort(operations),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, o: F.struct(o["end"].alias("at"), F.concat(s["out"], F.substr(base, s["at"] + 1, o["start"] - s["at"]), o["markup"]).alias("out")),
    )
    return F.concat(done["out"], F.substr(base, done["at"] + 1))


def runs_markup(runs: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): documents with their tracked changes as markup, paragraphs parted by a blank line."""
    piece = F.when(F.col("in_ins"), F.concat(F.lit("{++"), F.col("text"), F.lit("++}"))).when(F.col("in_del"), F.concat(F.lit("{--"), F.col("del_text"), F.lit("--}"))).otherwise(F.col("text"))
    parts = runs.select("doc_id", "p_idx", F.struct(F.col("r_idx"), F.lit(0).alias("k"), F.coalesce(piece, F.lit("")).alias("t")).alias("x"))
    if comments is not None:
        said = comments.select("doc_id", F.col("end_p_idx").alias("p_idx"), F.struct(F.lit(1 << 30).alias("r_idx"), F.lit(1).alias("k"), F.concat(F.lit("{>>"), F.col("text"), F.lit("<<}")).alias("t")).alias("x"))
        parts = parts.unionByName(said.where("p_idx is not null"))
    lines = parts.groupBy("doc_id", "p_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("line"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_idx", "line"))), lambda x: x["line"]), "\n\n").alias("text"))
