"""Inline Markdown of inserted text: **bold**, *italic*, ~~strike~~, ++underline++ and line breaks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = "array<struct<text: string, bold: boolean, italic: boolean, strike: boolean, underline: boolean, line_break: boolean>>"
_MARKS = {"**": "bold", "*": "italic", "~~": "strike", "++": "underline"}
_TOKEN = re.compile(r"\\([*~+\\])|(\*\*|\*|~~|\+\+)|(  \n|\n)|([^*~+\\\n ]+|.)", re.DOTALL)


def parse_segments(text: str) -> list[dict]:
    """Runs of one format; a mark without its partner is plain text, a backslash keeps a mark plain."""
    tokens = [m.groups() for m in _TOKEN.finditer(text)]
    paired, waiting = set(), {}
    for i, (_, mark, _, _) in enumerate(tokens):
        if mark:
            if mark in waiting:
                paired |= {waiting.pop(mark), i}
            else:
                waiting[mark] = i
    out: list[dict] = []
    on = dict.fromkeys(_MARKS.values(), False)
    for i, (escaped, mark, line, plain) in enumerate(tokens):
        if i in paired:
            on[_MARKS[mark]] = not on[_MARKS[mark]]
            continue
        piece = escaped or mark or plain or ""
        if line:
            out.append({"text": "", **on, "line_break": True})
        elif out and not out[-1]["line_break"] and all(out[-1][k] == v for k, v in on.items()):
            out[-1]["text"] += piece
        else:
            out.append({"text": piece, **on, "line_break": False})
    return out


def segments(text: Column) -> Column:
    """Formatted segments; texts without a mark or a line break don't go through Python."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else parse_segments(t) for t in texts])

    none = F.lit(False)
    one = F.array(F.struct(text.alias("text"), none.alias("bold"), none.alias("italic"), none.alias("strike"), none.alias("underline"), none.alias("line_break")))
    marked = text.rlike(r"[*~+\\\n]")
    return F.when(~marked & (F.length(text) > 0), one).otherwise(F.pandas_udf(run, SEGMENT)(F.when(marked, text).otherwise(F.when(text == "", ""))))


def html(found: Column) -> Column:
    """Segments as HTML."""

    def wrap(inner: Column, on: Column, tag: str) -> Column:
        return F.when(on, F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise(inner)

    def one(x: Column) -> Column:
        body = F.replace(F.replace(F.replace(x["text"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        for name, tag in (("bold", "b"), ("italic", "i"), ("strike", "s"), ("underline", "u")):
            body = wrap(body, x[name], tag)
        return F.when(x["line_break"], F.lit("<br/>")).otherwise(body)

    return F.array_join(F.transform(found, one), "")
