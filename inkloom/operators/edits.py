"""Edits: batches applied in order to a document's paragraphs, each edit seeing those before it.

A document's edits depend on each other, so a batch is folded within its document: its paragraphs and
edits are gathered into one row, and rows are spread over tasks. Documents without edits pass by. Tracked edits leave change markup ({++ins++}, {--del--}) in the text, untracked ones
change it. `apply_disjoint` is the set-based way, for edits of which no two touch one paragraph.

Edit types: insert, delete, replace, move, insert_paragraph, insert_paragraphs, delete_paragraph,
delete_section, apply_style, format, comment; and insert_tracked, delete_tracked, replace_tracked,
move_tracked, format_tracked, format_paragraph_tracked. An edit that can't be made fails with a
message; the others go on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.critic import stripped_text
from inkloom.functions.text import SPECIAL

EDIT = "doc_id, seq, type, find, replace, text, after, before, occurrence, regex, track"
_TABLE = str.maketrans(SPECIAL)
#: Deleted text in the markup isn't found again.
_GONE = re.compile(r"\{--.*?--\}", re.DOTALL)


class EditError(ValueError):
    pass


def _spans(text: str, find: str, regex: bool) -> list[tuple[int, int, re.Match | None]]:
    gone = [m.span() for m in _GONE.finditer(text)]
    if regex:
        hits = [(m.start(), m.end(), m) for m in re.finditer(find, text) if m.end() > m.start()]
    else:
        plain, seek, hits, at = text.translate(_TABLE), find.translate(_TABLE), [], 0
        while (at := plain.find(seek, at)) >= 0:
            hits.append((at, at + len(seek), None))
            at += len(seek)
    return [h for h in hits if not any(a < h[1] and h[0] < e for a, e in gone)]


class Fold:
    """Paragraphs of one document, as lists that edits change."""

    def __init__(self, texts: list[str], styles: list[str | None]):
        self.texts, self.styles = list(texts), list(styles)
        self.comments: list[tuple[int, str, str]] = []

    def found(self, find: str | None, occurrence: str | None, regex: bool, unique: bool = False):
        if not find:
            raise EditError("no search text given")
        hits = [(p, *s) for p, t in enumerate(self.texts) for s in _spans(t, find, regex)]
        if not hits:
            raise EditError(f"text not found: {find[:80]}")
        if unique and len(hits) > 1:
            raise EditError(f"text is ambiguous: {len(hits)} occurrences of {find[:80]}")
        which = occurrence or "first"
        if which == "all":
            return hits
        n = {"first": 1, "last": len(hits)}.get(which) or int(which)
        if not 1 <= n <= len(hits):
            raise EditError(f"occurrence {n} of {len(hits)}")
        return [hits[n - 1]]

    def put(self, p: int, start: int, end: int, new: str) -> None:
        self.texts[p] = self.texts[p][:start] + new + self.texts[p][end:]

    def apply(self, e: dict) -> str:
        kind, track = e["type"], bool(e.get("track"))
        if kind and kind.endswith("_tracked"):
            kind, track = kind.removesuffix("_tracked"), True
        method = getattr(self, f"do_{kind}", None)
        if method is None:
            raise EditError(f"unknown edit type: {e['type']}")
        return method(e, track)

    def _anchor(self, e: dict) -> tuple[str, bool]:
        if bool(e.get("after")) == bool(e.get("before")):
            raise EditError("give either after or before")
        return (e["after"], True) if e.get("after") else (e["before"], False)

    def do_insert(self, e, track):
        if e.get("text") is None:
            raise EditError("no text given")
        anchor, after = self._anchor(e)
        new = f"{{++{e['text']}++}}" if track else e["text"]
        hits = self.found(anchor, e.get("occurrence"), bool(e.get("regex")))
        for p, a, b, _ in reversed(hits):
            self.put(p, b if after else a, b if after else a, new)
        return f"inserted {len(hits)}"

    def do_delete(self, e, track):
        hits = self.found(e.get("text") or e.get("find"), e.get("occurrence"), bool(e.get("regex")))
        for p, a, b, _ in reversed(hits):
            self.put(p, a, b, f"{{--{self.texts[p][a:b]}--}}" if track else "")
        return f"deleted {len(hits)}"

    def do_replace(self, e, track):
        if e.get("replace") is None:
            raise EditError("no replacement given")
        hits = self.found(e.get("find"), e.get("occurrence"), bool(e.get("regex")))
        for p, a, b, m in reversed(hits):
            new = m.expand(e["replace"]) if m else e["replace"]
            self.put(p, a, b, (f"{{--{self.texts[p][a:b]}--}}" + (f"{{++{new}++}}" if new else "")) if track else new)
        return f"replaced {len(hits)}"

    def do_move(self, e, track):
        anchor, after = self._anchor(e)
        ((p, a, b, _),) = self.found(e.get("text") or e.get("find"), None, False, unique=True)
        ((q, c, d, _),) = self.found(anchor, None, False, unique=True)
        moved, at = self.texts[p][a:b], d if after else c
        if p == q and a < at < b:
            raise EditError("destination lies within what moves")
        edits = [(p, a, b, f"{{--{moved}--}}" if track else ""), (q, at, at, f"{{++{moved}++}}" if track else moved)]
        for x in sorted(edits, reverse=True):
            self.put(*x)
        return "moved 1"

    def _insert_lines(self, e, lines, track):
        anchor, after = self._anchor(e)
        ((p, *_),) = self.found(anchor, None, False, unique=True)
        at = p + after
        self.texts[at:at] = [f"{{++{t}++}}" if track else t for t in lines]
        self.styles[at:at] = [e.get("style")] * len(lines)
        return f"inserted {len(lines)} paragraphs"

    def do_insert_paragraph(self, e, track):
        if e.get("text") is None:
            raise EditError("no text given")
        return self._insert_lines(e, [e["text"]], track)

    def do_insert_paragraphs(self, e, track):
        if e.get("text") is None:
            raise EditError("no texts given")
        return self._insert_lines(e, e["text"].split("\n"), track)

    def _drop(self, at: list[int], track):
        for p in reversed(at):
            if track:
                self.texts[p] = f"{{--{stripped_text(self.texts[p])}--}}"
            else:
                del self.texts[p], self.styles[p]

    def do_delete_paragraph(self, e, track):
        ((p, *_),) = self.found(e.get("text") or e.get("find"), e.get("occurrence"), False)
        self._drop([p], track)
        return "deleted 1 paragraph"

    def do_delete_section(self, e, track):
        name = (e.get("text") or e.get("find") or "").lower()
        heads = [p for p, s in enumerate(self.styles) if (s or "").startswith("Heading")]
        spans = [(a, b) for a, b in zip(heads, [*heads[1:], len(self.texts)], strict=True)]
        hits = [s for s in spans if name and any(name in t.lower() for t in self.texts[s[0] : s[1]])]
        if len(hits) != 1:
            raise EditError("section not found" if not hits else f"section is ambiguous: {len(hits)} match")
        self._drop(list(range(*hits[0])), track)
        return f"deleted {hits[0][1] - hits[0][0]} paragraphs"

    def do_apply_style(self, e, track):
        hit = {p for p, *_ in self.found(e.get("find"), "all", bool(e.get("regex")))}
        for p in hit:
            self.styles[p] = e.get("replace")
        return f"styled {len(hit)}"

    do_format_paragraph = do_apply_style

    def do_format(self, e, track):
        mark = {"bold": "**", "italic": "*", "strike": "~~"}.get(e.get("replace") or "bold")
        if mark is None:
            raise EditError(f"unknown format: {e['replace']}")
        hits = self.found(e.get("text") or e.get("find"), e.get("occurrence"), bool(e.get("regex")))
        for p, a, b, _ in reversed(hits):
            self.put(p, a, b, mark + self.texts[p][a:b] + mark)
        return f"formatted {len(hits)}"

    def do_comment(self, e, track):
        hits = self.found(e.get("find"), e.get("occurrence"), bool(e.get("regex")))
        for p, a, b, _ in reversed(hits):
            self.put(p, a, b, "{==" + self.texts[p][a:b] + "=={>>" + (e.get("text") or "") + "<<}}")
        return f"commented {len(hits)}"


def apply_batch(paragraphs: DataFrame, edits: DataFrame, stop_on_error: bool = False) -> tuple[DataFrame, DataFrame]:
    """(paragraphs after, results): results are (doc_id, seq, type, success, message), paragraphs (doc_id, p_idx, style, text).

    paragraphs: (doc_id, p_idx, text) and perhaps style. edits: the columns of EDIT.
    """
    if "style" not in paragraphs.columns:
        paragraphs = paragraphs.withColumn("style", F.lit(None).cast("string"))
    kind = dict(paragraphs.dtypes)["doc_id"]
    ids = edits.select("doc_id").distinct()
    names = [c for c in EDIT.split(", ") if c in edits.columns and c not in ("doc_id", "seq")]
    lines = paragraphs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p_idx", "style", "text"))).alias("lines"))
    # Edits are packed with their order first, so that sorting never compares the rest.
    todo = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*names).alias("e")))).alias("todo"))

    def fold_one(doc_id, lines, todo) -> list[tuple]:
        doc = Fold([x["text"] or "" for x in lines], [x["style"] for x in lines])
        results = []
        for item in todo:
            e = dict(item["e"])
            before = (list(doc.texts), list(doc.styles))
            try:
                results.append((doc_id, True, int(item["seq"]), e["type"], True, doc.apply(e)))
            except (EditError, ValueError, re.error) as error:
                doc.texts, doc.styles = before
                results.append((doc_id, True, int(item["seq"]), e["type"], False, str(error)))
                if stop_on_error:
                    break
        return [(doc_id, False, i, s, None, t) for i, (t, s) in enumerate(zip(doc.texts, doc.styles, strict=True))] + results

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [r for d, x, t in zip(*(part.column(c).to_pylist() for c in ("doc_id", "lines", "todo")), strict=True) for r in fold_one(d, x or [], t)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (part.schema.field("doc_id").type, pa.bool_(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "is_result", "idx", "label", "success", "text"])

    packed = todo.join(lines, "doc_id", "left").select("doc_id", "lines", "todo")
    out = packed.mapInArrow(fold, f"doc_id {kind}, is_result boolean, idx int, label string, success boolean, text string")
    after = out.where("not is_result").select("doc_id", F.col("idx").alias("p_idx"), F.col("label").alias("style"), "text")
    rest = paragraphs.join(ids, "doc_id", "left_anti").select("doc_id", "p_idx", "style", "text")
    return rest.unionByName(after), out.where("is_result").select("doc_id", F.col("idx").alias("seq"), F.col("label").alias("type"), "success", F.col("text").alias("message"))


def batch_summary(results: DataFrame) -> DataFrame:
    """(doc_id, succeeded, failed, success_rate, all_succeeded)."""
    out = results.groupBy("doc_id").agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))
    total = F.col("succeeded") + F.col("failed")
    return out.withColumn("success_rate", F.when(total == 0, 100.0).otherwise(F.col("succeeded") * 100.0 / total)).withColumn("all_succeeded", F.col("failed") == 0)


def disjoint(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, p_idx): paragraphs that more than one edit would touch, empty where apply_disjoint is exact."""
    hits = edits.join(paragraphs, "doc_id").where(F.expr("contains(text, find)"))
    return hits.groupBy("doc_id", "p_idx").agg(F.count("*").alias("n")).where("n > 1")


def apply_disjoint(paragraphs: DataFrame, edits: DataFrame, track: bool = True) -> DataFrame:
    """Replacements (doc_id, find, replace) of every occurrence, by one join; it fails where two edits meet in one paragraph (see disjoint)."""
    new = F.expr("concat('{--', find, '--}{++', replace, '++}')") if track else F.col("replace")
    keys = [F.col("doc_id"), F.col("p_idx")]
    hits = paragraphs.join(edits.select("doc_id", "find", "replace"), "doc_id").where(F.expr("contains(text, find)"))
    changed = hits.select(*keys, F.replace("text", F.col("find"), new).alias("changed")).groupBy(*keys).agg(F.first("changed").alias("changed"), F.count("*").alias("n"))
    met = F.raise_error(F.concat(F.lit("edits meet in paragraph "), "p_idx", F.lit(" of "), F.col("doc_id")))
    changed = changed.select(*keys, F.when(F.col("n") == 1, F.col("changed")).otherwise(met).alias("changed"))
    return paragraphs.join(changed, ["doc_id", "p_idx"], "left").withColumn("text", F.coalesce("changed", "text")).drop("changed")


def rows_edited(cells: DataFrame, deleted: DataFrame, inserted: DataFrame) -> DataFrame:
    """Table cells once rows go and come: deleted (doc_id, tbl_idx, row_idx); inserted (doc_id, tbl_idx, after_row, cell_idx, text); rows are numbered anew."""
    from pyspark.sql import Window

    kept = cells.join(deleted, ["doc_id", "tbl_idx", "row_idx"], "left_anti").select("doc_id", "tbl_idx", F.col("row_idx").cast("double").alias("at"), "cell_idx", "text")
    new = inserted.select("doc_id", "tbl_idx", (F.col("after_row") + 0.5).alias("at"), "cell_idx", "text")
    w = Window.partitionBy("doc_id", "tbl_idx").orderBy("at")
    return kept.unionByName(new).withColumn("row_idx", (F.dense_rank().over(w) - 1).cast("int")).drop("at")


def columns_edited(cells: DataFrame, deleted: list[int]) -> DataFrame:
    """Cells without the columns given, those right of them moved up."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "tbl_idx", "row_idx").orderBy("cell_idx")
    return cells.where(~F.col("cell_idx").isin([*deleted, -1])).withColumn("cell_idx", (F.row_number().over(w) - 1).cast("int"))


def renamed_bookmark(bookmarks: DataFrame, links: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Bookmarks and links with a name changed everywhere."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]{0,39}", new):
        raise ValueError(f"not a bookmark name: {new}")
    swap = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    return bookmarks.withColumn("name", swap("name")), links.withColumn("anchor", swap("anchor"))
