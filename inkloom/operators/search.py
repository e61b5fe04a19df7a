"""Search in paragraphs: literal, regular expression and fuzzy, with scopes, occurrences and context."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions import text as T

Scope = str | dict | Callable[[], Column] | Column | None


def with_sections(paragraphs: DataFrame, heading: Column, parent: str | None = None) -> DataFrame:
    """Adds `section`: the text of the nearest heading before, under the same parent."""
    keys = ["doc_id"] + ([parent] if parent else [])
    before = Window.partitionBy(*keys).orderBy("p_idx").rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs.withColumn("section", F.last(F.when(heading, F.col("text")), ignorenulls=True).over(before))


def scope_heading(style: Column, outline: Column) -> Column:
    """What ends a section for scopes: an outline level, or a heading, title or contents style."""
    low = F.lower(style)
    return outline.isNotNull() | F.coalesce(style.startswith("Heading") | low.contains("heading") | (style == "Title") | low.startswith("toc"), F.lit(False))


LOCATIONS = {"tables": "table:%", "body": "body", "headers": "header%", "footers": "footer%"}


def scope_filter(scope: Scope, heading: Column | None = None) -> Column:
    """A predicate from a scope.

    A text searches paragraphs, `section:NAME` paragraphs below a heading that contains NAME (with
    with_sections() applied), `paragraph_containing:TEXT` as a plain text. A dict joins contains,
    not_contains, section and location; other keys are an error.
    """
    if scope is None:
        return F.lit(True)
    if isinstance(scope, Column):
        return scope
    if callable(scope):
        return scope()
    heading = F.lit(False) if heading is None else heading
    section = lambda name: ~heading & F.coalesce(F.contains("section", F.lit(name)), F.lit(False))
    if isinstance(scope, str):
        kind, _, rest = scope.partition(":")
        if kind == "section" and rest:
            return section(rest)
        return F.contains("text", F.lit(rest if kind == "paragraph_containing" and rest else scope))
    tests = F.lit(True)
    for key, value in scope.items():
        if key == "contains":
            tests &= F.contains("text", F.lit(value))
        elif key == "not_contains":
            tests &= ~F.contains("text", F.lit(value))
        elif key == "section":
            tests &= section(value)
        elif key == "location":
            if value not in LOCATIONS:
                raise ValueError(f"location must be one of {sorted(LOCATIONS)}")
            tests &= F.col("location").like(LOCATIONS[value])
        else:
            raise ValueError(f"unknown scope key {key!r}")
    return tests


def note_scope(scope: str) -> Column:
    """A predicate on notes: footnotes, endnotes, notes, footnote:N or endnote:N."""
    kind, _, number = scope.partition(":")
    if kind in ("footnotes", "endnotes"):
        return F.col("note_kind") == kind[:-1]
    if kind == "notes":
        return F.lit(True)
    if kind in ("footnote", "endnote") and number:
        return (F.col("note_kind") == kind) & (F.col("note_id") == number)
    raise ValueError(f"not a note scope: {scope}")


def scope_report(paragraphs: DataFrame, scope: Scope, chars: int = 100) -> DataFrame:
    """(doc_id, matched, excluded): beginnings of the paragraphs in and out of a scope."""
    start = F.struct("p_idx", F.substring("text", 1, chars).alias("t"))
    inside = scope_filter(scope)
    lists = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, start))), lambda x: x["t"])
    return paragraphs.groupBy("doc_id").agg(lists(inside).alias("matched"), lists(~inside).alias("excluded"))


def _quoted(found: str) -> str:
    return "\\Q" + found.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def literal_cuts(text: Column, found: str, case_sensitive: bool = True) -> Column:
    """The text cut before each place where found starts (places may overlap), a mark ahead of the first piece if found doesn't start there."""
    pattern = ("" if case_sensitive else "(?iu)") + _quoted(found)
    pieces = F.split(text, f"(?={pattern})", -1)
    return F.when(text.rlike(f"^(?:{pattern})"), pieces).otherwise(F.concat(F.array(F.lit(None).cast("string")), pieces))


def literal_pieces(cuts: Column, found: str) -> Column:
    """From literal_cuts the pieces as (size, head): head is what found matched, null for what stands ahead of the first place.

    Cases are folded while matching, so sizes are those of the text itself.
    """
    ahead = F.get(cuts, F.lit(0)).isNull()
    # A piece shorter than found ends where the next place begins: what was found goes on in the pieces after it.
    whole = lambda p, i: F.when(F.length(p) >= len(found), p).otherwise(F.array_join(F.slice(cuts, i + 1, F.lit(len(found))), ""))
    head = lambda p, i: F.when(~ahead | (i > 1), F.substring(whole(p, i), 1, len(found)))
    return F.filter(F.transform(cuts, lambda p, i: F.struct(F.length(p).alias("size"), head(p, i).alias("head"))), lambda x: x["size"].isNotNull())


#: Stand around each match of a regular expression; no text holds them.
_OPEN, _CLOSE = "\uffff", "\ufffe"


def regex_pieces(cuts: Column) -> Column:
    """From a text marked around each match and cut ahead of it: (size, head) of each match, size counting what stands before it too."""
    match = lambda p: F.substring_index(p, _CLOSE, 1)
    rest = lambda p, i: F.when(i == 0, F.length(p)).otherwise(F.length(p) - F.length(match(p)) - 1)
    return F.transform(F.slice(cuts, F.lit(2), F.size(cuts)), lambda p, i: F.struct((rest(F.get(cuts, i), i) + F.length(match(p))).alias("size"), match(p).alias("head")))


def find_all(
    paragraphs: DataFrame, find: str, regex: bool = False, case_sensitive: bool = True, scope: Scope = None, chars: int = 40, normalize: bool = False, heading: Column | None = None, fuzzy: dict | None = None
) -> DataFrame:
    """Matches in document order: the keys of paragraphs, index, pos, len, found, context.

    paragraphs: (doc_id, p_idx, text, …). Regular expressions are Java's, with Unicode classes;
    empty matches are dropped. fuzzy: {threshold, normalize_whitespace}.
    """
    if not find:
        raise ValueError("nothing to find")
    inside = paragraphs.where(scope_filter(scope, heading))
    keys = [c for c in paragraphs.columns if c not in ("text", "section")]
    if fuzzy:
        return fuzzy_find(inside, find, **fuzzy)
    # Pieces carry their size and what was found in them; places are running sums of sizes.
    if regex:
        pattern = "(?U)" + ("" if case_sensitive else "(?iu)") + find
        rows = inside.where(F.col("text").rlike(pattern))
        cuts = F.split(F.regexp_replace("text", pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN, -1)
        rows = rows.withColumn("_cuts", cuts)  # a column, as it is used for every piece
        pieces = regex_pieces(F.col("_cuts"))
        start = F.col("end") - F.length("x.head")
    else:
        text = T.normalize_special(F.col("text")) if normalize else F.col("text")
        seek = find
        for k, v in T.SPECIAL.items() if normalize else ():
            seek = seek.replace(k, v)
        rows = inside.where(F.contains(text, F.lit(seek)) if case_sensitive else text.rlike("(?iu)" + _quoted(seek)))
        rows = rows.withColumn("_cuts", literal_cuts(text, seek, case_sensitive))  # a column, as it is used for every piece
        pieces = literal_pieces(F.col("_cuts"), seek)
        if normalize:  # what stands in the text itself, at the same place
            whole = F.transform(pieces, lambda p: p["size"])
            at = lambda i: F.aggregate(F.slice(whole, 1, i), F.lit(0), lambda s, n: s + n)
            pieces = F.transform(pieces, lambda p, i: F.struct(p["size"].alias("size"), F.when(p["head"].isNotNull(), F.substr("text", at(i) + 1, F.lit(len(seek)))).alias("head")))
        start = F.col("end") - F.col("x.size")
    # The context depends on what was found alone, so it is made once for each spelling and the text goes no further.
    rows = rows.withColumn("pieces", pieces)
    kinds = F.array_distinct(F.filter(F.transform("pieces", lambda x: x["head"]), lambda h: F.length(h) > 0))
    contexts = F.map_from_arrays(kinds, F.transform(kinds, lambda k: T.context(F.col("text"), k, chars)))
    rows = rows.select(*keys, contexts.alias("contexts"), "pieces").select(*keys, "contexts", F.posexplode("pieces").alias("piece", "x"))
    order = Window.partitionBy("doc_id", "p_idx").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("x.size").over(order).cast("int")).where(F.length("x.head") > 0).withColumn("pos", start)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("p_idx", "pos")) - 1
    return rows.select(*keys, index.alias("index"), "pos", F.length("x.head").alias("len"), F.col("x.head").alias("found"), F.element_at("contexts", F.col("x.head")).alias("context"))


def matching(paragraphs: DataFrame, find: str) -> DataFrame:
    """Paragraphs that contain a text, the filter that every edit starts with."""
    return paragraphs.where(F.contains("text", F.lit(find)))


def occurrences(matches: DataFrame, which: str | int | list[int]) -> DataFrame:
    """Of each document's matches the first, the last, all, or those of the numbers given (from 1)."""
    if which == "all":
        return matches
    if which == "first":
        return matches.where("index = 0")
    if which == "last":
        last = F.max("index").over(Window.partitionBy("doc_id"))
        return matches.withColumn("_last", last).where("index = _last").drop("_last")
    numbers = [which] if isinstance(which, int) else list(which)
    if any(n < 1 for n in numbers):
        raise ValueError("occurrences count from 1")
    return matches.where(F.col("index").isin([n - 1 for n in numbers]))


def uniqueness(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, n, status): found, not_found or ambiguous, for every document."""
    n = matches.groupBy("doc_id").agg(F.count("*").alias("n"))
    out = docs.select("doc_id").distinct().join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("status", F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous"))


def expand_groups(matches: Column, pattern: str, replacement: str) -> Column:
    """The replacement for a match, with \\1 and \\g<name> filled from its groups."""
    java = re.sub(r"\\g<(\w+)>", r"${\1}", re.sub(r"\\(\d)", r"$\1", replacement))
    java = re.sub(r"\$\{(\d+)\}", r"$\1", java)
    return F.regexp_replace(matches, "(?U)" + re.sub(r"\(\?P<", "(?<", pattern), java)


def suggestions(paragraphs: DataFrame, find: str) -> DataFrame:
    """(doc_id, suggestions): why a text may not have been found in each document."""
    rules = [
        (any(c in find for c in T.QUOTES) or "'" in find or '"' in find, "compare its quotes with those of the document"),
        ("  " in find, "it has spaces in a row: one may be enough"),
        (find != find.strip(), f"white space at its ends: search for <{find.strip()}>"),
    ]
    fixed = [F.lit(s) for test, s in rules if test]
    whole = paragraphs.groupBy("doc_id").agg(F.max(F.contains(F.lower("text"), F.lit(find.lower()))).alias("loose"))
    some = F.array_compact(F.array(*fixed, F.when(F.col("loose"), F.lit("it is there in other capitals"))))
    general = F.array(F.lit("look for spelling mistakes"), F.lit("search for a shorter stretch"), F.lit("the document may not have it"))
    return whole.select("doc_id", F.when(F.size(some) > 0, some).otherwise(general).alias("suggestions"))


def ratio(a: str, b: str) -> float:
    """Similarity 2 * LCS / (length of both), from 0 to 1, by bit-parallel rows."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def needed_runs(m: int, threshold: float) -> dict[int, int]:
    """For each window length that can be similar enough to a text of m characters: how long a stretch they must share.

    With L characters in common, m - L and n - L others part them into at most m + n - 2L + 1 stretches.
    """
    out = {}
    for n in range(max(1, int(m * 0.7)), int(m * 1.3) + 1):
        common = max(1, math.ceil(threshold * (m + n) / 2 - 1e-9))
        if common <= min(m, n):
            out[n] = -(-common // (m + n - 2 * common + 1))
    return out


def shared_characters(text: str, find: str) -> np.ndarray:
    """For each different character of find a row: how often it stands in the text before each place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.array(sorted(set(map(ord, find))), np.uint32)
    sums = np.zeros((len(kinds), len(codes) + 1), np.int32)
    np.cumsum(codes[None, :] == kinds[:, None], axis=1, out=sums[:, 1:])
    return sums


def near_windows(sums: np.ndarray, find: str, starts: np.ndarray, ends: np.ndarray, threshold: float) -> np.ndarray:
    """Which windows may be similar enough: what two texts have in common in order is at most what they have in common at all."""
    have = np.array([find.count(c) for c in sorted(set(find))], np.int32)[:, None]
    common = np.minimum(sums[:, ends] - sums[:, starts], have).sum(0)
    return 2 * common >= threshold * (len(find) + ends - starts) - 1e-9


#: Characters whose windows are looked at together.
_TOGETHER = 1 << 18


def packed(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about _TOGETHER characters."""
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t) + 1
        if size >= _TOGETHER:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def fuzzy_windows(texts: list[str], find: str, threshold: float) -> list[list[tuple[int, int, float]]]:
    """For each text the best of the overlapping windows, 0.7 to 1.3 times as long as find, that are similar enough.

    Texts are laid end to end, so that what windows have in common with find is counted for all of them at once.
    """
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    for i, j in packed(texts):
        whole = "\n".join(texts[i:j])
        sizes = np.array([len(t) for t in texts[i:j]])
        begin = np.cumsum(sizes + 1) - sizes - 1
        sums = shared_characters(whole, find)
        for n in needed_runs(len(find), threshold):
            starts = np.arange(max(0, len(whole) - n + 1))
            starts = starts[near_windows(sums, find, starts, starts + n, threshold)]
            owner = np.searchsorted(begin, starts, "right") - 1
            inside = starts + n <= begin[owner] + sizes[owner]
            for k, at in zip(owner[inside].tolist(), starts[inside].tolist(), strict=True):
                score = ratio(find, whole[at : at + n])
                if score >= threshold:
                    out[i + k].append((at - int(begin[k]), n, score))
    for k, found in enumerate(out):
        best: list[tuple[int, int, float]] = []
        for at, n, score in sorted(found, key=lambda x: (-x[2], x[0], x[1])):
            if all(at >= a + m or a >= at + n for a, m, _ in best):
                best.append((at, n, score))
        out[k] = sorted(best)
    return out


def fuzzy_find(paragraphs: DataFrame, find: str, threshold: float = 0.9, normalize_whitespace: bool = False) -> DataFrame:
    """(doc_id, p_idx, index, pos, len, found, score). Paragraphs without a stretch that a match must share are skipped."""
    seek = " ".join(find.split()) if normalize_whitespace else find
    text = T.squeeze(F.col("text")) if normalize_whitespace else F.col("text")
    rows = paragraphs.select("doc_id", "p_idx", text.alias("text"))
    q = min(needed_runs(len(seek), threshold).values(), default=len(seek))
    some = F.lit(False)
    for g in sorted({seek[i : i + q] for i in range(len(seek) - q + 1)}):
        some |= F.contains("text", F.lit(g))
    rows = rows.where(some)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            texts = d["text"].tolist()
            out = [(doc, p, at, n, t[at : at + n], score) for doc, p, t, hits in zip(d["doc_id"], d["p_idx"], texts, fuzzy_windows(texts, seek, threshold), strict=True) for at, n, score in hits]
            yield pd.DataFrame(out, columns=["doc_id", "p_idx", "pos", "len", "found", "score"])

    kind = dict(paragraphs.dtypes)
    hits = rows.mapInPandas(run, f"doc_id {kind['doc_id']}, p_idx int, pos int, len int, found string, score double")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("p_idx", "pos")) - 1
    return hits.select("doc_id", "p_idx", index.alias("index"), "pos", "len", "found", "score")


def word_windows(texts: list[str], low: str, least: float) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of windows of whole words, 0.7 to 1.5 times as long as low, that may be similar enough to it once in lower case."""
    m = len(low)
    for i, j in packed(texts):
        whole = "\n".join(texts[i:j])
        sizes = np.array([len(t) for t in texts[i:j]])
        begin = np.cumsum(sizes + 1) - sizes - 1
        words = np.array([w.span() for w in re.finditer(r"\S+", whole)], np.int64).reshape(-1, 2)
        folded = whole.lower()
        sums = shared_characters(folded, low) if len(folded) == len(whole) else None  # a few letters grow when folded: then every window is tried
        for k in range(len(words)):
            starts, ends = words[: len(words) - k, 0], words[k:, 1]
            if (ends - starts > 1.5 * m).all():
                break
            owner = np.searchsorted(begin, starts, "right") - 1
            keep = (ends - starts >= 0.7 * m) & (ends - starts <= 1.5 * m) & (ends <= begin[owner] + sizes[owner])
            if sums is not None:
                keep[keep] = near_windows(sums, low, starts[keep], ends[keep], least)
            yield from zip((owner[keep] + i).tolist(), (starts - begin[owner])[keep].tolist(), (ends - begin[owner])[keep].tolist(), strict=True)


def similar_texts(paragraphs: DataFrame, find: str, k: int = 3, least: float = 0.6) -> DataFrame:
    """(doc_id, rank, found, score): the k most similar windows of each document that differ in more than case, of spellings alike the least by code point."""
    low = find.lower()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            out = []
            texts = [t or "" for t in d["text"]]
            found: dict[int, dict[str, tuple[float, str]]] = {}
            for i, a, e in sorted(word_windows(texts, low, least)):
                window = texts[i][a:e]
                score = ratio(low, window.lower())
                best = found.setdefault(i, {})
                if score >= least and window < best.get(window.lower(), (0.0, "\U0010ffff"))[1]:
                    best[window.lower()] = (score, window)
            for i, best in sorted(found.items()):
                doc = d["doc_id"].iloc[i]
                out += [(doc, t, s) for s, t in sorted(best.values(), key=lambda x: (-x[0], x[1].lower()))[:k]]
            yield pd.DataFrame(out, columns=["doc_id", "found", "score"])

    kind = dict(paragraphs.dtypes)
    hits = paragraphs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind['doc_id']}, found string, score double")
    once = hits.groupBy("doc_id", F.lower("found").alias("low")).agg(F.min("found").alias("found"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "low"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "rank", "found", "score")


def dry_run(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, seq, n, status) for edits (doc_id, seq, find): how often each would match in its document, as of now."""
    hits = edits.join(paragraphs, "doc_id").where(F.expr("contains(text, find)")).groupBy("doc_id", "seq").agg(F.sum(F.expr("(length(text) - length(replace(text, find, ''))) div length(find)")).alias("n"))
    out = edits.join(hits, ["doc_id", "seq"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("doc_id", "seq", "n", F.when(F.col("n") > 0, "ok").otherwise("failed").alias("status"))
