"""Comparison of documents: paragraph operations, and token hunks within paragraphs.

Sequence matching is heuristic and order-dependent, so it runs per pair of documents (paragraphs) or
per pair of texts (tokens) in Python, over Arrow batches; pairing, counting and reports around it are joins and groups.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T

TOKEN = re.compile(T.TOKEN.removeprefix("(?U)"))
#: Beyond so many hunks a paragraph is replaced as a whole.
MOST_HUNKS = 8
HUNK = "array<struct<kind: string, start: int, end: int, old: string, new: string>>"


#: Stretches of up to so many tokens are searched as strings; longer ones by numbered runs, whose time grows little faster than the text.
_SHORT = 2048


def _longest(x: str, y: str) -> tuple[int, int, int]:
    """(i, j, size) of the longest run that two strings share: of those the first in x, then in y, as SequenceMatcher chooses."""
    least = lambda p, q: max(map(len, bytes(map(eq, p, q)).split(b"\0")))
    # Versions differ little: the longest run often lies where both start, or where both end, side by side.
    size = max(1, least(x, y), least(x[::-1], y[::-1]))
    there = {y[j : j + size] for j in range(len(y) - size + 1)}
    able = [i for i in range(len(x) - size + 1) if x[i : i + size] in there]
    if not able:
        return 0, 0, 0
    first = able[0]
    for i in able:
        while i + size < len(x) and x[i : i + size + 1] in y:
            first, size = i, size + 1
    return first, y.index(x[first : first + size]), size


class _Grams:
    """Runs of equal tokens in two texts: numbers that two places share if, and only if, the same 2^k tokens begin there."""

    def __init__(self, a: list[str], b: list[str]):
        self.cut = len(a)
        ids: dict[str, int] = {}
        self.levels = [np.array([ids.setdefault(t, len(ids)) for t in (*a, None, *b)], np.int64)]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            x, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.unique(x[:-step] * (len(x) + 1) + x[step:], return_inverse=True)[1].reshape(-1))
        return self.levels[k]

    def at(self, start: int, end: int, length: int) -> np.ndarray:
        """A number for the run of so many tokens at each place from start on that ends by end."""
        k = length.bit_length() - 1
        x = self.level(k)
        n, rest = end - start - length + 1, length - (1 << k)
        return x[start : start + n] * (len(self.levels[0]) + 1) + x[start + rest : start + rest + n]

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """(i, j, size) of the longest run that both stretches have: of those the first in the first text, then in the second, as SequenceMatcher chooses."""
        blo, bhi = blo + self.cut + 1, bhi + self.cut + 1
        both = lambda n: np.isin(self.at(alo, ahi, n), self.at(blo, bhi, n))
        size, over = 0, min(ahi - alo, bhi - blo) + 1
        step = 1
        while size + step < over and both(size + step).any():
            size += step
            step *= 2
        over = min(over, size + step)
        while size + 1 < over:
            mid = (size + over) // 2
            size, over = (mid, over) if both(mid).any() else (size, mid)
        if not size:
            return alo, blo - self.cut - 1, 0
        i = alo + int(both(size).argmax())
        j = int((self.at(blo, bhi, size) == self.at(i, i + size, size)[0]).argmax())
        return i, blo - self.cut - 1 + j, size


def _gaps(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]] | None:
    """The opcodes of SequenceMatcher(None, a, b, autojunk=False) that aren't equal; None once more than MOST_HUNKS stretches whose content differs are certain."""
    blocks, ids, grams = [], {t: i for i, t in enumerate(dict.fromkeys((*a, *b)))}, None
    if len(ids) > sys.maxunicode:  # more kinds of tokens than there are characters
        return [o for o in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
    x, y = ("".join([chr(ids[t]) for t in tokens]) for tokens in (a, b))
    blank = [chr(i) for t, i in ids.items() if t.isspace()]
    words = lambda text: reduce(lambda left, c: left.replace(c, ""), blank, text)
    # Stretches between blocks, the largest first. One whose words differ holds a hunk that counts, whatever is found within it.
    todo, certain = [], 0

    def put(alo: int, ahi: int, blo: int, bhi: int) -> int:
        if alo == ahi and blo == bhi:
            return 0
        differ = int(words(x[alo:ahi]) != words(y[blo:bhi]))
        if alo < ahi and blo < bhi:
            heapq.heappush(todo, (-(ahi - alo) * (bhi - blo), differ, alo, ahi, blo, bhi))
        return differ

    certain += put(0, len(a), 0, len(b))
    while todo:
        if certain > MOST_HUNKS:
            return None
        _, differ, alo, ahi, blo, bhi = heapq.heappop(todo)
        if set(x[alo:ahi]).isdisjoint(y[blo:bhi]):
            continue
        if max(ahi - alo, bhi - blo) <= _SHORT:
            i, j, n = _longest(x[alo:ahi], y[blo:bhi])
            i, j = alo + i, blo + j
        else:
            grams = grams or _Grams(a, b)
            i, j, n = grams.longest(alo, ahi, blo, bhi)
        if n:
            blocks.append((i, j, n))
            certain += put(alo, i, blo, j) + put(i + n, ahi, j + n, bhi) - differ
    out, i, j = [], 0, 0
    for k, m, n in [*sorted(blocks), (len(a), len(b), 0)]:
        if (i, j) != (k, m):
            out.append(("replace" if i < k and j < m else "delete" if i < k else "insert", i, k, j, m))
        i, j = k + n, m + n
    return out


def text_hunks(old: str, new: str) -> list[dict] | None:
    """Changed stretches from old to new, at places of old; None if there are too many to be readable.

    Stretches that are only white space are kept only where they touch one with content.
    """
    a, b = TOKEN.findall(old), TOKEN.findall(new)
    at = [0]
    for t in a:
        at.append(at[-1] + len(t))
    gaps = _gaps(a, b)
    if gaps is None:
        return None
    found = [(kind, i, k, "".join(a[i:k]), "".join(b[j:m])) for kind, i, k, j, m in gaps]
    content = [bool((o + n).strip()) for *_, o, n in found]
    out = []
    for n, (kind, i, k, o, w) in enumerate(found):
        near = any(0 <= x < len(found) and content[x] and (found[x][2] == i or found[x][1] == k) for x in (n - 1, n + 1))
        if content[n] or near or o == "" or w == "":
            out.append({"kind": kind, "start": at[i], "end": at[k], "old": o, "new": w})
    return None if len(out) > MOST_HUNKS else out


def hunks(old: Column | str, new: Column | str) -> Column:
    """Hunks of two columns of texts; null where either is null or there are too many."""

    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or n is None else text_hunks(o, n) for o, n in zip(old, new, strict=True)])

    return F.pandas_udf(run, HUNK)(old, new)


def viability(paragraphs: DataFrame) -> DataFrame:
    """Adds reason: why a paragraph can't be edited by hunks, null if it can."""
    reason = (
        F.when(F.col("has_revisions"), "paragraph has tracked changes")
        .when(F.col("has_unsupported"), "paragraph has fields, links or content controls")
        .when(F.col("n_runs") != F.col("n_child_runs"), "paragraph has nested runs")
        .when(F.col("text") == "", "paragraph is empty")
    )
    return paragraphs.withColumn("reason", reason)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair_id, op_idx, kind, old_start, old_end, new_start, new_end) that turn the paragraphs of old into new.

    old, new: (pair_id, p_idx, text). Pairs whose texts are equal have no rows and aren't compared.
    """
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in ("pair_id", "p_idx", "text")))  # noqa: E731  versions may come from one table
    old, new = fresh(old), fresh(new)
    digest = lambda df, name: df.groupBy("pair_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("p_idx", "text")))), 256).alias(name))
    differ = digest(old, "a").join(digest(new, "b"), "pair_id", "full").where("not (a <=> b)").select("pair_id")
    kind = dict(old.dtypes)["pair_id"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for pair, a, b in zip(*(part.column(c).to_pylist() for c in ("pair_id", "old", "new")), strict=True):
                ops = [o for o in SequenceMatcher(None, a or [], b or []).get_opcodes() if o[0] != "equal"]
                rows += [(pair, i, *o) for i, o in enumerate(ops)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = (part.schema.field("pair_id").type, pa.int32(), pa.string(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["pair_id", "op_idx", "kind", "old_start", "old_end", "new_start", "new_end"])

    lists = lambda df, name: df.join(differ, "pair_id", "left_semi").groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_idx", "text"))), lambda x: x["text"]).alias(name))
    both = lists(old, "old").join(lists(new, "new"), "pair_id", "full").select("pair_id", "old", "new")
    return both.mapInArrow(run, f"pair_id {kind}, op_idx int, kind string, old_start int, old_end int, new_start int, new_end int")


def compared_changes(operations: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair_id, op_idx, p_idx, kind, old, new, hunks): a row for each changed paragraph.

    A replacement of as many paragraphs as there were pairs them off, and their hunks are found;
    other replacements delete the old and insert the new.
    """
    even = F.expr("kind = 'replace' and old_end - old_start = new_end - new_start")
    o, n = (df.select("pair_id", F.col("p_idx").alias(f"{name}_idx"), F.col("text").alias(name)) for df, name in ((old, "old"), (new, "new")))
    gone = operations.where(~even & (F.col("kind") != "insert")).join(o, "pair_id").where("old_idx >= old_start and old_idx < old_end")
    come = operations.where(~even & (F.col("kind") != "delete")).join(n, "pair_id").where("new_idx >= new_start and new_idx < new_end")
    pairs = operations.where(even).join(o, "pair_id").where("old_idx >= old_start and old_idx < old_end").withColumn("new_idx", F.expr("old_idx - old_start + new_start")).join(n, ["pair_id", "new_idx"])
    none = F.lit(None).cast("string")
    rows = gone.select("pair_id", "op_idx", F.col("old_idx").alias("p_idx"), F.lit("delete").alias("kind"), "old", none.alias("new"))
    rows = rows.unionByName(come.select("pair_id", "op_idx", F.col("new_idx").alias("p_idx"), F.lit("insert").alias("kind"), none.alias("old"), "new"))
    rows = rows.withColumn("hunks", F.lit(None).cast(HUNK))
    return rows.unionByName(pairs.select("pair_id", "op_idx", F.col("old_idx").alias("p_idx"), F.lit("replace").alias("kind"), "old", "new", hunks("old", "new").alias("hunks")))


def comparison_stats(changes: DataFrame) -> DataFrame:
    """(pair_id, inserted, deleted, replaced, total)."""
    count = lambda k: F.count_if(F.col("kind") == k)
    return changes.groupBy("pair_id").agg(count("insert").alias("inserted"), count("delete").alias("deleted"), count("replace").alias("replaced"), F.count("*").alias("total"))


def marked_up(old: str = "old", hunk_column: str = "hunks") -> Column:
    """The old text with hunks as change markup; whole replacement where hunks are null."""
    from inkloom.functions.critic import spliced

    parts = F.transform(
        hunk_column,
        lambda h: F.struct(
            h["start"].alias("start"), h["end"].alias("end"),
            F.concat(F.when(h["old"] != "", F.concat(F.lit("{--"), h["old"], F.lit("--}"))).otherwise(""), F.when(h["new"] != "", F.concat(F.lit("{++"), h["new"], F.lit("++}"))).otherwise("")).alias("markup"),
        ),
    )
    whole = F.concat(F.lit("{--"), F.col(old), F.lit("--}{++"), F.col("new"), F.lit("++}"))
    return F.when(F.col(hunk_column).isNull(), whole).otherwise(spliced(F.col(old), parts))

