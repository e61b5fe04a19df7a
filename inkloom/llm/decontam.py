"""Benchmark decontamination by an FM-index of each shard of documents.

A shard is some consecutive documents of a partition. Its index holds what of their words can match
at all: stretches whose consecutive word pairs all occur in the benchmark, at least as long as the
shortest window. Windows of the benchmark are searched backwards, occurrences are located by sampled
suffixes, and the spans of one document are merged.

The benchmark's windows go to the executors in blocks of bounded size; a benchmark of several
blocks takes one pass over the documents for each, and the passes' spans are merged.

Defined results: null has no words; an item without words has no windows; item rows that share an
item_id are one item; a null item_id counts as the item 'null'; documents may repeat; further
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_key
from .fm_index import FMIndex

WINDOW = 13
#: Bytes of benchmark text of one block.
BLOCK_BYTES = 4 << 20
#: Indexed words, and bytes of text, of a shard.
SHARD_WORDS = 1 << 18
SHARD_BYTES = 32 << 20
#: Letters in lower case, digits and what is beyond ASCII stay; all else parts words.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The windows of some benchmark items, as rows of word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        number: dict[bytes, int] = {}
        owners = defaultdict(set)
        for name, text in items:
            words = [number.setdefault(w, len(number) + 1) for w in fold_words(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[i : i + window])].add(name)
        self.number = number
        self.names = sorted({n for names in owners.values() for n in names})
        at = {n: i for i, n in enumerate(self.names)}
        rows = list(owners)
        self.owners = [sorted(at[n] for n in owners[r]) for r in rows]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int64)
        for i, r in enumerate(rows):
            self.rows[i, : len(r)] = r
        self.base = len(number) + 2
        self.pairs = np.unique([a * self.base + b for r in rows for a, b in zip(r, r[1:], strict=False)]).astype(np.int64)
        self.single = np.zeros(self.base, bool)
        self.single[[r[0] for r in rows if len(r) == 1]] = True
        self.least = min((len(r) for r in rows if len(r) > 1), default=0)

    def kept(self, ids: np.ndarray) -> np.ndarray:
        """Which words of one or more documents (0: unknown word or a document's end) may belong to a match."""
        out = self.single[ids] if self.single.any() else np.zeros(len(ids), bool)
        if not self.least or len(ids) < 2:
            return out
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[both] * self.base + ids[both + 1]
        found = np.searchsorted(self.pairs, code)
        known = np.zeros(len(ids) + 1, np.int8)
        known[both + 1] = self.pairs[np.minimum(found, len(self.pairs) - 1)] == code
        step = np.diff(known)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        fits = ends - starts + 1 >= self.least
        edge = np.zeros(len(ids) + 1, np.int32)
        np.add.at(edge, starts[fits], 1)
        np.add.at(edge, ends[fits] + 1, -1)
        return out | (np.cumsum(edge[:-1]) > 0)


def matches(windows: Windows, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[dict, dict]:
    """Spans and items by document; parts: (document, places of its kept words, their numbers)."""
    unknown = windows.base  # a word that no window has parts documents and stretches
    seq, doc, place = [], [], []
    for d, at, ids in parts:
        breaks = np.flatnonzero(np.diff(at) != 1) + 1
        seq.append(np.append(np.insert(ids, breaks, unknown), unknown))
        place.append(np.append(np.insert(at, breaks, -1), -1))
        doc.append(np.full(len(seq[-1]), d))
    seq, doc, place = map(np.concatenate, (seq, doc, place))
    index = FMIndex(seq)
    low, high = index.search(windows.rows, windows.lengths)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    found = index.locate(rows)
    spans, items = defaultdict(list), defaultdict(set)
    order = np.lexsort((found, doc[found]))
    for d, a, w in zip(doc[found][order].tolist(), place[found][order].tolist(), window[order].tolist(), strict=True):
        items[d].update(windows.owners[w])
        e = a + int(windows.lengths[w])
        if spans[d] and a <= spans[d][-1][1]:
            spans[d][-1][1] = max(e, spans[d][-1][1])
        else:
            spans[d].append([a, e])
    return spans, items


SPANS = "doc_id long, key long, n_words long, spans array<struct<a: int, e: int>>, items array<string>"
_TYPES = (pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("e", pa.int32())])), pa.list_(pa.string()))


def _search(windows):
    def emit(w: Windows, docs: list, held: list) -> pa.RecordBatch:
        spans, items = matches(w, held) if held else ({}, {})
        rows = [(n, [{"a": a, "e": e} for a, e in spans.get(i, ())], [w.names[k] for k in sorted(items.get(i, ()))]) for i, (_, _, n) in enumerate(docs)]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.int64()), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=["doc_id", "key", "n_words", "spans", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        number = w.number.get
        docs: list[tuple] = []
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        n_words = n_bytes = 0
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                words = fold_words(text or b"")
                ids = np.fromiter((number(x, 0) for x in words), np.int64, len(words))
                at = np.flatnonzero(w.kept(ids))
                if len(at):
                    held.append((len(docs), at, ids[at]))
                    n_words += len(at)
                docs.append((doc_id, key, len(words)))
                n_bytes += len(text or b"")
                if n_words >= SHARD_WORDS or n_bytes >= SHARD_BYTES:
                    yield emit(w, docs, held)
                    docs, held, n_words, n_bytes = [], [], 0, 0
        if docs:
            yield emit(w, docs, held)

    return run


MERGE = """aggregate(array_sort(spans), cast(array() as array<struct<a: int, e: int>>), (m, x) ->
  if(size(m) > 0 and x.a <= element_at(m, -1).e,
     concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).a as a, greatest(element_at(m, -1).e, x.e) as e))),
     concat(m, array(x))))"""


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, key (of its text), n_words, spans (word ranges a to e of benchmark windows, merged), items."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text"), F.col("text").alias("_t")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("_t"))).head()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    found = None
    for b in range(blocks):
        part = items.where(F.expr(f"pmod(xxhash64(text), {blocks}) = {b}")).select("item", "text")
        windows = spark.sparkContext.broadcast(Windows([(r.item, bytes(r.text)) for r in part.toLocalIterator()], window))
        hits = texts.mapInArrow(_search(windows), SPANS)
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        found = found.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.expr(f"count(*) div {blocks}").alias("copies"))
        found = found.select("doc_id", "key", "n_words", F.expr(MERGE).alias("spans"), "items", F.explode(F.expr("sequence(1L, copies)"))).drop("col")
    return found


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: words hit are a share-th of all or more."""
    hit = found.withColumn("n_hit", F.expr("aggregate(spans, 0L, (s, x) -> s + x.e - x.a)"))
    hit = hit.withColumn("n_items", F.size("items").cast("long"))
    hit = hit.withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ","), 256))
    return hit.withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    return judged(find(docs, benchmark, window)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "key")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    bad = contamination(docs, benchmark, window).where("contaminated").select("doc_id", "key").distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (text_key(docs["text"]) == bad["key"]), "left_anti")


def oracle_sql(window: int = WINDOW) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {words} AS w FROM benchmark),
win AS (
  SELECT item, unnest(list_transform(range(1, greatest(1, len(w) - {window} + 1) + 1), lambda i: list_slice(w, i, i + {window - 1}))) AS x
  FROM items WHERE len(w) > 0),
win2 AS (SELECT item, len(x) AS n, array_to_string(x, ' ') AS x FROM win),
lens AS (SELECT DISTINCT n FROM win2),
pos AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
occ AS (SELECT p.r, p.i, p.n, q.item FROM (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM pos) p JOIN win2 q ON p.n = q.n AND p.x = q.x),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""
