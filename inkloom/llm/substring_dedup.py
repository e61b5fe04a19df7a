"""Substring dedup: remove words covered by a window that also starts in a document of smaller doc_id.

1. Each partition sketches the anchors of its texts (windows.py) in a count-min sketch; the sketches
   are summed cell by cell. A window has an anchor wherever it occurs, so the estimate for its
   anchor is never below the window's count: a window whose anchor is estimated once is unique.
   Sketching one anchor a run instead of each window makes the sketch some 20 times smaller.
2. A second pass keeps only runs whose anchor is estimated repeated, with the hashes of their
   windows, and groups them exactly: first whole runs, then, where an anchor has different runs, the
   windows of the earliest occurrence of each.

Only one bit per cell (counted twice or not) returns to the tasks, `DEPTH * 2**bits` bits in all. Where
that would be more than `DEPTH * 2**MOST_BITS`, the cells counted twice stay a table, runs are joined
with it, and hashes of windows are taken from the texts once it is known which are wanted. Words are compared by their hashes: a span by 128 bits (anchor and span),
a window by 128 (anchor and window), which a trillion windows confuse with probability below 1e-14.

Defined results: an empty table gives no rows; null has no words; doc_id null counts as larger than any other; two rows with one
doc_id don't remove from each other; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, partitions, small_batches, stash, text_key
from .suffix_dedup import with_spans
from .windows import BYTES, PIECE, anchors, merged, pieces, prefix, span_hash

WIDTH = 50
GRAM = 8
DEPTH = 2
#: The sketch has 2**bits cells a row, which grows with the text. While the bits of all cells are at most 8 MB a row
#: they are sent to the tasks; a larger sketch stays a table and is joined.
LEAST_BITS, MOST_BITS = 16, 26
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LAST_ID = (1 << 63) - 1
RUN = "id long, key long, a int, n int, g long, s long"
WINDOW = "id long, g long, s long, x int, w long"


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a buffer and the place where it starts."""
    out, places = [], []
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):  # cut between words, or after a word longer than a piece
            part = _SPACE[np.frombuffer(text, np.uint8, end - at, at)]
            gaps = np.flatnonzero(part)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                more = [p for c in b" \t\n\v\f\r" if (p := text.find(bytes([c]), end)) >= 0]
                end = min(more, default=len(text))
        data = np.frombuffer(text, np.uint8, end - at, at)
        gap = np.concatenate([[True], _SPACE[data], [True]])
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        sums = prefix(BYTES[data])
        out.append(span_hash(sums, edges[::2], edges[1::2]))
        places.append(edges[::2] + at)
        at = end
    return (np.concatenate(out), np.concatenate(places)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def runs_of(texts: list[bytes], width: int, gram: int):
    """(text, a, n, g, s, window hashes) of all runs, for a group of texts at a time."""
    for i, j in grouped([len(t) + 1 for t in texts], PIECE):
        lengths = np.array([len(t) + 1 for t in texts[i:j]])
        values, places = word_hashes(b"\n".join(texts[i:j]))
        begin = np.searchsorted(places, np.cumsum(lengths) - lengths)
        end = np.append(begin[1:], len(values))
        for at, stop in pieces(len(values), width) if j - i == 1 else [(0, len(values))]:
            starts, ends = (begin, end) if j - i > 1 else (np.array([0]), np.array([stop - at]))
            doc, a, n, g, s, sums = anchors(values[at:stop], starts, ends, width, gram)
            yield doc + i, a - starts[doc] + at, n, g, s, (sums, a)


def _sketch(width: int, gram: int, bits: int):
    """The partition's sketch as its cells that aren't 0: (cell, count), count saturating at 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for _, _, _, g, _, _ in runs_of([t or b"" for t in batch.column("text").to_pylist()], width, gram):
                kept.append(g)
                held += len(g)
            if held > 1 << 20:
                yield _cells(np.concatenate(kept), bits)
                kept, held = [np.zeros(0, np.uint64)], 0
        yield _cells(np.concatenate(kept), bits)

    return run


def cells(g: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch, rows one after the other."""
    mask = np.uint64((1 << bits) - 1)
    return [(((g >> np.uint64(32 * k)) & mask) + np.uint64(k << bits)).astype(np.int64) for k in range(DEPTH)]


def _cells(g: np.ndarray, bits: int) -> pa.RecordBatch:
    cell, count = np.unique(np.concatenate(cells(g, bits)), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.minimum(count, 2).astype(np.int8))], names=["cell", "n"])


def repeated_cells(texts: DataFrame, width: int, gram: int, bits: int) -> np.ndarray:
    """One bit for each cell of the merged sketch: whether it counted two or more."""
    block = min(bits, 16)
    parts = (
        texts.mapInArrow(_sketch(width, gram, bits), "cell long, n byte")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .groupBy(F.shiftright("cell", block).cast("int").alias("block"))
        .applyInPandas(lambda k, d: _packed(k[0], d["cell"].to_numpy(), block), "block int, bits binary")
    )
    out = np.zeros((DEPTH << bits) // 8, np.uint8)
    size = (1 << block) // 8
    for row in parts.toLocalIterator():
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def _packed(block: int, cell: np.ndarray, width: int):
    import pandas as pd

    flags = np.zeros(1 << width, bool)
    flags[cell - (int(block) << width)] = True
    return pd.DataFrame({"block": [int(block)], "bits": [np.packbits(flags, bitorder="little").tobytes()]})


def _runs(width: int, gram: int, bits: int, repeated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = repeated.value
        for batch in batches:
            for doc, a, n, g, s, (sums, at) in runs_of([t or b"" for t in batch.column("text").to_pylist()], width, gram):
                keep = np.ones(len(g), bool)
                for c in cells(g, bits):
                    keep &= (table[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
                doc, a, n, g, s, at = (x[keep] for x in (doc, a, n, g, s, at))
                if not len(doc):
                    continue
                places = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                hashes = span_hash(sums, places, places + width)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n) * 8]).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(hashes.tobytes())])
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("key").take(rows), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(s.view(np.int64)), packed],
                    names=["id", "key", "a", "n", "g", "s", "hashes"],
                )

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of each run."""
    for batch in batches:
        hashes = [np.frombuffer(h, np.int64) for h in batch.column("hashes").to_pylist()]
        if not hashes:
            continue
        n = np.array([len(h) for h in hashes])
        rows = pa.array(np.repeat(np.arange(len(n)), n))
        x = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("id", "g", "s")), pa.array(x), pa.array(np.concatenate(hashes))], names=["id", "g", "s", "x", "w"])


def _windows_of_texts(width: int):
    """As _windows, for rows (id, text, spans) of texts and the runs (g, s, a, n) wanted of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "spans")), strict=True):
                sums = prefix(word_hashes(text or b"")[0])
                for x in spans:
                    places = np.arange(x["a"], x["a"] + x["n"])
                    w = span_hash(sums, places, places + width).view(np.int64)
                    same = lambda v, n=x["n"]: pa.array(np.full(n, v, np.int64))
                    yield pa.RecordBatch.from_arrays([same(doc), same(x["g"]), same(x["s"]), pa.array(np.arange(x["n"], dtype=np.int32)), pa.array(w)], names=["id", "g", "s", "x", "w"])

    return run


def _bare_runs(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, a, n, g, s, _ in runs_of([t or b"" for t in batch.column("text").to_pylist()], width, gram):
                if len(doc):
                    rows = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(rows), batch.column("key").take(rows), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(s.view(np.int64))],
                        names=["id", "key", "a", "n", "g", "s"],
                    )

    return run


def runs_by_join(texts: DataFrame, width: int, gram: int, bits: int) -> DataFrame:
    """Runs whose anchor is estimated repeated, by a sketch too large to send to tasks: a table of its repeated cells, joined row by row.

    Partial sums are the partitions' sketches, without the cells that are 0. A row of the sketch need only count what passed the one before.
    """
    runs = stash(texts.mapInArrow(_bare_runs(width, gram), RUN), "word-runs")
    for k in range(DEPTH):
        cell = F.expr(f"xxhash64(g, {k}) & {(1 << min(bits, 62)) - 1}L")
        often = stash(runs.groupBy(cell.alias("cell")).agg(F.count("*").alias("count")).where("count > 1").select("cell"), "sketch-cells")
        runs = runs.withColumn("cell", cell).join(often, "cell", "left_semi").select("id", "key", "a", "n", "g", "s")
    return stash(runs, "word-runs")


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, spans): removed word ranges of each text that has some, array of (a, e), not yet merged."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    size = docs.agg(F.sum(F.length(F.col("text")))).head()[0] or 0
    # About one anchor for 22 words of 6 letters; four cells each.
    bits = max(LEAST_BITS, int(size * 4 / 132).bit_length())
    if bits <= MOST_BITS:
        sketch = spark.sparkContext.broadcast(repeated_cells(texts.select("text"), width, gram, bits))
        runs = stash(texts.mapInArrow(_runs(width, gram, bits, sketch), f"{RUN}, hashes binary"), "word-runs")
    else:
        runs = runs_by_join(texts, width, gram, bits)
    # Written, so that the join with all runs has plain exchanges on both sides: Spark splits a span that stands everywhere.
    again = stash(runs.groupBy("g", "s").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "word-spans")
    shared = runs.groupBy("g").agg(F.min("s").alias("s0"), F.max("s").alias("s1")).where("s0 <> s1").select("g")
    bare = runs.select("id", "key", "a", "n", "g", "s")
    whole = bare.join(again, ["g", "s"]).where("id > first").select("id", "key", "a", F.expr(f"a + n - 1 + {width}").alias("e"))
    # Windows of the first occurrence of each span whose anchor has others.
    if "hashes" in runs.columns:
        unlike = runs.groupBy("g", "s").agg(F.min(F.struct("id", "hashes")).alias("r")).select("g", "s", "r.*").join(shared, "g", "left_semi")
        windows = unlike.mapInArrow(_windows, WINDOW)
    else:  # their hashes come from the texts where they stand
        unlike = runs.groupBy("g", "s").agg(F.min(F.struct("id", "key", "a", "n")).alias("r")).select("g", "s", "r.*").join(shared, "g", "left_semi")
        wanted = unlike.groupBy("id", "key").agg(F.collect_list(F.struct("g", "s", "a", "n")).alias("spans"))
        windows = texts.join(wanted, ["id", "key"]).select("id", "text", "spans").mapInArrow(_windows_of_texts(width), WINDOW)
    windows = stash(windows, "word-windows")
    least = windows.groupBy("g", "w").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    part = windows.join(least, ["g", "w"]).where("id > least").groupBy("g", "s", "id").agg(F.collect_list("x").alias("xs"))
    own = bare.join(part, ["g", "s", "id"]).select("id", "key", F.col("a").alias("a0"), F.explode(F.array_sort("xs")).alias("x"))
    some = own.select("id", "key", F.expr("a0 + x").alias("a"), F.expr(f"a0 + x + {width}").alias("e"))
    found = whole.unionByName(some).groupBy("id", "key").agg(F.collect_list(F.struct("a", "e")).alias("spans"))
    return found.select(F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "key", "spans")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space)."""
    found = repeated_spans(docs, width, gram)
    joined = with_spans(docs.select("doc_id", "text"), found).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                kept, at = [], 0
                for a, e in merged([(x["a"], x["e"]) for x in spans or ()]):
                    kept += words[at:a]
                    at = e
                kept += words[at:]
                left = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary").withColumn("kept", F.col("kept").cast("string"))
