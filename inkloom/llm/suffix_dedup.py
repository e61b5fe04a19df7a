"""Suffix-array dedup: remove every byte of a string of `width` bytes that also starts elsewhere.

1. Anchors (windows.py) turn each text into runs of windows; one row per run, no text.
2. Runs with equal spans repeat as a whole. They are counted by a partial aggregate.
3. An anchor under which two different spans occur may still hold windows common to both. One
   occurrence of each such span is fetched. Fingerprints first drop the windows that nothing in
   their group can equal; suffix arrays (lyndon.py), each over whole groups of one anchor, decide
   all others: they put equal windows next to each other. A stretch that stands in several spans
   goes into its array once and counts as often as it stands; what is found there holds for all of them.
4. Equal windows have equal anchors at equal places, so no pair is split over two arrays. A group of
   more bytes than an array may have is split so that this still holds: by ranges of the anchor's
   place in the window (STEPS), and by the bytes that all windows of a range share. The last range
   is one place, where the shared bytes are the window itself: such windows, however many they are,
   are counted by their bytes.

Defined results: null is an empty text; texts shorter than `width` lose nothing; repeated rows are
copies of each other; further columns are ignored; doc_id may be null or repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, partitions, small_batches, stash, text_key
from .lyndon import suffix_array
from .windows import BYTES, PIECE, POSITION, anchors, flag_runs, gram_hashes, merged, pieces, prefix, span_hash

WIDTH = 400
GRAM = 32
#: Most bytes of one suffix array, which takes some 130 bytes of memory a byte.
ARRAY_BYTES = 1 << 19
#: Places of the anchor that windows of one group may have, once a group is split; the last is 1.
STEPS = (64, 8, 1)

RUN = "doc_id long, key long, a int, n int, g long, s long"
CONTENT = "doc_id long, key long, a int, g long, s long, cnt long, content binary"


def runs_of(texts: list[bytes], width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, a, n, g, s) of all runs, for a group of texts at a time."""
    for i, j in grouped([len(t) for t in texts], PIECE):
        if j - i == 1:
            parts = [(i, at, texts[i][at:end]) for at, end in pieces(len(texts[i]), width)]
        else:
            parts = [(i, 0, b"".join(texts[i:j]))]
        for first, at, text in parts:
            lengths = [len(text)] if j - i == 1 else [len(t) for t in texts[i:j]]
            ends = np.cumsum(lengths)
            starts = ends - lengths
            values = BYTES[np.frombuffer(text, np.uint8)]
            doc, a, n, g, s, _ = anchors(values, starts, ends, width, gram)
            yield doc + first, a - starts[doc] + at, n, g.view(np.int64), s.view(np.int64)


def _runs(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for doc, a, n, g, s in runs_of(texts, width, gram):
                if len(doc):
                    rows = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(g), pa.array(s)],
                        names=["doc_id", "key", "a", "n", "g", "s"],
                    )

    return run


def array_repeats(contents: list[bytes], width: int, times: list[int] | None = None) -> list[np.ndarray]:
    """For each content a flag per window: whether the window also starts elsewhere, be it in contents or in a copy of its own (times: how often each content stands there)."""
    flags = [np.zeros(max(0, len(c) - width + 1), bool) for c in contents]
    text = b"".join(contents)
    times = [1] * len(contents) if times is None else times
    left = np.concatenate([np.arange(len(c), 0, -1) for c in contents]) if contents else np.zeros(0, int)
    whole = left >= width
    owner = np.repeat(np.arange(len(contents)), [len(c) for c in contents])
    begin = np.cumsum([0, *map(len, contents)])
    before = -1
    window = b""
    for i in suffix_array(text):
        if whole[i]:
            here = text[i : i + width]
            same = before >= 0 and here == window
            for x in (before, i) if same else (i,) if times[owner[i]] > 1 else ():
                flags[owner[x]][x - begin[owner[x]]] = True
            before, window = i, here
    return flags


def stretches(contents: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """For each content the ranges of its windows whose fingerprint occurs again in contents: no equal windows are lost."""
    prints = []
    for c in contents:
        at = np.arange(max(0, len(c) - width + 1))
        prints.append(span_hash(prefix(BYTES[np.frombuffer(c, np.uint8)]), at, at + width))
    _, back, count = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
    again = count[back] > 1
    ends = np.cumsum([len(x) for x in prints])
    return [flag_runs(again[e - len(x) : e]) for x, e in zip(prints, ends, strict=True)]


def _in_arrays(width: int):
    """Rows (doc_id, key, a, g, s, cnt, content) in order of g -> spans (doc_id, key, a, e) that repeat in part.

    A group has ARRAY_BYTES bytes at most; of it only stretches that may repeat go into an array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[tuple[list[tuple[tuple, int]], bytes]] = []
        size = 0
        group: list[tuple] = []
        found: list[tuple] = []

        def close() -> None:
            """The group at hand goes to the array at hand, or, if that would grow too large, to a new one."""
            nonlocal size, pool
            holders: dict[bytes, list[tuple[tuple, int]]] = {}
            for row, ranges in zip(group, stretches([r[6] for r in group], width), strict=True):
                for i, j in ranges:
                    holders.setdefault(row[6][i : j - 1 + width], []).append((row, i))
            more = sum(map(len, holders))
            if size + more > ARRAY_BYTES:
                solve()
                pool, size = [], 0
            pool += [(h, c) for c, h in holders.items()]
            size += more

        def report(row: tuple, i: int, length: int) -> None:
            if row[5] == 1:
                found.append((row[0], row[1], row[2] + i, row[2] + i + length))

        def solve() -> None:
            flags = array_repeats([c for _, c in pool], width, [len(h) for h, _ in pool]) if pool else []
            for (holders, _), here in zip(pool, flags, strict=True):
                for i, j in flag_runs(here):
                    for row, at in holders:
                        report(row, at + i, j - i - 1 + width)

        seen: set[int] = set()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "a", "g", "s", "cnt", "content")), strict=True):
                if group and row[3] != group[0][3]:
                    close()
                    group, seen = [], set()
                    if len(found) > 10_000:
                        yield _spans(found)
                        found = []
                if row[4] not in seen:  # a repeated row brings the same span again
                    seen.add(row[4])
                    group.append(row)
        if group:
            close()
        if pool:
            solve()
        yield _spans(found)

    return run


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "key", "a", "e"])


def anchor_place(content: bytes, gram: int) -> int:
    """Where the anchor of a run's windows stands in the run's bytes: the least gram, which all of its windows hold."""
    sums = prefix(BYTES[np.frombuffer(content, np.uint8)])
    at = np.arange(len(content) - gram + 1)
    return int(np.argmin(gram_hashes(sums, gram) & ~POSITION | at.astype(np.uint64)))


def ranges_of(content: bytes, width: int, gram: int, step: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(range, first window, last window, shared bytes) of a run's windows, by the place of the anchor in the window in ranges of step places."""
    place, last = anchor_place(content, gram), len(content) - width
    for k in range((place - last) // step, place // step + 1):
        low = k * step
        start = place - low
        yield k, max(0, start - step + 1), min(last, start), content[start : max(start, start - step + 1 + width)]


def _split(width: int, gram: int, step: int):
    """Rows (doc_id, key, a, g, s, cnt, content) -> as many rows for the ranges of each, in groups of their shared bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, key, a, g, s, cnt, content in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "a", "g", "s", "cnt", "content")), strict=True):
                for k, i, j, shared in ranges_of(content, width, gram, step):
                    name = hashlib.blake2b(shared, digest_size=8, salt=k.to_bytes(8, "little"), key=g.to_bytes(8, "little", signed=True)).digest()
                    own = hashlib.blake2b(k.to_bytes(8, "little"), digest_size=8, key=s.to_bytes(8, "little", signed=True)).digest()
                    out.append((doc_id, key, a + i, int.from_bytes(name, "little", signed=True), int.from_bytes(own, "little", signed=True), cnt, content[i : j + width]))
            for i in range(0, len(out), 4096):
                columns = zip(*out[i : i + 4096], strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "key", "a", "g", "s", "cnt", "content"])

    return run


def several(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys under which more than one span stands, told by its least and greatest."""
    return rows.groupBy(*keys).agg(F.min("s").alias("s0"), F.max("s").alias("s1")).where("s0 <> s1").select(*keys)


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, spans): for each text with repeats its removed byte ranges, array of (a, e), not yet merged."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    runs = stash(texts.mapInArrow(_runs(width, gram), RUN), "byte-runs")
    spans = runs.groupBy("g", "s").agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "key", "a", "n")).alias("at"))
    shared = several(runs, "g")
    # Written, so that the join with all runs has plain exchanges on both sides: Spark splits a span that stands everywhere.
    again = stash(spans.where("cnt > 1").select("g", "s"), "byte-repeats")
    whole = runs.join(again, ["g", "s"], "left_semi").select("doc_id", "key", "a", F.expr(f"a + n - 1 + {width}").alias("e"))
    needed = stash(spans.join(shared, "g").select("g", "s", "cnt", "at.*"), "byte-spans")
    content = needed.join(texts.withColumnRenamed("doc_id", "d").withColumnRenamed("key", "k"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    content = stash(content.select("doc_id", "key", "a", "g", "s", "cnt", F.expr(f"substring(text, a + 1, n + {width - 1})").alias("content")), "byte-contents")
    schema = "doc_id long, key long, a int, e int"
    found = whole
    for step in STEPS:
        large = content.groupBy("g").agg(F.sum(F.length("content")).alias("bytes")).where(F.col("bytes") > ARRAY_BYTES)
        large = stash(large.select("g"), "byte-large")
        fit = content.join(large, "g", "left_anti").repartition(partitions(spark) * 2, "g").sortWithinPartitions("g")
        found = found.unionByName(fit.mapInArrow(_in_arrays(width), schema))
        if not large.head(1):
            break
        rest = stash(content.join(large, "g", "left_semi").mapInArrow(_split(width, gram, step), CONTENT), "byte-ranges")
        content = stash(rest.join(several(rest, "g"), "g", "left_semi"), "byte-contents")
    else:
        again = stash(several(content, "g", "content"), "byte-windows")
        same = content.where("cnt = 1").join(again, ["g", "content"], "left_semi")
        found = found.unionByName(same.select("doc_id", "key", "a", F.expr(f"a + {width}").alias("e")))
    return found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "e")).alias("spans"))


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the spans that were found for their text, matched by doc_id and text."""
    left = docs.withColumn("key", text_key(F.col("text")))
    right = found.select(F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_n"), F.col("key").alias("_k"), "spans")
    on = (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == F.col("_d")) & (F.col("doc_id").isNull() == F.col("_n")) & (F.col("key") == F.col("_k"))
    return left.join(right, on, "left").drop("_d", "_n", "_k", "key")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes left)."""
    found = repeated_spans(docs, width, gram)
    joined = with_spans(docs.select("doc_id", "text"), found).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                gone = merged([(x["a"], x["e"]) for x in spans or ()])
                kept, at = [], 0
                for a, e in gone:
                    kept.append(text[at:a])
                    at = e
                left = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
