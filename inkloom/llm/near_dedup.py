"""MinHash near-dedup with odd sketches.

1. Documents with equal shingle sets form a class; the rest works on one set a class.
2. MinHash samples of a set are cut into bands. Sets that agree in a band are candidates. With rows
   and bands as below a pair of similarity 0.8 is missed with probability below 1e-6.
3. Samples are also folded into an odd sketch: sample i with value v flips bit hash(i, v). The XOR of
   two sketches has about two ones for each sample that differs, so its population count estimates
   high similarities well; pairs whose estimate is far below the threshold are dropped (the margin
   is MARGIN standard deviations).
4. What is left is confirmed on full shingle sets; only confirmed links join components.

No bucket is expanded into its pairs. In the first round each set is tried with one other: of the
least members of its buckets the one that it shares most buckets with. Links so found are joined
into components. Buckets that then hold several components are searched again, in blocks, with full
sets at hand: only pairs across components are tried, each in the first bucket that it shares, and
components that have met aren't tried again. A bucket of copies is one component by then, and
strays in it meet each block of it once: with n members outside the largest component of N, the
blocks hold about (N + n) * n / BLOCK + N + n sets.

Defined results: null, empty and blank texts have the empty set and link with nothing; fewer words
than a shingle make one shingle of all; rows that share a doc_id are one document for components
(each row keeps its own n_shingles); a null doc_id has a null component_id and isn't linked;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, stash
from .substring_dedup import word_hashes
from .windows import mix

#: Words of a shingle, and the least similarity of linked documents.
SHINGLE = 5
PERCENT = 80
ROWS, BANDS = 5, 36
SKETCH_BITS = 1024
MARGIN = 4.5
#: Members of a bucket searched against each other in one task.
BLOCK = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_K = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * _K)
_ODD = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in lower case (A-Z only)."""
    words = word_hashes(text.translate(_LOWER))[0]
    return _shingles(words, shingle)


def _shingles(words: np.ndarray, shingle: int) -> np.ndarray:
    if not len(words):
        return words
    n = max(1, len(words) - shingle + 1)
    h = np.full(n, len(words) if len(words) < shingle else shingle, np.uint64)
    for k in range(min(shingle, len(words))):
        h = mix(h * _K + words[k : k + n])
    return np.unique(h)


def minhash(found: np.ndarray) -> np.ndarray:
    """ROWS * BANDS samples: the least product with each odd multiplier. The shingles' hashes are random as they are."""
    high = (found >> np.uint64(32)).astype(np.uint32)
    out = np.empty(ROWS * BANDS, np.uint32)
    for i in range(0, len(out), 60):
        out[i : i + 60] = (high[None, :] * _ODD[i : i + 60, None]).min(1)
    return out.astype(np.uint64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    at = (mix(samples ^ _SEEDS[: len(samples)]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8))


def least_estimate(percent: int) -> int:
    """Most ones in the XOR of two sketches for which a pair is still confirmed."""
    k, n = ROWS * BANDS, SKETCH_BITS
    j = percent / 100
    differ = k * (1 - j) + MARGIN * (k * j * (1 - j)) ** 0.5  # samples that differ, at most
    ones = n / 2 * (1 - (1 - 2 / n) ** (2 * differ))
    return int(ones + 3 * (n / 4 * (1 - (1 - 2 / n) ** (4 * differ))) ** 0.5)


def _signatures(shingle: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text or b"", shingle)
                if not len(found):
                    rows.append((0, None, None, None, None))
                    continue
                samples = minhash(found)
                bands = np.full(BANDS, 7, np.uint64)
                for k in range(ROWS):
                    bands = mix(bands * _K + samples.reshape(BANDS, ROWS)[:, k])
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
                whole = mix(found)
                rows.append((len(found), int(found.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(whole).view(np.int64)), bands.view(np.int64), odd_sketch(samples).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])

    return run


def _likely(a: pd.Series, b: pd.Series, most: int) -> np.ndarray:
    if not len(a):
        return np.zeros(0, bool)
    left, right = (np.frombuffer(b"".join(x), np.uint64).reshape(len(a), -1) for x in (a, b))
    return np.bitwise_count(left ^ right).sum(1) <= most


def full_sets(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, set): shingle sets of the documents of ids (id), from their texts."""
    texts = docs.join(ids.hint("merge"), docs["doc_id"] == ids["id"], "left_semi").select("doc_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t or b"", shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["id", "set"])

    return texts.mapInArrow(sets, "id long, set binary").where("length(set) > 0")


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (x, y) of doc_ids those whose full sets meet the threshold."""
    wanted = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    full = stash(full_sets(wanted, docs, shingle), "shingle-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True)
            keep = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    left, right = full.select(F.col("id").alias("x"), F.col("set").alias("sx")), full.select(F.col("id").alias("y"), F.col("set").alias("sy"))
    return stash(pairs.join(right, "y").join(left, "x").select("x", "y", "sx", "sy").mapInArrow(check, "x long, y long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, root): least id that links reach, for ids with links. Each round points to the least root nearby, then to its root."""
    both = stash(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "link-ends")
    roots = stash(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("id").alias("y"), F.col("root").alias("r")), "y").groupBy(F.col("x").alias("id")).agg(F.min("r").alias("r"))
        # A root takes the least root that any of its members sees, so whole trees move at once.
        seen = roots.join(near, "id").select("id", "root", F.least("root", "r").alias("r"))
        hung = seen.groupBy("root").agg(F.min("r").alias("to"))
        step = seen.join(hung, "root").select("id", "root", F.least("r", "to").alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        new = stash(step.join(jump, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("root"), (F.least("new", F.coalesce("far", "new")) != F.col("root")).alias("moved")), "roots")
        roots = new.select("id", "root")
        if not new.where("moved").head(1):
            return roots


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets meet the threshold."""
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def across(bucket: int, ids, roots, bands, sketches, sets: list[np.ndarray], second, both: bool, most: int, percent: int) -> tuple[list, list]:
    """Links that join components of a bucket's block pair, confirmed on full sets; second: rows of the other block.

    A pair is tried in the first bucket that it shares, the nearest pairs of a row first; components that
    have met aren't tried again, so there are fewer links than rows.
    """
    label = np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if both else (np.arange(len(ids)),) * 2
    xs, ys = [], []
    for k, i in enumerate(left.tolist()):
        other = right if both else right[k + 1 :]
        fits = 100 * np.minimum(sizes[other], sizes[i]) >= percent * np.maximum(sizes[other], sizes[i])
        other = other[(label[other] != label[i]) & fits]
        if not len(other):
            continue
        ones = np.bitwise_count(sketches[other] ^ sketches[i]).sum(1)
        near, ones = other[ones <= most], ones[ones <= most]
        if not len(near):
            continue
        first = bands[i][(bands[near] == bands[i]).argmax(1)] == bucket
        for j in near[first][np.argsort(ones[first], kind="stable")].tolist():
            if label[j] != label[i] and linked(sets[i], sets[j], percent):
                xs.append(ids[i])
                ys.append(ids[j])
                label[label == label[j]] = label[i]
    return xs, ys


def _across(most: int, percent: int):
    """Rows (bucket, one, two, id, root, bands, sketch, set, second) in order of their group -> links (x, y)."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        ids, roots = table.column("id").to_numpy(), table.column("root").to_numpy()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        bucket = table.column("bucket").to_numpy()
        second, both = table.column("second").to_numpy(zero_copy_only=False), table.column("one").to_numpy() != table.column("two").to_numpy()
        starts = [0, *_starts(table)]
        xs, ys = [], []
        for a, e in zip(starts, [*starts[1:], len(ids)], strict=True):
            if e - a > 1:
                x, y = across(bucket[a], ids[a:e], roots[a:e], bands[a:e], sketches[a:e], sets[a:e], second[a:e], bool(both[a]), most, percent)
                xs += x
                ys += y
        x, y = np.array(xs, np.int64), np.array(ys, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    def _starts(table: pa.Table) -> list[int]:
        """Where a new group begins."""
        changed = np.zeros(max(0, table.num_rows - 1), bool)
        for c in ("bucket", "one", "two"):
            v = table.column(c).to_numpy()
            changed |= v[1:] != v[:-1]
        return (np.flatnonzero(changed) + 1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            starts = _starts(held)
            if starts:  # the last group may go on
                yield solve(held.slice(0, starts[-1]))
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def hung(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (id, root) once links join their components: roots are the nodes now, and only links between them are new."""
    ends = links
    for end in ("x", "y"):
        ends = ends.join(roots.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    ends = stash(ends.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "root-links")
    if not ends.head(1):
        return roots
    joined = components(ends).select(F.col("id").alias("root"), F.col("root").alias("least"))
    both = roots.join(joined, "root", "left").select("id", F.coalesce("least", "root").alias("root"))
    alone = joined.join(roots.select(F.col("id").alias("root")), "root", "left_anti").select(F.col("root").alias("id"), F.col("least").alias("root"))
    return stash(both.unionByName(alone), "roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    most = least_estimate(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = stash(texts.mapInArrow(_signatures(shingle), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # Rows that share a doc_id but not the set hang together by that id.
    classes = stash(full.groupBy("n_shingles", "h1", "h2").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("r")).select("n_shingles", "h1", "h2", F.col("r.doc_id").alias("id"), "r.bands", "r.sketch"), "classes")
    repeated = bool(full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").head(1))
    sketches = classes.select("id", "n_shingles", "sketch")
    bucketed = classes.select("id", F.explode("bands").alias("bucket"))  # the number of a band is part of its hash
    buckets = bucketed.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("bucket", "first")
    members = stash(bucketed.join(buckets, "bucket").select("bucket", "id", "first"), "buckets")
    # Of the firsts of its buckets each set tries the one it shares most with.
    shared = members.where("id > first").groupBy("id", "first").agg(F.count("*").alias("n"))
    pairs = shared.groupBy(F.col("id").alias("y")).agg(F.max(F.struct("n", (-F.col("first")).alias("x"))).alias("best")).select((-F.col("best.x")).alias("x"), "y")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield d.loc[_likely(d["a"], d["b"], most), ["x", "y"]]

    def with_sketches(p: DataFrame) -> DataFrame:
        one = sketches.select(F.col("id").alias("x"), F.col("n_shingles").alias("nx"), F.col("sketch").alias("a"))
        two = sketches.select(F.col("id").alias("y"), F.col("n_shingles").alias("ny"), F.col("sketch").alias("b"))
        fits = f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)"
        return p.join(two, "y").join(one, "x").where(fits).select("x", "y", "a", "b").mapInPandas(near, "x long, y long")

    links = confirmed(stash(with_sketches(pairs), "near-pairs"), texts, shingle, percent)
    roots = components(links)
    # Buckets that still hold several components, in blocks of bounded size. Members of a bucket's largest component
    # need no trial with each other: they stand in blocks of their own, which meet only those of the other members.
    labelled = members.select("bucket", "id").join(roots.hint("merge"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    labelled = stash(labelled, "labelled")
    parts = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    torn = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("big")).where("big.n < n")
    torn = stash(torn.select("bucket", F.col("big.root").alias("most"), F.expr(f"cast(ceil(big.n / {BLOCK}) as int)").alias("bigs"), F.expr(f"cast(ceil((n - big.n) / {BLOCK}) as int)").alias("rests")), "torn-buckets")
    block = F.expr("if(root = most, cast(pmod(xxhash64(id, 3), bigs) as int), bigs + cast(pmod(xxhash64(id, 3), rests) as int))")
    left = stash(labelled.join(torn.hint("merge"), "bucket").withColumn("block", block), "torn")
    wanted = left.select("id").distinct()
    known = classes.select("id", "bands", "sketch").join(stash(full_sets(wanted, texts, shingle), "shingle-sets").hint("merge"), "id")
    others = F.explode(F.expr("sequence(if(root = most, bigs, 0), bigs + rests - 1)"))
    dealt = left.join(known, "id").withColumn("other", others).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    dealt = dealt.select("bucket", "one", "two", "id", "root", "bands", "sketch", "set", (F.col("block") == F.col("two")).alias("second")).repartition(partitions(spark), "bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    more = stash(dealt.mapInArrow(_across(most, percent), "x long, y long").distinct(), "more-links")
    if more.head(1):
        roots = hung(roots, more)
    # Members of a class link with its first; so do sets that share a doc_id.
    own = signed.select("doc_id", "n_shingles", "h1", "h2").join(classes.select("n_shingles", "h1", "h2", "id"), ["n_shingles", "h1", "h2"], "left")
    if repeated:
        links = roots.where("id <> root").select(F.col("root").alias("x"), F.col("id").alias("y")).unionByName(own.where("id < doc_id").select(F.col("id").alias("x"), F.col("doc_id").alias("y")))
        roots = components(links.distinct())
        key = F.col("doc_id")
    else:
        key = F.coalesce("id", "doc_id")
    root = own.withColumn("key", F.when(F.col("n_shingles") > 0, key)).join(roots.withColumnRenamed("id", "key"), "key", "left")
    return root.select("doc_id", "n_shingles", F.coalesce("root", "key", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component, with all their columns."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def oracle_sql(shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(x) AS h FROM (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL ELSE unnest(list_transform(range(1, greatest(1, len(w) - {shingle - 1}) + 1), lambda i: array_to_string(list_slice(w, i, i + {shingle - 1}), ' '))) END AS x FROM d)
  WHERE x IS NOT NULL),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS k FROM s JOIN s t ON s.h = t.h AND s.doc_id < t.doc_id GROUP BY ALL) p
  JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
