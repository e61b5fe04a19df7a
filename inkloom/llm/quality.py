"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

The statistics are computed where the text is. Trees are fitted to a bounded sample of labelled rows
(`SAMPLE` rows, those with the least hash of their id; only their statistics reach the driver), and
flattened into arrays: each level of all trees is one vectorised numpy step.

Defined results: null and empty texts are scored like any other; documents without a label are
scored; several labels of one document count by their majority (a tie counts 1); of rows that share a
doc_id the one with the least statistics is learned from; an empty table gives no rows; without usable
labels every score is 0.5, with one class only it is near that class; held_out is false for a null
doc_id; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, small_batches

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAF, RIDGE = 80, 4, 32, 0.15, 20, 1.0
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 other mark, 8 beyond ASCII, 0 control
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]] = 1, 2, 3, 4, 5
_CLASS[[46, 44, 33, 63, 59, 58]] = 6
_CLASS[[c for c in range(33, 127) if not _CLASS[c]]] = 7
_CLASS[128:] = 8
_MARKS = [33, 35, 36, 37, 38, 42, 45, 46, 47, 60, 61, 64, 95, 124]
STATISTICS = 9 + len(_MARKS) + 17


def statistics(text: bytes) -> list[float]:
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    count = np.bincount(data, minlength=256)
    kind = _CLASS[data]
    kinds = np.bincount(kind, minlength=9)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m, k = max(n, 1), max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    different = len(set(words))
    same = int((data[1:] == data[:-1])[(kind[1:] == 7) | (kind[1:] == 6)].sum()) if n > 1 else 0
    after = kind[1:] if n > 1 else kind[:0]
    ahead = kind[:-1] if n > 1 else kind[:0]
    marks_in = int(((ahead >= 6) & (ahead <= 7) & (after == 4)).sum())
    capital = int(((ahead == 4) & (after == 2)).sum())
    letters = max(1, int(kinds[1] + kinds[2] + kinds[8]))
    packed = len(zlib.compress(text, 1)) if n else 0
    longest = int(lengths.max()) if len(lengths) else 0
    return [
        *(kinds / m),
        *(count[_MARKS] / k),
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()) if len(words) else 0.0, float(lengths.std()) if len(words) else 0.0, longest,
        different / k, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        same / k, marks_in / k, capital / k, kinds[2] / letters, packed / m, int((lengths == 1).sum()) / k, int((lengths > 20).sum()) / k, kinds[3] / k,
    ]


@dataclass
class Trees:
    """Complete trees of one depth: node i has the children 2i + 1 and 2i + 2; values of the last level are leaves."""

    base: float
    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees, nodes = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.zeros((len(x), trees), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        while at[0, 0] < nodes:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.above[tree, at])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, at - nodes].sum(1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts the logistic loss over histograms of at most BINS bins a statistic."""
    none = Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    if not len(y):
        return none
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return Trees(base, none.feature, none.above, none.leaf)
    n, columns = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(columns)]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    flat = bins + np.arange(columns) * BINS
    nodes = (1 << DEPTH) - 1
    raw = np.full(n, base)
    feature, above, leaf = [], [], []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        at = np.zeros(n, np.int64)
        f, t = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            cell = ((at - first)[:, None] * (columns * BINS) + flat).ravel()
            size = width * columns * BINS
            sums = [np.bincount(cell, np.repeat(w, columns), size).reshape(width, columns, BINS).cumsum(2) for w in (g, h, np.ones(n))]
            (gl, hl, cl), (ga, ha, ca) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(cl < LEAF) | (ca - cl < LEAF)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    f[first + k], t[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        down = at - nodes
        value = -RATE * np.bincount(down, g, nodes + 1) / (np.bincount(down, h, nodes + 1) + RIDGE)
        raw += value[down]
        feature.append(f)
        above.append(t)
        leaf.append(value)
    return Trees(base, np.stack(feature), np.stack(above), np.stack(leaf))


def fold(doc_id: Column, of: int, out: int) -> Column:
    """Whether a row is held out: crc32 of its id as text, modulo of, is out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == out, F.lit(False))


def labelled(labels: DataFrame, name: str, of: int, out: int) -> DataFrame:
    """(id, label) of the labelled documents that may be learned from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & ~fold(F.col("doc_id"), of, out))
    return usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg(name) >= 0.5).cast("int").alias("label"))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t or b"") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "label", "x"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    usable = labelled(labels, "quality", 4, 2)
    some = least_hashed(usable, "id", sample, usable.count())
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id").cast("long") == F.col("id"))
    known = rows.select("id", "label", F.col("text").cast("binary").alias("text")).mapInArrow(_statistics, "id long, label int, x array<double>")
    got = known.groupBy("id", "label").agg(F.min("x").alias("x")).collect()  # one text an id, sample rows at most
    got.sort(key=lambda r: (r.label, r.x))  # the order of rows doesn't follow from the data
    return fit(np.array([r.x for r in got]).reshape(len(got), STATISTICS), np.array([r.label for r in got], float))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(learn(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or b"") for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.value.scores(x))], names=["doc_id", "held_out", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id"), 4, 2).alias("held_out"), F.col("text").cast("binary").alias("text"))
    out = texts.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
