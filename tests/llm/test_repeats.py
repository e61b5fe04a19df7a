"""Suffix-array and substring dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from inkloom.llm import substring_dedup, suffix_dedup

from .docs import SCHEMA, frame, rows


def brute_bytes(data, width):
    texts = [(d, (t or "").encode()) for d, t, *_ in data]
    count = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def brute_words(data, width):
    texts = [(d, (t or "").encode().split()) for d, t, *_ in data]
    first = defaultdict(lambda: 1 << 63)
    for d, w in texts:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first[key], (1 << 63) - 1 if d is None else d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < ((1 << 63) - 1 if d is None else d):
                gone[i : i + width] = [True] * width
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def got(df, n):
    return sorted((tuple(r)[:n] for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    data = [*rows(seed), (None, "nul " * 20, None, None, 1), (5, "again " * 9, None, None, 1), (5, "again " * 9, None, None, 1)]
    assert got(suffix_dedup.remove_repeats(frame(spark, data), 24, 6), 5) == brute_bytes(data, 24)


@pytest.mark.parametrize("most", [40, 300, 4_000])
def test_suffix_dedup_large_groups(spark, monkeypatch, most):
    """Groups that no array may hold are split by ranges of the anchor's place, down to single windows; no array has more bytes than it may."""
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", most)
    monkeypatch.setattr(suffix_dedup, "STEPS", (8, 3, 1))
    rng = random.Random(3)
    base = [chr(97 + rng.randrange(26)) for _ in range(90)]
    data = []
    for i in range(40):
        t = list(base)
        t[rng.randrange(90)] = "#"
        t[rng.randrange(90)] = "%"
        data.append((i, "".join(t), None, None, 90))
    data += [(i, "".join(base) + " ends alike" * (i % 2), None, None, 90) for i in range(50, 56)] + [(7, data[7][1], None, None, 90)]
    assert got(suffix_dedup.remove_repeats(frame(spark, data), 24, 6), 5) == brute_bytes(data, 24)


def test_arrays_are_bounded(monkeypatch):
    """Whatever groups come, an array has ARRAY_BYTES at most; one of that size takes little memory."""
    import tracemalloc

    import pyarrow as pa

    sizes, inner = [], suffix_dedup.array_repeats
    monkeypatch.setattr(suffix_dedup, "array_repeats", lambda contents, width, times: sizes.append(sum(map(len, contents))) or inner(contents, width, times))
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 1 << 16)
    rng = random.Random(1)
    rows, shared = [], bytes(rng.randrange(97, 123) for _ in range(500))
    for g in range(60):
        for k in range(rng.randrange(2, 60)):
            if sum(len(r[6]) for r in rows if r[3] == g) < (1 << 16) - 800:
                rows.append((k, 0, 0, g, 100 * g + k, 1, (shared + bytes(rng.randrange(97, 123) for _ in range(rng.randrange(300))))))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "a", "g", "s", "cnt", "content"])
    suffix_dedup.stretches([shared], 400)  # powers that are kept for all arrays
    tracemalloc.start()
    spans = [s for out in suffix_dedup._in_arrays(400)(iter([batch])) for s in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) == len(rows) and all((s["a"], s["e"] >= 500) == (0, True) for s in spans)
    assert max(sizes) <= 1 << 16 and len(sizes) > 5 and peak < 200 * (1 << 16)


def test_ranges_hold_every_window_once():
    rng = random.Random(6)
    for _ in range(20):
        content = bytes(rng.randrange(97, 100) for _ in range(rng.randrange(24, 42)))
        for step in (8, 3, 1):
            ranges = list(suffix_dedup.ranges_of(content, 24, 6, step))
            assert sorted(w for _, i, j, _ in ranges for w in range(i, j + 1)) == list(range(len(content) - 23))
            assert all(shared in content[w : w + 24] for _, i, j, shared in ranges for w in range(i, j + 1))



def test_suffix_dedup_small_arrays(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 64)
    data = rows(7)
    assert got(suffix_dedup.remove_repeats(frame(spark, data), 24, 6), 5) == brute_bytes(data, 24)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    data = [*rows(seed), (None, "nul " * 20, None, None, 1), (5, "again " * 30, None, None, 1), (5, "again " * 30, None, None, 1)]
    assert got(substring_dedup.remove_repeats(frame(spark, data), 10, 3), 4) == brute_words(data, 10)


@pytest.mark.parametrize("seed", [1, 3])
def test_substring_dedup_with_a_sketch_too_large_to_send(spark, monkeypatch, seed):
    monkeypatch.setattr(substring_dedup, "MOST_BITS", 8)
    data = [*rows(seed), (None, "nul " * 20, None, None, 1), (5, "again " * 30, None, None, 1), (5, "again " * 30, None, None, 1)]
    assert got(substring_dedup.remove_repeats(frame(spark, data), 10, 3), 4) == brute_words(data, 10)


def test_pieces_of_long_texts(spark, monkeypatch):
    from inkloom.llm import windows

    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    monkeypatch.setattr(substring_dedup, "PIECE", 100)
    monkeypatch.setattr(windows.pieces, "__defaults__", (100,))
    data = rows(4)
    data = [*data, (777, data[3][1] + " " + (data[5][1] or "") * 3, None, None, 1)]
    texts = [(t or "").encode() for _, t, *_ in data]
    for module, width, gram in ((suffix_dedup, 24, 6), (substring_dedup, 10, 3)):
        found = {(int(d), int(a) + x) for part in module.runs_of(texts, width, gram) for d, a, n in zip(*part[:3], strict=True) for x in range(n)}
        size = len if module is suffix_dedup else lambda t: len(t.split())
        assert found == {(d, i) for d, t in enumerate(texts) for i in range(size(t) - width + 1)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_clashing_columns(spark):
    data = rows(5, n=8)
    plain = frame(spark, data)
    clash = plain.withColumnsRenamed({"lang": "key", "source": "spans", "n_chars": "g"}).selectExpr("*", "1 as a", "2 as e", "3 as s", "4 as id")
    assert got(suffix_dedup.remove_repeats(clash, 24, 6), 5) == brute_bytes(data, 24)
    assert got(substring_dedup.remove_repeats(clash, 10, 3), 4) == brute_words(data, 10)
