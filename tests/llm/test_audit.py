"""Filter interactions and importance resampling: against SQL, a walk over all orders, and plain Python."""

import math
import re
import zlib
from fractions import Fraction
from hashlib import sha256
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkloom.llm import filter_audit, resampling

from .compare import arrow, same, sql_rows
from .docs import SCHEMA, frame, rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
LABELS = "doc_id long, quality int, toxic int"


def awkward():
    hot = "Copied WORDS of a hot group " * 40
    out = [*rows(5, n=50), *[(1000 + i, hot, "de" if i % 3 else None, "s", 1) for i in range(70)], *[(1000 + i, hot, "de", "s", 1) for i in range(3)]]
    out += [(i, "many words # " * 90, "", "s", 1) for i in (-5, 7, 7)] + [(None, hot, "fr", "s", 1), (None, "", "fr", "s", 1), (None, "only with no id", "xx", "s", 1)]
    return [*out, (2000, "wé " * 300_000, "fr", "s", 1)]


def labels():
    return [(d, d % 2, d % 3 == 0 and 1 or 0) for d in range(0, 60, 2)] + [(1001, 1, 0), (1001, 0, 1), (1002, None, 1), (None, 1, 1), (1003, 1, None)]


def failing(data):
    """(part, set of failed filters) of each row, by the definitions."""
    out = []
    for d, text, lang, *_ in data:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": d is not None and any(e is not None and e < d and (other or "") == text for e, other, *_ in data),
        }
        out.append((d, lang or "", frozenset(k for k, v in fails.items() if v)))
    return out


def walked(data, known):
    good, toxic = ({d for d, *v in known if v[i] == 1 and d is not None} for i in (0, 1))
    found, out = failing(data), {}
    for part in {p for _, p, _ in found}:
        mine = [(d, f) for d, p, f in found if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [(d, x) for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                total[f] += len(here)
                redundant = sum(f in x for _, x in mine) - len(here)
                out[part, "".join(order), step] = (len(left), len(here), redundant, sum(x == {f} for _, x in mine), sum(d in good for d, _ in here), sum(d in toxic for d, _ in here))
        for (p, order, step), row in list(out.items()):
            if p == part:
                out[p, order, step] = (*row, total[order[step - 1]])
    return [(*k, *v) for k, v in out.items()]


NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("alike", [False, True])
def test_interactions(spark, monkeypatch, alike):
    """With fingerprints that are all alike, every text meets others at every boundary."""
    if alike:
        monkeypatch.setattr(filter_audit, "fingerprint", lambda text: F.pmod(F.length(text), F.lit(2)).cast("long"))
    monkeypatch.setattr(filter_audit, "partitions", lambda _: 13)
    data, known = awkward(), labels()
    docs = frame(spark, data).withColumnsRenamed({"source": "mask", "n_chars": "range"})
    out = filter_audit.audit(docs, spark.createDataFrame(known, LABELS))
    same(out, NAMES, walked(data, known))
    if not alike:
        columns, want = sql_rows(filter_audit.oracle_sql(), documents=arrow(data, COLUMNS, TYPES), labels=arrow(known, ("doc_id", "quality", "toxic"), (pa.int64(), pa.int32(), pa.int32())))
        same(out, columns, want)


def test_failures_and_other_filters(spark):
    data = awkward()
    masks = filter_audit.failures(frame(spark, data))
    bits = {1 << i: f for i, f in enumerate("ABCDE")}
    got = sorted(((r.doc_id, r.part, sorted(f for b, f in bits.items() if r["mask"] & b)) for r in masks.collect()), key=repr)
    assert got == sorted(((d, p, sorted(f)) for d, p, f in failing(data)), key=repr)
    two = filter_audit.audit(frame(spark, data), spark.createDataFrame([], LABELS), part="source", filters={"Z": lambda text, words: not words})
    assert {r.filter_order for r in two.collect()} == {"ZE", "EZ"} and two.count() == 4 * len({s or "" for _, _, _, s, _ in data})


def test_empty_audit(spark):
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0


def test_no_text_is_sampled_for_ranges(spark, sf_dir):
    """Bounds of ranges are drawn on numbers; the plan shuffles texts once."""
    from inkloom.llm.common import table

    docs = table(spark, sf_dir, "documents").withColumn("fp", filter_audit.fingerprint(F.col("text")))
    plan = docs.repartitionByRange(4, "fp", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(fp" in plan and plan.count("Exchange") == 1


def plain(data, target, share=25, least=20):
    """(doc_id, n_features, weight, score, rank) by exact sums."""

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    def count(texts):
        n = [0] * 10000
        for t in texts:
            for b in features(t)[1]:
                n[b] += 1
        return n

    s, t = count(x for _, x, *_ in data), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for d, text, *_ in data:
        n, f = features(text)
        weight = math.floor(Fraction(sum(gain[b] for b in f), len(f))) if f else 0
        h = int(sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for i, r in enumerate(able[: share * len(able) // 100], 1):
        r[5] = i
    return [(r[0], *r[2:]) for r in out]


RANKED = ("doc_id", "n_features", "weight", "score", "rank")


def test_resampling(spark):
    data = [*rows(6, n=80, kinds=30), (950, "W1 w2 Éß \U0001f600x a-b_c 12\x00z", None, None, 1), (951, "w1 " * 200_000, None, None, 1), (952, None, None, None, 1)]
    target = ["w1 w2 w3 w4", "W5 w6", "", None, "É w7"]
    docs = frame(spark, data).withColumnsRenamed({"lang": "words", "source": "buckets", "n_chars": "score"})
    out = resampling.resample(docs, spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string"))
    same(out, RANKED, plain(data, target))
    columns, want = sql_rows(resampling.oracle_sql(), documents=arrow(data, COLUMNS, TYPES), benchmark=arrow([(str(i), t) for i, t in enumerate(target)], ("item_id", "text")))
    same(out, columns, want)
    assert sum(r.rank is not None for r in out.collect()) == sum(r[1] >= 39 for r in plain(data, target)) * 25 // 100 > 3


def test_resampling_repeats_and_empty(spark):
    """A third of the rows is one document; one has no id; nothing is drawn twice."""
    data = [*rows(7, n=40), *[(77, "w1 w2 w3 " * 10, None, None, 1)] * 30, (None, "w4 w5 " * 15, None, None, 1)]
    docs, target = frame(spark, data), spark.createDataFrame([("w1 w2",)], "text string")
    out = resampling.resample(docs, target, share=100)
    same(out, RANKED, plain(data, ["w1 w2"], share=100))
    assert resampling.resample(spark.createDataFrame([], SCHEMA), target).count() == 0
    flat = resampling.resample(docs, target.limit(0))
    same(flat, RANKED, plain(data, []))


def test_scoring_explodes_nothing(spark, sf_dir):
    from inkloom.llm.common import table

    df = resampling.weighed(table(spark, sf_dir, "documents"), [0] * 10000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "split(0,0" not in plan
