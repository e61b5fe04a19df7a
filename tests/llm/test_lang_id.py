"""Language models against a dictionary version of the same definitions, and on documents that weren't learned from."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkloom.llm import lang_id as L

from .docs import SCHEMA, frame

TEXTS = {
    "xx": ["Der Hund und die Katze, 12 und der Mond!", "die die die Sonne", "Straße über dem Fluß"],
    "yy": ["the dog and the cat (and 3 the moon)", "a sun over the street", "the the"],
    "": ["çà et là, l'été", "été là"],
}


def normal(text):
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


def kneser_ney(texts, order):
    """P(character | context) of interpolated Kneser-Ney, from dictionaries."""
    runs = [None, *(Counter() for _ in range(order))]
    for t in texts:
        padded = " " * (order - 1) + normal(t)
        runs[order].update(padded[i - order + 1 : i + 1] for i in range(order - 1, len(padded)))
    for size in range(order - 1, 0, -1):
        runs[size] = Counter(g[1:] for g in runs[size + 1])
    discount, total, kinds = [None], [None], [None]
    for size in range(1, order + 1):
        n1, n2 = (sum(c == i for c in runs[size].values()) for i in (1, 2))
        discount.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
        all_of, different = Counter(), Counter()
        for g, c in runs[size].items():
            all_of[g[:-1]] += c
            different[g[:-1]] += 1
        total.append(all_of)
        kinds.append(different)
    return runs, discount, total, kinds


def probability(model, alphabet, gram):
    if not gram:
        return 1 / (alphabet + 1)
    runs, discount, total, kinds = model
    size, context = len(gram), gram[:-1]
    lower = probability(model, alphabet, gram[1:])
    if not total[size][context]:
        return lower
    own = max(runs[size][gram] - discount[size], 0) / total[size][context]
    return own + discount[size] * kinds[size][context] / total[size][context] * lower


@pytest.fixture(scope="module")
def grams(spark):
    rows = [(i, t.encode(), lang, True) for i, (lang, t) in enumerate((lang, t) for lang, ts in TEXTS.items() for t in ts * 2)]
    return L.gram_counts(spark.createDataFrame(rows, "doc_id long, text binary, lang string, kept boolean")).cache()


def test_models(spark, grams):
    langs = sorted(TEXTS)
    (model,) = L.learn(grams, langs)
    plain = {lang: kneser_ney(ts * 2, L.ORDER) for lang, ts in TEXTS.items()}
    alphabet = len({c for ts in TEXTS.values() for t in ts for c in normal(t)})
    probe = [t for ts in TEXTS.values() for t in ts] + ["unseen wörds zzz", "a", "", "123", "Ω ω", "der the été"]
    total, size = model.scores([L.stretches(t.encode()) for t in probe])
    for i, t in enumerate(probe):
        padded = " " * (L.ORDER - 1) + normal(t)
        assert size[i] == len(normal(t))
        for j, lang in enumerate(langs):
            want = -sum(math.log2(probability(plain[lang], alphabet, padded[k - L.ORDER + 1 : k + 1])) for k in range(L.ORDER - 1, len(padded)))
            assert total[i, j] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_pruned_models_sum_to_one(spark, grams):
    """Whatever is kept: the probabilities of all characters and of one that wasn't seen sum to one in every context."""
    langs = sorted(TEXTS)
    for entries in (5, 40):
        (model,) = L.learn(grams, langs, entries=entries)
        kept = L.discounted(grams.select("lang", "gram", "n"), entries).groupBy("lang", "size").count().collect()
        assert all(r["count"] <= entries for r in kept)
        chars = sorted({g.gram[-1] for g in L.discounted(grams.select("lang", "gram", "n"), entries).collect()}) + ["一"]
        for context in ("   ", "der", " th", "zzz"):
            codes = np.frombuffer("".join(context + c for c in chars).encode("utf-32-le"), np.uint32)
            bits = model.bits(codes, np.arange(len(chars)) * 4 + 3)
            assert np.exp2(-bits.astype(float)).sum(0) == pytest.approx(np.ones(len(langs)), rel=1e-4)


def test_counts_are_exact(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aàb c1.ß日本́") for _ in range(rng.randrange(60))) for _ in range(30)] + [""]
    want = Counter()
    for t in texts:
        padded = " " * (L.ORDER - 1) + normal(t)
        want.update(padded[i - L.ORDER + 1 : i + 1] for i in range(L.ORDER - 1, len(padded)))
    grams, n = L.counts(texts)
    assert dict(zip(grams, n.tolist(), strict=True)) == want


def test_many_characters_are_counted_in_halves():
    """Over 55,000 different letters can't be numbered by four in 63 bits; halves of the text can."""
    text = "".join(chr(i) for i in range(0x3400, 0x20000) if chr(i).isalpha() and chr(i).lower() == chr(i))[:60_000]
    grams, n = L.counts([text])
    assert n.sum() == len(text) and len(set(grams)) == len(grams) >= 55_200


def test_find():
    values = L.mix(np.arange(1000, dtype=np.uint64))
    known = L.Sorted(values)
    assert (known.values[known.find(values)] == values).all() and (known.find(L.mix(np.arange(1000, 3000, dtype=np.uint64))) == -1).all()
    assert (L.Sorted(np.zeros(0, np.uint64)).find(values) == -1).all()


def made(lang, n, rng):
    parts = {"aa": ["kor", "mel", "tis", "ba", "du"], "bb": ["xo", "zun", "qua", "rid", "fe"], "cc": ["lo", "mi", "kor", "pan", "gry"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(seed=0, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = "aa" if i % 3 else rng.choice(["bb", "cc"])
        out.append((i, made(lang, rng.randrange(4, 40), rng), lang, "s", 1))
    return out


EXTRA = [(1000, None, "aa", "s", 1), (1001, "", "bb", "s", 1), (1002, "12 -- 3.4 ́", "cc", "s", 1), (1003, "kormel tisba", None, "s", 1), (None, "xozun quarid fexo", "bb", "s", 1)]


def test_held_out(spark, monkeypatch):
    monkeypatch.setattr(L, "STRETCH", 5_000)
    data = [*corpus(), *EXTRA, (1005, made("cc", 9_000, random.Random(2)), "cc", "s", 1)]
    out = L.identify(frame(spark, data).withColumnsRenamed({"source": "kept", "n_chars": "size"}))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(data)
    for d, text, lang, *_ in data:
        r = got[d]
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.score == 0 and r.rejected and r.bits is None))
    right = [got[d].lang_pred == lang for d, t, lang, *_ in data if d is not None and d < 1000 and got[d].held_out]
    assert sum(right) >= 0.97 * len(right) > 50
    assert got[1003].lang_pred == "aa" and got[None].lang_pred == "bb" and got[1005].lang_pred == "cc"
    # In blocks of one language, in other partitions: the same rows.
    monkeypatch.setattr(L, "BLOCK", 1)
    again = {r.doc_id: r for r in L.identify(frame(spark, data[::-1]).repartition(5)).collect()}
    assert {d: r.lang_pred for d, r in again.items()} == {d: r.lang_pred for d, r in got.items()}


def test_far_texts_are_rejected(spark):
    rng = random.Random(4)
    strange = "".join(rng.choice("ωψχφυτσρπξνμλκ ") for _ in range(400))
    data = [*corpus(3, 900), (2000, strange, "aa", "s", 1), (2002, made("aa", 50, rng), "aa", "s", 1)]
    got = {r.doc_id: r for r in L.identify(frame(spark, data)).where("doc_id >= 2000").collect()}
    held = [d for d in (2000, 2002) if got[d].held_out]
    assert got[2000].rejected or 2000 not in held
    assert not got[2002].rejected


def test_calibration():
    langs = ["a", "b"]
    sure = np.array([[1.0, 4.0]] * 30 + [[4.0, 1.0]] * 30)
    unsure = np.array([[2.0, 2.1]] * 30 + [[2.1, 2.0]] * 30)
    truth = np.array([0] * 30 + [1] * 30)
    mixed = truth.copy()
    mixed[::3] = 1 - mixed[::3]
    far, near = L.calibrate(sure, truth, langs), L.calibrate(unsure, mixed, langs)
    assert 1 / (1 + math.exp(-3 * far.steepness)) > 0.95
    assert 1 / (1 + math.exp(-0.1 * near.steepness)) == pytest.approx(2 / 3, abs=0.05)  # two thirds are right
    assert far.limits == {"a": pytest.approx(1.05), "b": pytest.approx(1.05)}
    assert L.calibrate(np.zeros((0, 2)), np.zeros(0, int), langs).limits == {}


def test_nothing_to_learn(spark):
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    out = L.identify(frame(spark, [(1, "words", None, "s", 1), (2, None, None, "s", 1)])).collect()
    assert {(r.lang_pred, r.score) for r in out} == {("und", 0.0)}
    one = L.identify(frame(spark, [(1, "words and words", "q", "s", 1), (3, "other", None, "s", 1)])).collect()
    assert {r.lang_pred for r in one} == {"q"}


def test_counts_of_a_language_wait_for_one_another(monkeypatch):
    """Whatever the order of rows, what waits is bounded and all is counted."""
    import pyarrow as pa

    monkeypatch.setattr(L, "STRETCH", 50)
    rng = random.Random(5)
    rows = [(rng.choice("abcdefghijklmnopqrstuvwxyz"), made("aa", rng.randrange(1, 30), rng)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([True] * 200), pa.array([r[1].encode() for r in rows])], names=["lang", "kept", "text"])
    got, want = defaultdict(int), defaultdict(int)
    for out in L._count(iter([batch.slice(0, 120), batch.slice(120)])):
        for lang, n in zip(out.column("lang").to_pylist(), out.column("n").to_pylist(), strict=True):
            got[lang] += n
    for lang, t in rows:
        want[lang] += sum(len(normal(s)) for s in L.stretches(t.encode()))
    assert got == want


def test_calibration_takes_every_learnable_document(spark, monkeypatch):
    """No sample: each is held once against models of the documents of the other folds, and the settings are those of all."""
    data = [*corpus(5, 150), *EXTRA, (2001, "alone", "dd", "s", 1)]
    docs = frame(spark, data)
    seen, inner = [], L.calibrated
    monkeypatch.setattr(L, "calibrated", lambda known, langs: seen.append((known, langs, inner(known, langs))) or seen[0][2])
    L.identify(docs)
    ((known, langs, setting),) = seen
    texts = {d: (lang, t) for d, t, lang, *_ in data if d is not None and lang and zlib.crc32(str(d).encode()) % 4 != 2 and any(c.isalpha() for c in t or "")}
    fold = {r.doc_id: r.kept for r in L.learnable(docs).collect()}
    want = []
    for i in range(L.FOLDS):
        others = {lang: [t for d, (x, t) in texts.items() if x == lang and fold[d] != i] for lang in langs}
        plain = {lang: kneser_ney(ts, L.ORDER) for lang, ts in others.items()}
        alphabet = len({c for ts in others.values() for t in ts for c in normal(t)})
        for d, (lang, t) in texts.items():
            if fold[d] == i and others[lang]:
                padded = " " * (L.ORDER - 1) + normal(t)
                bits = -sum(math.log2(probability(plain[lang], alphabet, padded[k - L.ORDER + 1 : k + 1])) for k in range(L.ORDER - 1, len(padded)))
                want.append((lang, bits / len(normal(t))))
    got = [(r.lang, r.by_lang[langs.index(r.lang)]) for r in known.collect()]
    assert langs == ["aa", "bb", "cc", *["dd"] * (2001 in fold)] and len(set(fold.values())) == L.FOLDS
    assert len(want) == sum(lang != "dd" for lang, _ in texts.values())
    assert [lang for lang, _ in sorted(got)] == [lang for lang, _ in sorted(want)]
    assert [b for _, b in sorted(got)] == pytest.approx([b for _, b in sorted(want)], rel=1e-3)
    rows = known.collect()
    assert setting == L.calibrate(np.array([r.by_lang for r in rows]), np.array([langs.index(r.lang) for r in rows]), langs)


@pytest.mark.parametrize("cells", [1, 1 << 12])
def test_calibration_of_a_table_is_that_of_arrays(spark, monkeypatch, cells):
    """Ties, a language of too few documents, quantiles within a cell; rows in any order."""
    monkeypatch.setattr(L, "CELLS", cells)
    rng, langs = random.Random(6), ["", "x", "y", "z"]
    rows = [(lang, [round(rng.uniform(1, 4), digits) for _ in langs]) for lang, n, digits in (("", 400, 9), ("x", 250, 1), ("y", 20, 9), ("z", 19, 9)) for _ in range(n)]
    plain = L.calibrate(np.array([b for _, b in rows]), np.array([langs.index(lang) for lang, _ in rows]), langs)
    assert set(plain.limits) == {"", "x", "y"}
    for few in (1, 5):
        assert L.calibrated(spark.createDataFrame(rng.sample(rows, len(rows)), "lang string, by_lang array<double>").repartition(few), langs) == plain
    none = spark.createDataFrame([], "lang string, by_lang array<double>")
    assert L.calibrated(none, langs) == L.Calibration(8.0, {})
