"""Classifiers: accuracy on rows they didn't learn from, and awkward inputs."""

from zlib import crc32

import numpy as np
import pytest

from inkloom.llm import quality, toxicity
from inkloom.llm.common import table

from .docs import SCHEMA, frame, rows

LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"


def auc(score, label):
    score, label = np.array(score), np.array(label)
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize(("score", "label", "of", "out"), [(quality.score_quality, "quality", 4, 2), (toxicity.score_toxicity, "toxic", 3, 1)])
def test_held_out(spark, score, label, of, out):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (crc32(str(d).encode()) % of == out) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    test = [(got[r.doc_id].score, r[label]) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc(*zip(*test, strict=True)) > 0.85


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_awkward(spark, score):
    data = [*rows(1, n=10), (None, "no id", None, None, 1), (3, "twice", None, None, 1)]
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 1, 1), (None, 1, 1), (2, None, None), (3, 1, 0)], LABELS)
    none = spark.createDataFrame([], LABELS)
    for given in (labels, none):
        assert score(frame(spark, data), given).count() == len(data)
    assert score(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.3)).astype(float)
    p = quality.fit(x, y).scores(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.98


def test_trees_against_walks_of_one_row():
    """Flat arrays against a walk from node to node, and histogram splits against trying every edge."""
    rng = np.random.default_rng(1)
    x = np.round(rng.random((300, 4)), 1)
    y = (x[:, 0] + x[:, 2] > 1).astype(float)
    trees = quality.fit(x, y)
    for row, got in zip(x[:40], trees.scores(x[:40]), strict=True):
        total = trees.base
        for f, above, leaf in zip(trees.feature, trees.above, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > above[node] else 1)
            total += leaf[node - len(f)]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    p = 1 / (1 + np.exp(-trees.base))
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
    best = 0.0
    for j in range(4):
        for edge in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            low = x[:, j] <= edge
            if min(low.sum(), (~low).sum()) >= quality.LEAF:
                best = max(best, gain(low) + gain(~low))
    low = x[:, trees.feature[0][0]] <= trees.above[0][0]
    assert gain(low) + gain(~low) == pytest.approx(best)


@pytest.mark.parametrize("text", [b"", b"One two, two! Three\n\none 44 # # --", "Zoë  ça 1".encode(), b"\x00\x01 a", b"word " * 500])
def test_statistics_by_hand(text):
    got = quality.statistics(text)
    words, lines, n = text.split(), [x for x in text.split(b"\n") if x.strip()], len(text)
    assert len(got) == quality.STATISTICS and np.isfinite(got).all()
    share = lambda ok: sum(map(ok, text)) / max(n, 1)
    assert got[1] == pytest.approx(share(lambda c: 97 <= c <= 122)) and got[2] == pytest.approx(share(lambda c: 65 <= c <= 90)) and got[8] == pytest.approx(share(lambda c: c >= 128))
    rest = got[9 + len(quality._MARKS) :]
    assert rest[0] == pytest.approx(np.log1p(n)) and rest[1] == pytest.approx(np.log1p(len(words))) and rest[4] == max(map(len, words), default=0)
    assert rest[5] == pytest.approx(len(set(words)) / max(1, len(words))) and rest[7] == pytest.approx(len(set(lines)) / max(1, len(lines)))


def test_sample_of_labels(spark):
    from inkloom.llm.common import least_hashed

    ids = spark.range(5000).withColumnRenamed("id", "k")
    got = [r.k for r in least_hashed(ids, "k", 100, 5000).collect()]
    assert got == [r.k for r in ids.selectExpr("k", "xxhash64(k) as h").orderBy("h").limit(100).collect()]
    assert least_hashed(ids, "k", 9000, 5000).count() == 5000


LEXICON = {"idiot": 3.0, "scum*": 2.0}


def naive_clauses(reader, text):
    """(kind, weight) of each clause by its definition, on lists of words."""
    out, clause = [], []
    words = toxicity.plain_words(text.encode())
    for i, w in enumerate(words):
        clause.append(toxicity.bare(w))
        if w[-1:] in (b".", b"!", b"?", b";") or i == len(words) - 1:
            cls = [reader.classify(x.encode()) for x in clause]
            bad = [k for k, c in enumerate(cls) if c in (toxicity.INSULT, toxicity.THREAT)]
            if bad:
                negated = all(any(cls[j] == toxicity.NEGATION for j in range(max(0, k - 3), k)) for k in bad)
                reported = all(any(cls[j] == toxicity.REPORT for j in range(k)) for k in bad) or toxicity.REPORT in cls[max(bad) + 2 :]
                threat, aimed = toxicity.THREAT in cls, toxicity.TARGET in cls
                weight = max([LEXICON[reader.stem(clause[k])] for k in bad if cls[k] == toxicity.INSULT], default=0.0)
                arcs = toxicity.ARCS
                weight += threat * arcs["threat"] + aimed * arcs["target"] + negated * arcs["negated"] + reported * arcs["reported"]
                out.append((toxicity.KINDS[8 * threat + 4 * aimed + negated + 2 * reported], max(0.0, weight)))
            clause = []
    return out


def test_grammar():
    reader = toxicity.Reader(LEXICON)
    kinds = lambda t: {toxicity.KINDS[i]: round(np.expm1(v)) for i, v in enumerate(reader.features(t.encode())[: len(toxicity.KINDS)]) if v}
    assert kinds("Idiot! nothing else") == {"insult": 1}
    assert kinds("You are an idiot and scummy.") == {"insult_target": 1}
    assert kinds("Idiot, all of you. You idiot") == {"insult_target": 2}
    assert kinds("You are not an idiot") == {"insult_target_negated": 1}
    assert kinds("You are not an idiot but plain scum") == {"insult_target": 1}
    assert kinds("He said you idiot. Idiot") == {"insult_target_reported": 1, "insult": 1}
    assert kinds("You idiot, he wrote. An idiot said it; he said nothing.") == {"insult_target_reported": 1, "insult": 1}
    assert kinds("I will kill you") == {"threat_target": 1}
    assert kinds("fine day") == {} and kinds("") == {}


def test_grammar_against_its_definition():
    import random

    rng = random.Random(5)
    reader = toxicity.Reader(LEXICON)
    some = ["idiot", "scummy", "kill", "you", "not", "said", "day", "fine", "idiot.", "you!", "day;", "not?"]
    for _ in range(2000):
        text = " ".join(rng.choice(some) for _ in range(rng.randrange(16)))
        want = naive_clauses(reader, text)
        got = reader.clauses(toxicity.plain_words(text.encode()))
        assert [w for _, w in got] == pytest.approx([w for _, w in want])
        count = reader.features(text.encode())[: len(toxicity.KINDS)]
        assert {toxicity.KINDS[i]: round(np.expm1(v)) for i, v in enumerate(count) if v} == {k: sum(x == k for x, _ in want) for k, _ in want}


def test_composition():
    first, second = toxicity.holds(toxicity.TARGET, 4, 0.5), toxicity.holds(toxicity.INSULT, 1, 2.0)
    both = toxicity.compose(first, second)
    aimed = both[0, toxicity.TARGET][0]
    assert both[both[aimed, toxicity.INSULT][0], toxicity.END] == (0, 5, 2.5) and both[aimed, toxicity.END] == (0, 4, 0.5)


def test_accepted_rows(spark):
    data = [(1, "You idiot! You moron! Pathetic scum.", "x", "s", 1), (1, "a fine day", "x", "s", 1), (None, "Stupid loser! You clown! Idiot!", "x", "s", 1), (None, None, "x", "s", 1), (2, "", "x", "s", 1), (3, "not an idiot", "x", "s", 1)]
    none = spark.createDataFrame([], LABELS)
    clash = frame(spark, data).withColumnsRenamed({"lang": "key", "source": "bad", "n_chars": "_d"})
    left = toxicity.accepted(clash, none)
    assert left.columns == ["doc_id", "text", "key", "bad", "_d"]
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (1, "a fine day"), (2, ""), (3, "not an idiot")]


def test_very_long_text(spark):
    long = "word " * 200_000 + "You idiot! You moron! Pathetic scum. " * 50
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score_toxicity(frame(spark, [(1, long, None, None, 1)]), none).collect()[0].predicted == 1
    assert quality.score_quality(frame(spark, [(1, long, None, None, 1)]), none).collect()[0].score == 0.5
