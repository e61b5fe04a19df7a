"""Toxicity by a weighted finite-state grammar of clauses.

Words are read as classes: insult, threat, target, negation, reported speech, clause end. One
transducer handles each matter: `holds` remembers that a clause has an insult, a threat or a target,
`scoped` whether an insult or threat stands outside the words that a negation covers, `reported` whether
all of it is reported speech: after a word like "said", or all of it before one ("…, he wrote"). They are composed into one machine that puts out a single match for each clause
that holds an insult or a threat: what it is, whether it has a target (before or after), whether all
of it is negated, whether all of it is reported. Weights are log-odds and add up along a path: an
insult's own weight stands on its word, the rest on the arcs that end the clause. A path takes one
insult, so a clause weighs what its heaviest one does. Documents are scored by a logistic function
of their matched clauses, fitted to labels, starting from `PRIOR`.

Function words and the insults of `INSULTS` are fixed lists; further insults are learned: stems and
words that stand in many different contexts in documents labelled toxic, and hardly in others. Copies
repeat contexts, so they don't turn the words of one document into insults. Weights shrink towards
`SEED_WEIGHT` (listed insults) where labels are few. Learning reads at most `SAMPLE` documents of
each label, those with the least hash of their id, and keeps at most `KEPT` insults, the heaviest.

Defined results: null and empty texts have no matches; documents without a label are scored;
without usable labels the grammar's own weights and `PRIOR` decide; held_out is false for a null
doc_id; rows that share a doc_id are scored each; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, small_batches, stash, text_key
from .quality import THRESHOLD, fold, labelled

SAMPLE = 4000
#: Insults of a model, and contexts from which a stem may be learned.
KEPT, LEAST_CONTEXTS = 2000, 4
PREFIXES = (4, 5, 6)
#: Words whose class a task keeps.
KEPT_WORDS = 300_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
END = 8
# Common words of the languages of the corpus.
FUNCTION_WORDS = {
    THREAT: (
        "kill killing hurt beat destroy burn strangle stab shoot smash crush murder punish hunt "
        "töten umbringen schlagen verletzen vernichten verbrennen würgen matar golpear destruir quemar lastimar "
        "tuer frapper blesser détruire brûler étrangler"
    ).split(),
    TARGET: (
        "you your yours youre yourself he she they him her them all everyone people du dich dein deine ihr euch sie alle "
        "usted ustedes tú tu vosotros ellos ellas todos toi vous votre vos eux elles tous"
    ).split(),
    NEGATION: "not never no isnt arent wasnt dont nobody nicht kein keine keiner nie niemals nunca jamás ningún tampoco pas jamais aucun aucune".split(),
    REPORT: (
        "said says say called calls wrote writes claimed quoted quote alleged sagte sagt nannte nennt schrieb behauptete "
        "dijo dice llamó escribió afirmó dit disait appelé écrit affirmé"
    ).split(),
}
INSULTS = (
    "idiot idiots stupid moron morons loser losers pathetic worthless trash scum clown clowns disgusting imbecile dumb fool ugly garbage vermin jerk "
    "trottel dummkopf abschaum widerlich versager idiota estúpido imbécil basura escoria inútil asqueroso stupide imbécile ordure minable crétin"
).split()
SEED_WEIGHT = 2.5
#: Log-odds on the arcs that end a clause.
ARCS = {"threat": 2.0, "target": 0.5, "negated": -1.5, "reported": -1.0}
KINDS = [f"{what}{aim}{how}" for what in ("insult", "threat") for aim in ("", "_target") for how in ("", "_negated", "_reported", "_reported_negated")]
FEATURES = len(KINDS) + 5
#: Weights of the logistic function before any label is seen: clauses of each kind, all weight, the heaviest, density, one, two; the constant.
PRIOR = np.array([0.0] * len(KINDS) + [3.0, 0.0, 0.0, 0.0, 0.0, -5.0])

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c in b".!?;" else 0 if c == 39 else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), with the marks that end a clause still on them."""
    return text.translate(_PLAIN, b"'").split()


# Transducers: a machine maps (state, class) to (state, output bits, weight), state 0 first. END resets a machine.
Machine = dict[tuple[int, int], tuple[int, int, float]]
CLASSES = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END)
IS_INSULT, IS_THREAT, AIMED, NEGATED, REPORTED = 1, 2, 4, 8, 16


def holds(cls: int, bit: int, weight: float = 0.0) -> Machine:
    """Puts out bit at the end of a clause that holds a word of class cls."""
    return {(s, c): (0, bit * s, weight * s) if c == END else (int(s or c == cls), 0, 0.0) for s in (0, 1) for c in CLASSES}


def scoped(cls: int, bit: int, weight: float, length: int) -> Machine:
    """Puts out bit at the end of a clause whose insults and threats all stand within `length` words after a word of class cls.

    A state is (words still covered, 0 nothing met, 1 only covered ones met, 2 an open one met).
    """
    out: Machine = {}
    for left in range(length + 1):
        for met in range(3):
            for c in CLASSES:
                state = left * 3 + met
                if c == END:
                    out[state, c] = (0, bit * (met == 1), weight * (met == 1))
                    continue
                now = met if c not in (INSULT, THREAT) else max(met, 1 if left else 2)
                after = length if c == cls else max(0, left - 1)
                out[state, c] = (after * 3 + now, 0, 0.0)
    return out


def reported(cls: int, bit: int, weight: float) -> Machine:
    """Puts out bit at the end of a clause whose insults and threats all stand after a word of class cls, or all before one.

    A word right after an insult doesn't count: what an idiot said is no report of it. States: 0 nothing met, 1 such a word,
    2 that and insults after it, 3 an open insult just read, 4 open ones and then such a word, 5 open ones and other words since.
    """
    on_word, on_insult, on_other = (1, 1, 2, 5, 4, 4), (3, 2, 2, 3, 3, 3), (0, 1, 2, 5, 4, 5)
    out: Machine = {}
    for s in range(6):
        for c in CLASSES:
            if c == END:
                out[s, c] = (0, bit * (s in (2, 4)), weight * (s in (2, 4)))
            else:
                out[s, c] = ((on_word if c == cls else on_insult if c in (INSULT, THREAT) else on_other)[s], 0, 0.0)
    return out


def compose(a: Machine, b: Machine) -> Machine:
    """Both machines read the same classes; states are numbered anew, outputs joined, weights added."""
    number, todo, out = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        s = todo.pop()
        for c in CLASSES:
            (x, bits, w), (y, more, v) = a[s[0], c], b[s[1], c]
            if (x, y) not in number:
                number[x, y] = len(number)
                todo.append((x, y))
            out[number[s], c] = (number[x, y], bits | more, w + v)
    return out


def grammar() -> Machine:
    machine = compose(holds(INSULT, IS_INSULT), holds(THREAT, IS_THREAT, ARCS["threat"]))
    for more in (holds(TARGET, AIMED, ARCS["target"]), scoped(NEGATION, NEGATED, ARCS["negated"], 3), reported(REPORT, REPORTED, ARCS["reported"])):
        machine = compose(machine, more)
    return machine


def table(machine: Machine) -> tuple[list[list[int]], list[tuple[int, float]]]:
    """Next states by (state, class), and what each state puts out at the end of a clause."""
    n = 1 + max(s for s, _ in machine)
    move, last = [[0] * (END + 1) for _ in range(n)], [(0, 0.0)] * n
    for (s, c), (t, bits, w) in machine.items():
        move[s][c] = t
        if c == END:
            last[s] = (bits, w)
    return move, last


class Reader:
    """Finds the matched clauses of a text."""

    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.fixed = {w: c for c, words in FUNCTION_WORDS.items() for w in words}
        self.move, self.last = table(grammar())
        self.known: dict[bytes, int] = {}

    def stem(self, word: str) -> str | None:
        for n in PREFIXES:
            if word[:n] + "*" in self.insults and len(word) >= n:
                return word[:n] + "*"
        return word if word in self.insults else None

    def classify(self, word: bytes) -> int:
        name = bare(word)
        cls = self.fixed.get(name) or (INSULT if self.stem(name) else OTHER)
        return cls | (END if word[-1:] in (b".", b"!", b"?", b";") else 0)

    def classes(self, words: list[bytes]) -> list[int]:
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.classify(w)
        return list(map(known.__getitem__, words))

    def clauses(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(bits, weight) of each clause with an insult or a threat; only those are walked through."""
        classes = self.classes(words)
        found, begin = [], 0
        if not {INSULT, THREAT, INSULT | END, THREAT | END}.isdisjoint(classes):
            ends = [i for i, c in enumerate(classes) if c & END]
            for end in [*ends, len(classes) - 1] if not ends or ends[-1] < len(classes) - 1 else ends:
                part = classes[begin : end + 1]
                if not {INSULT, THREAT, INSULT | END, THREAT | END}.isdisjoint(part):
                    state, weight = 0, 0.0
                    for i, c in enumerate(part, begin):
                        state = self.move[state][c & 7]
                        if c & 7 == INSULT:
                            weight = max(weight, self.insults[self.stem(bare(words[i]))])
                    bits, more = self.last[state]
                    found.append((bits, max(0.0, weight + more)))
                begin = end + 1
        return found

    def features(self, text: bytes) -> list[float]:
        words = plain_words(text)
        count = [0] * len(KINDS)
        matched = self.clauses(words)
        for bits, _ in matched:
            count[(8 if bits & IS_THREAT else 0) + 4 * bool(bits & AIMED) + bool(bits & NEGATED) + 2 * bool(bits & REPORTED)] += 1
        weights = [w for _, w in matched]
        n = len(matched)
        return [*np.log1p(count), np.log1p(sum(weights)), max(weights, default=0.0), np.log1p(100 * n / max(1, len(words))), float(n > 0), float(n > 1)]


def bare(word: bytes) -> str:
    return word.strip(b".!?;").decode("utf-8", "replace")


def _stems(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, context, label): each stem of a text with the least hash of words around it.

    One context a text: copies bring the same one, so counting different contexts counts texts of their own.
    """
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            one: dict[str, int] = {}
            words = [bare(w) for w in plain_words(text or b"")]
            for i, w in enumerate(words):
                near = hash_pair(words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
                for s in _stems(w):
                    if s and near < one.get(s, near + 1):
                        one[s] = near
            yield pa.RecordBatch.from_arrays([pa.array(list(one), pa.string()), pa.array(list(one.values()), pa.int64()), pa.array([label] * len(one), pa.int32())], names=["stem", "context", "label"])


def hash_pair(a: str, b: str) -> int:
    return crc32(a.encode()) << 31 ^ crc32(b.encode())


def lexicon(texts: DataFrame) -> dict[str, float]:
    """Stems and words with their log-odds of standing in a toxic document, from (label, text); listed insults are always in it."""
    spark = texts.sparkSession
    size = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}
    n_toxic, n_other = size.get(1, 0), size.get(0, 0)
    one = texts.mapInArrow(_contexts, "stem string, context long, label int").groupBy("stem", "context").agg(F.max("label").alias("toxic"), F.min("label").alias("clean"))
    both = one.groupBy("stem").agg(F.sum("toxic").alias("n"), F.sum(1 - F.col("clean")).alias("m"))
    listed = spark.createDataFrame([(w,) for w in INSULTS], "seed string")
    both = stash(both.join(F.broadcast(listed), both["stem"] == listed["seed"], "left").where(f"n >= {LEAST_CONTEXTS} or seed is not null"), "stems")
    tried = both.where("seed is null").count()
    # By chance a stem's texts are toxic at the share of all; with so many stems tried, one must be far beyond it.
    share = min(max(n_toxic, 1) / max(n_toxic + n_other, 1), 1 - 1e-9)
    p = F.least(F.col("n") / (F.col("n") + F.col("m")), F.lit(1 - 1e-9))
    beyond = (F.col("n") + F.col("m")) * (p * F.log(p / share) + (1 - p) * F.log((1 - p) / (1 - share)))
    odds = F.log((F.col("n") + 0.5) / (n_toxic + 1)) - F.log((F.col("m") + 0.5) / (n_other + 1))
    learned = both.where("seed is null").where((p > share) & (beyond > float(np.log(20 * max(tried, 1))))).select("stem", odds.alias("odds"), (-F.col("n")).alias("less")).where("odds > 2")
    kept: dict[str, float] = {}
    for r in sorted(learned.orderBy(F.desc("odds"), "less", "stem").limit(KEPT).collect(), key=lambda r: (len(r.stem), r.stem)):
        # A longer stem adds nothing to a shorter one that is kept.
        if not any(s in kept for s in _stems(r.stem.rstrip("*"))[1:] if s != r.stem):
            kept[r.stem] = float(r.odds)
    seen = {r.stem: (r.n, r.m) for r in both.where("seed is not null").collect()}
    for w in INSULTS:
        n, m = seen.get(w, (0, 0))
        # As if one toxic text and few clean ones had it before: labels move the weight as they come.
        kept[w] = max(0.0, float(np.log((n + 1) / (n_toxic + 2)) - np.log((m + np.exp(-SEED_WEIGHT)) / (n_other + 2))) if n + m else SEED_WEIGHT)
    return kept


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant last) of a logistic regression around the prior ones, by Newton steps, halved while they don't help."""
    x = np.c_[x, np.ones(len(x))]
    penalty = np.array([ridge] * (x.shape[1] - 1) + [ridge / 10])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (penalty * (w - prior) ** 2).sum() / 2
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (p - y) + penalty * (w - prior))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-7:
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """Insults and the weights of matches, from at most sample documents of each label."""
    spark = docs.sparkSession
    rows = labelled(labels, "toxic", 3, 1)
    count = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    ids = None
    for label in (0, 1):
        some = least_hashed(rows.where(F.col("label") == label), "id", sample, count.get(label, 0))
        ids = some if ids is None else ids.unionByName(some)
    got = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("id")).select("label", F.col("text").cast("binary").alias("text"), text_key(F.col("text")).alias("key"))
    got = stash(got.groupBy("label", "key").agg(F.min("text").alias("text")).drop("key"), "toxic-sample")  # copies teach once
    insults = lexicon(got)
    reader = spark.sparkContext.broadcast(insults)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Reader(reader.value)
        for batch in batches:
            x = [by.features(t or b"") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    known = sorted((r.label, r.x) for r in got.mapInArrow(features, "label int, x array<double>").collect())
    if not known:
        return insults, PRIOR
    return insults, logistic(np.array([x for _, x in known]), np.array([label for label, _ in known], float), PRIOR)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, key (of its text), held_out, score, predicted, clauses (matches of each kind)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(learn(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        insults, w = model.value
        by = Reader(insults)
        for batch in batches:
            x = np.array([by.features(t or b"") for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, FEATURES)
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            clauses = np.rint(np.expm1(x[:, : len(KINDS)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("held_out"), pa.array(score), pa.array(clauses.tolist(), pa.list_(pa.int64()))], names=["doc_id", "key", "held_out", "score", "clauses"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), fold(F.col("doc_id"), 3, 1).alias("held_out"), F.col("text").cast("binary").alias("text"))
    out = texts.mapInArrow(run, "doc_id long, key long, held_out boolean, score double, clauses array<long>")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    found = score_toxicity(docs, labels, sample).where("predicted = 1").groupBy("doc_id", "key").agg(F.lit(1).alias("bad"))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (text_key(docs["text"]) == found["key"]), "left_anti")
