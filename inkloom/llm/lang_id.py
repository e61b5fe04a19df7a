"""Language identification by character language models, interpolated Kneser-Ney, one for each language.

Texts become lower-case letters with one space for every stretch of anything else, ahead of them
ORDER - 1 spaces. Spark counts the runs of ORDER characters of each language, summed up in each task
before they shuffle, over all documents that may be learned from. All else follows from these counts
by grouping: a shorter run counts the different characters seen ahead of it, a discount comes from the
runs counted once and twice, and a context keeps for shorter runs what its own runs don't take.

A model keeps, for each language and length, the ENTRIES most frequent runs (fewer where counts tie at
the end); the context hands the rest to shorter runs, so probabilities still sum to one. That bounds
what the driver and a worker hold: arrays sorted by the runs' hashes, with a column of log-probabilities
for each language, for BLOCK languages at a time. More languages take one pass over the texts a block.

A document goes to the language of the least cross-entropy, in bits a character. Its score is a
softmax over the languages' cross-entropies, whose steepness is fitted to all documents that may be
learned from. They are dealt into FOLDS, and each is held against models that count the other folds
(the models that are used count all of them); one whose language no other fold holds is left out, as
there is no model to hold it against. Sums over documents and quantiles are found by Spark, and only
these reach the driver. `rejected` says that the best cross-entropy is above the language's calibrated
limit, or the score below one half.

Defined results: null text and texts without letters are `und` with score 0, as is all if no language
can be learned; ties go to the language first by code point; documents of null language, or of a null
doc_id, aren't learned from; rows that repeat count as often as they stand; texts beyond STRETCH
characters are counted and scored whole, stretch by stretch, as if each began there (halves of one, where
it is counted, if it holds over 55,000 different letters); bytes that aren't UTF-8 are no letters; an empty table gives no rows; further columns are ignored under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stash
from .quality import fold
from .windows import mix

#: Characters of a run, and most runs of each length that a language's model keeps.
ORDER, ENTRIES = 4, 1 << 16
#: Languages scored in one pass, characters handled at once.
BLOCK, STRETCH = 16, 1 << 20
#: Parts that learnable documents are dealt into; models that count all but one are calibrated on that one.
FOLDS = 2
#: Share of the calibration documents of a language that its limit of cross-entropy leaves in, and the fewest that have a limit.
WITHIN, ENOUGH = 0.995, 20
#: Steepnesses tried; what they cost is counted in units, as whole numbers have one sum in any order.
STEEPNESSES, UNIT = np.geomspace(0.25, 256, 61), 1 << 16
#: Cells of a bit: a quantile is looked for in the cell that holds it.
CELLS = 1 << 12
UNKNOWN = "und"
SPACE = 32
_P = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def stretches(text: bytes | None) -> list[str]:
    whole = (text or b"").decode("utf-8", "ignore").lower()
    return [whole[i : i + STRETCH] for i in range(0, len(whole), STRETCH)]


def symbols(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each behind order - 1 spaces; the places of their own characters; the text of each."""
    sizes = [len(t) for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = letters()[codes]
    # Of a stretch of anything else only the first stays, if a letter of the same text stands before it.
    stay = letter.copy()
    stay[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    owner, codes = owner[stay], np.where(letter, codes, SPACE)[stay]
    places = np.arange(len(codes)) + (owner + 1) * (order - 1)
    out = np.full(len(codes) + len(texts) * (order - 1), SPACE, np.uint32)
    out[places] = codes
    return out, places, owner


def hashes(codes: np.ndarray, places: np.ndarray, order: int, ahead: int = 0) -> np.ndarray:
    """Hashes of the order characters that end `ahead` before each place."""
    h = np.zeros(len(places), np.uint64)
    for back in range(order - 1, -1, -1):
        h = h * _P + (codes[places - back - ahead].astype(np.uint64) + np.uint64(1))
    return mix(h)


def text_hashes(grams: list[str]) -> np.ndarray:
    """Hashes of texts that are all of one length."""
    if not grams:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    order = len(grams[0])
    return hashes(codes, np.arange(len(grams)) * order + order - 1, order)  # of no characters: the one hash of an empty context


def counts(texts: list[str], order: int = ORDER) -> tuple[list[str], np.ndarray]:
    """The different runs of order characters of texts, and how often each stands there."""
    codes, places, _ = symbols(texts, order)
    if not len(places):
        return [], np.zeros(0, np.int64)
    used = np.flatnonzero(np.bincount(codes))
    if len(used) ** order >= 1 << 63:  # can't be numbered exactly: half the texts, or of the text, at a time
        if len(texts) > 1:
            halves = texts[: len(texts) // 2], texts[len(texts) // 2 :]
        else:
            halves = [texts[0][: len(texts[0]) // 2]], [texts[0][len(texts[0]) // 2 :]]
        (a, n), (b, m) = (counts(h, order) for h in halves)
        return a + b, np.concatenate([n, m])
    rank = np.zeros(int(used[-1]) + 1, np.int64)
    rank[used] = np.arange(len(used))
    number = np.zeros(len(places), np.int64)
    for back in range(order - 1, -1, -1):
        number = number * len(used) + rank[codes[places - back]]
    number, n = np.unique(number, return_counts=True)
    chars = np.empty((len(number), order), np.uint32)
    for i in range(order - 1, -1, -1):
        number, digit = np.divmod(number, len(used))
        chars[:, i] = used[digit]
    whole = chars.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + order] for i in range(0, len(whole), order)], n


def fold_names() -> list[str]:
    return [f"n_{i}" for i in range(FOLDS)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts wait for others of their language, STRETCH characters of one and eight times that in all at most."""
    waiting: dict[tuple, tuple[list[str], int]] = {}

    def out(key: tuple) -> Iterator[pa.RecordBatch]:
        grams, n = counts(waiting.pop(key)[0])
        lang, kept = key
        n, none = pa.array(n, pa.int64()), pa.array(np.zeros(len(grams), np.int64))
        folds = [n if i == kept else none for i in range(FOLDS)]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), n, *folds], names=["lang", "gram", "n", *fold_names()])

    held = 0
    for batch in batches:
        for lang, kept, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "kept", "text")), strict=True):
            for some in stretches(text):
                texts, size = waiting.get((lang, kept), ([], 0))
                texts.append(some)
                waiting[lang, kept] = texts, size + len(some)
                held += len(some)
                if size + len(some) >= STRETCH:
                    held -= size + len(some)
                    yield from out((lang, kept))
                elif held >= 8 * STRETCH:
                    most = max(waiting, key=lambda k: waiting[k][1])
                    held -= waiting[most][1]
                    yield from out(most)
    for key in [*waiting]:
        yield from out(key)


def packs(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of at most STRETCH characters; none is longer than that."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > STRETCH:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def learnable(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """(doc_id, lang, text, kept) of the documents that may be learned from; kept is the fold whose models don't count them."""
    rows = docs.select("doc_id", F.col(f"`{lang}`").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold(F.col("doc_id"), 4, 2))
    return rows.withColumn("kept", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(FOLDS)).cast("int"))


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n, n_0, …): counts of runs over all rows, and over those of each fold."""
    numbers = ["n", *fold_names()]
    found = rows.select("lang", "kept", "text").mapInArrow(_count, "lang string, gram string, " + ", ".join(f"{n} long" for n in numbers))
    return found.groupBy("lang", "gram").agg(*(F.sum(n).alias(n) for n in numbers))


def versions(grams: DataFrame) -> DataFrame:
    """(fold, lang, gram, n) of (lang, gram, n, n_0, …): what all folds but one hold of each run, and as fold FOLDS what all hold."""
    counts = [F.struct(F.lit(i).alias("fold"), (F.col("n") - F.col(n)).alias("n")) for i, n in enumerate(fold_names())]
    counts.append(F.struct(F.lit(FOLDS).alias("fold"), F.col("n")))
    return grams.select("lang", "gram", F.explode(F.array(*counts)).alias("v")).select("v.fold", "lang", "gram", "v.n").where("n > 0")


def discounted(grams: DataFrame, entries: int = ENTRIES, order: int = ORDER, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(lang, size, gram, share): what each run that a model keeps takes of its context, after the discount.

    grams holds (lang, gram, n) of runs of order characters; by names the columns that tell models apart.
    """
    sizes = [grams.select(*by, F.lit(order).alias("size"), "gram", "n")]
    for size in range(order - 1, 0, -1):
        longer = sizes[-1].groupBy(*by, F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n"))
        sizes.append(longer.select(*by, F.lit(size).alias("size"), "gram", "n"))
    runs = sizes[0]
    for more in sizes[1:]:
        runs = runs.unionByName(more)
    runs = stash(runs, "runs")
    levels = runs.groupBy(*by, "size", "n").agg(F.count("*").alias("types"))  # different counts are few
    once, twice = (F.max(F.when(F.col("n") == i, F.col("types"))) for i in (1, 2))
    running = F.sum("types").over(Window.partitionBy(*by, "size").orderBy(F.col("n").desc()))
    levels = levels.withColumn("running", running).groupBy(*by, "size").agg(
        F.coalesce(once / (once + 2 * twice), F.lit(0.5)).alias("discount"),
        F.min(F.when(F.col("running") <= entries, F.col("n"))).alias("least"),
    )
    context = F.substring("gram", F.lit(1), F.col("size") - 1)
    totals = runs.groupBy(*by, "size", context.alias("context")).agg(F.sum("n").alias("total"))
    kept = runs.join(levels, [*by, "size"]).where(F.col("n") >= F.col("least")).withColumn("context", context)
    kept = kept.join(totals, [*by, "size", "context"])
    return kept.select(*by, "size", "gram", ((F.col("n") - F.col("discount")) / F.col("total")).alias("share"))


class Sorted:
    """Distinct hashes in ascending order, found through an index of their leading bits."""

    def __init__(self, values: np.ndarray):
        self.values = np.append(np.unique(values), np.uint64((1 << 64) - 1))
        self.shift = np.uint64(64 - max(4, int(len(values)).bit_length() + 1))
        leading = np.arange((1 << (64 - int(self.shift))), dtype=np.uint64) << self.shift
        self.start = np.searchsorted(self.values, leading)

    def __len__(self) -> int:
        return len(self.values) - 1

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for one that isn't there."""
        at = self.start[wanted >> self.shift]
        behind = np.flatnonzero(self.values[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[self.values[at[behind]] < wanted[behind]]
        at[(self.values[at] != wanted) | (at == len(self))] = -1
        return at


@dataclass
class Model:
    """Log-probabilities (base 2) of runs, by size, and what a context of that many characters hands on; a column for each language."""

    langs: list[str]
    runs: list[tuple[Sorted, np.ndarray]]
    contexts: list[tuple[Sorted, np.ndarray]]
    floor: float

    def bits(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Minus the log-probability of each place's character by each language: the longest run that a model knows decides."""
        out = np.zeros((len(places), len(self.langs)), np.float32)
        rest = np.arange(len(places))
        for size in range(len(self.runs), 0, -1):
            known, logs = self.runs[size - 1]
            at = known.find(hashes(codes, places[rest], size))
            hit = at >= 0
            out[rest[hit]] -= logs[at[hit]]
            rest = rest[~hit]
            if not len(rest):
                return out
            known, logs = self.contexts[size - 1]
            at = known.find(hashes(codes, places[rest], size - 1, 1))
            hit = at >= 0
            out[rest[hit]] -= logs[at[hit]]
        out[rest] -= np.float32(self.floor)
        return out

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each text (in stretches): bits by each language, and the number of its characters."""
        total, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        flat = [s for t in texts for s in t]
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        done = 0
        for some in packs(flat):
            codes, places, owner = symbols(some, len(self.runs))
            if len(places):
                bits = self.bits(codes, places)
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                text = of[done + owner[first]]
                np.add.at(total, text, np.add.reduceat(bits, first, axis=0, dtype=np.float64))
                np.add.at(size, text, np.diff(np.r_[first, len(owner)]))
            done += len(some)
        return total, size


def assemble(table: pd.DataFrame, langs: list[str], order: int = ORDER) -> Model:
    """A model of the languages from rows of (lang, size, gram, share).

    What a context hands on is what its kept runs leave. Runs that one language knows are given every
    language's probability, so that a place is looked up once for all of them.
    """
    column = {lang: i for i, lang in enumerate(langs)}
    table = table[table["lang"].isin(column)]
    characters = table["gram"].str[-1:].nunique()
    floor = -float(np.log2(characters + 1))  # one more for all characters that weren't seen
    runs: list[tuple[Sorted, np.ndarray]] = []
    contexts: list[tuple[Sorted, np.ndarray]] = []
    for size in range(1, order + 1):
        part = table[table["size"] == size]
        grams, at = np.unique(part["gram"].to_numpy(str), return_inverse=True)
        heads = np.array([g[:-1] for g in grams])
        lang = part["lang"].map(column).to_numpy(int)
        share = np.zeros((len(grams), len(langs)))
        share[at, lang] = part["share"].to_numpy(float)
        names, head = np.unique(heads, return_inverse=True)
        taken = np.zeros((len(names), len(langs)))
        np.add.at(taken, head, share)
        left = np.maximum(1 - taken, 1e-9)
        if size == 1:
            lower = np.full(share.shape, 2.0**floor)
        else:
            lower = np.exp2(-_lower(runs, contexts, floor, [g[1:] for g in grams], len(langs)))
        logs = np.log2(share + left[head] * lower).astype(np.float32)
        runs.append(_by_hash(list(grams), logs))
        contexts.append(_by_hash(list(names), np.log2(left).astype(np.float32)))
    return Model(langs, runs, contexts, floor)


def _lower(runs: list, contexts: list, floor: float, grams: list[str], langs: int) -> np.ndarray:
    """Bits of shorter runs by the model so far."""
    if not grams:
        return np.zeros((0, langs))
    size = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    return Model([""] * langs, runs, contexts, floor).bits(codes, np.arange(len(grams)) * size + size - 1).astype(float)


def _by_hash(grams: list[str], logs: np.ndarray) -> tuple[Sorted, np.ndarray]:
    found = text_hashes(grams)
    known = Sorted(found)
    out = np.zeros((len(known), logs.shape[1]), np.float32)
    out[known.find(found)] = logs
    return known, out


@dataclass
class Calibration:
    """Steepness of the softmax over cross-entropies, and each language's limit of bits a character."""

    steepness: float
    limits: dict[str, float]


def losses(entropies: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """What documents lose by each of STEEPNESSES, in UNITs; then the sum and the number of the distances between right languages and others."""
    gap = entropies - entropies[np.arange(len(truth)), truth][:, None]
    apart = np.abs(gap[gap != 0])
    units = [np.rint(np.logaddexp.reduce(-b * gap, axis=1) * UNIT).sum() for b in STEEPNESSES]
    return np.array([*units, np.rint(apart * UNIT).sum(), len(apart)]).astype(np.int64)


def steepness(lost: np.ndarray) -> float:
    """The best of STEEPNESSES by summed losses; 8 where no languages are told apart."""
    units, apart, number = lost[:-2], lost[-2], lost[-1]
    if not number:
        return 8.0
    doubt = 0.5 * apart / number  # half a document that is wrong keeps the fit finite where all are right
    return float(STEEPNESSES[np.argmin(units + STEEPNESSES * doubt)])


def calibrate(entropies: np.ndarray, truth: np.ndarray, langs: list[str]) -> Calibration:
    """Of arrays at hand: cross-entropies by language (rows without characters are left out) and the places of the right languages."""
    limits = {}
    for i, lang in enumerate(langs):
        own = np.sort(entropies[truth == i, i])
        if len(own) >= ENOUGH:  # a quantile of fewer says nothing
            limits[lang] = float(own[min(len(own) - 1, int(np.ceil(WITHIN * len(own))))]) * 1.05
    return Calibration(steepness(losses(entropies, truth)), limits)


def calibrated(known: DataFrame, langs: list[str]) -> Calibration:
    """What calibrate gives, of a table (lang, by_lang) of any size: losses add up, a quantile is looked for in one cell of a language."""
    place = {lang: i for i, lang in enumerate(langs)}

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(STEEPNESSES) + 2, np.int64)
        for batch in batches:
            truth = np.array([place[lang] for lang in batch.column("lang").to_pylist()], int)
            total += losses(np.array(batch.column("by_lang").to_pylist(), float).reshape(len(truth), len(langs)), truth)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total), dtype=np.int32)), "lost": pa.array(total)})

    lost = dict(known.select("lang", "by_lang").mapInArrow(lose, "at int, lost long").groupBy("at").agg(F.sum("lost")).collect())
    right = F.element_at("by_lang", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int"))
    own = known.select("lang", right.alias("own")).withColumn("cell", F.floor(F.col("own") * CELLS))
    cells = own.groupBy("lang", "cell").agg(F.count("*").alias("n"))
    of_lang = Window.partitionBy("lang")
    cells = cells.withColumn("number", F.sum("n").over(of_lang)).withColumn("before", F.sum("n").over(of_lang.orderBy("cell")) - F.col("n"))
    cells = cells.withColumn("rank", F.least(F.col("number") - 1, F.ceil(F.lit(WITHIN) * F.col("number"))) - F.col("before"))
    cells = cells.where((F.col("number") >= ENOUGH) & (F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).select("lang", "cell", "rank")
    values = own.join(F.broadcast(cells), ["lang", "cell"]).groupBy("lang", "rank", "own").agg(F.count("*").alias("n"))
    values = values.withColumn("running", F.sum("n").over(of_lang.orderBy("own"))).where(F.col("running") > F.col("rank"))
    limits = {r.lang: r.own * 1.05 for r in values.groupBy("lang").agg(F.min("own").alias("own")).collect()}
    return Calibration(steepness(np.array([lost.get(i, 0) for i in range(len(STEEPNESSES) + 2)])), limits)


def entropies(rows: DataFrame, models: list[Model]) -> DataFrame:
    """Adds to rows of (…, text): size, the characters counted, and by_lang, the bits a character of each language; texts go after the last model."""
    for i, model in enumerate(models):
        last = i == len(models) - 1
        rows = _scored(rows, model, f"by_lang_{i}", keep_text=not last)
    return rows.withColumn("by_lang", F.concat(*(F.col(f"by_lang_{i}") for i in range(len(models))))).drop(*(f"by_lang_{i}" for i in range(len(models))))


def _scored(rows: DataFrame, model: Model, name: str, keep_text: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    carried = [f for f in rows.schema.fields if f.name != "size" and (keep_text or f.name != "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, size = shared.value.scores([stretches(t) for t in batch.column("text").to_pylist()])
            fields = {f.name: batch.column(f.name) for f in carried}
            fields["size"] = pa.array(size)
            fields[name] = pa.array(list(total / np.maximum(size, 1)[:, None]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(fields)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    return rows.mapInArrow(run, f"{schema}, size long, {name} array<double>")


def models(kept: DataFrame, langs: list[str]) -> list[Model]:
    """Models of the languages, BLOCK in each, from rows of (lang, size, gram, share), which reach the driver a block at a time."""
    blocks = [langs[i : i + BLOCK] for i in range(0, len(langs), BLOCK)]
    return [assemble(kept.where(F.col("lang").isin(block)).select("lang", "size", "gram", "share").toPandas(), block) for block in blocks]


def learn(grams: DataFrame, langs: list[str], entries: int = ENTRIES) -> list[Model]:
    """Models of the languages from rows of (lang, gram, n)."""
    kept = discounted(grams.select("lang", "gram", "n").where("n > 0"), entries)
    return models(stash(kept, "kept-runs") if len(langs) > BLOCK else kept, langs)


def held_apart(usable: DataFrame, kept: DataFrame, counted: dict[str, list[int]]) -> DataFrame:
    """(lang, by_lang) of every learnable document with characters, by models that count the other folds, if any of these holds its language.

    kept holds the runs of all versions; counted says how many characters of a language each version counts.
    """
    parts = []
    for i in range(FOLDS):
        known = [lang for lang, n in counted.items() if n[i]]
        if known:
            rows = usable.where((F.col("kept") == i) & F.col("lang").isin(known)).select("lang", "text")
            scored = entropies(rows, models(kept.where(F.col("fold") == i), sorted(counted)))
            parts.append(stash(scored.where("size > 0").select("lang", "by_lang"), "held-apart"))
    if not parts:
        return usable.sparkSession.createDataFrame([], "lang string, by_lang array<double>")
    return reduce(DataFrame.unionByName, parts)


def identify(docs: DataFrame, lang: str = "lang", entries: int = ENTRIES) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, bits (a character, null if none was counted), rejected."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = learnable(docs, lang)
    grams = stash(gram_counts(usable), "grams")
    sums = grams.groupBy("lang").agg(*(F.sum(F.col("n") - F.col(n)).alias(n) for n in fold_names())).collect()
    counted = {r.lang: [r[n] for n in fold_names()] for r in sums}
    langs = sorted(counted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id"), 4, 2).alias("held_out"), F.col("text").cast("binary").alias("text"))
    if not langs:
        none = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits": F.lit(None).cast("double"), "rejected": F.lit(True)}
        return rows.drop("text").withColumns(none)
    kept = stash(discounted(versions(grams), entries, by=("fold", "lang")), "kept-runs")
    setting = calibrated(held_apart(usable, kept, counted), langs)
    best = F.array_min("by_lang")
    name = F.element_at(F.array(*map(F.lit, langs)), F.array_position("by_lang", best).cast("int"))
    mass = F.aggregate("by_lang", F.lit(0.0), lambda a, b: a + F.exp(F.lit(-setting.steepness) * (b - best)))
    limit = F.element_at(F.array(*(F.lit(setting.limits.get(x, float("inf"))) for x in langs)), F.array_position("by_lang", best).cast("int"))
    found = entropies(rows, models(kept.where(F.col("fold") == FOLDS), langs))
    some = F.col("size") > 0
    return found.select(
        "doc_id", "held_out",
        F.when(some, name).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(some, 1 / mass).otherwise(0.0).alias("score"),
        F.when(some, best).alias("bits"),
        F.when(some, (best > limit) | (1 / mass < 0.5)).otherwise(True).alias("rejected"),
    )
