"""Token counts of whole texts, with huge documents cut into chunks that are counted apart.

A document of over `huge` characters is dealt out in chunks. Around each place between chunks the
text is encoded twice, with offsets: once with text before the place and once without. Where both
encodings have the same tokens for a while, and a word begins there, what came before no longer
matters: the chunks are spliced at that common boundary, and each is counted between its two
boundaries. If the encodings don't agree within the overlap, the overlap is doubled, up to a
chunk's size; a document that still has an unproven boundary is counted in one piece.

Tokenizers that drop white space count each word between white space by itself, so the counts of
words already seen in a task are kept (a bounded number of them). A probe decides which do.

Defined results: null is an empty text with 0 tokens; repeated rows count each; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, text_key

CHUNK = 1 << 15
HUGE = 1 << 16
OVERLAP = 512
#: Tokens on both sides of a boundary that must agree.
STABLE = 8
#: Words whose counts a task keeps.
KEPT_WORDS = 1_000_000


class Encoder:
    """A tokenizer file: .json for tokenizers, .model for sentencepiece."""

    def __init__(self, path: str):
        self.words: dict[bytes, int] = {}
        # sentencepiece puts a space before every text: one that a chunk begins with is left to it.
        self.skip = int(path.endswith(".model"))
        if path.endswith(".model"):
            import sentencepiece

            self._piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_word = False
            return
        from tokenizers import Tokenizer

        self._piece = None
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        split = self._tokenizer.pre_tokenizer and self._tokenizer.pre_tokenizer.pre_tokenize_str("a \t\n\r\v\f b")
        added = self._tokenizer.get_added_tokens_decoder().values()
        self.by_word = split is not None and [at for _, at in split] == [(0, 1), (8, 9)] and not any(set(t.content) & set(" \t\n\r\v\f") for t in added)

    def encoded(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token."""
        if self._piece:
            at, place = [], 0  # the character of each byte, as offsets count bytes
            for c in text:
                at += [place] * len(c.encode())
                place += 1
            at.append(place)
            return [(p.id, at[p.begin], at[p.end]) for p in self._piece.encode(text, return_type="proto").pieces]
        e = self._tokenizer.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def _counts(self, texts: list[str]) -> list[int]:
        if self._piece:
            return [len(x) for x in self._piece.encode(texts, num_threads=1)]
        return [len(e) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text (UTF-8)."""
        if not self.by_word:
            return self._counts([t.decode() for t in texts])
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.words) if split else set()
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words.clear()
            new = set().union(*split)
        new = list(new)
        parts = [new[i : i + 256] for i in range(0, len(new), 256)]
        for i in range(0, len(parts), 64):
            # One call for many words, told apart by offsets: a call costs more than a word.
            some = [[w.decode() for w in part] for part in parts[i : i + 64]]
            for part, words, e in zip(parts[i : i + 64], some, self._tokenizer.encode_batch([" ".join(w) for w in some], add_special_tokens=False), strict=True):
                ends = np.cumsum([len(w) + 1 for w in words])
                at = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.offsets))
                self.words.update(zip(part, np.bincount(np.searchsorted(ends, at, "right"), minlength=len(words)).tolist(), strict=True))
        get = self.words.__getitem__
        return [sum(map(get, words)) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def boundary(before: str, after: str, encoded, overlap: int = OVERLAP, stable: int = STABLE, plain: bool = False) -> int | None:
    """A place in after where it may be cut, whatever stands before; None if none is proven. plain: only at a space proper."""
    while True:
        left, right = before[-overlap:], after[:overlap]
        shift = len(left)
        with_left = {(i, a - shift, b - shift): k for k, (i, a, b) in enumerate(encoded(left + right))}
        own = encoded(right)
        order = [with_left.get(t) for t in own]
        for k in range(stable, len(own) - stable + 1):
            run = order[k - stable : k + stable]
            if None in run or run[-1] - run[0] != 2 * stable - 1:
                continue
            # Cut between tokens k - 1 and k: before the white space that precedes the word of token k.
            c = own[k - 1][2]
            if 0 < c < len(right) - 1 and (right[c] == " " if plain else right[c].isspace()) and not right[c - 1].isspace() and not right[c + 1].isspace() and own[k][1] in (c, c + 1):
                return c
        if overlap >= max(len(before), len(after)):
            return None
        overlap *= 2


def chunk_count(window: str, core: int, length: int, first: bool, last: bool, by: Encoder) -> int | None:
    """Tokens of a chunk: window is the chunk with its neighbourhood, core where the chunk starts in it."""
    start, end = 0, len(window)
    if not first:
        c = boundary(window[max(0, core - length) : core], window[core : core + length], by.encoded, plain=bool(by.skip))
        if c is None:
            return None
        start = core + c + by.skip
    if not last:
        c = boundary(window[core : core + length], window[core + length : core + 2 * length], by.encoded, plain=bool(by.skip))
        if c is None:
            return None
        end = core + length + c
    return by.counts([window[start:end].encode()])[0]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). path: the tokenizer's file, on every executor."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = "doc_id long, n_bytes long, n_tokens long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(path)
        for batch in batches:
            data = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in data], pa.int64()), pa.array(by.counts(data), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(path)
        for batch in batches:
            d = batch.to_pydict()
            n = [chunk_count(w, c, chunk, i == 0, i == m - 1, by) for w, c, i, m in zip(d["window"], d["core"], d["i"], d["m"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64())], names=["doc_id", "key", "n"])

    as_bytes = [F.col("doc_id"), F.col("text").cast("binary").alias("text")]
    small = texts.where(F.length("text") <= huge).select(as_bytes).mapInArrow(whole, out)
    large = texts.where(F.length("text") > huge).withColumn("key", text_key(F.col("text")))
    cut = (
        large.select("doc_id", "key", "text", F.expr(f"cast(length(text) div {chunk} as int)").alias("m"))
        .select("*", F.explode(F.expr("sequence(0, m - 1)")).alias("i"))
        .select("doc_id", "key", "m", "i", F.expr(f"least(i * {chunk}, {chunk})").alias("core"), F.expr(f"substring(text, greatest(i * {chunk} - {chunk}, 0) + 1, {3 * chunk} - if(i = 0, {chunk}, 0))").alias("window"))
        .repartition(partitions(spark), "doc_id", "key", "i")
    )
    # Repeated rows bring each chunk again: their mean is the count of one.
    spliced = cut.mapInArrow(chunks, "doc_id long, key long, n long").groupBy("doc_id", "key").agg(F.sum("n").alias("n"), F.max(F.col("n").isNull()).alias("failed"))
    rows = large.groupBy("doc_id", "key").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("n_bytes"))
    joined = rows.join(spliced.withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    counted = joined.where("not failed").select("doc_id", F.col("n_bytes").cast("long"), F.expr("n div copies").alias("n_tokens"), F.explode(F.expr("sequence(1L, copies)"))).drop("col")
    unproven = spliced.where("failed").select(F.col("doc_id").alias("d"), F.col("key").alias("k"))
    again = large.join(unproven, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi").select(as_bytes).mapInArrow(whole, out)
    return small.unionByName(counted).unionByName(again).withColumn("over_limit", F.col("n_tokens") > limit)
