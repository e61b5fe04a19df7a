"""Token counts against the libraries on whole texts."""

import random

import pytest

from inkloom.llm import tokens

from .docs import SCHEMA, frame, rows

public_tokenizers = pytest.importorskip("public_tokenizers")


def want(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(p.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    path = public_tokenizers.path(name)
    rng = random.Random(1)
    long = [" ".join("".join(rng.choice("abcdeéñ '’.,!1") for _ in range(rng.randrange(1, 12))) for _ in range(900)) for _ in range(4)]
    solid = "x" * 3000 + " " + "y1" * 900
    data = [*rows(1, n=12), *((5000 + i, t, None, None, 1) for i, t in enumerate([*long, solid, long[0], "a <|endoftext|> b", "é ́x", "tab\tand  wide"])), (5000, long[0], None, None, 1)]
    out = tokens.token_counts(frame(spark, data), path, limit=100, chunk=600, huge=1200).collect()
    texts = [t or "" for _, t, *_ in data]
    expect = sorted(((d, len(t.encode()), n, n > 100) for (d, *_), t, n in zip(data, texts, want(path, texts), strict=True)), key=repr)
    assert sorted((tuple(r) for r in out), key=repr) == expect


def test_boundary_widens_and_gives_up():
    e = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "alpha beta gamma delta " * 40
    assert tokens.boundary(text, text, e.encoded, overlap=16) is not None
    assert tokens.boundary("x" * 200, "x" * 200, e.encoded, overlap=16) is None


def test_empty(spark):
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).count() == 0
