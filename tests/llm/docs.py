"""Small documents with the awkward cases: nulls, empty and long texts, copies, near copies, shared passages."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, kinds=60):
    return [f"w{rng.randrange(kinds)}{'é' if rng.random() < 0.05 else ''}" for _ in range(n)]


def rows(seed=0, n=40, kinds=60, length=80):
    rng = random.Random(seed)
    texts = []
    passage = words(rng, 30, kinds)
    for i in range(n):
        kind = rng.randrange(6)
        if texts and kind == 0:
            texts.append(rng.choice(texts))
        elif texts and kind == 1:
            w = rng.choice(texts).split(" ")
            w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
        elif kind == 2:
            w = words(rng, rng.randrange(length), kinds)
            at = rng.randrange(len(w) + 1)
            texts.append(" ".join(w[:at] + passage + w[at:]))
        else:
            texts.append(" ".join(words(rng, rng.randrange(length), kinds)).replace(" w1 ", "\n", 1))
    texts += ["", " \t\n", "x" * 700, "ab" * 500, "one two three", "one two three"]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, (900, None, None, None, None)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)
