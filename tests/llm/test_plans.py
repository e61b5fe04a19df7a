"""What the plans must look like."""

import re

from inkloom.llm import decontam, secrets, tokens
from inkloom.llm.common import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = plan(secrets.secrets(docs))
    assert all("lang" not in s and "n_chars" not in s for s in re.findall(r"ReadSchema: (struct<[^>]*>)", text))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_decontamination_doesnt_shuffle(spark, sf_dir):
    assert "Exchange" not in plan(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def test_repeatable(spark, sf_dir):
    from inkloom.llm import mixing

    docs = table(spark, sf_dir, "documents")
    first, again = (sorted(map(repr, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert first == again


def test_small_documents_arent_shuffled_for_counts(spark, sf_dir):
    import public_tokenizers

    df = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    small = plan(df).split("Union")[1]
    assert "MapInArrow" in small
