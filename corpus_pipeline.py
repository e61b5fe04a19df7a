"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

A stage takes any columns with doc_id and text (mixing: source too) and, but for the last, returns them all; run()
reads the columns of documents and leaves others behind. Defined results, for every stage: a null text is an empty
one; an empty table gives an empty table with the same columns; rows may repeat, and copies of a row share its fate;
a doc_id may be null or stand on several rows. What each stage makes of such rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkloom.llm import decontam, mixing, near_dedup, secrets, toxicity
from inkloom.llm.common import stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Null and empty texts have no matches and stay; rows that share a doc_id are judged each by its own text."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words, stays, that of the least doc_id.

    Null, empty and blank texts are like nothing and stay, as do rows without a doc_id. Rows that share a doc_id are one document: all stay, or all go.
    """
    return near_dedup.one_of_each(docs, shingle=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words stand in benchmark windows go.

    Texts without words stay; an empty benchmark takes nothing; rows that share a doc_id are judged each by its own text.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, n_chars follows its text. A null text stays null, its n_chars too."""
    out = secrets.redacted(docs)
    return out.selectExpr(*("cast(length(text) as bigint) as n_chars" if c == "n_chars" else c for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds how many words of each document the mix takes; documents of which it takes none go, and so do texts without words.

    A null source is a source of its own. Adds size, source_size, target and taken.
    """
    return mixing.mix(docs, keep=tuple(c for c in docs.columns if c != "doc_id")).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
