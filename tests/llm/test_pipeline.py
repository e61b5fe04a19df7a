"""The pipeline against its stages' operators, one by one, on a small table."""

import re

import corpus_pipeline
from inkloom.llm import decontam, mixing, near_dedup, secrets, toxicity
from inkloom.llm.common import table

from .docs import frame


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    start = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    left = docs.where(~docs["doc_id"].isin([*toxic, -1]))
    copies = {r.doc_id for r in near_dedup.near_duplicates(left).where("not kept").collect()}
    left = left.where(~left["doc_id"].isin([*copies, -1]))
    bad = {r.doc_id for r in decontam.contamination(left, table(spark, sf_dir, "benchmark")).where("contaminated").collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    stay = set(start) - toxic - copies - bad
    # Exactly those go of which the mix takes nothing; what it takes is what mixing alone takes of the redacted texts.
    last = mixing.mix(secrets.redacted(left.where(~left["doc_id"].isin([*bad, -1])))).collect()
    assert toxic and copies and bad and {r.doc_id for r in last} == stay
    assert {r.doc_id: (r.size, r.taken) for r in last if r.taken} == {d: (r.size, r.taken) for d, r in out.items()}
    for d, r in out.items():
        text = start[d].text
        spans = [(m.start(), m.end()) for _, p, g, least in secrets.RULES for m in re.finditer(p, text, re.ASCII) if len(m[g]) >= least]
        merged, at, want = [], 0, ""
        for a, e in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([a, e])
        for a, e in merged:
            want, at = want + text[at:a] + "[secret]", e
        assert r.text == want + text[at:] and r.n_chars == len(r.text)
        assert 0 < r.taken <= 2 * r.size


def test_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_near_copies_share_five_words_in_a_row(spark):
    """A text with every twentieth word changed is similar on pairs of words, not on five; one with one word changed is on both."""
    words = [f"w{i}" for i in range(100)]
    other = [f"x{i}" if i % 20 == 10 else w for i, w in enumerate(words)]
    copy = [*words[:50], "edited", *words[51:]]
    docs = frame(spark, [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, other, copy))])
    assert {r.doc_id for r in near_dedup.near_duplicates(docs, shingle=2).where("not kept").collect()} == {1, 2}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect()} == {0, 1}


LONG = "clean words of a long text number " * 30_000
AWKWARD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (None, None, None, None, None), (None, "a text that has no id at all", "en", None, 1), (4, LONG, "en", "b", len(LONG)),
    (5, "one row that stands here twice over", "en", "b", 1), (5, "one row that stands here twice over", "en", "b", 1), (6, "same id here", "en", "b", 1), (6, "and another text with that id", "en", "b", 1),
    (7, "password = abcdef12345 and more words", "en", "a", 1), (8, "one row that stands here twice over", "en", "b", 1), (9, "tie", "en", "c", 1), (10, "tie too", "en", "c", 1),
]


def folder(spark, path, docs):
    """A folder of tables as the pipeline reads them."""
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("i", "a benchmark item of some words"), ("n", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_awkward_rows(spark, tmp_path):
    """Nulls, empty, blank and very long texts, rows and ids that repeat, extra columns with names that stages use."""
    docs = frame(spark, AWKWARD)
    extra = docs
    for name in ("key", "kept", "size", "taken", "found", "merged", "bad", "words"):
        extra = extra.withColumn(name, docs["source"])
    where = folder(spark, tmp_path, extra)
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, where)
        assert out.columns == extra.columns
        got = {(r.doc_id, r.text) for r in out.collect()}
        if name == "near_dedup":  # the copy with the greater id goes, both rows of the other stay
            assert got == {(d, t) for d, t, *_ in AWKWARD} - {(8, AWKWARD[11][1])} and out.count() == len(AWKWARD) - 1
        elif name == "secrets":
            assert {r.text: r.n_chars for r in out.where("doc_id = 7").collect()} == {"[secret] and more words": 23} and out.count() == len(AWKWARD)
            assert [(r.text, r.n_chars) for r in out.where("doc_id = 1").collect()] == [(None, None)]
        else:
            assert rows(out) == rows(extra)
    out = corpus_pipeline.run(spark, where)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"]
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (4, LONG) in got and not {d for d, _ in got} & {1, 2, 3, 8} and all(r.taken > 0 for r in out.collect())


def test_empty_table(spark, tmp_path):
    docs = frame(spark, AWKWARD).limit(0)
    where = folder(spark, tmp_path, docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, where).count() == 0


def test_stashes_are_alike():
    """The library and this subpackage each write tables to the shared folder; neither imports the other, so both must do it alike."""
    import inspect

    from inkloom.llm import common
    from inkloom.sources import tables

    lines = lambda f: [x.strip() for x in inspect.getsource(f).splitlines()]
    shared = [x for x in lines(common.shared_dir) if x.startswith(("if not", "raise", "found =", "spark.conf.set", "spark.sparkContext"))]
    assert all(x.replace("found", "folder").replace("not folder", "not folder") in lines(tables.written) for x in shared)
    assert any("/tables/{name}-{uuid.uuid4().hex}" in x for x in lines(common.stash)) and any("/tables/{name}-{uuid.uuid4().hex}" in x for x in lines(tables.written))
