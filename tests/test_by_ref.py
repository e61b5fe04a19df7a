"""Edits by reference, groups of changes, bare parts and the rules that parts keep."""

import pytest
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import by_ref, changes, search, tracked
from inkloom.sources import docx

from .test_documents import BODY, W, package
from .test_tracked import EDITS, edit, plain_runs, rejected, texts


@pytest.fixture(scope="module")
def found(spark):
    table = '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a1</w:t></w:r></w:p><w:p><w:r><w:t>a2</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>b1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    body = f"<w:p><w:r><w:t>one</w:t></w:r></w:p>{table}<w:p><w:r><w:t>two</w:t></w:r></w:p>"
    df = docx.entities_of_xml(spark.createDataFrame([("d", f"<w:document {W}><w:body>{body}</w:body></w:document>"), ("bad", "<w:p>"), ("none", None)], "doc_id string, xml string")).cache()
    yield lambda kind: docx.entity(df, kind)
    df.unpersist()


def test_bare_parts(found):
    got = [(r.p_idx, r.location, r.text) for r in found("paragraphs").orderBy("p_idx").collect()]
    assert got[0] == (0, "body", "one") and got[-1] == (6, "body", "two") and len(got) == 7
    assert {r.doc_id for r in found("errors").collect()} == {"bad", "none"}


def test_elements(found):
    got = {r.ref: (r.element_type, r["first"], r["last"]) for r in by_ref.elements(found("paragraphs")).collect()}
    want = {"p:0": ("paragraph", 0, 0), "p:1": ("paragraph", 6, 6), "tbl:0": ("table", 1, 5), "tbl:0/row:0": ("row", 1, 3), "tbl:0/row:1": ("row", 4, 5), "tbl:0/row:0/cell:0": ("cell", 1, 2), "tbl:0/row:0/cell:1": ("cell", 3, 3), "tbl:0/row:0/cell:0/p:1": ("paragraph", 2, 2)}
    assert want.items() <= got.items() and len(got) == 2 + 1 + 2 + 4 + 5


def test_insert(spark, found):
    rows = [
        (1, "p:0", "A", "after", True), (2, "p:0", "B", "after", True), (3, "p:0", "C", "before", False), (4, "p:0", "D", "before", True), (5, "p:1", "!", "end", True), (6, "p:1", "?", "end", False), (7, "p:1", ">", "start", True),
        (8, "tbl:0/row:0/cell:0", "+", "after", True), (9, "tbl:0/row:1", "-", "before", False), (10, "tbl:0/row:0/cell:1", "in an empty cell", "start", True), (11, "p:9", "x", "after", True), (12, "p:0", "x", "beside", True), (13, "p:0", None, None, None),
    ]
    edits = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, seq int, ref string, text string, position string, track boolean")
    lines, runs, made, results = by_ref.insert(found("paragraphs"), found("runs"), edits)
    assert {r.seq for r in results.collect() if not r.success} == {11, 12, 13}
    got = [r.text for r in lines.where("doc_id = 'd'").orderBy("n").collect()]
    assert got == ["C", "D", "one", "A", "B", "a1", "a2", "", "b1", "b2", "two"]
    now = texts(runs.where("doc_id = 'd'"))
    assert [now.get((tracked.BODY, i), "") for i in range(7)] == ["one", "a1", "a2+", "in an empty cell", "-b1", "b2", ">two!?"]
    ids = [int(r.change_id) for r in made.collect()]
    assert sorted(ids) == list(range(1, 8)) and {r.text for r in made.collect()} == {"A", "B", "D", "!", ">", "+", "in an empty cell"}


def test_delete(spark, found):
    rows = [(1, "tbl:0/row:0", True), (2, "tbl:0/row:0/cell:0", False), (3, "tbl:0/row:1/cell:1/p:0", False), (4, "p:1", True), (5, "tbl:7", True)]
    runs, made, results = by_ref.delete(found("paragraphs"), found("runs"), spark.createDataFrame([("d", *r) for r in rows], "doc_id string, seq int, ref string, track boolean"))
    now = texts(runs)
    assert [now.get((tracked.BODY, i), "") for i in range(7)] == ["one", "", "", "", "b1", "", ""] and {r.text for r in made.collect()} == {"a1", "a2", "two"}
    assert {r.p_idx: r.text for r in rejected(runs).collect() if r.text} == {0: "one", 1: "a1", 2: "a2", 4: "b1", 6: "two"}
    assert {r.seq: r.success for r in results.collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_comment(spark, found):
    rows = [("d", 1, "tbl:0/row:1", "why?", "Olga"), ("d", 2, "p:0", "and this?", "Petr"), ("d", 3, "p:7", "lost", "Petr"), ("d", 4, "tbl:0/row:0/cell:1", "empty", "Petr")]
    comments, ranges, results = by_ref.comment(found("paragraphs"), found("comments"), found("comment_ranges").drop("part"), spark.createDataFrame(rows, "doc_id string, seq int, ref string, text string, author string"))
    got = {(r.text, r.start_p_idx, r.end_p_idx, r.marked_text) for r in comments.join(ranges, ["doc_id", "comment_id"]).collect()}
    assert got == {("why?", 4, 5, "b1b2"), ("and this?", 0, 0, "one"), ("empty", 3, 3, "")}
    assert {r.seq: r.message for r in results.collect()}[3] == "nothing has the reference p:7"


def test_groups_of_changes(spark):
    """Groups that edits record outlive other edits and decisions."""
    docs = {"a": [["one two three four"]], "b": [["one"]]}
    todo = spark.createDataFrame([edit("a", 1, "delete_tracked", text="one "), edit("a", 2, "replace_tracked", find="three", replace="3"), edit("b", 1, "delete_tracked", text="one")], EDITS)
    after, made, _ = tracked.apply(plain_runs(spark, docs), todo)
    named = spark.createDataFrame([("a", 1, "shorter"), ("a", 2, "digits"), ("b", 1, "shorter"), ("b", 9, None)], "doc_id string, seq int, group_name string")
    members = tracked.members(made, named).cache()
    assert {(r.doc_id, r.group_name, tuple(r.ids)) for r in changes.groups(members).collect()} == {("a", "shorter", ("1",)), ("a", "digits", ("2", "3")), ("b", "shorter", ("1",))}
    later, _, _ = tracked.apply(after, spark.createDataFrame([edit("a", 1, "insert_tracked", after="four", text=" five")], EDITS))
    back, n = changes.decided_groups(later, members, False, "shorter")
    assert {r.doc_id: r.text for r in tracked.visible(back).collect()} == {"a": "one two 3 four five", "b": "one"}
    assert {(r.doc_id, r.group_name, r.n) for r in n.collect()} == {("a", "shorter", 1), ("b", "shorter", 1)}
    kept, n = changes.decided_groups(back, members, True, "digits", "shorter")
    assert {(r.doc_id, r.group_name, r.n) for r in n.collect()} == {("a", "digits", 2)}
    assert {r.doc_id: r.text for r in rejected(kept).collect()} == {"a": "one two 3 four", "b": "one"}


def test_problems_of_parts(spark):
    head = '<?xml version="1.0" encoding="{}"?>'
    odd = {
        "word/document.xml": head.format("ISO-8859-1") + f"<w:document {W}><w:body>{BODY}</w:body></w:document>",
        "word/a.xml": head.format("utf-8") + f'<w:x {W} xmlns:mc="urn:mc" mc:Ignorable="w14 w99 zz"/>',
        "word/b.xml": "<a>", "word/c.xml": "<a x='encoding=\"latin1\"'/>", "word/d.txt": "<", "word/_rels/e.rels": "<q:r/>",
    }
    rows = docx.problems(spark.createDataFrame([("good", package()), ("odd", package(odd)), ("broken", b"x"), ("none", None)], "doc_id string, content binary")).collect()
    got = {(r.doc_id, r.part, r.rule) for r in rows}
    assert got == {("odd", "word/document.xml", "encoding"), ("odd", "word/a.xml", "namespace"), ("odd", "word/b.xml", "xml"), ("odd", "word/_rels/e.rels", "xml"), ("broken", None, "package"), ("none", None, "package")}
    assert {r.detail for r in rows if r.rule == "namespace"} == {"w99", "zz"}


def test_quotes_there_and_back(spark):
    df = spark.createDataFrame([(1, 0, "the plaintiff’s “free trial” offer")], "doc_id long, p_idx int, text string")
    assert df.select(T.denormalize_quotes(F.col("text")).alias("t")).head().t == "the plaintiff's \"free trial\" offer"
    hit = search.find_all(df, 'plaintiff\'s "free', normalize=True).select("doc_id", "pos", "len").join(df, "doc_id").select(T.restored(F.col("text"), F.col("pos"), F.col("len")).alias("t"))
    assert hit.head().t == "plaintiff’s “free"
