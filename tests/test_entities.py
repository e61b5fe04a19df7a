"""Trees, exports, entity edits and validation over a package built in memory."""

import pytest
from pyspark.sql import functions as F

from inkloom.operators import entity_edits as E
from inkloom.operators import export, nodes, structure, validation
from inkloom.sources import docx

from .test_documents import package, values


@pytest.fixture(scope="module")
def found(spark):
    df = docx.entities(spark.createDataFrame([("a", package()), ("broken", b"no zip")], "doc_id string, content binary")).cache()
    yield lambda kind: docx.entity(df, kind)
    df.unpersist()


def main(found):
    return found("paragraphs").where("part = 'word/document.xml'")


def test_tree(spark, found):
    tree = nodes.tree(found("paragraphs"), found("changes").where("p_idx is not null").select("doc_id", "p_idx"))
    refs = dict(values(tree, "ref", "parent_ref"))
    assert refs["p:0"] is None and refs["tbl:0/row:0/cell:1"] == "tbl:0/row:0" and len(refs) == 8
    assert values(nodes.find(tree, element_type="heading", level=1), "text") == [("Introduction",)]
    assert sorted(values(nodes.find(tree, has_changes=True), "ref")) == [("p:1",), ("p:2",)]
    assert values(nodes.find(tree, element_type="cell", contains="owl"), "text") == [("owl cell",)]
    assert dict(values(nodes.counts(tree), "element_type", "n")) == {"heading": 1, "paragraph": 3, "table": 1, "row": 1, "cell": 2}
    hits = nodes.search_tree(tree, "OWL", most=2)
    assert sorted(values(hits, "ref", "found", "total")) == [("p:1", "owl", 4), ("tbl:0", "owl", 4)]
    there, missing = nodes.lookup(tree, spark.createDataFrame([("a", "p:1"), ("a", "p:99")], "doc_id string, ref string"))
    assert (there.count(), values(missing, "ref")) == (1, [("p:99",)])


def test_exports(spark, found):
    text = export.markdown(main(found)).head().text
    assert text.startswith("# Introduction\n\nThe plain green owl\n\nbold now\n\n| owl cell | other |\n| --- | --- |\n\n")
    assert export.plain(main(found)).head().text.startswith("Introduction\n============\n\n")
    sections = structure.sections(main(found), F.col("style").startswith("Heading"))
    assert 'heading: "Introduction"' in export.outline_yaml(sections).head().text
    assert '[ref=tbl:0/row:0/cell:0]' in export.tree_yaml(nodes.tree(found("paragraphs"))).head().text
    assert values(spark.range(1).select(export.quoted(F.lit('a"b\\\n')).alias("q")), "q") == [('"a\\"b\\\\\\n"',)]
    rows = spark.createDataFrame([(1, "x", 2), (1, "y", None)], "k long, name string, v int")
    table = export.table_from(rows, ["name", "v"], "k", ["name"])
    assert [t for _, _, t in sorted(values(table, "row_idx", "cell_idx", "text"))] == ["name", "v", "x", "2", "y", ""]


def test_notes(spark, found):
    notes, refs = found("notes"), found("note_refs")
    new = spark.createDataFrame([("a", "footnote", 0, "first")], "doc_id string, note_kind string, p_idx int, text string")
    more, more_refs = E.insert_notes(notes, refs, new)
    assert ("4", "first") in values(more, "note_id", "text")
    gone = spark.createDataFrame([("a", "footnote", "3")], "doc_id string, note_kind string, note_id string")
    left, left_refs = E.delete_notes(more, more_refs, gone)
    assert sorted(values(left.where("w_type is null"), "note_id", "text")) == [("1", "first"), ("2", "used")]
    assert sorted(values(left_refs, "note_id", "p_idx")) == [("1", 0), ("2", 1)]
    edit = gone.withColumn("note_id", F.lit("2")).withColumn("text", F.lit("new"))
    assert ("2", "{--used--}{++new++}") in values(E.edit_notes(notes, edit, track=True), "note_id", "text")


def test_links_and_bookmarks(spark, found):
    ids = {r.text: r.link_idx for r in found("hyperlinks").collect()}
    edit = spark.createDataFrame([("a", ids["out"], "http://new"), ("a", ids["up"], "there")], "doc_id string, link_idx int, value string")
    assert ("rId9", "http://new") in values(E.link_targets(found("hyperlinks"), found("relationships"), edit), "rel_id", "target")
    anchors = dict(values(E.link_anchors(found("hyperlinks"), edit), "text", "anchor"))
    assert anchors["up"] == "there" and anchors["out"] is None and anchors["lost"] == "nowhere"
    assert E.remove_links(found("hyperlinks"), edit).count() == 1
    new = spark.createDataFrame([("a", "good", 1, "x"), ("a", "intro", 1, "x"), ("a", "1bad", 1, "x"), ("a", "good", 2, "x")], "doc_id string, name string, p_idx int, preview string")
    marks, refused = E.create_bookmarks(found("bookmarks"), new)
    assert sorted(values(marks, "name", "bookmark_id")) == [("good", "2"), ("intro", "1")] and refused.count() == 3
    code = spark.range(1).select(E.reference_code(F.lit("intro"), "page").alias("a"), E.reference_code(F.lit("intro"), "number", linked=False).alias("b")).head()
    assert (code.a, code.b) == ("PAGEREF intro \\h", "REF intro \\r")


def test_comments(spark, found):
    new = spark.createDataFrame([("a", 1, "owl", "Ann Lee", "look")], "doc_id string, p_idx int, marked_text string, author string, text string")
    comments, ranges = E.add_comments(found("comments"), found("comment_ranges"), new)
    assert ("2", "AL") in values(comments, "comment_id", "initials") and ranges.count() == 2
    one = spark.createDataFrame([("a", "0")], "doc_id string, comment_id string")
    left, _ = E.delete_comments(comments, ranges, one)
    assert left.count() == 2 and E.delete_comments(comments, ranges)[0].count() == 0
    assert ("A1", False) in values(E.resolve_comments(found("comment_ex"), found("comments"), one, done=False), "para_id", "done")


def test_contents_headers_styles_formats(spark, found):
    assert values(E.contents(main(found)), "entry_idx", "level", "title") == [(0, 1, "Introduction")]
    assert ("{--Top--}{++New++}",) in values(E.replace_in_parts(found("paragraphs"), "header", "Top", "New"), "text")
    wanted = spark.createDataFrame([("a", "Quote", "paragraph", "Quote")] * 1, "doc_id string, style_id string, style_type string, name string")
    assert E.ensure_styles(E.ensure_styles(found("styles"), wanted), wanted).count() == 1
    runs = found("runs").where("part = 'word/document.xml'")
    hit = spark.createDataFrame([("a", 1, 0, 1)], "doc_id string, p_idx int, run_start int, run_end int")
    done = E.format_runs(runs, hit, bold=True)
    assert done.where("p_idx = 1 and bold").count() == 3
    source = spark.createDataFrame([("a", None, True, "FF0000")], "doc_id string, bold boolean, italic boolean, color string")
    assert values(E.copy_format(runs, source, hit).where("p_idx = 1 and r_idx = 0"), "bold", "italic", "color") == [(None, True, "FF0000")]


def test_validation(spark, found):
    breaches = validation.breaches(found("runs"), found("changes"), found("errors"), found("bookmarks"))
    docs = spark.createDataFrame([("a",), ("broken",)], "doc_id string")
    assert sorted(values(validation.verdicts(docs, breaches), "doc_id", "is_valid")) == [("a", True), ("broken", False)]
    old = spark.createDataFrame([("a", 1, "The plain owl"), ("b", 0, "x")], "doc_id string, p_idx int, text string")
    rows = [("a", 1, 0, "The plain ", "", False, False, None), ("a", 1, 1, "green ", "", True, False, "Al"), ("a", 1, 2, "owl", "", False, False, None), ("b", 0, 0, "y", "", False, False, None)]
    new = spark.createDataFrame(rows, "doc_id string, p_idx int, r_idx int, text string, del_text string, in_ins boolean, in_del boolean, author string")
    assert sorted(values(validation.only_tracked(old, new, "Al"), "doc_id", "same")) == [("a", True), ("b", False)]
