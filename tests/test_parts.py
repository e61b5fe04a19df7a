"""Links, pictures and comments saved into packages and read back."""

import io
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from inkloom.operators import by_ref, links, tracked
from inkloom.plans import block_queries
from inkloom.sources import docx, parts

from .test_documents import PARTS, package

PNG = b"\x89PNG not really"


@pytest.fixture(scope="module")
def packages(spark):
    return spark.createDataFrame([("a", package()), ("b", package()), ("broken", b"x"), ("none", None)], "doc_id string, content binary")


@pytest.fixture(scope="module")
def found(spark, packages):
    df = docx.entities(packages).cache()
    yield lambda kind: docx.entity(df, kind)
    df.unpersist()


def test_links_and_pictures(spark, packages, found):
    todo = spark.createDataFrame(
        [
            ("a", 1, "see <here>", "The plain ", 'http://x.y/?a=1&b="2"', None, None), ("a", 2, "inner", "bold n", None, "intro", None), ("a", 3, "top link", "To", "http://head", None, "headers"), ("a", 4, "note link", " used", "http://note", None, "footnotes"),
            ("a", 5, "x", "nowhere", "http://x", None, None), ("a", 6, "x", "o", "http://x", None, None), ("a", 7, "x", "owl", "u", "v", None), ("a", 8, "in a change", "gre", None, "intro", None),
        ],
        "doc_id string, seq int, text string, after string, url string, anchor string, scope string",
    )
    put, said = parts.links(found("paragraphs"), found("relationships"), todo)
    assert {r.seq: r.success for r in said.collect()} == {i: i not in (5, 6, 7) for i in range(1, 9)}
    pictures = spark.createDataFrame([("a", 1, "a <b>", "PNG", PNG, 1.5, 1.0, "owl cell", True), ("a", 2, "plain", "jpg", b"jpg", 2.0, 1.0, "bold", False), ("b", 1, "c", "exe", b"", 1.0, 1.0, "bold", False)], "doc_id string, seq int, name string, extension string, content binary, width_inches double, height_inches double, after string, track boolean")
    drawn, told = parts.images(found("paragraphs"), found("relationships").unionByName(put.where("kind = 'rel'").select("doc_id", F.col("part").alias("source_part"), "rel_id", "rel_type", "target", "mode")), found("parts"), pictures, tracked.top_ids(found("changes")))
    assert {(r.doc_id, r.seq): r.success for r in told.collect()} == {("a", 1): True, ("a", 2): True, ("b", 1): False}
    saved = parts.patched(packages, put, drawn)
    out = {r.doc_id: r.content for r in saved.collect()}
    was = {r.doc_id: r.content for r in packages.collect()}
    assert out["b"] == was["b"] and bytes(out["broken"]) == b"x" and out["none"] is None
    new = zipfile.ZipFile(io.BytesIO(bytes(out["a"])))
    assert new.read("word/media/image1.png") == PNG and new.read("word/media/image2.jpg") == b"jpg" and new.read("word/comments.xml").decode() == PARTS["word/comments.xml"]
    again = docx.entities(saved.where("doc_id = 'a'")).cache()
    entity = lambda kind: docx.entity(again, kind)
    assert entity("errors").count() == 0 and docx.problems(saved.where("doc_id = 'a'")).count() == 0
    text = {(r.part, r.p_idx): r.text for r in entity("paragraphs").collect()}
    assert text[tracked.BODY, 1] == "The plain see <here>green in a changeowl" and text[tracked.BODY, 2] == "bold ninnerow"
    assert text["word/header1.xml", 0] == "Totop linkp" and text["word/footnotes.xml", 1] == " usednote link"
    kept = {r.text: (r.part, r.anchor, r.rel_id) for r in entity("hyperlinks").collect()}
    targets = {(r.source_part, r.rel_id): (r.target, r.mode) for r in entity("relationships").collect()}
    assert kept["inner"][1] == "intro" and targets[tracked.BODY, kept["see <here>"][2]] == ('http://x.y/?a=1&b="2"', "External")
    assert targets["word/header1.xml", kept["top link"][2]][0] == "http://head" and targets["word/footnotes.xml", kept["note link"][2]][0] == "http://note"
    assert len({*targets}) == entity("relationships").count()
    resolved = {r.text: r.status for r in links.resolved_links(entity("hyperlinks").where("part = 'word/document.xml'"), entity("relationships").where("source_part = 'word/document.xml'"), entity("bookmarks")).collect()}
    assert resolved["inner"] == "internal" and resolved["see <here>"] == "external"
    pics = {r.name: (r.p_idx, r.width, r.height, targets[r.part, r.rel_id][0]) for r in entity("images").collect()}
    assert pics == {"a <b>": (3, 1371600, 914400, "media/image1.png"), "plain": (2, 1828800, 914400, "media/image2.jpg")}
    types = {r.part: r.content_type for r in links.content_type(entity("parts"), entity("content_types")).collect()}
    assert types["word/media/image1.png"] == "image/png" and types["word/media/image2.jpg"] == "image/jpeg"
    assert [(r.change_id, r.change_type) for r in entity("changes").where("p_idx = 3").collect()] == [("5", "insertion")]
    again.unpersist()


def test_comments_are_saved(spark, packages, found):
    bare = {k: v for k, v in PARTS.items() if not k.startswith("word/comments")}
    bare["word/document.xml"] = bare["word/document.xml"].replace('<w:commentRangeStart w:id="0"/>', "").replace('<w:commentRangeEnd w:id="0"/>', "")
    both = packages.where("doc_id = 'a'").unionByName(spark.createDataFrame([("bare", package(bare))], "doc_id string, content binary"))
    read = docx.entities(both).cache()
    entity = lambda df, kind: docx.entity(df, kind)
    before, ranges = entity(read, "comments"), entity(read, "comment_ranges").drop("part")
    todo = spark.createDataFrame([(d, i, ref, text, 'O "M" Q') for d in ("a", "bare") for i, ref, text in ((1, "tbl:0", "why & how?"), (2, "p:0", "first"))], "doc_id string, seq int, ref string, text string, author string")
    after, places, _ = by_ref.comment(entity(read, "paragraphs"), before, ranges, todo)
    again = docx.entities(parts.patched(both, parts.comments(before, after, places, entity(read, "relationships")))).cache()
    got = {(r.doc_id, r.comment_id): (r.text, r.author) for r in entity(again, "comments").collect()}
    assert got[("a", "0")][0] == "why?" and len(got) == 6 and set(got.values()) >= {("why & how?", 'O "M" Q'), ("first", 'O "M" Q')}
    spots = {(r.doc_id, r.comment_id): (r.start_p_idx, r.end_p_idx, r.marked_text) for r in entity(again, "comment_ranges").collect()}
    by_text = {(d, got[d, c][0]): v for (d, c), v in spots.items()}
    for d in ("a", "bare"):
        assert by_text[d, "why & how?"] == (3, 4, "owl cellother") and by_text[d, "first"] == (0, 0, "Introduction")
    assert {r.doc_id for r in entity(again, "relationships").where("rel_type = 'comments'").collect()} >= {"bare"} and entity(again, "errors").count() == 0
    read.unpersist()
    again.unpersist()


def test_references_are_saved(spark, packages, found):
    """A field's runs stand together, and what is edited behind it leaves them so."""
    rows = [
        ("a", 1, "intro", "The p", None, None, None), ("a", 2, "intro", "bold n", None, "page", None), ("a", 3, "intro", "owl c", "NOTEREF", "above_below", False), ("a", 4, "nothere", "plain", None, None, None),
        ("a", 5, "intro", "plain", "SEQ", None, None), ("a", 6, "intro", "plain", None, "colour", None), ("a", 7, "intro", "absent", None, None, None),
    ]
    edits = spark.createDataFrame(rows, "doc_id string, seq int, target string, after string, kind string, display string, linked boolean")
    put, said = parts.references(found("paragraphs"), found("bookmarks"), edits)
    assert {r.seq: r.success for r in said.collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}
    saved = parts.patched(packages, put).where("doc_id = 'a'")
    again = docx.entities(saved).cache()
    got = {(r.p_idx, r.code, r.display, r.dirty) for r in docx.entity(again, "fields").where("part = 'word/document.xml'").collect()}
    assert got == {(1, "REF intro \\h", "Introduction", True), (2, "PAGEREF intro \\h", "?", True), (3, "NOTEREF intro \\p", "?", True), (5, "REF intro \\h", "Introduction", False)}
    runs = docx.entity(again, "runs")
    todo = spark.createDataFrame([("a", 1, "replace_tracked", "lain", "LAIN")], "doc_id string, seq int, type string, find string, replace string")
    after = tracked.apply(runs, todo)[0]
    last = docx.entities(docx.saved(saved, tracked.changed_paragraphs(after, runs)))
    fields = {(r.p_idx, r.code, r.display) for r in docx.entity(last, "fields").where("part = 'word/document.xml'").collect()}
    assert fields == {f[:3] for f in got}
    text = {r.p_idx: r.text for r in docx.entity(last, "paragraphs").where("part = 'word/document.xml'").collect()}
    assert text[1] == "The pIntroductionLAIN green owl"
    again.unpersist()


def test_some_kinds_alone(packages, found):
    """Entities of some kinds are those of a whole reading, a package that can't be read among them."""
    for kinds in (("comments", "comment_ranges"), ("paragraphs",), ("relationships", "errors"), ("content_types", "styles", "fields", "images"), ("runs", "changes", "notes")):
        some = {(r.doc_id, r.kind, r.row) for r in docx.entities(packages, *kinds).collect()}
        assert some == {(r.doc_id, r.kind, r.row) for r in docx.entities(packages).collect() if r.kind in kinds} and some
    with pytest.raises(ValueError):
        docx.entities(packages, "paragraph")


def test_packages_of_queries_are_read_once(spark, sf_dir):
    """Each use of packages and of their entities reads what was written, and doesn't zip and parse again."""
    for df in block_queries._packages(spark, sf_dir, "comments", "paragraphs"):
        assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("body", [b'<a xmlns="u" xmlns:w="v>w"><b/></a>', b'<!-- <b x=\'> xmlns --><a xmlns:w="v"><b xmlns:q="r"/></a>', '<?xml version="1.0" encoding="UTF-16"?><a xmlns:w="v"/>'.encode("utf-16"), b"<a/>"])
def test_namespaces(body):
    assert list(docx.namespaces(body)) == [found for _, found in ET.iterparse(io.BytesIO(body), ["start-ns"])]
