"""Packages built in memory: read, edited, written and read again."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkloom.operators import changes, links, search, structure
from inkloom.sources import docx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml"'
BODY = """
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:bookmarkStart w:id="1" w:name="intro"/><w:r><w:t>Introduction</w:t></w:r><w:bookmarkEnd w:id="1"/></w:p>
<w:p><w:commentRangeStart w:id="0"/><w:r><w:t>The plain </w:t></w:r><w:ins w:id="2" w:author="Mira" w:date="2024-01-02T03:04:05Z"><w:r><w:t>green </w:t></w:r></w:ins><w:del w:id="3" w:author="Jonas"><w:r><w:delText>red </w:delText></w:r></w:del><w:r><w:rPr><w:b/></w:rPr><w:t>owl</w:t></w:r><w:commentRangeEnd w:id="0"/><w:r><w:footnoteReference w:id="2"/></w:r></w:p>
<w:p><w:r><w:rPr><w:b/><w:rPrChange w:id="4" w:author="Ines"><w:rPr><w:i/></w:rPr></w:rPrChange></w:rPr><w:t>bold now</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>owl cell</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>other</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:hyperlink w:anchor="intro"><w:r><w:t>up</w:t></w:r></w:hyperlink><w:hyperlink r:id="rId9"><w:r><w:t>out</w:t></w:r></w:hyperlink><w:hyperlink w:anchor="nowhere"><w:r><w:t>lost</w:t></w:r></w:hyperlink>
<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> REF intro \\h </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>Introduction</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>"""
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="main"/></Types>',
    "word/document.xml": f"<w:document {W}><w:body>{BODY}</w:body></w:document>",
    "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Type="x/hyperlink" Target="http://a.b" TargetMode="External"/><Relationship Id="rId1" Type="x/footnotes" Target="footnotes.xml"/><Relationship Id="rId2" Type="x/header" Target="header1.xml"/><Relationship Id="rId3" Type="x/image" Target="media/gone.png"/></Relationships>',
    "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t> used</w:t></w:r></w:p></w:footnote><w:footnote w:id="3"><w:p><w:r><w:t>unused</w:t></w:r></w:p></w:footnote></w:footnotes>',
    "word/comments.xml": f'<w:comments {W}><w:comment w:id="0" w:author="Olga" w:initials="D"><w:p w14:paraId="A1"><w:r><w:t>why?</w:t></w:r></w:p></w:comment><w:comment w:id="1" w:author="Petr"><w:p w14:paraId="A2"><w:r><w:t>because</w:t></w:r></w:p></w:comment></w:comments>',
    "word/commentsExtended.xml": f'<w15:commentsEx {W}><w15:commentEx w15:paraId="A1" w15:done="1"/><w15:commentEx w15:paraId="A2" w15:paraIdParent="A1"/></w15:commentsEx>',
    "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>",
}


def package(parts=PARTS):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return data.getvalue()


@pytest.fixture(scope="module")
def found(spark):
    rows = [("a", package()), ("broken", b"no zip"), ("bad", package({"word/document.xml": "<w:p>"})), ("none", None)]
    df = docx.entities(spark.createDataFrame(rows, "doc_id string, content binary")).cache()
    yield lambda kind: docx.entity(df, kind)
    df.unpersist()


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_paragraphs(found):
    got = values(found("paragraphs").where("doc_id = 'a' and part = 'word/document.xml'").orderBy("p_idx"), "p_idx", "body_p_idx", "style", "location", "text", "text_search")
    assert got[0] == (0, 0, "Heading1", "body", "Introduction", "Introduction")
    assert got[1] == (1, 1, None, "body", "The plain green owl", "The plain green red owl")
    assert got[3][:4] == (3, None, None, "table:0:row:0:cell:0") and got[5][:2] == (5, 3)
    assert values(found("paragraphs").where("location = 'header'"), "text") == [("Top",)]
    assert {r.doc_id for r in found("errors").collect()} == {"broken", "bad", "none"}


def test_changes_and_decisions(found):
    ch = found("changes")
    assert values(changes.listing(ch).orderBy("rank"), "change_type", "author", "text") == [("insertion", "Mira", "green "), ("deletion", "Jonas", "red "), ("format_run", "Ines", "")]
    assert values(changes.statistics(ch), "insertions", "deletions", "formats", "total") == [(1, 1, 1, 3)]
    assert values(ch.where("author = 'Mira'").select(changes.parsed_date(F.col("date")).cast("string").alias("d")), "d") == [("2024-01-02 03:04:05",)]
    runs = found("runs").where("p_idx in (1, 2) and part = 'word/document.xml'")
    line = lambda df: values(df.where("p_idx = 1").groupBy("p_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_idx", "text"))), lambda x: x["text"]), "").alias("t")), "t")
    assert line(changes.decided(runs, True)) == [("The plain green owl",)]
    assert line(changes.decided(runs, False)) == [("The plain red owl",)]
    assert values(changes.decided(runs, False).where("text = 'bold now'"), "bold", "italic") == [(True, True)]


def test_comments_notes_links(found):
    c = links.comments_with_ranges(found("comments"), found("comment_ranges"), found("comment_ex"))
    assert sorted(values(c, "comment_id", "marked_text", "resolved", "parent_id")) == [("0", "The plain green owl", True, None), ("1", None, False, "0")]
    assert values(links.threads(c).where("n_replies > 0"), "comment_id", "replies") == [("0", ["1"])]
    assert values(links.orphan_notes(found("notes"), found("note_refs")), "note_id", "text") == [("3", "unused")]
    assert values(links.renumbered(found("notes"), found("note_refs")), "note_id", "new_id") == [("2", 1)]
    marks, rels = found("bookmarks"), found("relationships")
    got = links.resolved_links(found("hyperlinks"), rels, marks)
    assert sorted(values(got, "text", "status")) == [("lost", "broken"), ("out", "external"), ("up", "internal")]
    xrefs = links.cross_references(found("fields"))
    assert values(xrefs, "field_type", "target", "display") == [("REF", "intro", "Introduction")]
    assert values(links.validated(found("hyperlinks"), xrefs, marks), "broken_links", "broken_xrefs", "orphan_bookmarks", "is_valid") == [(1, 0, 0, False)]
    assert ("word/media/gone.png", "missing") in values(links.unmatched_parts(found("parts"), rels).where("doc_id = 'a'"), "part", "problem")
    types = values(links.content_type(found("parts"), found("content_types")).where("doc_id = 'a' and part in ('word/document.xml', 'word/comments.xml')"), "part", "content_type")
    assert dict(types) == {"word/document.xml": "main", "word/comments.xml": "application/xml"}
    kinds = values(links.reference_targets(marks, found("paragraphs"), found("fields"), found("notes")).groupBy("kind").count(), "kind", "count")
    assert dict(kinds) == {"bookmark": 1, "heading": 1, "footnote": 2}
    assert values(links.headers_of(found("headers_footers"), rels), "text") == [("Top",)]


def test_search_over_runs(found):
    p = found("paragraphs").where("doc_id = 'a' and part = 'word/document.xml'")
    hits = search.find_all(p.select("doc_id", "p_idx", "location", "text"), "owl")
    assert sorted(values(hits, "p_idx", "pos", "location")) == [(1, 16, "body"), (3, 0, "table:0:row:0:cell:0")]
    assert values(search.find_all(p.select("doc_id", "p_idx", "location", "text"), "owl", scope={"location": "tables"}), "p_idx") == [(3,)]
    wide = search.find_all(p.select("doc_id", "p_idx", "text"), "plain green owl")
    touched = structure.runs_of_matches(wide, found("runs").where("part = 'word/document.xml'"))
    assert values(touched, "run_start", "run_end", "offset_start", "offset_end") == [(0, 3, 4, 3)]


def test_written_package_reads_back(spark, found, tmp_path):
    p = found("paragraphs").where("doc_id = 'a' and part = 'word/document.xml'")
    runs = found("runs").where("part = 'word/document.xml'")
    out = docx.zipped(docx.document_xml(runs, p))
    again = docx.entities(out)
    assert sorted(values(docx.entity(again, "paragraphs"), "p_idx", "style", "text")) == sorted(values(p, "p_idx", "style", "text"))
    assert sorted(values(docx.entity(again, "changes"), "change_type", "text")) == [("deletion", "red "), ("insertion", "green ")]
    path = tmp_path / "x.docx"
    path.write_bytes(bytes(out.head().content))
    assert docx.packages(spark, str(tmp_path)).count() == 1
