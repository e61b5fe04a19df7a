"""Paragraph properties: merged, compared, changed as tracked rows, saved and read back."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkloom.operators import changes
from inkloom.operators import formatting as G
from inkloom.sources import docx, parts

from .test_documents import PARTS, W, package

TAB = {"position": 1.0, "kind": "left", "leader": None}


def columns(prefix):
    return {c: F.col(f"{prefix}.{c}") for c in G.PROPERTIES}


def test_merge_and_diff(spark):
    kind = ", ".join(f"{c}: {k}" for c, k in G.PROPERTIES.items())
    base = {"alignment": "left", "spacing_before": 6.0, "indent_left": 0.5, "tab_stops": [TAB, {"position": 2.0, "kind": "right", "leader": "dot"}, {"position": 3.0, "kind": "left", "leader": None}]}
    update = {"alignment": "center", "spacing_after": 3.0, "tab_stops": [{"position": 3.0, "kind": "clear", "leader": None}, {"position": 1.0, "kind": "center", "leader": None}, {"position": 0.5, "kind": "left", "leader": None}]}
    df = spark.createDataFrame([(base, update), ({}, {}), (base, {})], f"a struct<{kind}>, b struct<{kind}>")
    got = df.select(F.struct(*(v.alias(c) for c, v in G.merged(columns("a"), columns("b")).items())).alias("m"), G.differing(columns("a"), columns("b")).alias("d")).collect()
    m = got[0].m.asDict(True)
    assert (m["alignment"], m["spacing_before"], m["spacing_after"], m["indent_left"]) == ("center", 6.0, 3.0, 0.5)
    assert [(t["position"], t["kind"]) for t in m["tab_stops"]] == [(0.5, "left"), (1.0, "center"), (2.0, "right")]
    assert {k: (v.old, v.new) for k, v in got[0].d.items() if k != "tab_stops"} == {"alignment": ("left", "center"), "spacing_before": ("6.0", None), "spacing_after": (None, "3.0"), "indent_left": ("0.5", None)}
    assert all(v is None for v in got[1].m) and got[1].d == {} and got[2].m.asDict(True)["tab_stops"] == base["tab_stops"]


EDITS = "doc_id string, seq int, containing string, starting_with string, ending_with string, index int, alignment string, spacing_after double, line_spacing double, indent_left double, tab_stops array<struct<position: double, kind: string, leader: string>>, track boolean"


def edit(doc_id, seq, **given):
    names = [c.strip().split(" ")[0] for c in EDITS.replace("position: double, kind: string, leader: string", "").split(",")[2:]]
    assert set(given) <= set(names)
    return (doc_id, seq, *(given.get(n) for n in names))


TODO = [
    edit("a", 1, containing="plain", alignment="center", spacing_after=12.0),
    edit("a", 2, starting_with="Intro", indent_left=0.5, track=False),
    edit("a", 3, containing="plain", alignment="justify", tab_stops=[TAB, {"position": 2.5, "kind": "right", "leader": "dot"}]),
    edit("a", 4, index=2, alignment="left"),  # as it was
    edit("a", 5, containing="nowhere", alignment="left"),
    edit("a", 6, alignment="left"),
    edit("a", 7, index=0),
    edit("a", 8, index=0, alignment="slanted"),
    edit("a", 9, starting_with="owl", ending_with="cell", line_spacing=1.5),
    edit("gone", 1, index=0, alignment="left"),
]


@pytest.fixture(scope="module")
def packages(spark):
    body = PARTS["word/document.xml"].replace("<w:p><w:r><w:rPr><w:b/><w:rPrChange", '<w:p><w:pPr><w:keepNext/><w:spacing w:before="120" w:after="60"/><w:jc w:val="left"/><w:rPr><w:b/></w:rPr></w:pPr><w:r><w:rPr><w:b/><w:rPrChange')
    body = body.replace("<w:p><w:commentRangeStart", '<w:p><w:pPr><w:keepNext/><w:spacing w:before="120" w:after="60"/><w:outlineLvl w:val="3"/><w:rPr><w:b/></w:rPr></w:pPr><w:commentRangeStart')
    return spark.createDataFrame([("a", package(PARTS | {"word/document.xml": body})), ("b", package())], "doc_id string, content binary")


def test_formatted_paragraphs_are_saved(spark, packages):
    found = docx.entities(packages).cache()
    entity = lambda df, kind: docx.entity(df, kind)
    had = {r.p_idx: r for r in entity(found, "paragraph_properties").collect()}
    assert (had[1].spacing_before, had[1].spacing_after, had[1].alignment) == (6.0, 3.0, None) and had[2].alignment == "left"
    formatted, made, results = G.format_paragraphs(entity(found, "paragraphs"), entity(found, "paragraph_properties"), spark.createDataFrame(TODO, EDITS), changes=entity(found, "changes"))
    assert {(r.doc_id, r.seq): (r.success, r.message) for r in results.collect()} == {
        ("a", 1): (True, "formatted 1"), ("a", 2): (True, "formatted 1"), ("a", 3): (True, "formatted 1"), ("a", 4): (True, "nothing to change"), ("a", 5): (False, "no such paragraph: nowhere"),
        ("a", 6): (False, "give containing, starting_with, ending_with or index"), ("a", 7): (False, "no property given"), ("a", 8): (False, "unknown alignment: slanted"), ("a", 9): (True, "formatted 1"), ("gone", 1): (False, "no such paragraph: 0"),
    }
    assert sorted((r.seq, r.change_id, r.p_idx) for r in made.collect()) == [(1, "5", 1), (3, "6", 1), (9, "7", 3)]
    saved = parts.patched(packages, G.saved(formatted))
    again = docx.entities(saved).cache()
    now = {r.p_idx: r for r in entity(again, "paragraph_properties").where("doc_id = 'a'").collect()}
    assert (now[1].alignment, now[1].spacing_before, now[1].spacing_after, [(t.position, t.kind, t.leader) for t in now[1].tab_stops]) == ("justify", 6.0, 12.0, [(1.0, "left", None), (2.5, "right", "dot")])
    assert now[0].indent_left == 0.5 and now[3].line_spacing == 1.5 and now[2] == had[2]
    kinds = {(r.change_id, r.p_idx) for r in entity(again, "changes").where("change_type = 'format_paragraph'").collect()}
    assert kinds == {("6", 1), ("7", 3)}
    out = {r.doc_id: bytes(r.content) for r in saved.collect()}
    xml = zipfile.ZipFile(io.BytesIO(out["a"])).read("word/document.xml").decode()
    one = xml.split("<w:p>")[2]
    assert [t for t in ("<w:keepNext", "<w:tabs", "<w:spacing", "<w:jc", "<w:outlineLvl", "<w:rPr", "<w:pPrChange") if t in one] == ["<w:keepNext", "<w:tabs", "<w:spacing", "<w:jc", "<w:outlineLvl", "<w:rPr", "<w:pPrChange"]
    places = [one.index(t) for t in ("<w:keepNext", "<w:tabs", "<w:spacing", "<w:jc", "<w:outlineLvl", "<w:rPr", "<w:pPrChange")]
    assert places == sorted(places) and '<w:spacing w:before="120" w:after="60"' in one[places[-1] :] and "<w:jc" not in one[places[-1] :].split("</w:pPrChange>")[0]
    assert changes.statistics(entity(again, "changes").where("doc_id = 'a'")).head().total == 5
    assert out["b"] == {r.doc_id: bytes(r.content) for r in packages.collect()}["b"] and W
    found.unpersist()
    again.unpersist()
