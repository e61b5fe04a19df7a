import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkloom.functions import markdown
from inkloom.operators import links


def test_segments():
    got = markdown.parse_segments("a **b *c* d** ~~e~~ ++f++\nlone * star \\*kept\\*")
    names = lambda s: [k for k in ("bold", "italic", "strike", "underline") if s[k]]
    assert [(s["text"], names(s)) for s in got if not s["line_break"]][:5] == [("a ", []), ("b ", ["bold"]), ("c", ["bold", "italic"]), (" d", ["bold"]), (" ", [])]
    assert got[-1]["text"] == "lone * star *kept*" and sum(s["line_break"] for s in got) == 1


@settings(max_examples=200, deadline=None)
@given(st.text("ab *~+", max_size=20))
def test_text_without_marks_stays(text):
    out = "".join(s["text"] for s in markdown.parse_segments(text))
    assert [c for c in out if c in "ab "] == [c for c in text if c in "ab "]


def test_columns(spark):
    df = spark.createDataFrame([("x < **y**\nz",), ("plain",), ("",), (None,)], "t string")
    got = [r.h for r in df.select(markdown.html(markdown.segments(F.col("t"))).alias("h")).collect()]
    assert got == ["x &lt; <b>y</b><br/>z", "plain", "", None]


def test_json(spark):
    rows = spark.createDataFrame([("a", 1, "t", None, "http://x", "external"), ("a", 0, "u", "m", None, "internal")], "doc_id string, link_idx int, text string, anchor string, target string, status string")
    assert [len(json.loads(links.links_json(rows).head().links)[k]) for k in ("external", "internal", "broken")] == [1, 1, 0]
    refs = spark.createDataFrame([("a", 0, "REF", "m", "x")], "doc_id string, field_idx int, field_type string, target string, display string")
    assert json.loads(links.references_json(refs).head().references)[0]["target"] == "m"
