"""Operators that SQL doesn't cover, against plain Python; and every query against its SQL."""

import datetime
import decimal
import re
from difflib import SequenceMatcher

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkloom.functions import critic
from inkloom.functions import text as T
from inkloom.operators import diff, edits, search, structure
from inkloom.plans import block_queries, edit_queries, lookup_queries  # noqa: F401  they register their queries
from inkloom.plans.queries import QUERIES, SQL, _link_tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return f"{v:.8g}" if isinstance(v, float) else f"{float(v):.8g}" if isinstance(v, decimal.Decimal) else repr(v.isoformat() if isinstance(v, datetime.datetime) else v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(SQL[name])
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    got = df.select(*want.columns).collect()
    assert sorted([plain(v) for v in r] for r in got) == sorted([plain(v) for v in r] for r in want.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_minimal_hunks_take_every_line(spark, tmp_path):
    texts = {1: "\n".join(["in the end", "same", "on the way to the top", "", " the ", "at the last"]), 2: "over the hill", 3: "nothing", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(d, i, *h.values()) for d, t in texts.items() for i, x in enumerate((t or "").split("\n")) for h in diff.text_hunks(x, x.replace(" the ", " that ")) or []]
    got = QUERIES["minimal_hunks"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want) and {r[1] for r in want} == {0, 2, 4, 5}


def test_links_reach_words_anywhere(spark, tmp_path):
    far, long = "far", "w" * 50
    html = f'<p>{"word " * 20}{far} {long}</p><a href="#{far}">x</a><a href="#{long}">y</a><a href="#none">z</a>'
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found, _, marks = _link_tables(spark, str(tmp_path))
    assert [r.anchor for r in found.orderBy("link_idx").collect()] == [far, long, "none"] and {far, long} <= {r.name for r in marks.collect()}
    assert [tuple(r) for r in QUERIES["references_validated"](spark, str(tmp_path)).collect()] == [(1, 1, 1, 1, False)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=20), st.text("abcd", max_size=20))
def test_ratio(a, b):
    want = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
    assert abs(search.ratio(a, b) - want) < 1e-12


@settings(max_examples=100, deadline=None)
@given(st.text("abcde", min_size=4, max_size=9), st.text("abcde", max_size=40), st.sampled_from([0.6, 0.75, 0.85, 0.95]))
def test_fuzzy_windows_lose_nothing(find, text, threshold):
    every = [(at, n) for n in range(max(1, int(len(find) * 0.7)), int(len(find) * 1.3) + 1) for at in range(len(text) - n + 1) if search.ratio(find, text[at : at + n]) >= threshold]
    got = search.fuzzy_windows([find[::-1], text, text], find, threshold)[2]
    # Every similar window is kept or overlaps one that is at least as similar.
    assert all(any(a < at + n and at < a + k and s >= search.ratio(find, text[at : at + n]) for a, k, s in got) for at, n in every)
    assert all((a, k) in every for a, k, _ in got)


def test_fuzzy(spark):
    p = spark.createDataFrame([(1, 0, "the production prodcts here"), (1, 1, "nothing"), (2, 0, None)], "doc_id long, p_idx int, text string")
    got = search.find_all(p, "production products", fuzzy={"threshold": 0.9}).collect()
    assert [(r.p_idx, r.found) for r in got] == [(0, "production prodcts")]
    best = search.similar_texts(p, "producton products", k=1).collect()
    assert [r.found for r in best] == ["production prodcts"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "cc", ",", "-", "x'y"]), max_size=14).map("".join), st.lists(st.sampled_from(["a", "b", " ", "cc", ",", "-", "x'y"]), max_size=14).map("".join))
def test_hunks_rebuild(a, b):
    found = diff.text_hunks(a, b)
    if found is None:
        return
    out, at = "", 0
    for h in found:
        assert a[h["start"] : h["end"]] == h["old"]
        out, at = out + a[at : h["start"]] + h["new"], h["end"]
    out += a[at:]
    assert re.sub(r"\s+", "", out) == re.sub(r"\s+", "", b)


def test_compare(spark):
    old = ["one", "two", "three", "four", "five"]
    new = ["one", "2", "three", "inserted", "four"]
    df = lambda xs: spark.createDataFrame([(7, i, t) for i, t in enumerate(xs)] + [(8, 0, "same")], "pair_id long, p_idx int, text string")
    ops = diff.compare(df(old), df(new))
    want = [o for o in SequenceMatcher(None, old, new).get_opcodes() if o[0] != "equal"]
    assert [tuple(r)[2:] for r in ops.orderBy("op_idx").collect()] == want
    stats = diff.comparison_stats(diff.compared_changes(ops, df(old), df(new))).collect()
    assert [tuple(r) for r in stats] == [(7, 1, 1, 1, 3)]
    one = spark.createDataFrame([("the cat sat", "the dog sat")], "old string, new string").withColumn("hunks", diff.hunks("old", "new"))
    assert one.select(diff.marked_up().alias("t")).head().t == "the {--cat--}{++dog++} sat"


def test_batch(spark):
    p = spark.createDataFrame([(1, 0, "Heading1", "Terms"), (1, 1, None, "Pay the fee, the whole fee."), (1, 2, "Heading1", "Other"), (1, 3, None, "drop me"), (2, 0, None, "untouched")], "doc_id long, p_idx int, style string, text string")
    names = "doc_id long, seq int, type string, find string, replace string, text string, after string, before string, occurrence string, regex boolean, track boolean"
    row = lambda seq, kind, **x: (1, seq, kind, *(x.get(k) for k in ("find", "replace", "text", "after", "before", "occurrence", "regex", "track")))
    todo = [
        row(1, "replace", find="fee", replace="price", occurrence="all"), row(2, "insert_tracked", text=" now", after="Pay"), row(3, "delete_section", text="drop me"),
        row(4, "replace", find="fee", replace="x"), row(5, "replace", find=r"the (\w+)", replace=r"\1", regex=True, occurrence="2"), row(6, "insert_paragraph", text="New line", after="whole"),
        row(7, "nonsense"), row(8, "insert", text="x"), row(9, "delete", text="price", occurrence="5"),
    ]
    after, results = edits.apply_batch(p, spark.createDataFrame(todo, names))
    got = {r.seq: (r.success, r.message) for r in results.collect()}
    assert [got[i][0] for i in range(1, 10)] == [True, True, True, False, True, True, False, False, False]
    assert [(r.doc_id, r.text) for r in after.orderBy("doc_id", "p_idx").collect()] == [(1, "Terms"), (1, "Pay{++ now++} the price, whole price."), (1, "New line"), (2, "untouched")]
    assert tuple(edits.batch_summary(results).select("succeeded", "failed", "all_succeeded").head()) == (5, 4, False)


def test_move_and_comment():
    f = edits.Fold(["a b c", "d e f"], [None, None])
    f.apply({"type": "move_tracked", "text": "b", "after": "e"})
    assert f.texts == ["a {--b--} c", "d e{++b++} f"]
    f.apply({"type": "comment", "find": "d", "text": "why"})
    assert f.texts[1].startswith("{==d=={>>why<<}}")
    with pytest.raises(edits.EditError):
        f.apply({"type": "move", "text": "zzz", "after": "e"})


def test_critic_round_trip(spark):
    text = "x {++in++} {--out--} {~~old~>new~~} {>>note<<} {==mark==} {==m=={>>c<<}}"
    # A mark before a commented one is read as one span with it: kinds go in order, overlaps are dropped.
    assert [o[0] for o in critic.parse_one(text)] == ["insertion", "deletion", "substitution", "comment", "highlight_comment"]
    assert [o[5] for o in critic.parse_one("{==m=={>>c<<}}")] == ["c"]
    df = spark.createDataFrame([(1, "a {++b++} {~~c~>d~~}"), (2, "plain"), (3, None)], "doc_id long, text string")
    ops = critic.parse(df)
    again = ops.select("start", "end", critic.rendered(F.col("kind"), F.col("text"), F.col("replacement"), F.col("comment")).alias("m")).collect()
    assert all(("a {++b++} {~~c~>d~~}")[r.start : r.end] == r.m for r in again) and len(again) == 2


def test_scopes(spark):
    with pytest.raises(ValueError):
        search.scope_filter({"not_in": "x"})
    with pytest.raises(ValueError):
        search.scope_filter({"location": "attic"})
    p = spark.createDataFrame([(1, 0, "HEAD"), (1, 1, "aaa aa"), (1, 2, "b")], "doc_id long, p_idx int, text string")
    assert [r.pos for r in search.find_all(p, "aa").collect()] == [0, 1, 4]
    report = search.scope_report(p, "a").head()
    assert (report.matched, report.excluded) == (["aaa aa"], ["HEAD", "b"])
    assert p.select(search.expand_groups(F.lit("ab12"), r"(?P<x>[a-z]+)(\d+)", r"\2-\g<x>").alias("t")).head().t == "12-ab"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    lit = F.lit
    assert one(T.initials(lit("ada  lovelace"))) == "AL"
    assert one(T.normalize_currency(lit("$1000 and $1,234.5 and $12"))) == "$1,000.00 and $1,234.50 and $12.00"
    assert one(T.normalize_dates(lit("31 February 2024, Dec 8, 2025; 2024-02-30; 1/2/2024"))) == "31 February 2024, December 08, 2025; 2024-02-30; January 02, 2024"
    assert one(T.numbered_level(lit("1.2 x"))) == 2 and one(T.numbered_level(lit("article IV"))) == 1 and one(T.numbered_level(lit("x"))) is None
    assert one(T.all_caps(lit("ÉTAT A"))) and not one(T.all_caps(lit("A1")))
    assert one(T.style_level(lit("Heading 3"))) == 3 and one(T.style_level(lit("Subtitle"))) == 2
    assert one(T.heading_level(lit("Heading2"))) == 2 and one(T.heading_level(lit("heading2"))) is None
    assert one(T.valid_bookmark(lit("_x"))) is False and one(T.valid_bookmark(lit("a_1"))) is True
    f = one(T.field(lit(" REF target \\h \\p ")))
    assert (f.field_type, f.target, f.linked, f.position, f.number) == ("REF", "target", True, True, False)
    assert one(T.field_switch(lit('TOC \\o "1-3" \\h'), "o")) == "1-3" and one(T.field_switch(lit("TOC \\h"), "h")) == "" and one(T.field_switch(lit("TOC"), "h")) is None
    assert tuple(one(T.toc_levels(lit('TOC \\o "2-4"')))) == (2, 4) and tuple(one(T.toc_levels(lit("TOC")))) == (1, 3)
    assert tuple(one(T.toc_entry(lit("TOC2"), lit("Scope .... 12")))) == (2, "Scope", 12)
    assert one(T.tokens(lit("l’été non-dit, x"))) == ["l’été", " ", "non-dit", ",", " ", "x"]
    assert one(T.continuity(lit("of which x"))) == ["starts in lower case", "starts with a connecting phrase"]
    assert one(T.image_size(lit(914400), lit(457200))) == "1.0in x 0.5in"
    assert one(T.ref_parts(lit("tbl:0/row:2/p:~abc")))[2].fingerprint == "abc"
    assert (one(T.twips(lit(1.5))), one(T.inch_twips(lit(1.0))), one(T.half_points(lit(10.5)))) == (30, 1440, 21)
    assert one(T.has_special_chars(lit("a – b"))) and not one(T.has_special_chars(lit("a - b")))


def test_sections_of_headings(spark):
    p = spark.createDataFrame([(1, 0, "Heading1", "A"), (1, 1, None, "x"), (1, 2, "Heading2", "B"), (2, 0, None, "only")], "doc_id long, p_idx int, style string, text string")
    got = structure.detect_sections(p).orderBy("doc_id", "start_idx").collect()
    assert [(r.doc_id, r.heading, r.start_idx, r.end_idx, r.method) for r in got] == [(1, "A", 0, 2, "heading_style"), (1, "B", 2, 3, "heading_style"), (2, None, 0, 1, "chunks")]
