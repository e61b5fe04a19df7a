"""Lookups that the registered queries don't reach: cases of nulls, edges and missing entities."""

from pyspark.sql import functions as F

from inkloom.operators import lookups


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_tables(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, "A"), (1, 0, 0, 1, None), (1, 0, 1, 0, "b"), (1, 1, 0, 0, "a x")], "doc_id long, tbl_idx int, row_idx int, cell_idx int, text string")
    assert values(lookups.table_shapes(cells), "tbl_idx", "n_rows", "n_cols") == [(0, 2, 2), (1, 1, 1)]
    assert values(lookups.first_table(cells, "a"), "tbl_idx") == [(1,)] and values(lookups.first_table(cells, "a", False), "tbl_idx") == [(0,)]
    assert values(lookups.rows_containing(cells, "b"), "tbl_idx", "row_idx", "found") == [(0, 0, False), (0, 1, True), (1, 0, False)]
    left = cells.where("tbl_idx = 0").select("doc_id", "tbl_idx", F.lit(-1).alias("after_col"), "row_idx", F.lit("new").alias("text")).distinct()
    assert values(lookups.column_inserted(cells.where("tbl_idx = 0"), left), "row_idx", "cell_idx", "text") == [(0, 0, "new"), (0, 1, "A"), (0, 2, None), (1, 0, "new"), (1, 1, "b")]


def test_by_name_and_url(spark):
    rows = spark.createDataFrame([("Body Text", "http://a.b/c"), (None, None)], "name string, target string")
    assert lookups.by_name(rows, "BODY text").count() == 1 and lookups.by_name(rows, "BODY text", case_sensitive=True).count() == 0
    assert lookups.by_url(rows, "a.b").count() == 1 and lookups.by_url(rows, "zz").count() == 0


def test_surroundings_at_the_edges(spark):
    row = spark.range(1).select(lookups.surroundings(F.lit("abcdef"), F.lit(0), F.lit(2), 3).alias("x"), lookups.surroundings(F.lit("abcdef"), F.lit(4), F.lit(2), 3).alias("y")).head()
    assert tuple(row.x) == ("", "ab", "cde") and tuple(row.y) == ("bcd", "ef", "")


def test_contents_switches(spark):
    fields = spark.createDataFrame([(1, 'TOC \\o "1-3" \\h', False), (1, "TOC", False), (1, "REF x", False)], "doc_id long, code string, dirty boolean")
    assert values(lookups.contents_updated(fields, 2, 5), "code", "dirty") == sorted([('TOC \\o "2-5" \\h', True), ('TOC \\o "2-5"', True), ("REF x", False)], key=repr)
    assert values(lookups.contents_updated(fields, linked=False), "code") == sorted([('TOC \\o "1-3"',), ("TOC",), ("REF x",)], key=repr)
    assert lookups.contents_removed(fields).count() == 1
    after, n = lookups.marked_dirty(fields, ("TOC",))
    assert values(n, "n") == [(2,)] and values(after.where("dirty"), "code") == sorted([('TOC \\o "1-3" \\h',), ("TOC",)], key=repr)


def test_versions_that_lack_a_document(spark):
    old, new = (spark.createDataFrame(rows, "doc_id long") for rows in ([(1,), (1,), (2,)], [(1,), (3,)]))
    assert values(lookups.paragraph_delta(old, new), "doc_id", "n_old", "n_new", "delta") == [(1, 2, 1, -1), (2, 1, 0, -1), (3, 0, 1, 1)]


def test_note_html_escapes(spark):
    runs = spark.createDataFrame([(1, "n", "2", 0, 0, "a<b", True, None), (1, "n", "2", 0, 1, "  ", True, None), (1, "n", "2", 1, 0, "c", None, True), (1, "n", None, 0, 0, "body", None, None)], "doc_id long, part string, note_id string, p_idx int, r_idx int, text string, bold boolean, italic boolean")
    assert values(lookups.note_html(lookups.note_runs(runs)), "note_id", "html") == [("2", "<b>a&lt;b</b><i>c</i>")]
