"""Queries of lookups, accepting and rejecting, notes, links, references and exports, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import changes as C
from inkloom.operators import entity_edits, export, links, lookups, nodes, search, structure, validation
from inkloom.plans.queries import EV, HEADING, P, RUNS, _changes, _heading, _p, _runs, query
from inkloom.sources.tables import chat_comments, read

# Tables: nations are rows of their region's table, with key and name as cells.
_CELLS = "cells AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_nationkey % 2 AS tbl_idx, CAST(row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 2 ORDER BY n_nationkey) - 1 AS INTEGER) AS row_idx, n_nationkey, n_name FROM nation), c AS (SELECT doc_id, tbl_idx, row_idx, 0 AS cell_idx, CAST(n_nationkey AS VARCHAR) AS text FROM cells UNION ALL SELECT doc_id, tbl_idx, row_idx, 1, n_name FROM cells)"


def _cells(spark, d):
    from pyspark.sql import Window

    rows = read(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), (F.col("n_nationkey") % 2).alias("tbl_idx"), "n_nationkey", "n_name")
    rows = rows.withColumn("row_idx", F.row_number().over(Window.partitionBy("doc_id", "tbl_idx").orderBy("n_nationkey")) - 1)
    return rows.select("doc_id", "tbl_idx", "row_idx", F.posexplode(F.array(F.col("n_nationkey").cast("string"), "n_name")).alias("cell_idx", "text"))


@query(f"WITH {_CELLS} SELECT doc_id, tbl_idx, CAST(max(row_idx) + 1 AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_cols FROM c GROUP BY doc_id, tbl_idx")
def table_shapes(spark, d):
    return lookups.table_shapes(_cells(spark, d))


@query(f"WITH {_CELLS} SELECT doc_id, min(tbl_idx) AS tbl_idx FROM c WHERE contains(lower(text), 'on') GROUP BY doc_id")
def first_table(spark, d):
    return lookups.first_table(_cells(spark, d), "ON", case_sensitive=False)


@query(f"WITH {_CELLS} SELECT doc_id, tbl_idx, row_idx, max(contains(text, 'A')) AS found FROM c GROUP BY ALL")
def rows_containing(spark, d):
    return lookups.rows_containing(_cells(spark, d), "A")


@query(f"WITH {_CELLS}, w AS (SELECT CAST(r_regionkey AS BIGINT) AS doc_id, unnest([1, 99]) AS row_idx FROM region) SELECT w.doc_id, 0 AS tbl_idx, w.row_idx, 1 AS cell_idx, c.text, c.text IS NOT NULL AS found FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.tbl_idx = 0 AND c.row_idx = w.row_idx AND c.cell_idx = 1")
def cells_at(spark, d):
    wanted = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(0).alias("tbl_idx"), F.explode(F.array(F.lit(1), F.lit(99))).alias("row_idx"), F.lit(1).alias("cell_idx"))
    return lookups.cells_at(_cells(spark, d), wanted)


@query(f"WITH {_CELLS} SELECT doc_id, tbl_idx, row_idx, CASE WHEN cell_idx = 1 THEN 2 ELSE 0 END AS cell_idx, text FROM c UNION ALL SELECT DISTINCT doc_id, tbl_idx, row_idx, 1, 'row ' || row_idx FROM c")
def column_inserted(spark, d):
    cells = _cells(spark, d)
    return lookups.column_inserted(cells, cells.where("cell_idx = 0").select("doc_id", "tbl_idx", "row_idx", F.lit(0).alias("after_col"), F.concat(F.lit("row "), "row_idx").alias("text")))


@query(f"""WITH {_CELLS}, r AS (SELECT doc_id, tbl_idx, row_idx, string_agg('"' || CASE WHEN length(text) > 5 THEN substr(text, 1, 5) || '...' ELSE text END || '"', ', ' ORDER BY cell_idx) AS line FROM c GROUP BY ALL)
SELECT doc_id, tbl_idx, 'rows:' || chr(10) || string_agg('  - [' || line || ']', chr(10) ORDER BY row_idx) || chr(10) AS text FROM r GROUP BY ALL""")
def table_yaml(spark, d):
    return lookups.table_yaml(_cells(spark, d), 5)


# Sections and references

_S = f"{P}, s AS (SELECT *, CAST(sum(CAST({HEADING} AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p_idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS section_id FROM p)"
_TEXT = "replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t')"


@query(f"WITH {_S} SELECT doc_id, section_id, max(contains(text, 'worthless')) AS found, min(p_idx) FILTER (contains(text, 'worthless')) AS first_idx FROM s GROUP BY doc_id, section_id")
def sections_containing(spark, d):
    return lookups.sections_containing(_p(spark, d), _heading(), "worthless")


@query(f"WITH {_S} SELECT doc_id, section_id, p_idx, text FROM s WHERE section_id = 1")
def expanded_sections(spark, d):
    return lookups.expanded_sections(_p(spark, d), _heading(), read(spark, d, "documents").select("doc_id", F.lit(1).alias("section_id"))).select("doc_id", "section_id", "p_idx", "text")


@query(f"""WITH {_S} SELECT doc_id, section_id, 'section: ' || section_id || chr(10) || 'content:' || chr(10) || string_agg('  - ref: p:' || p_idx || chr(10) || '    text: "' || {_TEXT} || '"', chr(10) ORDER BY p_idx) || chr(10) AS text FROM s WHERE section_id = 1 GROUP BY doc_id, section_id""")
def section_yaml(spark, d):
    return lookups.section_yaml(expanded_sections(spark, d))


_REFS = f"{P}, w AS (SELECT doc_id, unnest([0, 4]) AS p_idx FROM documents), e AS (SELECT w.doc_id, 'p:' || w.p_idx AS ref, p.p_idx, p.text, p.text IS NOT NULL AS found FROM w LEFT JOIN p ON p.doc_id = w.doc_id AND p.p_idx = w.p_idx)"


def _expanded(spark, d):
    wanted = read(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit("p:0"), F.lit("p:4"))).alias("ref"))
    return lookups.expanded_refs(structure.resolve(_p(spark, d), wanted), _p(spark, d))


@query(f"WITH {_REFS} SELECT * FROM e")
def expanded_refs(spark, d):
    return _expanded(spark, d)


@query(f"""WITH {_REFS} SELECT doc_id, 'refs:' || chr(10) || coalesce(string_agg('  - ref: ' || ref || chr(10) || '    text: "' || {_TEXT} || '"', chr(10) ORDER BY ref) FILTER (found), '') || chr(10)
  || CASE WHEN count(*) FILTER (NOT found) > 0 THEN 'not_found:' || chr(10) || string_agg('  - ' || ref, chr(10) ORDER BY ref) FILTER (NOT found) || chr(10) ELSE '' END AS text FROM e GROUP BY doc_id""")
def refs_yaml(spark, d):
    return lookups.refs_yaml(_expanded(spark, d))


@query(f"WITH {P}, o AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id), w AS (SELECT doc_id, count(*) AS m FROM p WHERE NOT contains(text, 'worthless') GROUP BY doc_id) SELECT doc_id, n AS n_old, coalesce(m, 0) AS n_new, coalesce(m, 0) - n AS delta FROM o LEFT JOIN w USING (doc_id)")
def paragraph_delta(spark, d):
    return lookups.paragraph_delta(_p(spark, d), _p(spark, d).where("not contains(text, 'worthless')"))


@query(f"WITH {P}, m AS (SELECT doc_id, p_idx, text, strpos(text, 'idiot') - 1 AS s FROM p WHERE contains(text, 'idiot')) SELECT doc_id, p_idx, substr(text, CAST(greatest(s - 50, 0) + 1 AS BIGINT), CAST(s - greatest(s - 50, 0) AS BIGINT)) AS before, 'idiot' AS matched, substr(text, CAST(s + 6 AS BIGINT), 50) AS after FROM m")
def match_surroundings(spark, d):
    at = F.expr("instr(text, 'idiot') - 1")
    return _p(spark, d).where("contains(text, 'idiot')").select("doc_id", "p_idx", lookups.surroundings(F.col("text"), at, F.lit(5)).alias("x")).select("doc_id", "p_idx", "x.*")


@query(f"WITH {P} SELECT doc_id, count(*) AS n_paragraphs, (SELECT count(*) FROM events e WHERE e.event_id // 50 = p.doc_id) AS n_changes FROM p GROUP BY doc_id")
def document_stats(spark, d):
    out = structure.document_stats(paragraphs=_p(spark, d), changes=_changes(spark, d))
    return out.join(read(spark, d, "documents").where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")


@query(f"WITH {P} SELECT doc_id, p_idx, CASE WHEN matched THEN substr(text, 1, 20) END AS inside FROM (SELECT *, contains(text, 'worthless') AS matched FROM p) WHERE matched")
def scope_members(spark, d):
    return _p(spark, d).where(search.scope_filter("paragraph_containing:worthless")).select("doc_id", "p_idx", F.substring("text", 1, 20).alias("inside"))


@query(f"WITH {P} SELECT doc_id, coalesce(list(substr(text, 1, 100) ORDER BY p_idx) FILTER (contains(text, 'idiot')), []) AS matched, coalesce(list(substr(text, 1, 100) ORDER BY p_idx) FILTER (NOT contains(text, 'idiot')), []) AS excluded FROM p GROUP BY doc_id")
def scope_report(spark, d):
    return search.scope_report(_p(spark, d), "idiot")


# Notes: suppliers, as elsewhere

_NOTES = "n AS (SELECT s_suppkey % 5 AS doc_id, 'footnote' AS note_kind, CAST(s_suppkey AS VARCHAR) AS note_id, CAST(s_suppkey AS INTEGER) AS p_idx, s_name AS text FROM supplier)"


def _notes(spark, d):
    return read(spark, d, "supplier").select((F.col("s_suppkey") % 5).alias("doc_id"), F.lit("footnote").alias("note_kind"), F.col("s_suppkey").cast("string").alias("note_id"), F.col("s_suppkey").cast("int").alias("p_idx"), F.col("s_name").alias("text"))


@query(f"WITH {_NOTES} SELECT doc_id, note_id, text FROM n WHERE contains(lower(text), 'er#00000000')")
def notes_containing(spark, d):
    return lookups.containing(_notes(spark, d), "ER#00000000", case_sensitive=False).select("doc_id", "note_id", "text")


@query(f"WITH {_NOTES}, x AS (SELECT *, unnest(range(0, length(text))) AS pos FROM n) SELECT doc_id, note_id, CAST(row_number() OVER (PARTITION BY doc_id, note_id ORDER BY pos) - 1 AS INTEGER) AS index, 0 AS note_p_idx, CAST(pos AS INTEGER) AS pos FROM x WHERE substr(text, CAST(pos + 1 AS BIGINT), 1) = '0'")
def note_search(spark, d):
    hits = search.find_all(_notes(spark, d).where(search.note_scope("footnotes")), "0")
    return lookups.note_matches(hits).select("doc_id", "note_id", "index", "note_p_idx", "pos")


@query(f"""WITH {_NOTES} SELECT doc_id, 'word/footnotes.xml' AS part, note_id, CASE WHEN p_idx % 2 = 0 THEN '<b>' || replace(text, '#', '&amp;') || '</b>' ELSE replace(text, '#', '&amp;') END AS html FROM n""")
def note_html(spark, d):
    runs = _notes(spark, d).select("doc_id", F.lit("word/footnotes.xml").alias("part"), "note_id", "p_idx", F.lit(0).alias("r_idx"), F.replace("text", F.lit("#"), F.lit("&")).alias("text"), (F.col("p_idx") % 2 == 0).alias("bold"), F.lit(False).alias("italic"))
    return lookups.note_html(lookups.note_runs(runs))


@query(f"WITH {_NOTES} SELECT doc_id, note_kind, note_id, CASE WHEN p_idx % 3 = 0 THEN 'see ' || text ELSE text END AS text FROM n")
def notes_edited(spark, d):
    notes = _notes(spark, d)
    new = notes.where("p_idx % 3 = 0").select("doc_id", "note_kind", "note_id", F.concat(F.lit("see "), "text").alias("text"))
    return entity_edits.edit_notes(notes.drop("p_idx"), new).select("doc_id", "note_kind", "note_id", "text")


# Links, bookmarks, comments: anchors of pages, parts and turns

_LINKS = "l AS (SELECT p_partkey % 50 AS doc_id, CAST(p_partkey // 50 AS INTEGER) AS link_idx, CASE WHEN p_size % 2 = 0 THEN p_brand END AS anchor, CASE WHEN p_size % 2 = 1 THEN 'rId' || p_size END AS rel_id, p_name AS text FROM part), rels AS (SELECT DISTINCT p_partkey % 50 AS doc_id, 'rId' || p_size AS rel_id, 'http://example.org/' || p_size AS target FROM part WHERE p_size % 4 = 1), marks AS (SELECT DISTINCT p_partkey % 50 AS doc_id, p_brand AS name FROM part WHERE p_size % 8 = 0)"


def _link_tables(spark, d):
    part = read(spark, d, "part").withColumn("doc_id", F.col("p_partkey") % 50)
    even = F.col("p_size") % 2 == 0
    found = part.select("doc_id", F.floor(F.col("p_partkey") / 50).cast("int").alias("link_idx"), F.when(even, F.col("p_brand")).alias("anchor"), F.when(~even, F.concat(F.lit("rId"), "p_size")).alias("rel_id"), F.col("p_name").alias("text"))
    rels = part.where("p_size % 4 = 1").select("doc_id", F.concat(F.lit("rId"), "p_size").alias("rel_id"), F.concat(F.lit("http://example.org/"), "p_size").alias("target")).distinct()
    marks = part.where("p_size % 8 = 0").select("doc_id", F.col("p_brand").alias("name")).distinct()
    return found, rels, marks


_RESOLVED = f"{_LINKS}, r AS (SELECT l.*, rels.target, CASE WHEN rels.target IS NOT NULL THEN 'external' WHEN marks.name IS NOT NULL THEN 'internal' ELSE 'broken' END AS status FROM l LEFT JOIN rels ON rels.doc_id = l.doc_id AND rels.rel_id = l.rel_id LEFT JOIN marks ON marks.doc_id = l.doc_id AND marks.name = l.anchor)"


@query(f"WITH {_RESOLVED} SELECT doc_id, link_idx, anchor, rel_id, text, target, status FROM r")
def links_status(spark, d):
    return links.resolved_links(*_link_tables(spark, d))


@query(f"WITH {_RESOLVED} SELECT doc_id, link_idx, target FROM r WHERE contains(target, 'org/1')")
def links_by_url(spark, d):
    return lookups.by_url(links.resolved_links(*_link_tables(spark, d)), "org/1").select("doc_id", "link_idx", "target")


@query(f"""WITH {_LINKS}, a AS (SELECT doc_id, count(*) AS b FROM l WHERE anchor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.doc_id = l.doc_id AND m.name = l.anchor) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(b, 0) AS BIGINT) AS broken_links, CAST(coalesce(b, 0) AS BIGINT) AS broken_xrefs, CAST(0 AS BIGINT) AS orphan_bookmarks, b IS NULL AS is_valid FROM (SELECT DISTINCT doc_id FROM l) LEFT JOIN a USING (doc_id)""")
def links_validated(spark, d):
    found, _, marks = _link_tables(spark, d)
    return links.validated(found, found.where("anchor is not null").select("doc_id", F.col("anchor").alias("target")), marks)


@query(f"WITH {_LINKS} SELECT m.doc_id, m.name, count(l.anchor) AS n_refs FROM marks m LEFT JOIN l ON l.doc_id = m.doc_id AND l.anchor = m.name GROUP BY ALL")
def references_to(spark, d):
    found, _, marks = _link_tables(spark, d)
    return lookups.references_to(found.select("doc_id", F.col("anchor").alias("target")), marks)


@query(f"WITH {_LINKS} SELECT doc_id, name FROM marks WHERE lower(name) = 'brand#11'")
def bookmarks_by_name(spark, d):
    return lookups.by_name(_link_tables(spark, d)[2], "BRAND#11")


@query(f"WITH {_LINKS} SELECT doc_id, anchor AS target FROM l WHERE anchor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.doc_id = l.doc_id AND m.name = l.anchor)")
def references_broken(spark, d):
    found, _, marks = _link_tables(spark, d)
    return links.broken_references(found.where("anchor is not null").select("doc_id", F.col("anchor").alias("target")), marks)


@query(f"""WITH {_LINKS}, t AS (SELECT doc_id, max(link_idx) AS top FROM l GROUP BY doc_id), q AS (SELECT doc_id, coalesce(max(CAST(substr(rel_id, 4) AS INTEGER)), 0) AS rid FROM rels GROUP BY doc_id)
SELECT doc_id, link_idx, text, anchor, rel_id FROM l UNION ALL SELECT doc_id, CAST(top + 1 AS INTEGER), 'inside', 'here', NULL FROM t UNION ALL SELECT doc_id, CAST(top + 2 AS INTEGER), 'outside', NULL, 'rId' || CAST(coalesce(rid, 0) + 1 AS BIGINT) FROM t LEFT JOIN q USING (doc_id)""")
def links_inserted(spark, d):
    found, rels, _ = _link_tables(spark, d)
    null = F.lit(None).cast("string")
    new = found.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("p_idx"), F.lit("inside").alias("text"), null.alias("url"), F.lit("here").alias("anchor")), F.struct(F.lit(2).alias("p_idx"), F.lit("outside").alias("text"), F.lit("http://a").alias("url"), null.alias("anchor")))).alias("x")).select("doc_id", "x.*")
    return lookups.links_inserted(found.withColumn("p_idx", F.lit(0)), rels, new)[0].drop("p_idx")


@query(f"WITH {_LINKS} SELECT doc_id, link_idx, CASE WHEN link_idx = 3 THEN 'new ' || text ELSE text END AS text FROM l")
def link_texts(spark, d):
    found = _link_tables(spark, d)[0]
    new = found.where("link_idx = 3").select("doc_id", "link_idx", F.concat(F.lit("new "), "text").alias("value"))
    return lookups.link_texts(found, new).select("doc_id", "link_idx", "text")


_FIELDS = """f AS (SELECT p_partkey % 50 AS doc_id, CAST(p_partkey // 50 AS INTEGER) AS field_idx, CASE p_size % 4 WHEN 0 THEN 'TOC \\o "1-3" \\h \\z' WHEN 1 THEN 'REF ' || p_brand || ' \\h' WHEN 2 THEN 'PAGEREF ' || p_brand ELSE 'PAGE' END AS code FROM part)"""


def _fields(spark, d):
    case = """case p_size % 4 when 0 then 'TOC \\\\o "1-3" \\\\h \\\\z' when 1 then concat('REF ', p_brand, ' \\\\h') when 2 then concat('PAGEREF ', p_brand) else 'PAGE' end as code"""
    return read(spark, d, "part").selectExpr("p_partkey % 50 as doc_id", "cast(floor(p_partkey / 50) as int) as field_idx", case, "false as dirty")


@query(f"""WITH {_FIELDS} SELECT doc_id, field_idx, CASE WHEN code LIKE 'TOC%' THEN 'TOC \\o "2-4" \\h \\z' ELSE code END AS code, code LIKE 'TOC%' AS dirty FROM f""")
def contents_updated(spark, d):
    return lookups.contents_updated(_fields(spark, d), 2, 4)


@query(f"WITH {_FIELDS} SELECT doc_id, field_idx, code FROM f WHERE code NOT LIKE 'TOC%'")
def contents_removed(spark, d):
    return lookups.contents_removed(_fields(spark, d)).drop("dirty")


@query(f"WITH {_FIELDS} SELECT doc_id, count(*) AS n FROM f WHERE code LIKE 'REF%' OR code LIKE 'PAGEREF%' GROUP BY doc_id")
def references_dirty(spark, d):
    return lookups.marked_dirty(_fields(spark, d))[1]


@query(f"WITH {_FIELDS} SELECT doc_id, field_idx, split_part(code, ' ', 1) AS field_type, split_part(code, ' ', 2) AS target FROM f WHERE code LIKE 'REF%' OR code LIKE 'PAGEREF%'")
def references_of_fields(spark, d):
    return links.cross_references(_fields(spark, d)).select("doc_id", "field_idx", "field_type", "target")


@query(f"""WITH {_FIELDS} SELECT doc_id, field_idx, CASE WHEN code LIKE 'TOC%' THEN 1 ELSE 0 END + CASE WHEN code LIKE 'TOC%' THEN 3 ELSE 0 END AS levels FROM f WHERE code LIKE 'TOC%'""")
def contents_levels(spark, d):
    rows = lookups.contents_updated(_fields(spark, d)).where("code like 'TOC%'")
    levels = T.toc_levels(F.col("code"))
    return rows.select("doc_id", "field_idx", levels.alias("x")).select("doc_id", "field_idx", F.expr("x.low + x.high").alias("levels"))


@query(f"""WITH {P}, h AS (SELECT doc_id, p_idx, substr('_Ref' || array_to_string(list_transform(string_split(lower(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ''), 1, 32) AS stem FROM p WHERE {HEADING} AND trim(text, ' ') <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stem ORDER BY p_idx) AS k FROM h) SELECT doc_id, CASE WHEN k = 1 THEN stem ELSE stem || '_' || k END AS name, p_idx FROM k""")
def heading_bookmarks(spark, d):
    styled = _p(spark, d).withColumn("style", F.when(_heading(), "Heading1").otherwise("Normal"))
    return lookups.heading_bookmarks(styled, spark.createDataFrame([], "doc_id long, name string, p_idx int"))


@query("""WITH i AS (SELECT s_suppkey % 5 AS doc_id, CAST(s_suppkey AS INTEGER) AS p_idx, s_name AS name FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p_idx, name) AS k FROM i)
SELECT doc_id, p_idx, 'rId' || (k + 7) AS rel_id, CAST(1371600 AS BIGINT) AS width, CAST(914400 AS BIGINT) AS height, name FROM k""")
def images_inserted(spark, d):
    new = _notes(spark, d).select("doc_id", "p_idx", F.col("text").alias("name"), F.lit("png").alias("extension"), F.lit(1.5).alias("width_inches"), F.lit(1.0).alias("height_inches"))
    docs = new.select("doc_id").distinct()
    none = spark.createDataFrame([], "doc_id long, p_idx int, rel_id string, width long, height long, name string")
    return lookups.images_inserted(none, docs.withColumn("rel_id", F.lit("rId7")).withColumn("target", F.lit("x")), docs.withColumn("part", F.lit("word/media/image2.png")), new)[0]


@query("""SELECT s_suppkey % 5 AS doc_id, CAST(s_suppkey AS INTEGER) AS p_idx, '{"name":"' || s_name || '","width_inches":1.5,"height_inches":1.0}' AS image FROM supplier""")
def images_json(spark, d):
    return lookups.image_json(images_inserted(spark, d))


@query("SELECT conv_id AS doc_id, turn AS comment_id, text FROM conversations WHERE turn <> 1")
def comments_deleted(spark, d):
    comments = chat_comments(read(spark, d, "conversations"))
    gone = comments.where("comment_id = 1").select("doc_id", "comment_id")
    ranges = comments.select("doc_id", "comment_id")
    return entity_edits.delete_comments(comments, ranges, gone)[0].select("doc_id", "comment_id", "text")


# Accepting and rejecting


def _decided_sql(hit: str, accept: bool) -> str:
    drop = "in_del" if accept else "in_ins"
    stay = "in_ins" if accept else "in_del"
    text = "text" if accept else f"CASE WHEN ({hit}) AND in_del THEN del_text ELSE text END"
    gone = "del_text" if accept else f"CASE WHEN ({hit}) AND in_del THEN '' ELSE del_text END"
    return f"""WITH {RUNS} SELECT doc_id, CASE WHEN ({hit}) AND {stay} THEN NULL ELSE change_id END AS change_id, author, {text} AS text, {gone} AS del_text, in_ins AND NOT ({hit} AND in_ins) AS in_ins, in_del AND NOT ({hit} AND in_del) AS in_del
FROM runs WHERE NOT (({hit}) AND {drop})"""


@query(_decided_sql("author = 'user3'", False))
def reject_by_author(spark, d):
    return C.decided(_runs(spark, d), False, F.col("author") == "user3")


@query(_decided_sql("change_id % 10 = 3", True))
def accept_by_id(spark, d):
    return C.decided(_runs(spark, d), True, F.col("change_id") % 10 == 3)


@query(_decided_sql("change_id % 10 = 3", False))
def reject_by_id(spark, d):
    return C.decided(_runs(spark, d), False, F.col("change_id") % 10 == 3)


@query(_decided_sql("in_ins", True))
def accept_insertions(spark, d):
    return C.decided(_runs(spark, d), True, F.col("in_ins"))


@query(_decided_sql("in_ins", False))
def reject_insertions(spark, d):
    return C.decided(_runs(spark, d), False, F.col("in_ins"))


@query(_decided_sql("in_del", True))
def accept_deletions(spark, d):
    return C.decided(_runs(spark, d), True, F.col("in_del"))


@query(_decided_sql("in_del", False))
def reject_deletions(spark, d):
    return C.decided(_runs(spark, d), False, F.col("in_del"))


@query(_decided_sql("contains(text || del_text, '1')", True))
def accept_by_text(spark, d):
    return C.decided(_runs(spark, d), True, F.concat("text", "del_text").contains("1"))


@query(_decided_sql("contains(text || del_text, '1')", False))
def reject_by_text(spark, d):
    return C.decided(_runs(spark, d), False, F.concat("text", "del_text").contains("1"))


# Functions

_PART = "p_name || ' ' || substr('“”‘’', CAST(p_partkey % 4 + 1 AS BIGINT), 1)"


def _part_text():
    return F.concat("p_name", F.lit(" "), F.substr(F.lit("“”‘’"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)))


@query(f"""SELECT p_partkey, translate({_PART}, '“”‘’', '""''''') AS plain, regexp_matches({_PART}, '[‘’“”]') AS smart, regexp_matches({_PART}, '["'']') AS straight FROM part""")
def quotes_normalized(spark, d):
    t = _part_text()
    return read(spark, d, "part").select("p_partkey", T.normalize_quotes(t).alias("plain"), T.has_smart_quotes(t).alias("smart"), T.has_straight_quotes(t).alias("straight"))


@query(f"WITH {P} SELECT doc_id, p_idx, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM p WHERE regexp_matches(text, '^[\\x20-\\x7E\\t]*$')")
def whitespace_squeezed(spark, d):
    return _p(spark, d).where(F.col("text").rlike(r"^[\x20-\x7E\t]*$")).select("doc_id", "p_idx", T.squeeze(F.col("text")).alias("text"))


@query("SELECT o_orderkey, CAST(trunc(o_totalprice * 20) AS INTEGER) AS twips, CAST(trunc(o_totalprice * 2) AS INTEGER) AS half_points FROM orders")
def unit_conversions(spark, d):
    return read(spark, d, "orders").select("o_orderkey", T.twips(F.col("o_totalprice")).cast("int").alias("twips"), T.half_points(F.col("o_totalprice")).cast("int").alias("half_points"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size % 9 + 1 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS level FROM part")
def style_levels(spark, d):
    style = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Heading"), F.col("p_size") % 9 + 1)).when(F.col("p_size") % 4 == 1, "Title").when(F.col("p_size") % 4 == 2, "Subtitle").otherwise("Normal")
    return read(spark, d, "part").select("p_partkey", T.style_level(style).alias("level"))


@query("SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z][A-Za-z0-9_]{0,39}$') AS valid FROM part")
def bookmark_names(spark, d):
    return read(spark, d, "part").select("p_partkey", T.valid_bookmark(F.col("p_name")).alias("valid"))


# Validation and trees


@query("SELECT p_partkey % 50 AS doc_id, CASE WHEN p_size % 2 = 0 THEN ' ' || p_name ELSE p_name END AS text, p_size % 3 = 0 AS preserved FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 0")
def whitespace_breaches(spark, d):
    texts = read(spark, d, "part").select((F.col("p_partkey") % 50).alias("doc_id"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_name")).alias("text"), (F.col("p_size") % 3 == 0).alias("preserved"))
    return validation.unpreserved(texts)


@query(f"WITH {P} SELECT doc_id, coalesce(count(*) FILTER (contains(text, 'idiot')), 0) AS n FROM p GROUP BY doc_id")
def tree_matches(spark, d):
    tables = {c: F.lit(None).cast("int") for c in ("tbl_idx", "row_idx", "cell_idx")}
    rows = _p(spark, d).withColumns(tables).withColumn("part", F.lit("word/document.xml")).withColumn("style", F.lit("Normal")).withColumn("location", F.lit("body")).withColumn("body_p_idx", F.col("p_idx"))
    found = nodes.find(nodes.tree(rows), element_type="paragraph", contains="idiot").groupBy("doc_id").agg(F.count("*").alias("n"))
    return _p(spark, d).select("doc_id").distinct().join(found, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
