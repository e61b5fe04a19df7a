"""Queries of paragraph edits, batches, regular expressions and overlapping hits, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import blocks, by_ref, changes, formatting, search, tracked, versions
from inkloom.plans.edit_queries import _SAFE, _SPLIT, _edits, _lines, _runs
from inkloom.plans.queries import HEADING, P, RUNS, _heading, _p, query
from inkloom.plans.queries import _runs as change_runs
from inkloom.plans.queries import _versions
from inkloom.sources import docx, parts
from inkloom.sources.tables import read, written


def _block_edits(spark, d, *rows: dict):
    """The same paragraph edits for every document."""
    names = ("type", "text", "find", "after", "before", "heading", "style", "occurrence", "scope", "ref")
    one = F.array(*(F.struct(F.lit(i).alias("seq"), *(F.lit(r.get(n)).cast("string").alias(n) for n in names)) for i, r in enumerate(rows, 1)))
    return read(spark, d, "documents").select("doc_id", F.explode(one).alias("e")).select("doc_id", "e.*")


@query(f"""WITH {P}, h AS (SELECT doc_id, p_idx, unnest([i for i in range(0, length(text)) if substr(text, i + 1, 4) = 'enen']) AS pos FROM p WHERE contains(text, 'enen'))
SELECT doc_id, p_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p_idx, pos) - 1 AS INTEGER) AS index, CAST(pos AS INTEGER) AS pos, CAST(4 AS INTEGER) AS len, 'enen' AS found FROM h""")
def find_all_overlapping(spark, d):
    return search.find_all(_p(spark, d), "enen").drop("context")


BLOCKS = (
    {"type": "insert_paragraphs_tracked", "after": "disgusting", "text": "Alpha one\nBeta two"},
    {"type": "delete_paragraph_tracked", "find": "trash", "occurrence": "first"},
    {"type": "insert_paragraph", "before": "Beta two", "text": "Mid"},
)
_FOUND = f"""{P}, c AS (SELECT doc_id, CAST(sum((length(text) - length(replace(text, 'disgusting', ''))) // 10) AS BIGINT) AS n, min(p_idx) FILTER (contains(text, 'disgusting')) AS a,
  min(p_idx) FILTER (contains(text, 'trash')) AS b, count(*) FILTER (contains(text, 'trash')) AS m FROM p GROUP BY doc_id)"""
_EDITED = f"""{_FOUND}, r AS (SELECT p.doc_id, p_idx AS o, 0 AS k, CASE WHEN p_idx = b THEN '' ELSE text END AS text, CASE WHEN p_idx = b THEN text END AS gone, NULL AS ins_id, CASE WHEN p_idx = b THEN CAST(CASE WHEN n = 1 THEN 4 ELSE 2 END AS VARCHAR) END AS mark_id FROM p JOIN c ON p.doc_id = c.doc_id
UNION ALL SELECT doc_id, a, 1, 'Alpha one', NULL, '1', NULL FROM c WHERE n = 1 UNION ALL SELECT doc_id, a, 2, 'Mid', NULL, NULL, NULL FROM c WHERE n = 1 UNION ALL SELECT doc_id, a, 3, 'Beta two', NULL, '2', NULL FROM c WHERE n = 1)"""


@query(f"WITH {_EDITED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, k) - 1 AS INTEGER) AS n, text, gone, ins_id, mark_id FROM r")
def paragraphs_edited(spark, d):
    """Paragraphs put in and taken out with tracked changes, the last beside one that the first put in."""
    return blocks.apply(_p(spark, d), _block_edits(spark, d, *BLOCKS))[0].select("doc_id", "n", "text", "gone", "ins_id", "mark_id")


@query(f"""WITH {_FOUND} SELECT doc_id, '1' AS change_id, 'insertion' AS change_type, 'Alpha one' AS text FROM c WHERE n = 1 UNION ALL SELECT doc_id, '2', 'insertion', 'Beta two' FROM c WHERE n = 1
UNION ALL SELECT c.doc_id, CASE WHEN n = 1 THEN '3' ELSE '1' END, 'deletion', text FROM c JOIN p ON p.doc_id = c.doc_id AND p.p_idx = c.b UNION ALL SELECT doc_id, CASE WHEN n = 1 THEN '4' ELSE '2' END, 'deletion', '' FROM c WHERE b IS NOT NULL""")
def paragraph_changes(spark, d):
    return blocks.apply(_p(spark, d), _block_edits(spark, d, *BLOCKS))[1].select("doc_id", "change_id", "change_type", "text")


@query(f"""WITH {_FOUND} SELECT doc_id, CAST(1 AS INTEGER) AS seq, n = 1 AS success, CASE WHEN n = 0 THEN 'text not found: disgusting' WHEN n = 1 THEN 'inserted 2 paragraphs' ELSE 'text is ambiguous: ' || n || ' occurrences of disgusting' END AS message FROM c
UNION ALL SELECT doc_id, 2, m = 1, CASE WHEN m = 0 THEN 'text not found: trash' WHEN m = 1 THEN 'deleted 1 paragraphs' ELSE 'text is ambiguous: ' || m || ' paragraphs have trash' END FROM c
UNION ALL SELECT doc_id, 3, m > 2, CASE WHEN m < 2 THEN 'text not found: trash' WHEN m = 2 THEN 'occurrence [1, 3] of 2' ELSE 'deleted 2 paragraphs' END FROM (SELECT doc_id, CASE WHEN m = 1 THEN 0 ELSE m END AS m FROM c) WHERE m <> 2
UNION ALL SELECT doc_id, 3, FALSE, 'occurrence [1, 3] of 2' FROM c WHERE m = 2
UNION ALL SELECT doc_id, 4, FALSE, 'give either after or before' FROM c UNION ALL SELECT doc_id, 5, FALSE, 'unknown edit type: shuffle' FROM c""")
def paragraph_results(spark, d):
    todo = _block_edits(
        spark, d, BLOCKS[0], {"type": "delete_paragraph_tracked", "find": "trash"}, {"type": "delete_paragraph", "find": "trash", "occurrence": "[1, 3]"}, {"type": "insert_paragraph", "text": "x"}, {"type": "shuffle", "find": "x"}
    )
    return blocks.apply(_p(spark, d), todo)[2].select("doc_id", "seq", "success", "message")


def _styled(spark, d):
    return _p(spark, d).withColumn("style", F.when(_heading(), "Heading1"))


_BLOCK = f"""{P}, q AS (SELECT *, sum(CASE WHEN {HEADING} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p_idx) AS block FROM p),
s AS (SELECT doc_id, min(block) AS block FROM q WHERE block > 0 AND contains(lower(text), 'disgust') GROUP BY doc_id HAVING count(DISTINCT block) = 1)"""


@query(f"""WITH {_BLOCK} SELECT q.doc_id, p_idx, p_idx AS n, CASE WHEN s.block IS NULL THEN text ELSE '' END AS text, CASE WHEN s.block IS NOT NULL AND text <> '' THEN text END AS gone FROM q LEFT JOIN s ON q.doc_id = s.doc_id AND q.block = s.block""")
def section_deleted_tracked(spark, d):
    """The one section that has a text, its paragraphs deleted as tracked changes."""
    return blocks.apply(_styled(spark, d), _block_edits(spark, d, {"type": "delete_section_tracked", "heading": "Disgust"}))[0].select("doc_id", "p_idx", "n", "text", "gone")


@query(f"""WITH {_BLOCK} SELECT q.doc_id, p_idx, CAST(row_number() OVER (PARTITION BY q.doc_id ORDER BY p_idx) - 1 AS INTEGER) AS n, text FROM q LEFT JOIN s ON q.doc_id = s.doc_id AND q.block = s.block WHERE s.block IS NULL""")
def section_deleted(spark, d):
    """The one section that has a text, removed."""
    return blocks.apply(_styled(spark, d), _block_edits(spark, d, {"type": "delete_section", "heading": "Disgust"}))[0].where("not removed").select("doc_id", "p_idx", "n", "text")


@query(f"""WITH p AS (SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS p_idx, unnest(s) AS text FROM (SELECT doc_id, string_split({_SAFE}, chr(10)) AS s FROM documents)), {_EDITED[len(P) + 2:]}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, k) - 1 AS INTEGER) AS p_idx, replace(text, chr(13), chr(10)) AS text, replace(coalesce(gone, text), chr(13), chr(10)) AS text_search, mark_id IS NOT NULL AS mark_deleted FROM r""")
def docx_paragraphs_edited(spark, d):
    """Texts written as packages, paragraphs put in and taken out with tracked changes, saved and read back."""
    packages, found = _packages(spark, d, "runs", "paragraphs")
    before = docx.entity(found, "runs")
    lines, _, _ = blocks.apply(docx.entity(found, "paragraphs"), _block_edits(spark, d, *BLOCKS).withColumn("doc_id", F.col("doc_id").cast("string")))
    lines = written(lines, "lines-after")
    keys = blocks.touched(lines)
    before, after = (df.join(keys, tracked.KEYS, "left_semi") for df in (before, blocks.runs_after(lines, before)))
    saved = docx.saved(packages, tracked.changed_paragraphs(written(after, "runs-after"), before), blocks.spliced(lines))
    return docx.entity(docx.entities(saved, "paragraphs"), "paragraphs").select(F.col("doc_id").cast("long").alias("doc_id"), "p_idx", "text", "text_search", "mark_deleted")


@query(f"WITH {P} SELECT doc_id, p_idx, replace(regexp_replace(text, '(t)(rash)', '\\2-\\1', 'g'), 'worthless', 'w$5.00') AS text FROM p")
def edit_regex(spark, d):
    """Look-around, groups, dollar signs, and a pattern that can't be read among them."""
    rows = ({"find": "(?<=w)orthless", "replace": "$5.00"}, {"find": "(", "replace": "x"}, {"find": "(?P<t>t)(rash)", "replace": "\\2-\\g<t>"})
    return _lines(spark, d, tracked.apply(_runs(spark, d), _edits(spark, d, *({"type": "replace", "regex": True, "occurrence": "all", **r} for r in rows)))[0])


@query(f"""WITH {P}, {_SPLIT.format(find='the')}, n AS (SELECT doc_id, max(k) AS n FROM h GROUP BY doc_id)
SELECT h.doc_id, p_idx, string_agg(CASE WHEN i = 0 THEN t WHEN k IN (1, 3) AND n.n >= 3 THEN 'THE' || t ELSE 'the' || t END, '' ORDER BY i) AS text FROM h JOIN n ON h.doc_id = n.doc_id GROUP BY h.doc_id, p_idx""")
def edit_occurrences(spark, d):
    return _lines(spark, d, tracked.apply(_runs(spark, d), _edits(spark, d, {"type": "replace", "find": "the", "replace": "THE", "occurrence": "[1, 3]"}))[0])


_WORDS = ("worthless", "trash", "idiot", "disgusting", "with", "from", "that", "was", "und", "der", "que", "les")


@query(f"WITH {P} SELECT doc_id, p_idx, replace({'replace(' * len(_WORDS)}text{''.join(f''', '{w}', '<{i}>')''' for i, w in enumerate(_WORDS))}, '<1>', '<one>') AS text FROM p")
def edit_batch(spark, d):
    """A dozen edits that can't meet, and one that sees what they left."""
    rows = [{"type": "replace", "find": w, "replace": f"<{i}>", "occurrence": "all"} for i, w in enumerate(_WORDS)]
    return _lines(spark, d, tracked.apply(_runs(spark, d), _edits(spark, d, *rows, {"type": "replace", "find": "<1>", "replace": "<one>", "occurrence": "all"}))[0])


@query(f"WITH {P} SELECT doc_id, p_idx, replace(text, 'worthless', 'worth little') AS text, text AS before FROM p WHERE contains(text, 'worthless')")
def hunks_applied(spark, d):
    """Lines brought to another version, only the words that differ marked: what stands there now, and what comes back when all is rejected."""
    runs = _runs(spark, d).where("text like '%worthless%'")
    after, _ = tracked.replaced_minimal(runs, runs.select(*tracked.KEYS, F.regexp_replace("text", "worthless", "worth little").alias("new")))
    back = tracked.visible(after.where("not in_ins").withColumn("text", F.concat("text", F.coalesce("del_text", F.lit("")))))
    return tracked.visible(after).join(back.withColumnRenamed("text", "before"), tracked.KEYS).select("doc_id", "p_idx", "text", "before")


@query(f"""WITH {P}, {_SPLIT.format(find='with that')} SELECT doc_id, CAST(CAST(2 * k - 1 AS BIGINT) AS VARCHAR) AS change_id, 'deletion' AS change_type, 'that' AS text FROM h WHERE i > 0
UNION ALL SELECT doc_id, CAST(CAST(2 * k AS BIGINT) AS VARCHAR), 'insertion', 'this' FROM h WHERE i > 0""")
def edit_minimal(spark, d):
    """A replacement that keeps its first word marks the second alone."""
    todo = _edits(spark, d, {"type": "replace_tracked", "find": "with that", "replace": "with this", "occurrence": "all"}).withColumn("minimal", F.lit(True))
    return tracked.apply(_runs(spark, d), todo)[1].select("doc_id", "change_id", "change_type", "text")


def _cells(spark, d):
    """Names of nations as the cells of one table a region."""
    cells = read(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.lit(tracked.BODY).alias("part"), F.col("n_nationkey").alias("p_idx"), F.lit(0).alias("tbl_idx"), F.col("n_nationkey").alias("row_idx"), F.lit(0).alias("cell_idx"), F.col("n_name").alias("text"))
    return cells, cells.select("doc_id", "part", "p_idx", F.lit(0).alias("r_idx"), "text")


@query("""WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_nationkey AS row_idx, n_name AS t, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS a, max(n_nationkey) OVER (PARTITION BY n_regionkey) AS b FROM nation)
SELECT doc_id, row_idx, CASE WHEN row_idx = a THEN '> ' ELSE '' END || t || CASE WHEN row_idx = n_.m THEN ' (sic)' ELSE '' END || CASE WHEN row_idx = b THEN ' end' ELSE '' END AS text FROM n JOIN (SELECT CAST(n_regionkey AS BIGINT) AS d, min(n_nationkey) AS m FROM nation GROUP BY n_regionkey) n_ ON n.doc_id = n_.d""")
def cells_at_refs(spark, d):
    """Text put at the ends of a table and of its first cell, by their references."""
    cells, runs = _cells(spark, d)
    first = cells.groupBy("doc_id").agg(F.min("row_idx").alias("r"))
    row = F.concat(F.lit("tbl:0/row:"), F.col("r"), F.lit("/cell:0"))
    given = [(1, F.lit("tbl:0"), "> ", "before"), (2, row, " (sic)", "end"), (3, F.lit("tbl:0"), " end", "end")]
    todo = first.select("doc_id", F.explode(F.array(*(F.struct(F.lit(i).alias("seq"), ref.alias("ref"), F.lit(text).alias("text"), F.lit(at).alias("position"), F.lit(True).alias("track")) for i, ref, text, at in given))).alias("e")).select("doc_id", "e.*")
    after = by_ref.insert(cells, runs, todo)[1]
    return tracked.visible(after).select("doc_id", F.col("p_idx").alias("row_idx"), "text")


@query("""WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_nationkey AS row_idx, n_name AS t, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS hit FROM nation)
SELECT doc_id, row_idx, CASE WHEN hit THEN '' ELSE t END AS text, CASE WHEN hit THEN t ELSE '' END AS gone FROM n""")
def rows_deleted_at_refs(spark, d):
    cells, runs = _cells(spark, d)
    todo = cells.groupBy("doc_id").agg(F.min("row_idx").alias("r")).select("doc_id", F.lit(1).alias("seq"), F.concat(F.lit("tbl:0/row:"), F.col("r")).alias("ref"), F.lit(True).alias("track"))
    after = by_ref.delete(cells, runs, todo)[0]
    gone = after.groupBy(*tracked.KEYS).agg(F.max("del_text").alias("gone"))
    return tracked.visible(after).join(gone, tracked.KEYS).select("doc_id", F.col("p_idx").alias("row_idx"), "text", F.coalesce("gone", F.lit("")).alias("gone"))


@query(f"""WITH {P}, r AS (SELECT doc_id, p_idx AS o, 0 AS k, text || CASE WHEN p_idx = 0 THEN ' (amended)' ELSE '' END AS text FROM p UNION ALL SELECT doc_id, 1, 1, 'New clause.' FROM p WHERE p_idx = 1 UNION ALL SELECT doc_id, 0, -1, 'Title' FROM p WHERE p_idx = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, k) - 1 AS INTEGER) AS n, text FROM r""")
def paragraphs_at_refs(spark, d):
    """New paragraphs beside p:0 and p:1, and text at the end of p:0."""
    given = [(1, "p:1", "New clause.", "after"), (2, "p:0", "Title", "before"), (3, "p:0", " (amended)", "end")]
    one = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(ref).alias("ref"), F.lit(text).alias("text"), F.lit(at).alias("position"), F.lit(True).alias("track")) for i, ref, text, at in given))
    todo = read(spark, d, "documents").select("doc_id", F.explode(one).alias("e")).select("doc_id", "e.*")
    lines, runs, _, _ = by_ref.insert(_p(spark, d), _runs(spark, d), todo)
    now = tracked.visible(runs).select("doc_id", "p_idx", F.col("text").alias("now"))
    return lines.join(now, ["doc_id", "p_idx"], "left").select("doc_id", "n", F.coalesce("now", "text").alias("text"))


@query("""WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, min(n_nationkey) AS a, max(n_nationkey) AS b, string_agg(n_name, '' ORDER BY n_nationkey) AS t FROM nation GROUP BY n_regionkey)
SELECT doc_id, '0' AS comment_id, a AS start_p_idx, b AS end_p_idx, t AS marked_text, 'Why?' AS text, 'OM' AS initials FROM n""")
def comments_at_refs(spark, d):
    cells, _ = _cells(spark, d)
    none = lambda kinds: spark.createDataFrame([], kinds)
    todo = cells.select("doc_id").distinct().select("doc_id", F.lit(1).alias("seq"), F.lit("tbl:0").alias("ref"), F.lit("Why?").alias("text"), F.lit("Olga Mir").alias("author"))
    comments, ranges, _ = by_ref.comment(cells, none("doc_id long, comment_id string, author string, initials string, date string, text string, para_id string"), none("doc_id long, comment_id string, start_p_idx int, end_p_idx int, marked_text string"), todo)
    return comments.join(ranges, ["doc_id", "comment_id"]).select("doc_id", "comment_id", "start_p_idx", "end_p_idx", "marked_text", "text", "initials")


@query(f"""WITH {RUNS} SELECT doc_id, CASE WHEN change_id % 3 = 0 AND in_del THEN NULL ELSE change_id END AS change_id, CASE WHEN change_id % 3 = 0 AND in_del THEN del_text ELSE text END AS text, in_ins, CASE WHEN change_id % 3 = 0 THEN FALSE ELSE in_del END AS in_del FROM runs WHERE NOT (change_id % 3 = 0 AND in_ins)""")
def groups_rejected(spark, d):
    """The changes of one group rejected, those of others kept."""
    runs = change_runs(spark, d)
    members = runs.select("doc_id", "change_id", F.when(F.col("change_id") % 3 == 0, "round 1").otherwise("round 2").alias("group_name"))
    return changes.decided_groups(runs.withColumn("change_id", F.col("change_id").cast("string")), members, False, "round 1")[0].select("doc_id", F.col("change_id").cast("long").alias("change_id"), "text", "in_ins", "in_del")


def _xml(spark, d, encoding="ISO-8859-1"):
    """(doc_id, xml): texts as bare main parts, every seventh of them said to be in another encoding."""
    runs = _runs(spark, d).withColumn("text", F.regexp_replace("text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))
    bare = runs.withColumns({c: F.lit(None).cast(t) for c, t in (("bold", "boolean"), ("italic", "boolean"), ("color", "string"))})
    xml = docx.document_xml(bare, _p(spark, d).withColumn("style", F.lit(None).cast("string")))
    return xml.withColumn("xml", F.when(F.col("doc_id") % 7 == 0, F.replace("xml", F.lit('encoding="UTF-8"'), F.lit(f'encoding="{encoding}"'))).otherwise(F.col("xml")))


@query("SELECT doc_id, 'word/document.xml' AS part, 'encoding' AS rule, 'ISO-8859-1' AS detail FROM documents WHERE doc_id % 7 = 0 AND text IS NOT NULL")
def package_problems(spark, d):
    return docx.problems(docx.zipped(_xml(spark, d))).select(F.col("doc_id").cast("long").alias("doc_id"), "part", "rule", "detail")


@query(f"""SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS p_idx, replace(unnest(s), chr(13), chr(10)) AS text FROM (SELECT doc_id, string_split({_SAFE}, chr(10)) AS s FROM documents)""")
def xml_paragraphs(spark, d):
    """Bare main parts read as documents; a carriage return is a line end to XML."""
    return docx.entity(docx.entities_of_xml(_xml(spark, d, "UTF-8")), "paragraphs").select(F.col("doc_id").cast("long").alias("doc_id"), "p_idx", "text")


@query("SELECT p_partkey, p_name || ' it''s \"new\"' AS text FROM part")
def quotes_denormalized(spark, d):
    return read(spark, d, "part").select("p_partkey", T.denormalize_quotes(F.concat("p_name", F.lit(" it’s “new”"))).alias("text"))


def _packages(spark, d, *kinds):
    """(packages, entities of some kinds) of texts, each line a paragraph: written, so that each is zipped once and parsed once."""
    packages = written(docx.zipped(_xml(spark, d, "UTF-8")), "packages")
    return packages, written(docx.entities(packages, *kinds), "entities")


_LINKED = f"""p AS (SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS p_idx, replace(unnest(s), chr(13), chr(10)) AS text FROM (SELECT doc_id, string_split({_SAFE}, chr(10)) AS s FROM documents)),
c AS (SELECT doc_id, CAST(sum((length(text) - length(replace(text, 'disgusting', ''))) // 10) AS BIGINT) AS n FROM p GROUP BY doc_id)"""


@query(f"WITH {_LINKED} SELECT p.doc_id, p_idx, CASE WHEN n = 1 THEN replace(text, 'disgusting', 'disgusting (see <note>)') ELSE text END AS text FROM p JOIN c ON p.doc_id = c.doc_id")
def docx_links_saved(spark, d):
    """A link with its relationship put behind a text that stands once in a package, saved and read back."""
    packages, found = _packages(spark, d, "paragraphs", "relationships")
    todo = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("seq"), F.lit(" (see <note>)").alias("text"), F.lit("disgusting").alias("after"), F.lit("http://a.b/?c&d").alias("url"), F.lit(None).cast("string").alias("anchor"))
    put, _ = parts.links(docx.entity(found, "paragraphs"), docx.entity(found, "relationships"), todo)
    again = docx.entities(parts.patched(packages, put), "paragraphs")
    return docx.entity(again, "paragraphs").select(F.col("doc_id").cast("long").alias("doc_id"), "p_idx", "text")


@query(f"WITH {_LINKED} SELECT doc_id, 'word/document.xml' AS part, 'rId2' AS rel_id, 'image' AS rel_type, 'media/image1.png' AS target, CAST(1371600 AS BIGINT) AS width, CAST(914400 AS BIGINT) AS height, 'insertion' AS change_type FROM c WHERE n = 1")
def docx_pictures_saved(spark, d):
    """A picture put behind a text as a tracked change, saved with its part and relationship, and read back."""
    packages, found = _packages(spark, d, "paragraphs", "relationships", "parts")
    todo = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("seq"), F.lit("seal").alias("name"), F.lit("png").alias("extension"), F.lit(b"bytes of a picture").alias("content"), F.lit(1.5).alias("width_inches"), F.lit(1.0).alias("height_inches"), F.lit("disgusting").alias("after"), F.lit(True).alias("track"))
    put, _ = parts.images(docx.entity(found, "paragraphs"), docx.entity(found, "relationships"), docx.entity(found, "parts"), todo)
    again = written(docx.entities(parts.patched(packages, put), "images", "relationships", "parts", "changes"), "entities")
    seen = docx.entity(again, "images").join(docx.entity(again, "relationships").select("doc_id", F.col("source_part").alias("part"), "rel_id", "rel_type", "target"), ["doc_id", "part", "rel_id"])
    there = docx.entity(again, "parts").select("doc_id", F.substring("part", 6, 100).alias("target"))
    rows = seen.join(there, ["doc_id", "target"]).join(docx.entity(again, "changes").select("doc_id", "p_idx", "change_type"), ["doc_id", "p_idx"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "part", "rel_id", "rel_type", "target", "width", "height", "change_type")


@query("SELECT doc_id, '0' AS comment_id, CAST(0 AS INTEGER) AS start_p_idx, CAST(0 AS INTEGER) AS end_p_idx, 'Is this & that so?' AS text FROM documents WHERE text IS NOT NULL")
def docx_comments_saved(spark, d):
    """A comment on the first paragraph of packages without comments, saved with its part and read back."""
    packages, found = _packages(spark, d, "comments", "comment_ranges", "paragraphs", "relationships")
    before, ranges = docx.entity(found, "comments"), docx.entity(found, "comment_ranges").drop("part")
    todo = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("seq"), F.lit("p:0").alias("ref"), F.lit("Is this & that so?").alias("text"), F.lit("Olga").alias("author"))
    after, places, _ = by_ref.comment(docx.entity(found, "paragraphs"), before, ranges, todo)
    put = parts.comments(before, after, places, docx.entity(found, "relationships"))
    again = written(docx.entities(parts.patched(packages, put), "comments", "comment_ranges"), "entities")
    spots = docx.entity(again, "comment_ranges").select("doc_id", "comment_id", "start_p_idx", "end_p_idx")
    return docx.entity(again, "comments").select("doc_id", "comment_id", "text").join(spots, ["doc_id", "comment_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), "comment_id", "start_p_idx", "end_p_idx", "text")


@query(f"""WITH {P}, x AS (SELECT doc_id, min(p_idx) FILTER (contains(text, 'disgusting')) AS a, min(p_idx) FILTER (contains(text, 'trash') AND text LIKE 'The%') AS c FROM p GROUP BY doc_id),
e AS (SELECT doc_id, a AS p_idx, 1 AS seq, 'center' AS al, NULL AS sp, NULL AS ind FROM x WHERE a IS NOT NULL UNION ALL SELECT doc_id, 0, 2, 'justify', 12.0, NULL FROM x UNION ALL SELECT doc_id, c, 3, NULL, NULL, 0.5 FROM x WHERE c IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS id FROM e)
SELECT doc_id, p_idx, arg_max(al, seq) FILTER (al IS NOT NULL) AS alignment, CAST(max(sp) AS DOUBLE) AS spacing_after, CAST(max(ind) AS DOUBLE) AS indent_left, CAST(max(id) AS VARCHAR) AS change_id FROM n GROUP BY doc_id, p_idx""")
def paragraphs_formatted(spark, d):
    """Three edits of paragraph properties, which may meet in one paragraph."""
    null = lambda kind: F.lit(None).cast(kind)
    given = [("disgusting", None, None, "center", None, None), (None, None, 0, "justify", 12.0, None), ("trash", "The", None, None, None, 0.5)]
    names = {"containing": "string", "starting_with": "string", "index": "int", "alignment": "string", "spacing_after": "double", "indent_left": "double"}
    one = F.array(*(F.struct(F.lit(i).alias("seq"), *(F.lit(v).cast(k).alias(n) for (n, k), v in zip(names.items(), row, strict=True))) for i, row in enumerate(given, 1)))
    todo = read(spark, d, "documents").select("doc_id", F.explode(one).alias("e")).select("doc_id", "e.*")
    none = read(spark, d, "documents").where("false").select("doc_id", F.lit(0).alias("p_idx"), null("string").alias("alignment"))
    return formatting.format_paragraphs(_p(spark, d), none, todo)[0].select("doc_id", "p_idx", "alignment", "spacing_after", "indent_left", "change_id")


@query(f"""WITH {_LINKED}, b AS (SELECT doc_id, min(p_idx) FILTER (contains(text, 'disgusting')) AS p_idx FROM p GROUP BY doc_id)
SELECT c.doc_id, b.p_idx, 'PAGEREF start \\h' AS code, '?' AS display, TRUE AS dirty FROM c JOIN b ON c.doc_id = b.doc_id WHERE n = 1""")
def docx_references_saved(spark, d):
    """A page reference put behind a text that stands once in a package, saved as a field and read back."""
    packages, found = _packages(spark, d, "paragraphs")
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    marks = docs.select("doc_id", F.lit("start").alias("name"), F.lit(0).alias("p_idx"), F.lit("").alias("preview"))
    todo = docs.select("doc_id", F.lit(1).alias("seq"), F.lit("start").alias("target"), F.lit("disgusting").alias("after"), F.lit("page").alias("display"))
    put, _ = parts.references(docx.entity(found, "paragraphs"), marks, todo)
    return docx.entity(docx.entities(parts.patched(packages, put), "fields"), "fields").select(F.col("doc_id").cast("long").alias("doc_id"), "p_idx", "code", "display", "dirty")


_LATER = f"""{P}, v AS (SELECT doc_id, p_idx, CASE WHEN p_idx % 5 = 2 THEN 'Revised. ' || text ELSE text END AS text FROM p WHERE p_idx % 7 <> 4)"""


@query(f"WITH {_LATER} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p_idx) - 1 AS k, text FROM v")
def versions_applied(spark, d):
    """Documents brought to a later version by tracked changes: what stands there once all is accepted is that version."""
    old, new = _versions(spark, d)
    old, new = (df.withColumnRenamed("pair_id", "doc_id") for df in (old, new))
    # Lines of the new version are numbered without gaps.
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("p_idx")) - 1
    lines, runs, _ = versions.applied(old, _runs(spark, d), new.withColumn("p_idx", number.cast("int")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1
    return versions.visible(lines, runs).select("doc_id", rank.cast("long").alias("k"), "text")
