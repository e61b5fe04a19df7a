"""Registered queries over the driver's tables, each with the SQL that must give the same rows.

The tables play the parts of documents: lines of `documents` are paragraphs, `pages` have headings
and links, turns of `conversations` are comments, `events` are tracked changes, rows of `lineitem`
are table rows, and `supplier` and `nation` are notes and their references.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import critic
from inkloom.functions import text as T
from inkloom.operators import changes as C
from inkloom.operators import diff, edits, entity_edits, export, links, search, structure
from inkloom.sources import docx
from inkloom.sources.tables import chat_comments, event_changes, page_headings, page_links, paragraphs, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

P = "p AS (SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS p_idx, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
HEADING = "length(text) BETWEEN 1 AND 60"
SHORT = "CASE change_type WHEN 'insertion' THEN 'insert' WHEN 'deletion' THEN 'delete' WHEN 'format_run' THEN 'format' WHEN 'format_paragraph' THEN 'format' ELSE change_type END"
EV = """ch AS (SELECT event_id // 50 AS doc_id, event_id AS change_id, CASE event_type WHEN 'click' THEN 'insertion' WHEN 'view' THEN 'deletion' WHEN 'purchase' THEN 'format_run' WHEN 'signup' THEN 'move_to' WHEN 'error' THEN 'move_from' ELSE 'insertion' END AS change_type,
  'user' || (user_id % 20) AS author, ts AS date, 'value ' || CAST(floor(value) AS BIGINT) AS text FROM events)"""
RUNS = f"""{EV}, runs AS (SELECT doc_id, change_id, author, CASE WHEN change_type = 'deletion' THEN '' ELSE text END AS text, CASE WHEN change_type = 'deletion' THEN text ELSE '' END AS del_text,
  change_type = 'insertion' AS in_ins, change_type = 'deletion' AS in_del FROM ch)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _p(spark, d):
    return paragraphs(read(spark, d, "documents"))


def _heading():
    return F.expr(HEADING)


def _changes(spark, d):
    return event_changes(read(spark, d, "events"))


def _runs(spark, d):
    gone = F.col("change_type") == "deletion"
    return _changes(spark, d).select(
        "doc_id", "change_id", "author", F.when(gone, "").otherwise(F.col("text")).alias("text"), F.when(gone, F.col("text")).otherwise("").alias("del_text"),
        (F.col("change_type") == "insertion").alias("in_ins"), gone.alias("in_del"),
    )


# Search


def _literal_sql(find: str, fold: bool = False, where: str = "TRUE", extra: str = "", source: str = "p") -> str:
    t, f = ("lower(text)", find.lower()) if fold else ("text", find)
    n = len(find)
    return f"""WITH {P}{extra}, hit AS (
  SELECT doc_id, p_idx, text, unnest(list_filter(range(0, length({t}) - {n} + 1), lambda i: substr({t}, i + 1, {n}) = '{f}')) AS pos FROM {source} WHERE contains({t}, '{f}') AND {where}),
h AS (SELECT *, substr(text, pos + 1, {n}) AS found, row_number() OVER (PARTITION BY doc_id ORDER BY p_idx, pos) - 1 AS index FROM hit),
c AS (SELECT *, strpos(text, found) AS spot FROM h)
SELECT doc_id, p_idx, CAST(index AS INTEGER) AS index, CAST(pos AS INTEGER) AS pos, CAST({n} AS INTEGER) AS len, found,
  (CASE WHEN spot > 41 THEN '...' ELSE '' END) || substr(text, CAST(greatest(spot - 40, 1) AS BIGINT), CAST(least(spot + {n} + 40, length(text) + 1) - greatest(spot - 40, 1) AS BIGINT)) || (CASE WHEN spot + {n} + 40 <= length(text) THEN '...' ELSE '' END) AS context
FROM c"""


@query(_literal_sql("the"))
def find_all_literal(spark, d):
    return search.find_all(_p(spark, d), "the")


@query(_literal_sql("The", fold=True))
def find_all_ignore_case(spark, d):
    return search.find_all(_p(spark, d), "The", case_sensitive=False)


@query(_literal_sql("and", where="contains(text, 'with')"))
def find_all_scope_contains(spark, d):
    return search.find_all(_p(spark, d), "and", scope={"contains": "with"})


@query(_literal_sql("and", where="NOT contains(text, 'with')"))
def find_all_scope_not_contains(spark, d):
    return search.find_all(_p(spark, d), "and", scope={"not_contains": "with"})


_SECTION = f", q AS (SELECT *, last_value(CASE WHEN {HEADING} THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM p)"


@query(_literal_sql("and", where=f"contains(section, 'the') AND NOT ({HEADING})", extra=_SECTION, source="q"))
def find_all_scope_section(spark, d):
    return search.find_all(search.with_sections(_p(spark, d), _heading()), "and", scope="section:the", heading=_heading())


_REGEX = f"""WITH {P}, m AS (SELECT doc_id, p_idx, text, regexp_extract_all(text, '[A-Z][a-z]+ing', 0) AS m, string_split_regex(text, '[A-Z][a-z]+ing') AS g FROM p WHERE regexp_matches(text, '[A-Z][a-z]+ing')),
x AS (SELECT doc_id, p_idx, text, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(pos := list_sum(list_transform(list_slice(g, 1, i), lambda s: length(s))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda s: length(s))), 0), found := m[i]))) AS x FROM m)
SELECT doc_id, p_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p_idx, x.pos) - 1 AS INTEGER) AS index, CAST(x.pos AS INTEGER) AS pos, CAST(length(x.found) AS INTEGER) AS len, x.found AS found FROM x"""


@query(_REGEX)
def find_all_regex(spark, d):
    return search.find_all(_p(spark, d), "[A-Z][a-z]+ing", regex=True).drop("context")


def _occurrence_sql(test: str) -> str:
    return f"SELECT doc_id, p_idx, pos FROM (SELECT *, max(index) OVER (PARTITION BY doc_id) AS last FROM ({_literal_sql('the')})) WHERE {test}"


@query(_occurrence_sql("index = 0"))
def occurrence_first(spark, d):
    return search.occurrences(search.find_all(_p(spark, d), "the"), "first").select("doc_id", "p_idx", "pos")


@query(_occurrence_sql("index = last"))
def occurrence_last(spark, d):
    return search.occurrences(search.find_all(_p(spark, d), "the"), "last").select("doc_id", "p_idx", "pos")


@query(_occurrence_sql("index IN (1, 3)"))
def occurrence_numbers(spark, d):
    return search.occurrences(search.find_all(_p(spark, d), "the"), [2, 4]).select("doc_id", "p_idx", "pos")


@query(f"""WITH n AS (SELECT doc_id, count(*) AS n FROM ({_literal_sql('worthless')}) GROUP BY doc_id)
SELECT DISTINCT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM documents LEFT JOIN n USING (doc_id)""")
def unique_matches(spark, d):
    return search.uniqueness(search.find_all(_p(spark, d), "worthless"), read(spark, d, "documents"))


@query(f"WITH {P} SELECT doc_id, p_idx, CAST(len(regexp_extract_all(text, '\\s+|[\\p{{L}}\\p{{M}}\\p{{N}}_]+(?:[''’‘\\-][\\p{{L}}\\p{{M}}\\p{{N}}_]+)*|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]')) AS INTEGER) AS n_tokens FROM p")
def tokenize_counts(spark, d):
    return _p(spark, d).select("doc_id", "p_idx", F.size(T.tokens(F.col("text"))).alias("n_tokens"))


_FROM, _TO = "".join(T.SPECIAL), "".join(T.SPECIAL.values())


@query(f"""SELECT p_partkey, translate(p_name || ' ' || substr('{_FROM}', CAST(p_partkey % 17 + 1 AS BIGINT), 1) || p_brand, '{_FROM}', '{_TO.replace("'", "''")}') AS text FROM part""")
def normalize_special(spark, d):
    odd = F.substr(F.lit(_FROM), (F.col("p_partkey") % 17 + 1).cast("int"), F.lit(1))
    return read(spark, d, "part").select("p_partkey", T.normalize_special(F.concat("p_name", F.lit(" "), odd, "p_brand")).alias("text"))


@query("""SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '[“”]') THEN 'has typographic double quotes' END, CASE WHEN regexp_matches(text, '[‘’]') THEN 'has typographic single quotes' END,
  CASE WHEN contains(text, chr(160)) THEN 'has a space that keeps words together' END, CASE WHEN contains(text, chr(8203)) THEN 'has an invisible space' END,
  CASE WHEN contains(text, chr(9)) THEN 'has a tab' END, CASE WHEN contains(text, chr(10)) OR contains(text, chr(13)) THEN 'spans several lines' END], lambda x: x IS NOT NULL) AS issues FROM documents""")
def suggest_issues(spark, d):
    return read(spark, d, "documents").select("doc_id", T.common_issues(F.col("text")).alias("issues"))


@query(f"""WITH {P}, l AS (SELECT doc_id, max(contains(lower(text), 'worthless  ')) AS loose FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN loose THEN ['it has spaces in a row: one may be enough', 'white space at its ends: search for <Worthless>', 'it is there in other capitals']
  ELSE ['it has spaces in a row: one may be enough', 'white space at its ends: search for <Worthless>'] END AS suggestions FROM l""")
def suggestions(spark, d):
    return search.suggestions(_p(spark, d), "Worthless  ")


@query(f"""WITH {P}, e AS (SELECT d.doc_id, b.item_id AS seq, b.text AS find FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id % 40),
h AS (SELECT e.doc_id, e.seq, sum((length(p.text) - length(replace(p.text, e.find, ''))) // length(e.find)) AS n FROM e JOIN p ON e.doc_id = p.doc_id AND contains(p.text, e.find) GROUP BY ALL)
SELECT e.doc_id, e.seq, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'failed' END AS status FROM e LEFT JOIN h ON e.doc_id = h.doc_id AND e.seq = h.seq""")
def batch_dry_run(spark, d):
    docs, bench = read(spark, d, "documents"), read(spark, d, "benchmark")
    todo = docs.join(bench.select(F.col("item_id").alias("seq"), F.col("text").alias("find")), F.col("doc_id") % 40 == F.col("seq") % 40).select("doc_id", "seq", "find")
    return search.dry_run(_p(spark, d), todo)


def _similarity(find: str, window: str) -> str:
    """SQL for 2 * LCS / (both lengths) of a text and a column, row by row of bits."""
    bits = " ".join(f"WHEN '{c}' THEN {sum(1 << i for i, x in enumerate(find) if x == c)}" for c in sorted(set(find)))
    full, m = (1 << len(find)) - 1, len(find)
    masks = f"list_transform(string_split({window}, ''), lambda c: CAST(CASE c {bits} ELSE 0 END AS BIGINT))"
    row = f"list_reduce(list_prepend(CAST({full} AS BIGINT), {masks}), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})"
    return f"2 * ({m} - bit_count({row})) / ({m} + length({window}))"


_FIND = "worthles"
_LETTERS = " + ".join(f"CAST(contains(win, '{c}') AS INTEGER)" for c in sorted(set(_FIND)))


@query(f"""WITH {P}, w AS (SELECT doc_id, p_idx, n, spot, substr(text, spot + 1, n) AS win FROM (SELECT *, unnest(range(0, length(text) - n + 1)) AS spot FROM p, (SELECT unnest([6, 7, 8, 9, 10]) AS n) WHERE length(text) >= n)),
s AS (SELECT *, {_similarity(_FIND, "win")} AS score FROM w WHERE 2 * ({_LETTERS}) >= 0.85 * ({len(_FIND)} + n)),
g AS (SELECT doc_id, p_idx, list([{{'spot': spot, 'n': n, 'found': win, 'score': score}}] ORDER BY score DESC, spot, n) AS xs FROM s WHERE score >= 0.85 GROUP BY doc_id, p_idx),
b AS (SELECT doc_id, p_idx, unnest(list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].spot < y.spot + y.n AND y.spot < x[1].spot + x[1].n)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS x FROM g)
SELECT doc_id, p_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p_idx, x.spot) - 1 AS INTEGER) AS index, CAST(x.spot AS INTEGER) AS pos, CAST(x.n AS INTEGER) AS len, x.found AS found, x.score AS score FROM b""")
def fuzzy_find(spark, d):
    return search.find_all(_p(spark, d), "worthles", fuzzy={"threshold": 0.85})


@query(f"""WITH {P}, t AS (SELECT doc_id, p_idx, regexp_extract_all(text, '\\S+') AS w FROM p),
v AS (SELECT doc_id, array_to_string(w[i:j], ' ') AS win FROM (SELECT doc_id, w, i, unnest(range(i, least(len(w), i + 6) + 1)) AS j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t))),
s AS (SELECT doc_id, min(win) AS found, lower(win) AS low FROM v WHERE length(win) BETWEEN 7 AND 13 GROUP BY doc_id, lower(win)),
r AS (SELECT doc_id, found, low, {_similarity("worthless", "low")} AS score FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, low) AS INTEGER) AS rank, found, score FROM r WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, low) <= 3""")
def similar_topk(spark, d):
    return search.similar_texts(_p(spark, d), "worthless", k=3, least=0.6)


# Structure


@query(f"WITH {P} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY p_idx) AS text FROM p GROUP BY doc_id")
def doc_text(spark, d):
    return structure.document_text(_p(spark, d))


@query(f"""WITH {P}, s AS (SELECT *, {HEADING} AS h, CAST(sum(CAST({HEADING} AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p_idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS section_id FROM p)
SELECT doc_id, section_id, arg_min(text, p_idx) FILTER (h) AS heading, min(p_idx) AS start_idx, max(p_idx) + 1 AS end_idx, count(*) AS n_paragraphs,
  arg_min(substr(text, 1, 100), p_idx) FILTER (NOT h AND trim(text, ' ') <> '') AS preview FROM s GROUP BY doc_id, section_id""")
def section_groups(spark, d):
    return structure.sections(_p(spark, d), _heading())


@query(f"""WITH {P}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
a AS (SELECT *, coalesce(lead(p_idx) OVER (PARTITION BY doc_id ORDER BY p_idx), n) AS nx FROM n WHERE {HEADING})
SELECT doc_id, text AS heading, p_idx AS start_idx, CAST(coalesce(lead(p_idx) OVER (PARTITION BY doc_id ORDER BY p_idx), n) AS INTEGER) AS end_idx FROM a WHERE nx - p_idx >= 2""")
def section_bounds(spark, d):
    return structure.section_bounds(_p(spark, d), _heading(), micro=2)


@query(f"""WITH {P}, b AS (SELECT *, length(text) < 25 AS blank FROM p), i AS (SELECT *, sum(CAST(blank AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p_idx) AS island FROM b)
SELECT doc_id, min(p_idx) AS start_idx, max(p_idx) + 1 AS end_idx, count(*) AS n FROM i WHERE NOT blank GROUP BY doc_id, island HAVING count(*) >= 2""")
def blank_line_blocks(spark, d):
    # Short lines stand for blank ones: these texts have none.
    return structure.blank_line_blocks(_p(spark, d).withColumn("text", F.when(F.length("text") < 25, "").otherwise(F.col("text"))))


@query(f"""WITH {P}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
SELECT doc_id, min(p_idx) AS start_idx, max(p_idx) + 1 AS end_idx FROM n GROUP BY doc_id, CASE WHEN n <= 20 THEN 0 ELSE p_idx // 10 END""")
def chunk_fallback(spark, d):
    return structure.chunks(_p(spark, d))


_NUMBERED = " OR ".join(f"regexp_matches(trim(text, ' '), '(?i){p}')" for p in T.NUMBERED)


@query(f"""WITH {P}, t AS (SELECT *, CASE WHEN trim(text, ' ') <> '' AND length(trim(text, ' ')) <= 100 AND ((upper(trim(text, ' ')) = trim(text, ' ') AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 2) OR {_NUMBERED}) THEN 3 END AS tier FROM p),
b AS (SELECT *, min(tier) OVER (PARTITION BY doc_id) AS best, count(*) OVER (PARTITION BY doc_id) AS n FROM t),
h AS (SELECT doc_id, text AS heading, p_idx AS start_idx, CAST(coalesce(lead(p_idx) OVER (PARTITION BY doc_id ORDER BY p_idx), n) AS INTEGER) AS end_idx FROM b WHERE tier = 3),
r AS (SELECT * FROM b WHERE best IS NULL), i AS (SELECT *, trim(text, ' ') = '' AS blank FROM r),
k AS (SELECT *, sum(CAST(blank AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p_idx) AS island FROM i),
g AS (SELECT doc_id, min(p_idx) AS start_idx, max(p_idx) + 1 AS end_idx, count(*) AS n FROM k WHERE NOT blank GROUP BY doc_id, island HAVING count(*) >= 2),
gd AS (SELECT doc_id FROM g GROUP BY doc_id HAVING count(*) > 1), sp AS (SELECT DISTINCT doc_id FROM i WHERE blank AND doc_id IN (SELECT doc_id FROM gd))
SELECT doc_id, heading, start_idx, end_idx, 'heuristic' AS method FROM h WHERE end_idx - start_idx >= 2
UNION ALL SELECT doc_id, NULL, start_idx, end_idx, 'blank_lines' FROM g WHERE doc_id IN (SELECT doc_id FROM sp)
UNION ALL SELECT doc_id, NULL, min(p_idx), max(p_idx) + 1, 'chunks' FROM r WHERE doc_id NOT IN (SELECT doc_id FROM sp) GROUP BY doc_id, CASE WHEN n <= 20 THEN 0 ELSE p_idx // 10 END""")
def section_cascade(spark, d):
    return structure.detect_sections(_p(spark, d))


@query(f"""WITH {P}, {EV}, n AS (SELECT doc_id, count(*) AS n_paragraphs FROM p GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS k FROM ch GROUP BY doc_id)
SELECT doc_id, n_paragraphs, CAST(0 AS BIGINT) AS n_tables, CAST(coalesce(k, 0) AS BIGINT) AS n_changes, n_paragraphs * 100 AS tokens,
  CASE WHEN n_paragraphs < 100 THEN 'small' WHEN n_paragraphs < 300 THEN 'medium' WHEN n_paragraphs < 500 THEN 'large' ELSE 'very_large' END AS tier FROM n LEFT JOIN c USING (doc_id)""")
def size_info(spark, d):
    return structure.size_info(_p(spark, d), changes=_changes(spark, d))


@query(f"""WITH {P}, s AS (SELECT *, {HEADING} AS h, sum(CASE WHEN {HEADING} THEN 0 ELSE length(text) // 4 END) OVER (PARTITION BY doc_id ORDER BY p_idx ROWS UNBOUNDED PRECEDING) AS spent FROM p)
SELECT doc_id, p_idx, h OR spent <= 500 AS kept FROM s""")
def token_budget(spark, d):
    return structure.token_budget(_p(spark, d), 500, _heading()).select("doc_id", "p_idx", "kept")


_PRINT = "replace(replace(rtrim(to_base64(unhex(substr(sha256(substr(text, 1, 200) || '||body'), 1, 12))), '='), '+', '-'), '/', '_')"


@query(f"WITH {P} SELECT doc_id, p_idx, 'p:' || p_idx AS ref, {_PRINT} AS fingerprint FROM p")
def fingerprint_refs(spark, d):
    return structure.refs(_p(spark, d))


@query(f"""WITH {P}, k AS (SELECT doc_id, p_idx, {_PRINT} AS f FROM p), w AS (SELECT doc_id, 'p:~' || f AS ref FROM k WHERE p_idx = 1 UNION ALL SELECT doc_id, 'p:3' FROM documents)
SELECT w.doc_id, w.ref, min(k.p_idx) AS p_idx FROM w LEFT JOIN k ON k.doc_id = w.doc_id AND (w.ref = 'p:' || k.p_idx OR w.ref = 'p:~' || k.f) GROUP BY ALL""")
def resolve_refs(spark, d):
    known = structure.refs(_p(spark, d))
    wanted = known.where("p_idx = 1").select("doc_id", F.concat(F.lit("p:~"), "fingerprint").alias("ref")).unionByName(read(spark, d, "documents").select("doc_id", F.lit("p:3").alias("ref")))
    return structure.resolve(_p(spark, d), wanted)


_CELLS = "cells AS (SELECT l_orderkey AS doc_id, 0 AS tbl_idx, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS INTEGER) AS row_idx, 1 AS cell_idx, l_returnflag || ' ' || l_partkey AS text FROM lineitem)"


def _cells(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("tbl_idx"), (F.row_number().over(w) - 1).alias("row_idx"), F.lit(1).alias("cell_idx"), F.concat("l_returnflag", F.lit(" "), "l_partkey").alias("text"))


@query(f"WITH {_CELLS} SELECT *, count(*) OVER (PARTITION BY doc_id) > 4 AS has_more FROM cells QUALIFY row_idx BETWEEN 2 AND 3")
def table_page(spark, d):
    return structure.page(_cells(spark, d), 2, 2)


@query(f"WITH {_CELLS} SELECT doc_id, tbl_idx, row_idx, cell_idx, text FROM cells WHERE contains(text, 'R 1') QUALIFY row_number() OVER (PARTITION BY doc_id, tbl_idx ORDER BY row_idx, cell_idx) = 1")
def find_cell(spark, d):
    return structure.find_cell(_cells(spark, d), "R 1")


@query(f"""WITH {_CELLS}, k AS (SELECT doc_id, tbl_idx, CAST(row_idx AS DOUBLE) AS spot, cell_idx, text FROM cells WHERE row_idx <> 1 UNION ALL SELECT o_orderkey, 0, 0.5, 1, o_orderstatus FROM orders)
SELECT doc_id, tbl_idx, CAST(dense_rank() OVER (PARTITION BY doc_id, tbl_idx ORDER BY spot) - 1 AS INTEGER) AS row_idx, cell_idx, text FROM k""")
def table_rows_edited(spark, d):
    cells = _cells(spark, d)
    gone = cells.where("row_idx = 1").select("doc_id", "tbl_idx", "row_idx")
    new = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("tbl_idx"), F.lit(0).alias("after_row"), F.lit(1).alias("cell_idx"), F.col("o_orderstatus").alias("text"))
    return edits.rows_edited(cells, gone, new)


# Tracked changes


@query(f"WITH {EV} SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['insertion', 'deletion', 'move_from', 'move_to', 'format_run', 'format_paragraph'], change_type), change_id) - 1 AS INTEGER) AS rank FROM ch")
def changes_list(spark, d):
    return C.listing(_changes(spark, d))


@query(f"WITH {EV} SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY change_id) - 1 AS INTEGER) AS rank FROM ch WHERE change_type = 'insertion' AND author = 'user7'")
def changes_filter(spark, d):
    return C.listing(_changes(spark, d), "insertion", "user7")


@query(f"""WITH {EV} SELECT doc_id, count(*) FILTER (change_type = 'insertion') AS insertions, count(*) FILTER (change_type = 'deletion') AS deletions, count(*) FILTER (change_type = 'move_from') AS moves,
  count(*) FILTER (change_type LIKE 'format%') AS formats, count(*) AS total FROM ch GROUP BY doc_id""")
def change_stats(spark, d):
    return C.statistics(_changes(spark, d))


@query(f"WITH {EV} SELECT doc_id, author AS key, count(*) AS n, list(change_id ORDER BY change_id) AS ids FROM ch GROUP BY ALL")
def changes_by_author(spark, d):
    return C.grouped(_changes(spark, d), "author")


@query(f"WITH {EV} SELECT doc_id, {SHORT} AS key, count(*) AS n, list(change_id ORDER BY change_id) AS ids FROM ch GROUP BY ALL")
def changes_by_type(spark, d):
    return C.grouped(_changes(spark, d), "type")


@query(f"WITH {EV}, s AS (SELECT author, {SHORT} AS kind FROM ch) SELECT author, kind, count(*) AS n FROM s GROUP BY GROUPING SETS ((author), (kind), ())")
def changes_report_sets(spark, d):
    return C.report_sets(_changes(spark, d))


@query(f"WITH {EV} SELECT doc_id, change_id FROM ch WHERE NOT change_type LIKE 'format%' AND contains(lower(text), 'value 1')")
def changes_containing(spark, d):
    return _changes(spark, d).where(C.containing("Value 1")).select("doc_id", "change_id")


@query(f"WITH {EV} SELECT DISTINCT doc_id FROM ch WHERE NOT change_type LIKE 'format%'")
def documents_with_changes(spark, d):
    return C.has_changes(_changes(spark, d))


@query(f"WITH {EV} SELECT doc_id, CAST(max(change_id) + 1 AS INTEGER) AS next_id FROM ch GROUP BY doc_id")
def next_change_id(spark, d):
    return C.next_id(_changes(spark, d))


@query(f"WITH {EV} SELECT doc_id, author AS change_id, count(*) AS n FROM ch GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return C.duplicate_ids(_changes(spark, d).drop("change_id").withColumnRenamed("author", "change_id"))


@query(f"WITH {RUNS} SELECT doc_id, CASE WHEN in_ins THEN NULL ELSE change_id END AS change_id, author, text, CASE WHEN in_ins THEN '' ELSE del_text END AS del_text, FALSE AS in_ins, FALSE AS in_del FROM runs WHERE NOT in_del")
def accept_all(spark, d):
    return C.decided(_runs(spark, d), True)


@query(f"WITH {RUNS} SELECT doc_id, CASE WHEN in_del THEN NULL ELSE change_id END AS change_id, author, CASE WHEN in_del THEN del_text ELSE text END AS text, CASE WHEN in_del THEN '' ELSE del_text END AS del_text, FALSE AS in_ins, FALSE AS in_del FROM runs WHERE NOT in_ins")
def reject_all(spark, d):
    return C.decided(_runs(spark, d), False)


@query(f"""WITH {RUNS} SELECT doc_id, CASE WHEN author = 'user3' AND in_ins THEN NULL ELSE change_id END AS change_id, author, text, del_text, in_ins AND author <> 'user3' AS in_ins, in_del FROM runs WHERE NOT (author = 'user3' AND in_del)""")
def accept_by_author(spark, d):
    return C.decided(_runs(spark, d), True, F.col("author") == "user3")


@query(f"WITH {EV} SELECT doc_id, count(*) AS n FROM ch WHERE author = 'user3' AND change_type NOT LIKE 'move%' GROUP BY doc_id")
def accepted_counts(spark, d):
    return C.decided_changes(_changes(spark, d), True, F.col("author") == "user3")[1]


@query(f"WITH {EV} SELECT doc_id, 'round ' || (change_id % 3) AS group_name, list(change_id ORDER BY change_id) AS ids, count(*) AS n FROM ch GROUP BY ALL")
def edit_groups(spark, d):
    return C.groups(_changes(spark, d).withColumn("group_name", F.concat(F.lit("round "), F.col("change_id") % 3)))


@query(f"""WITH {EV}, c AS (SELECT doc_id, change_id, {SHORT} AS kind, '{{"change_id":' || change_id || ',"type":"' || {SHORT} || '","author":"' || author || '","date":"' || strftime(date, '%Y-%m-%dT%H:%M:%S') || '","text":"' || text || '"}}' AS one FROM ch)
SELECT doc_id, '{{"title":"Change report","total_changes":' || count(*) || ',"summary":{{"insert":' || count(*) FILTER (kind = 'insert') || ',"delete":' || count(*) FILTER (kind = 'delete') || ',"move_from":' || count(*) FILTER (kind = 'move_from') || ',"move_to":' || count(*) FILTER (kind = 'move_to')
  || ',"format":' || count(*) FILTER (kind = 'format') || '}},"changes":[' || string_agg(one, ',' ORDER BY change_id) || ']}}' AS report FROM c GROUP BY doc_id""")
def changes_report_json(spark, d):
    return C.report_json(_changes(spark, d))


@query(f"""WITH {EV}, l AS (SELECT doc_id, change_id, author, '- **' || {SHORT} || '** by ' || author || ' on ' || strftime(date, '%Y-%m-%d') || ': ' || substr(text, 1, 100) AS line FROM ch),
g AS (SELECT *, CASE WHEN lag(author) OVER w IS DISTINCT FROM author THEN chr(10) || '## ' || author || chr(10) ELSE '' END AS head FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY author, change_id))
SELECT doc_id, '# Change report' || chr(10) || chr(10) || 'Total changes: ' || count(*) || chr(10) || string_agg(head || line, chr(10) ORDER BY author, change_id) || chr(10) AS report FROM g GROUP BY doc_id""")
def changes_report_markdown(spark, d):
    return C.report_markdown(_changes(spark, d), by="author")


@query(f"""WITH {EV} SELECT doc_id, '<html><body><h1>Change report</h1><p>' || count(*) || ' changes</p><ul>' || string_agg('<li class="' || {SHORT} || '"><b>' || author || '</b> ' || text || '</li>', '' ORDER BY change_id) || '</ul></body></html>' AS report FROM ch GROUP BY doc_id""")
def changes_report_html(spark, d):
    return C.report_html(_changes(spark, d))


# Comments, notes and links


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS comment_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id FROM conversations)
SELECT a.doc_id, a.comment_id, CAST(count(b.comment_id) AS BIGINT) AS n_replies, list(b.comment_id ORDER BY b.comment_id) FILTER (b.comment_id IS NOT NULL) AS replies
FROM c a LEFT JOIN c b ON a.doc_id = b.doc_id AND a.comment_id = b.parent_id GROUP BY ALL""")
def comment_threads(spark, d):
    return links.threads(chat_comments(read(spark, d, "conversations")))


@query("SELECT conv_id AS doc_id, turn AS comment_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id, role AS author, text FROM conversations QUALIFY author = 'assistant'")
def comments_by_author(spark, d):
    return links.filter_comments(chat_comments(read(spark, d, "conversations")), author="assistant")


def _notes(spark, d):
    """Suppliers are notes that lines refer to, nations are notes that nothing refers to."""
    row = lambda df, key, kind, text: df.select((F.col(key) % 5).cast("long").alias("doc_id"), F.lit("footnote").alias("note_kind"), kind.alias("note_id"), F.when(F.col("bad"), "separator").alias("w_type"), F.col(text).alias("text"))
    some = row(read(spark, d, "supplier").withColumn("bad", F.col("s_acctbal") < 0), "s_suppkey", F.col("s_suppkey").cast("string"), "s_name")
    return some.unionByName(row(read(spark, d, "nation").withColumn("bad", F.lit(False)), "n_nationkey", (F.col("n_nationkey") + 1000000).cast("string"), "n_name"))


def _note_refs(spark, d):
    return read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("doc_id"), F.lit("footnote").alias("note_kind"), F.col("l_suppkey").cast("string").alias("note_id"), F.col("l_orderkey").cast("int").alias("p_idx"))


_NOTES = """notes AS (SELECT s_suppkey % 5 AS doc_id, 'footnote' AS note_kind, CAST(s_suppkey AS VARCHAR) AS note_id, CASE WHEN s_acctbal < 0 THEN 'separator' END AS w_type, s_name AS text FROM supplier
  UNION ALL SELECT CAST(n_nationkey % 5 AS BIGINT), 'footnote', CAST(n_nationkey + 1000000 AS VARCHAR), NULL, n_name FROM nation),
refs AS (SELECT l_suppkey % 5 AS doc_id, 'footnote' AS note_kind, CAST(l_suppkey AS VARCHAR) AS note_id, CAST(l_orderkey AS INTEGER) AS p_idx FROM lineitem)"""


@query(f"WITH {_NOTES} SELECT * FROM notes n WHERE w_type IS NULL AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = n.doc_id AND r.note_id = n.note_id)")
def notes_orphan(spark, d):
    return links.orphan_notes(_notes(spark, d), _note_refs(spark, d))


@query(f"""WITH {_NOTES}, f AS (SELECT doc_id, note_kind, note_id, min(p_idx) AS p_idx FROM refs GROUP BY ALL)
SELECT n.doc_id, n.note_kind, n.note_id, CAST(row_number() OVER (PARTITION BY n.doc_id, n.note_kind ORDER BY f.p_idx, CAST(n.note_id AS INTEGER)) AS INTEGER) AS new_id FROM notes n JOIN f ON n.doc_id = f.doc_id AND n.note_id = f.note_id""")
def notes_renumber(spark, d):
    return links.renumbered(_notes(spark, d), _note_refs(spark, d))


@query(f"""WITH {_NOTES} SELECT doc_id, note_kind, arg_min(note_id, list_position(['7', '2', '12', '17'], note_id)) AS note_id, string_agg(text, chr(10) ORDER BY list_position(['7', '2', '12', '17'], note_id)) AS text
FROM notes WHERE note_id IN ('7', '2', '12', '17') GROUP BY doc_id, note_kind""")
def notes_merge(spark, d):
    return links.merged_notes(_notes(spark, d), ["7", "2", "12", "17"])


_LINKS = """l AS (SELECT page_id AS doc_id, CAST(unnest(range(0, len(t))) AS INTEGER) AS link_idx, unnest(t) AS target, unnest(x) AS text FROM (
  SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a>', 1) AS t, regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a>', 2) AS x FROM pages))"""


@query(f"WITH {_LINKS} SELECT doc_id, link_idx, target, regexp_replace(text, '<[^>]*>', '', 'g') AS text FROM l")
def page_link_rows(spark, d):
    return page_links(read(spark, d, "pages"))


def _link_tables(spark, d):
    found = page_links(read(spark, d, "pages")).select("doc_id", "link_idx", F.expr("substring(target, 2)").alias("anchor"), F.when(F.col("link_idx") % 4 == 0, F.concat(F.lit("r"), F.length("target"))).alias("rel_id"))
    rels = read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.expr("sequence(3, 5)")).alias("k")).select("doc_id", F.concat(F.lit("r"), "k").alias("rel_id"), F.concat(F.lit("http://example.org/"), "k").alias("target"))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<a\b[^>]*>.*?</a>", " "), "<[^>]*>", " ")
    marks = read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.split(bare, "[ \\n]+")).alias("name")).where("name <> ''").distinct()
    return found, rels, marks


_PAGE_LINKS = f"""{_LINKS}, k AS (SELECT doc_id, link_idx, substr(target, 2) AS anchor, CASE WHEN link_idx % 4 = 0 THEN 'r' || length(target) END AS rel_id FROM l),
rels AS (SELECT page_id AS doc_id, 'r' || unnest([3, 4, 5]) AS rel_id, 'http://example.org/' || unnest([3, 4, 5]) AS target FROM pages),
marks AS (SELECT DISTINCT doc_id, name FROM (SELECT page_id AS doc_id, unnest(string_split_regex(regexp_replace(regexp_replace(html, '(?is)<a\\b[^>]*>.*?</a>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\n]+')) AS name FROM pages) WHERE name <> '')"""


@query(f"""WITH {_PAGE_LINKS} SELECT k.doc_id, k.link_idx, k.anchor, k.rel_id, r.target, CASE WHEN r.target IS NOT NULL THEN 'external' WHEN m.name IS NOT NULL THEN 'internal' ELSE 'broken' END AS status
FROM k LEFT JOIN rels r ON r.doc_id = k.doc_id AND r.rel_id = k.rel_id LEFT JOIN marks m ON m.doc_id = k.doc_id AND m.name = k.anchor""")
def links_resolved(spark, d):
    return links.resolved_links(*_link_tables(spark, d))


@query(f"""WITH {_PAGE_LINKS}, b AS (SELECT k.doc_id, count(*) AS n FROM k LEFT JOIN marks m ON m.doc_id = k.doc_id AND m.name = k.anchor WHERE m.name IS NULL GROUP BY ALL),
o AS (SELECT m.doc_id, count(*) AS n FROM marks m WHERE NOT starts_with(m.name, '_') AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = m.doc_id AND k.anchor = m.name) GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(b.n, 0) AS BIGINT) AS broken_links, CAST(coalesce(b.n, 0) AS BIGINT) AS broken_xrefs, CAST(coalesce(o.n, 0) AS BIGINT) AS orphan_bookmarks, b.n IS NULL AS is_valid
FROM (SELECT doc_id FROM k UNION SELECT doc_id FROM marks) d LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id)""")
def references_validated(spark, d):
    found, _, marks = _link_tables(spark, d)
    xrefs = found.select("doc_id", F.col("anchor").alias("target"))
    return links.validated(found, xrefs, marks)


@query("""SELECT page_id AS doc_id, CAST(unnest(range(0, len(t))) AS INTEGER) AS h_idx, CAST(unnest(t) AS INTEGER) AS level, trim(regexp_replace(unnest(x), '<[^>]*>', '', 'g'), ' ') AS heading FROM (
  SELECT page_id, regexp_extract_all(html, '(?is)<h([1-6])\\b[^>]*>(.*?)</h[1-6]>', 1) AS t, regexp_extract_all(html, '(?is)<h([1-6])\\b[^>]*>(.*?)</h[1-6]>', 2) AS x FROM pages)""")
def page_outline(spark, d):
    return page_headings(read(spark, d, "pages"))


@query(f"""WITH {P} SELECT 'heading' AS kind, doc_id, CAST(p_idx AS VARCHAR) AS target, text FROM p WHERE {HEADING} AND trim(text, ' ') <> ''
UNION ALL SELECT 'bookmark', p_partkey, p_brand, p_name FROM part UNION ALL SELECT 'footnote', s_suppkey % 5, CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'footnote', n_nationkey % 5, CAST(n_nationkey + 1000000 AS VARCHAR), n_name FROM nation""")
def xref_targets(spark, d):
    marks = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("name"), F.col("p_name").alias("preview"))
    styled = _p(spark, d).withColumn("style", F.when(_heading(), "Heading1").otherwise("Normal"))
    no_fields = spark.createDataFrame([], "doc_id long, p_idx int, code string")
    return links.reference_targets(marks, styled, no_fields, _notes(spark, d))


# Exports and contents

_YAML = "replace(replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t')"

def _styled(spark, d):
    return _p(spark, d).withColumn("style", F.when(_heading(), "Heading2").otherwise("Normal")).withColumn("tbl_idx", F.lit(None).cast("int")).withColumn("row_idx", F.lit(None).cast("int")).withColumn("cell_idx", F.lit(None).cast("int"))


@query(f"WITH {P} SELECT doc_id, string_agg(CASE WHEN {HEADING} THEN '## ' || text ELSE text END, chr(10) || chr(10) ORDER BY p_idx) FILTER (text <> '') || chr(10) AS text FROM p GROUP BY doc_id HAVING count(*) FILTER (text <> '') > 0")
def export_markdown(spark, d):
    return export.markdown(_styled(spark, d))


@query(f"WITH {P} SELECT doc_id, string_agg(CASE WHEN {HEADING} THEN text || chr(10) || repeat('-', length(text)) ELSE text END, chr(10) || chr(10) ORDER BY p_idx) FILTER (text <> '') || chr(10) AS text FROM p GROUP BY doc_id HAVING count(*) FILTER (text <> '') > 0")
def export_plain(spark, d):
    return export.plain(_styled(spark, d))


@query(f"WITH {P} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p_idx) - 1 AS INTEGER) AS entry_idx, CAST(2 AS INTEGER) AS level, trim(text, ' ') AS title, p_idx FROM p WHERE {HEADING} AND trim(text, ' ') <> ''")
def contents_entries(spark, d):
    return entity_edits.contents(_styled(spark, d))


@query("""WITH o AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS row_idx, o_orderkey, o_orderstatus FROM orders)
SELECT doc_id, 0 AS tbl_idx, row_idx, 0 AS cell_idx, CAST(o_orderkey AS VARCHAR) AS text FROM o UNION ALL SELECT doc_id, 0, row_idx, 1, o_orderstatus FROM o
UNION ALL SELECT DISTINCT doc_id, 0, 0, 0, 'o_orderkey' FROM o UNION ALL SELECT DISTINCT doc_id, 0, 0, 1, 'o_orderstatus' FROM o""")
def table_from_rows(spark, d):
    return export.table_from(read(spark, d, "orders"), ["o_orderkey", "o_orderstatus"], "o_custkey", ["o_orderkey"])


@query(f"""WITH {P}, s AS (SELECT *, {HEADING} AS h, sum(CAST({HEADING} AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p_idx ROWS UNBOUNDED PRECEDING) AS section_id FROM p),
g AS (SELECT doc_id, CAST(section_id AS BIGINT) AS section_id, coalesce(arg_min(text, p_idx) FILTER (h), '') AS heading, min(p_idx) AS a, count(*) AS n, coalesce(arg_min(substr(text, 1, 100), p_idx) FILTER (NOT h AND trim(text, ' ') <> ''), '') AS preview FROM s GROUP BY doc_id, section_id),
q AS (SELECT *, {_YAML.format(c='heading')} AS qh, {_YAML.format(c='preview')} AS qp FROM g)
SELECT doc_id, 'sections:' || chr(10) || string_agg('  - heading: "' || qh || '"' || chr(10) || '    paragraphs: ' || n || chr(10) || '    start: p:' || a || chr(10) || '    preview: "' || qp || '"', chr(10) ORDER BY section_id) || chr(10) AS text FROM q GROUP BY doc_id""")
def outline_yaml(spark, d):
    return export.outline_yaml(structure.sections(_p(spark, d), _heading()))


@query(f"""WITH {_NOTES}, top AS (SELECT doc_id, max(CAST(note_id AS INTEGER)) AS top FROM notes GROUP BY doc_id), nw AS (SELECT n_nationkey % 5 AS doc_id, n_nationkey AS p_idx, n_name AS text FROM nation)
SELECT doc_id, note_kind, note_id, w_type, text FROM notes UNION ALL SELECT doc_id, 'footnote', CAST(top + row_number() OVER (PARTITION BY doc_id ORDER BY p_idx, text) AS VARCHAR), NULL, text FROM nw JOIN top USING (doc_id)""")
def notes_inserted(spark, d):
    new = read(spark, d, "nation").select((F.col("n_nationkey") % 5).cast("long").alias("doc_id"), F.lit("footnote").alias("note_kind"), F.col("n_nationkey").alias("p_idx"), F.col("n_name").alias("text"))
    return entity_edits.insert_notes(_notes(spark, d), _note_refs(spark, d), new)[0]


# Text functions and markup


@query("SELECT l_orderkey, l_linenumber, 'paid $' || format('{:,.2f}', l_extendedprice) || ' of $' || format('{:,.2f}', round(l_quantity * 1000)) || '.' AS text FROM lineitem")
def normalize_currency(spark, d):
    raw = F.concat(F.lit("paid $"), F.format_string("%.2f", "l_extendedprice"), F.lit(" of $"), F.round(F.col("l_quantity") * 1000).cast("long"), F.lit("."))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.normalize_currency(raw).alias("text"))


@query("SELECT o_orderkey, 'due ' || strftime(o_orderdate, '%B %d, %Y') || ' or ' || strftime(o_orderdate, '%B %d, %Y') || ', at last ' || strftime(o_orderdate, '%B %d, %Y') || ' not 31/31/2024' AS text FROM orders")
def normalize_dates(spark, d):
    at = lambda form: F.date_format("o_orderdate", form)
    raw = F.concat(F.lit("due "), at("M/d/yyyy"), F.lit(" or "), at("yyyy-MM-dd"), F.lit(", at last "), at("d MMMM yyyy"), F.lit(" not 31/31/2024"))
    return read(spark, d, "orders").select("o_orderkey", T.normalize_dates(raw).alias("text"))


@query("SELECT p_partkey, replace('see Section ' || (p_size % 3) || ' and Section ' || p_size || '1', 'Section 2 ', 'Section 9 ') AS text FROM part")
def section_references(spark, d):
    return read(spark, d, "part").select("p_partkey", T.section_references(F.concat(F.lit("see Section "), F.col("p_size") % 3, F.lit(" and Section "), "p_size", F.lit("1")), "2", "9").alias("text"))


_MARKED = "'a {++' || p_name || '++} b {--' || p_brand || '--} {~~' || p_type || '~>new~~} {>>why<<} {==' || p_brand || '==} end'"
_marked = lambda: F.expr(_MARKED)


@query("SELECT p_partkey, 'a ' || p_name || ' b  new  ' || p_brand || ' end' AS accepted, 'a  b ' || p_brand || ' ' || p_type || '  ' || p_brand || ' end' AS rejected FROM part")
def critic_strip(spark, d):
    return read(spark, d, "part").select("p_partkey", critic.stripped(_marked()).alias("accepted"), critic.stripped(_marked(), accept=False).alias("rejected"))


@query("""SELECT p_partkey, unnest(CAST(range(0, 5) AS INTEGER[])) AS op_idx, unnest(['insertion', 'deletion', 'substitution', 'comment', 'highlight']) AS kind, unnest([p_name, p_brand, p_type, NULL, p_brand]) AS text,
  unnest([NULL, NULL, 'new', NULL, NULL]) AS replacement, unnest([NULL, NULL, NULL, 'why', NULL]) AS comment FROM part""")
def critic_parse(spark, d):
    return critic.parse(read(spark, d, "part").select("p_partkey", _marked().alias("text"))).select("p_partkey", "op_idx", "kind", "text", "replacement", "comment")


@query("SELECT p_partkey, '{~~' || substr(p_name, 1, 3) || '~>new~~}' || substr(p_name, 4) || '' AS text FROM part")
def critic_render(spark, d):
    markup = critic.rendered(F.lit("substitution"), F.substring("p_name", 1, 3), F.lit("new"), F.lit(None).cast("string"))
    operations = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), markup.alias("markup")))
    return read(spark, d, "part").select("p_partkey", critic.spliced(F.col("p_name"), operations).alias("text"))


# Comparison and edits


def _versions(spark, d):
    """Each document and the one after it of its source, as two versions of a text."""
    p = _p(spark, d)
    later = p.withColumn("text", F.when(F.col("p_idx") % 5 == 2, F.concat(F.lit("Revised. "), F.col("text"))).otherwise(F.col("text"))).where("p_idx % 7 <> 4")
    return p.withColumnRenamed("doc_id", "pair_id"), later.withColumnRenamed("doc_id", "pair_id")


@query()
def compare_documents(spark, d):
    return diff.compare(*_versions(spark, d))


@query()
def compare_stats(spark, d):
    old, new = _versions(spark, d)
    return diff.comparison_stats(diff.compared_changes(diff.compare(old, new), old, new))


@query()
def minimal_hunks(spark, d):
    new = F.regexp_replace("text", " the ", " that ")
    p = _p(spark, d).where(F.col("text") != new)
    return p.select("doc_id", "p_idx", F.explode(diff.hunks(F.col("text"), new)).alias("h")).select("doc_id", "p_idx", "h.*")


def _batch(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    row = "named_struct('seq', {}, 'type', '{}', 'find', {}, 'replace', {}, 'text', {}, 'after', {}, 'before', string(null), 'occurrence', {}, 'regex', {}, 'track', {})"
    todo = [row.format(1, "replace", "'the'", "'THE'", "string(null)", "string(null)", "'first'", "false", "true"), row.format(2, "insert", "string(null)", "string(null)", "' [seen]'", "'THE'", "'first'", "false", "false"), row.format(3, "delete", "string(null)", "string(null)", "'and'", "string(null)", "'last'", "false", "false")]
    return docs.select("doc_id", F.explode(F.expr(f"array({', '.join(todo)})")).alias("e")).select("doc_id", "e.*")


@query()
def batch_edits(spark, d):
    return edits.apply_batch(_p(spark, d), _batch(spark, d))[0]


@query(f"""WITH {P}, k AS (SELECT doc_id, max(contains(text, 'the')) AS a, max(contains(text, 'THE')) AS b, max(contains(text, 'and')) AS c FROM p GROUP BY doc_id),
s AS (SELECT doc_id, CAST(a AS INTEGER) + CAST(a OR b AS INTEGER) + CAST(c AS INTEGER) AS n FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS succeeded, CAST(3 - n AS BIGINT) AS failed, n * 100.0 / 3 AS success_rate, n = 3 AS all_succeeded FROM s""")
def batch_results(spark, d):
    return edits.batch_summary(edits.apply_batch(_p(spark, d), _batch(spark, d))[1])


@query(f"WITH {P} SELECT doc_id, p_idx, replace(text, 'worthless', '{{--worthless--}}{{++priceless++}}') AS text FROM p")
def edit_disjoint(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.lit("worthless").alias("find"), F.lit("priceless").alias("replace"))
    return edits.apply_disjoint(_p(spark, d), docs)


@query(f"WITH {P} SELECT doc_id, p_idx, CASE WHEN {HEADING} THEN 'Heading1' END AS style, replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), chr(13), chr(10)) AS text FROM p")
def docx_roundtrip(spark, d):
    """Texts written as packages and read back: (doc_id, p_idx, style, text)."""
    p = _p(spark, d).withColumn("style", F.when(_heading(), "Heading1"))
    no = F.lit(None).cast("boolean")
    runs = p.select("doc_id", "p_idx", F.lit(0).alias("r_idx"), F.regexp_replace("text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "").alias("text"), F.lit("").alias("del_text"), F.lit(False).alias("in_ins"), F.lit(False).alias("in_del"), F.lit(None).cast("string").alias("change_id"), no.alias("bold"), no.alias("italic"), F.lit(None).cast("string").alias("color"))
    written = docx.zipped(docx.document_xml(runs, p))
    return docx.entity(docx.entities(written), "paragraphs").select(F.col("doc_id").cast("long"), "p_idx", "style", "text")
