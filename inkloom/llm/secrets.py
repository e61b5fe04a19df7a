"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: for every literal part
one of its spellings must occur, with all its trigrams. The index holds postings (trigram, document)
for the trigrams that any rule asks for, in lower case. Postings of one document are intersected
with the rules' queries, and only rules whose query holds are run over a document's text. Rules
without a mandatory trigram are run over every text.

Defined results: null is an empty text; rows repeat freely; spans count code points, end exclusive;
further columns are ignored.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, text_key

#: Kind, pattern, and the group that must have a length, with that length. The first three are the base rules.
RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("key_block", r"-----BEGIN [A-Z ]{0,16}PRIVATE KEY-----", 0, 0),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("payment", r"sk_live_[A-Za-z0-9]{16,}", 0, 24),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
]
BASE = 3
#: Spellings of one literal part beyond which it is given up.
SPELLINGS = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All of: one of: sets of trigrams that must occur, in lower case. Empty if nothing is mandatory."""
    import re._constants as c
    import re._parser as parser

    out: list[list[frozenset[str]]] = []

    def flush(spellings: set[str]) -> None:
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in spellings]
        if sets and all(sets):
            out.append(sorted(set(sets), key=sorted))

    def exact(items) -> set[str] | None:
        """All spellings of items, or None."""
        found = {""}
        for op, arg in items:
            if op is c.LITERAL:
                part = {chr(arg).lower()}
            elif op is c.IN and all(k is c.LITERAL for k, _ in arg) and len(arg) <= 8:
                part = {chr(v).lower() for _, v in arg}
            elif op is c.BRANCH:
                parts = [exact(x) for x in arg[1]]
                part = None if None in parts else set().union(*parts)
            elif op is c.SUBPATTERN:
                part = exact(arg[3])
            elif op is c.MAX_REPEAT and arg[1] == 1:
                part = exact(arg[2])
                part = part if part is None or arg[0] else part | {""}
            elif op is c.MAX_REPEAT and arg[0] == arg[1] and arg[1] <= 8:
                one = exact(arg[2])
                part = None if one is None else {"".join(x) for x in product(one, repeat=arg[0])} if len(one) ** arg[0] <= SPELLINGS else None
            else:
                part = None
            if part is None or len(found) * len(part) > SPELLINGS:
                return None
            found = {a + b for a in found for b in part}
        return found

    def walk(items) -> None:
        run = {""}
        for item in items:
            part = exact([item])
            if part is not None and "" not in part and len(run) * len(part) <= SPELLINGS:
                run = {a + b for a in run for b in part}
                continue
            flush(run)
            run = part if part is not None and "" not in part else {""}
            op, arg = item
            if part is None and op is c.SUBPATTERN:
                walk(arg[3])
            elif part is None and op is c.MAX_REPEAT and arg[0] > 0:
                walk(arg[2])
        flush(run)

    walk(parser.parse(pattern))
    return out


def asked(rules=RULES) -> list[str]:
    """The trigrams that any rule asks for."""
    return sorted({t for _, p, _, _ in rules for one in trigram_query(p) for s in one for t in s})


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index: (trigram, doc_id, key), a row for each asked trigram of each text."""
    low = docs.select(F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("key"), F.lower("text").alias("low"))
    found = F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(asked(rules))))
    return low.select(F.explode(F.array_compact(found)).alias("trigram"), "doc_id", "key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, key, due): the rules, one bit each, whose query holds for a document."""
    number = {t: i for i, t in enumerate(asked(rules))}
    has = index.groupBy("doc_id", "key").agg(F.collect_set("trigram").alias("has"))
    due = F.lit(0)
    for r, (_, pattern, _, _) in enumerate(rules):
        query = trigram_query(pattern)
        if not query:
            continue
        holds = F.lit(True)
        for one in query:
            some = F.lit(False)
            for s in one:
                some = some | (F.size(F.array_except(F.array(*(F.lit(number[t]) for t in sorted(s))), "has")) == 0)
            holds = holds & some
        due = due + F.when(holds, F.lit(1 << r)).otherwise(F.lit(0))
    return has.select("doc_id", "key", due.alias("due")).where("due > 0")


#: Items of a block of running sums: work is in proportion to it, and to the square of the number of blocks.
SUM_BLOCK = 128


def running_sums(sizes: Column) -> Column:
    """Sums of the items up to each one, by blocks, so that many matches in one text cost no square."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / SUM_BLOCK).cast("int")), lambda b: F.slice(sizes, b * SUM_BLOCK + 1, SUM_BLOCK))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    ahead = F.aggregate(
        F.transform(blocks, total), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    )["out"]
    sums = F.flatten(F.zip_with(blocks, ahead, lambda xs, at: F.transform(xs, lambda x, i: at + total(F.slice(xs, 1, i + 1)))))
    return F.when(F.size(sizes) > 0, sums).otherwise(F.array().cast("array<int>"))


def spans(text: Column, rank: int, rule: tuple) -> Column:
    """Array of (start, rank, kind, end) of a rule's matches, leftmost first, without those that are too short."""
    kind, pattern, group, least = rule
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(whole, F.length)
    # A match ends where all gaps and matches up to it end.
    ends = running_sums(F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, s: g + s))
    rows = F.transform(
        F.arrays_zip(ends.alias("e"), sizes.alias("s"), F.transform(value, F.length).alias("v")),
        lambda x: F.struct((x["e"] - x["s"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["e"].alias("end"), x["v"].alias("v")),
    )
    fit = F.filter(rows, lambda x: x["v"] >= least)
    return F.transform(fit, lambda x: F.struct(x["start"], x["rank"], x["kind"], x["end"]))


SPAN = "array<struct<start: int, rank: int, kind: string, end: int>>"


def joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, rules=RULES, name: str = "found") -> DataFrame:
    """All columns of docs, and one by that name: array of (start, rank, kind, end) of every rule's matches."""
    # Written, so that Spark knows how small the candidates are: while they fit a broadcast, no text is shuffled.
    hits = stash(candidates(postings(docs, rules), rules), "candidates")
    both = docs.join(hits, docs["doc_id"].eqNullSafe(hits["doc_id"]) & (text_key(docs["text"]) == hits["key"]), "left")
    none = F.array().cast(SPAN)
    text = F.coalesce(docs["text"], F.lit(""))
    parts = []
    for r, rule in enumerate(rules):
        if trigram_query(rule[1]):
            due = F.coalesce(hits["due"].bitwiseAND(F.lit(1 << r)) > 0, F.lit(False))
        else:
            due = F.coalesce(docs["text"].rlike(rule[1]), F.lit(False))
        parts.append(F.when(due, spans(text, r, rule).cast(SPAN)).otherwise(none))
    return both.select(*(docs[f"`{c}`"] for c in docs.columns), F.concat(*parts).alias(name))


def secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "found")
    counts = [F.expr(f"cast(size(filter(found, x -> x.rank = {r})) as bigint) as n_{RULES[r][0]}") for r in range(BASE)]
    base = F.sha2(joined(F.filter("found", lambda x: x["rank"] < BASE)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, joined(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span that was found replaced by mark; the columns stay."""
    name, merged = "found", "merged"
    while name in docs.columns or merged in docs.columns:
        name, merged = name + "_", merged + "_"
    found = scan(docs, name=name)
    # Overlapping spans of different kinds are one; the mark stands where each begins.
    merge = f"""aggregate(array_sort({name}), cast(array() as array<struct<a: int, e: int>>), (m, x) ->
      if(size(m) > 0 and x.start < element_at(m, -1).e,
         concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).a as a, greatest(element_at(m, -1).e, x.end) as e))),
         concat(m, array(struct(x.start as a, x.end as e)))))"""
    found = found.withColumn(merged, F.expr(merge))
    pieces = f"transform({merged}, (x, i) -> concat(substring(text, coalesce(get({merged}, i - 1).e, 0) + 1, x.a - coalesce(get({merged}, i - 1).e, 0)), '{mark}'))"
    text = F.expr(f"if(size({merged}) > 0, concat(array_join({pieces}, ''), substring(text, element_at({merged}, -1).e + 1)), text)")
    return found.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def oracle_sql() -> str:
    parts = []
    for r, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT r, {r} AS rank, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack("
            f"s := list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0), n := length(m[i]), v := length(v[i])))) AS x, {least} AS least "
            f"FROM (SELECT r, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}'))"
        )
    union = " UNION ALL ".join(parts)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
f AS (SELECT r, rank, kind, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.n AS BIGINT) AS e FROM ({union}) WHERE x.v >= least),
a AS (
  SELECT r, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {BASE}) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS every
  FROM f GROUP BY r)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN a USING (r)"""
