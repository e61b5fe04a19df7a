"""Filter interaction audit: what each quality filter removes, repeats or wastes in every order of application.

Each document gets a mask of the filters that it fails. Four filters need its text alone. The fifth,
exact duplication, is found by sorting: rows are dealt to ranges of (text fingerprint, doc_id), sorted
in each by fingerprint, full text and doc_id, and every row is held against its predecessor. A range
may end within a group of copies, so its first and last fingerprints' texts are reported as boundary
rows; the least doc_id of a text in earlier ranges then decides those rows that a range alone couldn't.

Bounds are drawn on (fingerprint, doc_id), so that no text is sampled to the driver and a group of
copies of any size spreads over as many ranges as it fills. Texts that meet at a boundary are held
against each other by SHA-256.

Masks are counted by (part, mask), a few rows of each task, and all that the orders ask for follows
from these counts: what a filter does depends on the set of filters before it, not on their order.

Defined results: null text counts as empty, and empty texts are copies of one another; a null part is
the part ''; a row is a duplicate only of a smaller doc_id, so rows alike in doc_id and text don't
make each other duplicates and a null doc_id neither is one nor makes one; a document with several
labels is good, or toxic, if one of them says so; an unlabelled one is neither; an empty table has no
parts and gives no rows; further columns are ignored under any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, stash

_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(128, 192))
_MARKS = frozenset(b"#$%&*|")


def _short(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def _repetitive(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def _shouting(text: bytes, words: list[bytes]) -> bool:
    upper = len(text) - len(text.translate(None, _UPPER))
    return 100 * upper > 3 * len(text.translate(None, _CONTINUED))


def _marked(text: bytes, words: list[bytes]) -> bool:
    return not _MARKS.isdisjoint(text)


#: Filters on a text's UTF-8 bytes and its words; a name is one letter. True: the text fails.
FILTERS: dict[str, Callable[[bytes, list[bytes]], bool]] = {"A": _short, "B": _repetitive, "C": _shouting, "D": _marked}
DUPLICATE = "E"



def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


_ROW = "doc_id long, part string, mask int, open boolean, range int, fp long, sha binary, least long"


def _marks(filters: dict[str, Callable]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one sorted range: each document's mask, and boundary rows (doc_id and part null, sha set) for the texts of its first and last fingerprint."""
    duplicate = 1 << len(filters)
    checks = [(1 << i, f) for i, f in enumerate(filters.values())]
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("open", pa.bool_()), ("range", pa.int32()), ("fp", pa.int64()), ("sha", pa.binary()), ("least", pa.int64())])

    def packed(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def bounds(ends: dict[bytes, tuple]) -> list[tuple]:
        return [(None, None, None, None, here, fp, sha, least) for sha, (here, fp, least) in ends.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # fingerprints of the first row and of the row before
        before = least = mask = sha = None  # the text before, the least doc_id of its group here, its mask without E, its hash if wanted
        ends: dict[bytes, tuple] = {}  # texts of the fingerprint at hand: hash -> (range, fp, least)
        for batch in batches:
            out = []
            for doc_id, part, here, fp, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "range", "fp", "text")), strict=True):
                if first is None:
                    first = fp
                if text != before or before is None:
                    if ends and last != fp:
                        if last == first:  # the fingerprints between the first and the last lie wholly in this range
                            out += bounds(ends)
                        ends = {}
                    words = text.split()
                    mask = sum(bit for bit, fails in checks if fails(text, words))
                    before, least, sha = text, None, hashlib.sha256(text).digest()
                if least is None:
                    least = doc_id
                ends[sha], last = (here, fp, least), fp
                copy = doc_id is not None and doc_id > least
                unsure = doc_id is not None and not copy and fp == first
                out.append((doc_id, part, mask | duplicate if copy else mask, unsure, here, fp if unsure else None, sha if unsure else None, None))
            yield from packed(out)
        yield from packed(bounds(ends))

    return run


def failures(docs: DataFrame, part: str = "lang", filters: dict[str, Callable] | None = None) -> DataFrame:
    """Per document: doc_id, part, mask. Bit i of the mask is the i-th filter's failure, the last bit says duplicate."""
    spark = docs.sparkSession
    small_batches(spark)
    filters = FILTERS if filters is None else filters
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("fp", fingerprint(F.col("text")))
    ranged = rows.repartitionByRange(partitions(spark), "fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    marked = stash(ranged.withColumn("range", F.spark_partition_id()).mapInArrow(_marks(filters), _ROW), "masks")
    # Boundary rows: one or two of each range. A text is continued where an earlier range has a smaller doc_id of it.
    earlier = Window.partitionBy("fp", "sha").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bounds = marked.where("mask is null").groupBy("range", "fp", "sha").agg(F.min("least").alias("least"))
    carried = bounds.withColumn("carried", F.min("least").over(earlier)).where("carried < least")
    carried = carried.select(F.col("range").alias("b_range"), F.col("fp").alias("b_fp"), F.col("sha").alias("b_sha"))
    found = marked.where("mask is not null")
    undecided = found.where("open").join(carried, (F.col("range") == F.col("b_range")) & (F.col("fp") == F.col("b_fp")) & (F.col("sha") == F.col("b_sha")), "left")
    undecided = undecided.withColumn("mask", F.when(F.col("b_range").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseOR(1 << len(filters))))
    columns = ("doc_id", "part", "mask")
    return found.where("not open").select(*columns).unionByName(undecided.select(*columns))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of (doc_id, part, mask): documents, those of quality 1, those that are toxic."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(*(F.max((F.col(c) == 1).cast("long")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = masks.join(known, F.col("doc_id") == F.col("labelled"), "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))


def interactions(counted: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The tables of sets and of orders depend on the number of filters alone: 2,560 and 600 rows for five.
    """
    spark = counted.sparkSession
    k = len(names)
    every = range(1 << k)
    sets = [(s, f, m, not m & (s | 1 << f), not m & s and m >> f & 1 == 1, m & s != 0 and m >> f & 1 == 1, m == 1 << f) for f in range(k) for s in every if not s >> f & 1 for m in every]
    sets = spark.createDataFrame([(s, f, m, *map(int, flags)) for s, f, m, *flags in sets], "ahead int, filter int, m int, keeps int, removes int, repeats int, only int")
    ways = F.element_at(F.array(*(F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k))), F.bit_count("ahead") + 1)
    step = counted.join(F.broadcast(sets), F.col("mask") == F.col("m")).groupBy("part", "ahead", "filter").agg(
        *(F.sum(F.col(flag) * F.col(count)).cast("long").alias(name) for name, flag, count in (
            ("kept", "keeps", "n"), ("removed", "removes", "n"), ("redundant", "repeats", "n"), ("unique_fails", "only", "n"), ("good_lost", "removes", "good"), ("toxic_lost", "removes", "toxic")))
    )
    step = step.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "filter")).cast("long"))
    orders = [("".join(names[i] for i in p), j + 1, sum(1 << i for i in p[:j]), p[j]) for p in permutations(range(k)) for j in range(k)]
    orders = spark.createDataFrame(orders, "filter_order string, step int, o_ahead int, o_filter int")
    out = step.join(F.broadcast(orders), (F.col("ahead") == F.col("o_ahead")) & (F.col("filter") == F.col("o_filter")))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Callable] | None = None) -> DataFrame:
    """The interactions of all filters and of exact duplication, by part."""
    filters = FILTERS if filters is None else filters
    counted = stash(counters(failures(docs, part, filters), labels), "counters")
    return interactions(counted, "".join([*filters, DUPLICATE]))


def oracle_sql(documents: str = "documents", labels: str = "labels") -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM {documents}),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM {labels} GROUP BY doc_id),
f AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, {{
    'A': len(words) < 200,
    'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(least < w.doc_id, FALSE)}} AS x
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, (CASE WHEN x['A'] THEN 'A' ELSE '' END) || (CASE WHEN x['B'] THEN 'B' ELSE '' END) || (CASE WHEN x['C'] THEN 'C' ELSE '' END)
    || (CASE WHEN x['D'] THEN 'D' ELSE '' END) || (CASE WHEN x['E'] THEN 'E' ELSE '' END) AS fails FROM f),
c AS (SELECT part, fails, count(*) AS n, sum(CAST(good AS INT)) AS good, sum(CAST(toxic AS INT)) AS toxic FROM m GROUP BY ALL),
z AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z),
o AS (SELECT a.z || b.z || g.z || h.z || i.z AS filter_order FROM z a, z b, z g, z h, z i WHERE len(list_distinct([a.z, b.z, g.z, h.z, i.z])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[:step - 1] AS ahead FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, letter, n, good, toxic, fails, contains(fails, letter) AS here, len(translate(fails, ahead, '')) < len(fails) AS gone FROM c, s),
t AS (SELECT part, filter_order, step, letter,
  CAST(sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM t"""
