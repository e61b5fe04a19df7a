"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source takes whole epochs first: as many as its target holds. What is left of the target is drawn
without replacement: a document of quality weight w and uniform u has the key -ln(u) / w, documents
are sorted by key within their source, and those whose prefix sum of sizes stays within the rest are
taken; the one that crosses the rest is cut to what is missing, so a source meets its target to a word.

A source's prefix sum passes its rest at one document, the cut: what stands before it is taken whole,
what stands after it isn't. So only the cut is searched, on rows of (source, key, doc_id, size): keys
fall into classes by a monotone function, class sums are added up, and just the class that holds the
cut is sorted. One source may hold any share of the rows. The cuts, a row for each source, are then
joined to the documents, whose texts are never shuffled for it while Spark finds the cuts small
enough to broadcast.

Defined results: null text has size 0; null is a source of its own, the last; a source of size 0 has
target 0; documents with one doc_id share a key and order by size; rows alike in doc_id, key and size
at the cut are taken one after the other in no certain order; reruns agree; an empty table gives no
rows; further columns are ignored, or kept where asked, under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, word_count

WEIGHTS = (5, 2, 1)
#: Target of all sources, and most of one, in epochs.
SHARE, MOST = 1.5, 2
#: Rows of a class of keys, about.
CLASS_ROWS = 4_000
SEED = "mix-1"
JUNK = r"[!-@\[-`{-~]+"


def quality_weight(text: Column) -> Column:
    """From 0.5 to 1: by the share of characters that are no digits or ASCII punctuation."""
    share = F.length(F.regexp_replace(text, JUNK, "")) / F.nullif(F.length(text), F.lit(0))
    return F.lit(0.5) + F.lit(0.5) * F.coalesce(share, F.lit(0.0))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / F.lit(float((1 << 48) + 1))
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds target to (source, source_size, …), a row for each source: min(cap, level * weight), all summing to share.

    Its window spans all sources, of which there is one small row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("w", weight.cast("double")).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - before) / after
    ranked = capped.withColumn("level", level).withColumn("at", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("at", "level"))
    found = ranked.withColumn("level", F.min(fits).over(every)["level"])
    return found.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))).drop("w", "cap", "level", "at")


#: Rows of (source, doc_id, size, draw) in the order in which a source's documents are drawn.
PLACE = ("draw", "doc_id", "size")


def cuts(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row for each source: s, source_size, target, epochs, rest, and the cut: at (its place), before (sizes ahead of it), alike (rows at that place).

    at is null where no document passes the rest.
    """
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5))
    sources = sources.withColumn("epochs", epochs).select(F.col("source").alias("s"), "source_size", "target", "epochs", rest.alias("rest"), F.ceil(F.col("n") / CLASS_ROWS).alias("classes"))
    sources = stash(sources, "sources")
    # exp(-0.75 draw) falls with the key and is near uniform for weights from 0.5 to 1.
    cls = F.floor((F.lit(1.0) - F.exp(F.lit(-0.75) * F.col("draw"))) * F.col("classes")).alias("class")
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["s"])).select("s", "rest", cls, *PLACE)
    sums = rows.groupBy("s", "rest", "class").agg(F.sum("size").alias("here"))
    ahead = F.sum("here").over(Window.partitionBy("s").orderBy("class")) - F.col("here")
    torn = sums.withColumn("ahead", ahead).where("ahead <= rest and ahead + here > rest")
    torn = stash(torn.select(F.col("s").alias("t"), F.col("class").alias("c"), "ahead"), "cut-classes")
    inside = rows.join(torn, rows["s"].eqNullSafe(torn["t"]) & (rows["class"] == torn["c"])).groupBy("s", "rest", "ahead", *PLACE).agg(F.count("*").alias("alike"))
    before = F.col("ahead") + F.sum(F.col("size") * F.col("alike")).over(Window.partitionBy("s").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") * F.col("alike")
    over = inside.withColumn("before", before).where("before <= rest and before + size * alike > rest")
    over = over.groupBy(F.col("s").alias("o")).agg(F.min(F.struct(F.struct(*PLACE).alias("at"), "before", "alike")).alias("cut"))
    found = sources.join(over, sources["s"].eqNullSafe(over["o"]), "left").select("s", "source_size", "target", "epochs", "rest", "cut.*")
    return stash(found, "cuts")


def mix(docs: DataFrame, keep: tuple[str, ...] = (), weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per document: doc_id, the columns of keep, size, source_size, target, taken."""
    draw = sampling_key(F.col("doc_id"), quality_weight(F.col("text")))
    narrow = (F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), draw.alias("draw"))
    sized = stash(docs.select(*narrow), "sized")
    found = cuts(sized, weights, share, most)
    # Texts that are to be kept are read again rather than written.
    rows = docs.select(*narrow, *(F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep))) if keep else sized
    rows = rows.join(found, rows["source"].eqNullSafe(found["s"])).withColumn("place", F.struct(*PLACE))

    def taken(before: Column) -> Column:
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
        whole = F.when(F.col("at").isNull() | (F.col("place") < F.col("at")), F.col("size"))
        part = whole.otherwise(F.when(F.col("place").eqNullSafe(F.col("at")), part).otherwise(0))
        return (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")

    columns = ("doc_id", *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "size", "source_size", "target")
    if not found.where("alike > 1").head(1):
        return rows.select(*columns, taken(F.col("before")))
    tied = F.coalesce(F.col("place").eqNullSafe(F.col("at")) & (F.col("alike") > 1), F.lit(False))
    number = F.row_number().over(Window.partitionBy("source").orderBy("place")) - 1
    ties = rows.where(tied).withColumn("before", F.col("before") + number * F.col("size"))
    return rows.where(~tied).select(*columns, taken(F.col("before"))).unionByName(ties.select(*columns, taken(F.col("before"))))


def mix_sql(documents: str = "documents") -> str:
    words = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"
    return f"""
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM (
  SELECT *, floor(target - epochs * source_size + 0.5) AS rest,
    sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM (
    SELECT d.*, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS epochs
    FROM (
      SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST({words} AS BIGINT) AS size,
        -ln((CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) + 1) / CAST({(1 << 48) + 1} AS DOUBLE))
          / (0.5 + 0.5 * coalesce(length(regexp_replace(text, '[!-@\\[-`{{-~]+', '', 'g')) / CAST(nullif(length(text), 0) AS DOUBLE), 0)) AS draw
      FROM {documents}) d
    JOIN (
      SELECT source, source_size, least(cap, coalesce(min(CASE WHEN level <= cap / w THEN struct_pack(p := pos, level := level) END) OVER ()['level'] * w, cap)) AS target
      FROM (
        SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
          row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos
        FROM (
          SELECT source, source_size, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS DOUBLE) AS w,
            CAST(2 * source_size AS DOUBLE) AS cap, 1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS budget
          FROM (SELECT source, CAST(sum({words}) AS BIGINT) AS source_size FROM {documents} GROUP BY source)))) t
    ON d.source IS NOT DISTINCT FROM t.source))"""
