"""Importance resampling towards a target distribution, on hashed word n-grams.

A document's features are its runs of one to `longest` words, each hashed to one of `buckets`. What a
bucket is worth is the logarithm of its smoothed share in the target texts over that in the corpus;
a document's weight is the mean worth of its features. Documents are drawn without replacement by
weight plus Gumbel noise from a hash of doc_id: the highest sums are taken.

Scoring explodes nothing: higher-order functions turn a text into its array of buckets, which is then
summed over a literal array of gains. Only totals shuffle, at most `buckets` rows from each task. The
draw works on rows of numbers: scores are whole numbers of a narrow range, so counts by score name
the score at which the draw ends, and only drawn rows are numbered, within their score.

Defined results: null and empty texts have no features, weight 0, and count too few words to be drawn;
a null doc_id is hashed as 'null' and drawn after others of its score; rows alike in doc_id, words and
score are numbered in no certain order, which leaves the result's rows the same; an empty corpus gives
no rows; an empty target is a flat one; further columns are ignored under any name. Very long texts
are taken whole: a row holds its text, words and buckets at once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

BUCKETS, LONGEST = 10_000, 2
#: Percent of the documents of at least LEAST words that are drawn.
SHARE, LEAST = 25, 20
SEED = "7"
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and anything beyond ASCII, with A-Z in lower case; none for null."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), GAP), "")


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def buckets_of(words: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """The buckets of all runs of 1 to longest words, repeats included."""

    def runs(n: int) -> Column:
        if n == 1:
            return F.transform(words, lambda w: bucket(w, buckets))
        # The run that begins at word i; the last n - 1 words begin none.
        feature = lambda w, i: bucket(F.concat_ws(" ", w, *(F.get(words, i + j) for j in range(1, n))), buckets)
        return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0))), feature)

    return F.concat(*(runs(n) for n in range(1, longest + 1)))


def totals(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all texts."""
    words = texts.select(words_of(F.col("text")).alias("words"))
    return words.select(F.explode(buckets_of(F.col("words"), buckets, longest)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """What each bucket is worth, in thousandths of a natural logarithm, rounded down: buckets numbers, sent to the driver."""
    both = totals(docs, buckets, longest).withColumnRenamed("n", "s").join(totals(target, buckets, longest).withColumnRenamed("n", "t"), "bucket", "full")
    counts = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    every = Window.partitionBy()
    counts = counts.withColumns({"all_s": F.sum("s").over(every), "all_t": F.sum("t").over(every)})
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    rows = counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()
    return [r.gain for r in sorted(rows)]


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, worth: list[int], longest: int = LONGEST) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score."""
    gain = F.split(F.lit(",".join(map(str, worth))), ",").cast("array<bigint>")  # folded to one literal
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    found = found.select("doc_id", F.size("words").cast("long").alias("n_words"), buckets_of(F.col("words"), len(worth), longest).alias("buckets"))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(gain, b + 1))
    found = found.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, n_features)) div nullif(n_features, 0)")).cast("long")
    return found.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def drawn(scored: DataFrame, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """Adds rank to rows of (doc_id, n_words, score, …): 1, 2, 3 … for the share percent of highest scores among those of least words, else null."""
    by_score = scored.where(F.col("n_words") >= least).groupBy("score").agg(F.count("*").alias("here"))
    # A row for each score, tens of thousands at most.
    ahead = F.sum("here").over(Window.orderBy(F.col("score").desc())) - F.col("here")
    cut = by_score.withColumns({"ahead": ahead, "draw": F.floor(F.sum("here").over(Window.partitionBy()) * share / 100)})
    cut = cut.where("ahead < draw").select(F.col("score").alias("at"), "ahead", "draw")
    rows = scored.join(cut, (F.col("score") == F.col("at")) & (F.col("n_words") >= least), "left")
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_words", "n_features")
    taken = rows.where("at is not null").withColumn("place", F.col("ahead") + F.row_number().over(within))
    rest = rows.where("at is null").withColumn("place", F.lit(None).cast("long"))
    rank = F.when(F.col("place") <= F.col("draw"), F.col("place")).cast("long")
    return taken.unionByName(rest).select(*scored.columns, rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (null: not drawn)."""
    return drawn(stash(weighed(docs, gains(docs, target, buckets, longest), longest), "weights"), share, least)


def oracle_sql(documents: str = "documents", target: str = "benchmark") -> str:
    lower, upper = string.ascii_lowercase, string.ascii_uppercase
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    feature = "list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    byte = "CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)"
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH b AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, round: {shift}) ORDER BY i) AS steps FROM range(256) t(i)),
w AS (SELECT doc_id, {words} AS w FROM {documents}),
x AS (SELECT doc_id, len(w) AS n_words, {feature} AS f FROM w),
y AS (SELECT {feature} AS f FROM (SELECT {words} AS w FROM {target})),
e AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(f) AS f FROM x) GROUP BY ALL),
g AS (SELECT f, count(*) AS n FROM (SELECT unnest(f) AS f FROM y) GROUP BY f),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, [{byte} for i in range(len(hex(encode(f))) // 2)]),
    lambda c, v: xor(steps[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM (SELECT f FROM e UNION SELECT f FROM g), b),
s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM e JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS t FROM g JOIN k USING (f) GROUP BY bucket),
q AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket)),
v AS (SELECT doc_id, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM e JOIN k USING (f) JOIN q USING (bucket) GROUP BY doc_id),
z AS (SELECT x.doc_id, n_words, CAST(len(f) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || x.doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM x LEFT JOIN v ON x.doc_id = v.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_words >= {LEAST})
SELECT z.doc_id, n_words, n_features, weight, score, CASE WHEN rank <= {SHARE} * n // 100 THEN rank END AS rank FROM z LEFT JOIN r ON z.doc_id = r.doc_id"""
