"""Exact top-k search by inner product, over vectors sorted by length.

Vectors are rotated to the axes of a singular value decomposition (of a bounded sample), so that the
first coordinates hold most of every product. A task handles one block of queries against one block
of vectors, longest vectors first. A vector is dropped for a query when the sum over the first
coordinates, plus the product of the lengths of what remains (Cauchy-Schwarz), can't reach the
query's k-th best score so far; once the product of whole lengths can't, the rest of the block is
skipped. Scores of what is left are exact integer products.

Blocks of vectors are classes of length, searched in two rounds, the longest class first. A query starts
with the k-th best score against the longest vectors of all, and takes the k-th best of each round
to the next. So it knows the least length that a vector must have to matter: queries are dealt into
blocks by that length, and neither a query nor a vector is sent to a block pair that no vector is
long enough for.

Vectors of any direction and size are kept whole; the rotation only steers pruning, and bounds are
widened by more than its rounding error. Components are whole numbers held as doubles, which is exact;
products that may not fit a long are added up as Python integers.

Defined results: vectors that are null, or hold null or non-finite components, take no part; nor do
rows whose vec_id is null. A score beyond a long is returned as the nearest long, but ranked by its
value (to a double's precision). Shorter vectors are filled with 0. A row is no candidate for a query
of its own vec_id. Repeated rows are candidates each; repeated queries are asked once. An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import least_hashed, stash

SAMPLE = 10_000
SEEDS = 512
BLOCK = 8192
QUERY_BLOCK = 2048
#: Shares of the vectors, by descending length, after which a class ends; the first class is a round, the others another.
CLASSES = (1 / 8, 1 / 4, 1 / 2, 3 / 4)
#: Bands of queries.
NEEDS = 16
STEP = 1024
_LONG = (1 << 63) - 1
#: Largest double that a sum of products may reach in longs.
_SAFE = float(1 << 62)


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(1024 x) of each component as a double, for the vectors that take part."""
    usable = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(1024D * double(x)) < double('infinity'))"
    # Beyond 2**52 a double is a whole number as it is.
    floor = "transform(embedding, x -> if(abs(1024D * double(x)) < 4503599627370496D, double(floor(1024D * double(x))), 1024D * double(x)))"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable).select("vec_id", F.expr(floor).alias("v"))


def matrix(column, d: int) -> np.ndarray:
    """Rows of lists as one matrix of d columns."""
    lengths = np.fromiter((len(v) for v in column), np.int64, len(column))
    if len(column) and (lengths == d).all():
        return np.stack(column.to_numpy()).astype(float)
    out = np.zeros((len(column), d))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def products(query: np.ndarray, vectors: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact inner products of query rows q with vectors v: as longs (the nearest, where they don't fit) and as doubles."""
    if not len(q):
        return np.zeros(0, np.int64), np.zeros(0)
    tops, most = np.abs(query).max(1, initial=0), np.abs(vectors).max(1, initial=0)
    if tops.max() * most.max(initial=0) * query.shape[1] < 1 << 53:  # every sum is a whole double
        if len(q) * 8 > len(query) * len(vectors):
            near = (query @ vectors.T)[q, v]
        else:
            near = np.concatenate([np.einsum("ij,ij->i", query[q[i : i + 65536]], vectors[v[i : i + 65536]]) for i in range(0, len(q), 65536)])
        return near.astype(np.int64), near
    out, near = np.zeros(len(q), np.int64), np.zeros(len(q))
    fits = (tops[q] * most[v] * query.shape[1] < _SAFE) & (np.maximum(tops[q], most[v]) < _SAFE)
    for rows in np.array_split(np.flatnonzero(fits), len(q) // 65536 + 1):
        out[rows] = (query[q[rows]].astype(np.int64) * vectors[v[rows]].astype(np.int64)).sum(1)
    near[fits] = out[fits]
    for i in np.flatnonzero(~fits).tolist():
        exact = sum(int(a) * int(b) for a, b in zip(query[q[i]].tolist(), vectors[v[i]].tolist(), strict=True))
        out[i] = max(-_LONG - 1, min(_LONG, exact))
        near[i] = float(exact) if abs(exact) < 1 << 1000 else np.copysign(np.inf, exact)
    return out, near


def lengths_of(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m**2).sum(1))


def best(query: np.ndarray, own: np.ndarray, floor: np.ndarray, vectors: np.ndarray, vec_id: np.ndarray, axes: np.ndarray, k: int):
    """(query row, vec_id, score, score as double) of the k best of each query that are not below floor, by pruned search."""
    head = max(1, query.shape[1] // 4)
    order = np.argsort(-lengths_of(vectors), kind="stable")
    vectors, vec_id = vectors[order], vec_id[order]
    lengths, size_q = lengths_of(vectors), lengths_of(query)
    with np.errstate(over="ignore", invalid="ignore"):
        turned_q, turned_v = query @ axes, vectors @ axes
        tail_q, tail_v = lengths_of(turned_q[:, head:]), lengths_of(turned_v[:, head:])
        floor = floor.astype(float).copy()
        none = np.zeros(0, np.int64)
        kept = [none, none, none, np.zeros(0)]
        for at in range(0, len(vectors), STEP):
            end = min(len(vectors), at + STEP)
            slack = 1e-9 * size_q * lengths[at] + 1e-3
            # What overflows to nan bounds nothing.
            active = np.flatnonzero(~(size_q * lengths[at] + slack < floor))
            if not len(active):
                break
            bound = turned_q[active, :head] @ turned_v[at:end, :head].T
            bound += np.outer(tail_q[active], tail_v[at:end])
            q, v = np.nonzero(~(bound + slack[active, None] < floor[active, None]))
            q, v = active[q], v + at
            fresh = own[q] != vec_id[v]
            q, v = q[fresh], v[fresh]
            score, near = products(query, vectors[at:end], q, v - at)
            some = near >= floor[q]
            q, v, score, near = q[some], v[some], score[some], near[some]
            q, name, score, near = (np.concatenate(x) for x in zip(kept, (q, vec_id[v], score, near), strict=True))
            order = np.lexsort((name, -near, ~score, q))
            q, name, score, near = q[order], name[order], score[order], near[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            kept = [x[rank < k] for x in (q, name, score, near)]
            full = np.flatnonzero(rank == k - 1)
            floor[q[full]] = np.maximum(floor[q[full]], near[full])
    return kept


FOUND = "query_id long, mark long, vec_id long, score long, near double"


def _marks(query: np.ndarray) -> np.ndarray:
    """A hash of each query's vector: with its id it names the query."""
    return pd.util.hash_array(np.array([row.tobytes() for row in query], dtype=object)).view(np.int64) if len(query) else np.zeros(0, np.int64)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row whose vec_id is divisible by every, against all rows."""
    spark = vectors.sparkSession
    v = stash(integer_vectors(vectors).withColumn("length", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))")), "vectors")
    # Shares of the vectors that are longer than the cuts: the seeds, then the classes.
    shares = [0.9999, 0.999, 0.99, 0.9] + [1 - x for x in CLASSES]
    total, d, cuts = v.agg(F.count("*"), F.max(F.size("v")), F.percentile_approx("length", shares, 10_000)).head()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = max(1, d)
    sample = matrix(least_hashed(v.select("vec_id", "v"), "vec_id", SAMPLE, total).select("v").toPandas()["v"], d)
    scale = np.abs(sample).max(initial=0) or 1.0
    axes = np.linalg.eigh(sample.T / scale @ (sample / scale))[1][:, ::-1]  # right singular vectors, the heaviest first
    enough = [c for x, c in zip(shares[:4], cuts[:4], strict=True) if (1 - x) * total >= 2 * SEEDS]
    seeds = (v.where(F.col("length") >= enough[0]) if enough else v).orderBy(F.desc("length"), "vec_id").limit(SEEDS).select("vec_id", "v").toPandas()
    seed_v, seed_id = matrix(seeds["v"], d), seeds["vec_id"].to_numpy()

    def started(batches):
        """Adds mark and floor, the k-th best score against the longest vectors (below it by rounding), and need."""
        for b in batches:
            query, own = matrix(b["q"], d), b["query_id"].to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                against = np.where(own[:, None] == seed_id[None, :], -np.inf, query @ seed_v.T)
                floor = np.full(len(b), -np.inf)
                if len(b) and against.shape[1] >= k:
                    floor = np.partition(against, against.shape[1] - k, axis=1)[:, against.shape[1] - k]
                    floor = np.nan_to_num(floor, nan=-np.inf, neginf=-np.inf)
                    floor -= 1e-9 * lengths_of(query) * lengths_of(seed_v).max(initial=0) + 1e-3
            yield pd.DataFrame({"query_id": own, "q": b["q"], "mark": _marks(query), "floor": np.nan_to_num(floor, nan=-np.inf, neginf=-np.inf)})

    asked = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    asked = stash(asked.mapInPandas(started, "query_id long, q array<double>, mark long, floor double"), "queries")
    def solve(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({n: np.zeros(0, t) for n, t in (("query_id", np.int64), ("mark", np.int64), ("vec_id", np.int64), ("score", np.int64), ("near", float))})
        own = q["query_id"].to_numpy()
        row, name, score, near = best(matrix(q["q"], d), own, q["floor"].to_numpy(), matrix(c["v"], d), c["vec_id"].to_numpy(), axes, k)
        return pd.DataFrame({"query_id": own[row], "mark": q["mark"].to_numpy()[row], "vec_id": name, "score": score, "near": near})

    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.desc("near"), "vec_id")
    # Classes of length, the longest first (0), each dealt by vec_id into blocks of bounded size.
    kind = F.lit(0)
    for c in sorted(set(cuts[4:])) if total > BLOCK else ():
        kind = kind + (F.col("length") < c).cast("int")
    v = v.withColumn("kind", kind)
    classes = [(r.kind, max(1, -(-r.n // BLOCK)), r.most) for r in v.groupBy("kind").agg(F.count("*").alias("n"), F.max("length").alias("most")).orderBy("kind").collect()]
    found = None
    for rest, blocks in ((1, classes[:1]), (0, classes[1:])):
        if not blocks:
            continue
        starts = np.cumsum([0, *(n for _, n, _ in blocks)]).tolist()
        # Blocks of queries by the length that a vector needs to matter to them: a block sees the classes that reach its least need.
        length_q = F.expr("sqrt(aggregate(q, 0D, (s, x) -> s + x * x))")
        need = F.coalesce(F.when(F.col("floor") > 0, F.col("floor") / (length_q * (1 + 1e-9))), F.lit(0.0))
        due = asked.withColumn("need", need)
        n_queries, *edges = due.agg(F.count("*"), F.percentile_approx("need", [i / NEEDS for i in range(1, NEEDS)], 1000)).head()
        band = F.lit(0)
        for e in sorted(set(edges[0] or [])) if n_queries > QUERY_BLOCK else ():
            band = band + (F.col("need") >= e).cast("int")
        due = due.withColumn("band", band)
        bands = due.groupBy("band").agg(F.count("*").alias("n"), F.min("need").alias("least")).orderBy("band").collect()
        q_first = np.cumsum([0, *(max(1, -(-r.n // QUERY_BLOCK)) for r in bands)]).tolist()
        seen = [sum(most >= r.least for _, _, most in blocks) for r in bands]  # classes from the longest on; fewer for greater needs
        qb, upto = F.lit(0), F.lit(0)
        for i, r in enumerate(bands):
            mine = F.col("band") == r.band
            qb = F.when(mine, F.lit(q_first[i]) + F.expr(f"cast(pmod(xxhash64(query_id, mark), {q_first[i + 1] - q_first[i]}) as int)")).otherwise(qb)
            upto = F.when(mine, F.lit(starts[seen[i]])).otherwise(upto)
        sent = due.select("query_id", "q", "mark", "floor", qb.alias("qb"), upto.alias("upto")).where("upto > 0").withColumn("cb", F.explode(F.expr("sequence(0, upto - 1)"))).drop("upto")
        cb, reach = F.lit(0), F.lit(0)
        for i, (name, n, _) in enumerate(blocks):
            mine = F.col("kind") == name
            cb = F.when(mine, F.lit(starts[i]) + F.expr(f"cast(pmod(xxhash64(vec_id, 7), {n}) as int)")).otherwise(cb)
            reach = F.when(mine, F.lit(q_first[sum(s > i for s in seen)])).otherwise(reach)
        here = v.where(F.col("kind").isin([name for name, _, _ in blocks]))
        dealt = here.select("vec_id", "v", cb.alias("cb"), reach.alias("reach")).where("reach > 0").withColumn("qb", F.explode(F.expr("sequence(0, reach - 1)"))).drop("reach")
        new = sent.groupBy("qb", "cb").cogroup(dealt.groupBy("qb", "cb")).applyInPandas(solve, FOUND)
        new = new if found is None else found.unionByName(new)
        found = new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if rest and classes[1:]:
            found = stash(found.drop("rank"), "found")
            kth = found.groupBy("query_id", "mark").agg(F.count("*").alias("n"), F.min("near").alias("kth")).where(F.col("n") >= k).select("query_id", "mark", "kth")
            asked = stash(asked.join(kth, ["query_id", "mark"], "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", "floor"))).drop("kth"), "queries")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle_sql(every: int = 100, k: int = 10) -> str:
    return f"""
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
