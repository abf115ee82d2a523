"""Exact top-k inner-product search: columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.llm.common import table

_LONG = 2**63 - 1


def best_of_tile(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = 8) -> list[tuple[int, int, int]]:
    """(query's place, vec_id, score) of the k best candidates of a tile for every query; ties to smaller ids. All are
    exact integers.

    Layout is vertical: a row per dimension, dimensions of most mass first. Scores are summed one block of dimensions
    after the other; before each, candidates whose sum so far plus the product of the remaining norms (Cauchy-Schwarz)
    stays below the k-th best known score go, and the survivors are compacted."""
    dims = vectors.shape[1]
    if dims and float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0)) * dims >= 2**53:
        return _exactly(queries, own, vectors, ids, k)
    heavy = np.argsort(-(vectors.astype(float) ** 2).sum(0), kind="stable")
    norms = (vectors.astype(float) ** 2).sum(1)
    order = np.lexsort((ids, -norms))
    ids, tall = ids[order], np.ascontiguousarray(vectors[order][:, heavy].T.astype(float))
    asked = queries[:, heavy].astype(float)
    cuts = list(range(0, dims, block)) + [dims]
    mass = np.zeros((len(cuts), len(ids)))
    asked_mass = np.zeros((len(cuts), len(asked)))
    for j in range(len(cuts) - 2, -1, -1):
        mass[j] = mass[j + 1] + (tall[cuts[j] : cuts[j + 1]] ** 2).sum(0)
        asked_mass[j] = asked_mass[j + 1] + (asked[:, cuts[j] : cuts[j + 1]] ** 2).sum(1)
    mass, asked_mass = np.sqrt(mass) * (1 + 1e-9), np.sqrt(asked_mass) * (1 + 1e-9)
    first = min(len(ids), max(256, 4 * k))
    seeds = asked @ tall[:, :first]  # a first bound for every query
    out = []
    for i in range(len(asked)):
        others = np.flatnonzero(ids != own[i])
        known = seeds[i][: np.searchsorted(others, first)] if len(others) == len(ids) else seeds[i][others[others < first]]
        bound = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf
        alive, sums = others, np.zeros(len(others))
        for j in range(len(cuts) - 1):
            keep = sums + asked_mass[j, i] * mass[j, alive] >= bound - 0.5
            if not keep.all():
                alive, sums = alive[keep], sums[keep]
            rows = tall[cuts[j] : cuts[j + 1]]
            sums = sums + asked[i, cuts[j] : cuts[j + 1]] @ (rows if len(alive) == len(ids) else rows[:, alive])
        if len(alive) > k:
            edge = np.partition(sums, len(sums) - k)[len(sums) - k]
            near = sums >= edge
            alive, sums = alive[near], sums[near]
        for j in np.lexsort((ids[alive], -sums))[:k]:
            out.append((i, int(ids[alive[j]]), int(sums[j])))
    return out


def _exactly(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The same for numbers too large for doubles; scores beyond the range of long become its ends."""
    out = []
    for i, q in enumerate(queries.astype(object)):
        scores = [(-max(-_LONG - 1, min(_LONG, int(sum(q * v)))), int(n)) for v, n in zip(vectors.astype(object), ids, strict=True) if n != own[i]]
        out += [(i, n, -s) for s, n in sorted(scores)[:k]]
    return out


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """key and v, floor(scale * x) of every component as double; rows that are null, hold null or non-finite components
    or have no key take no part."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("key"), v.alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    return rows.select("key", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding", tile_rows: int = 16384, tile_queries: int = 4096) -> DataFrame:
    """The k highest inner products of every query with the vectors that have another key, on floor(scale * x).

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, repeated rows count each as
    candidates and once as a query (the least vector of a repeated key). Only vectors of one length meet. Queries with
    fewer than k candidates get all; empty tables give no rows. Other columns are not read.

    Queries and candidates are dealt to tiles of bounded size by a hash; every tile of queries meets every tile of
    candidates in a task of its own, so neither side is broadcast or passes through the driver, and copies of one
    vector spread over all tiles. A tile returns k rows a query."""
    cand = whole_vectors(vectors, key, vector, scale)
    asked = whole_vectors(queries, key, vector, scale).groupBy("key").agg(F.min("v").alias("v"))
    tiles = cand.count() // tile_rows + 1
    parts = asked.count() // tile_queries + 1

    def spread(df: DataFrame, mine: str, n: int, other: str, m: int, kind: int) -> DataFrame:
        part = F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(n)) if not kind else F.pmod(F.xxhash64("key"), F.lit(n))
        dealt = df.select("key", "v", part.cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
        return dealt.select("a", "b", F.size("v").alias("d"), F.lit(kind).alias("kind"), "key", "v")

    both = spread(cand, "a", tiles, "b", parts, 0).unionByName(spread(asked, "b", parts, "a", tiles, 1))

    def tile(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        ids = rows.column("key").to_numpy()
        values = rows.column("v").combine_chunks()
        flat = values.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(values.flatten()) else np.zeros((len(ids), 0), np.int64)
        is_query = kind == 1
        found = best_of_tile(flat[is_query], ids[is_query], flat[~is_query], ids[~is_query], k) if is_query.any() and not is_query.all() else []
        place, other, score = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table([pa.array(ids[is_query][place]), pa.array(other), pa.array(score)], ["query_id", "vec_id", "score"])

    near = both.groupBy("a", "b", "d").applyInArrow(tile, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP2_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
