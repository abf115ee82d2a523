"""Segments of similar units: k by silhouette and by elbow, restarts, and what tells the segments apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.storage import stored
from strata.operators.selection import fit_all, side_by_side

#: Rows of one matrix product: their distances to some hundred centres stay in a core's cache.
CHUNK = 1024


def moved(points: DataFrame, sets: list[np.ndarray], chunk: int = CHUNK) -> list[tuple[np.ndarray, float]]:
    """For each set of centres the means of the points next to each (ties to the first centre; a centre without points
    stays) and the sum of squared distances to the centres given. points: one column, array<double> without NULLs. All
    sets are one matrix, so a chunk of points is one product; a task returns a row a centre."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    flat, sizes = np.concatenate([sets[i] for i in order]), [len(sets[i]) for i in order]
    width, norms = flat.shape[1], (flat * flat).sum(axis=1)
    #: times (point, 1, its square): the squared distance
    distance = np.column_stack([-2 * flat, norms, np.ones(len(flat))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, near = np.zeros(distance.shape), np.zeros((len(flat), chunk))
        for b in batches:
            rows = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            rows = np.column_stack([rows, np.ones(len(rows)), (rows * rows).sum(axis=1)])
            for x in (rows[at : at + chunk] for at in range(0, len(rows), chunk)):
                far, start = distance @ x.T, 0
                for k in sorted(set(sizes)):
                    n = sizes.count(k)
                    group = far[start : start + n * k].reshape(n, k, len(x))
                    closest = group == group.min(axis=1)[:, None]
                    if np.count_nonzero(closest) > n * len(x):
                        closest &= closest.cumsum(axis=1) == 1
                    near[start : start + n * k, : len(x)] = closest.reshape(n * k, len(x))
                    start += n * k
                total += near[:, : len(x)] @ x
        seen = np.flatnonzero(total[:, width])
        yield pa.RecordBatch.from_pydict({"centre": pa.array(seen, pa.int32()), "total": pa.array(list(total[seen]), pa.list_(pa.float64()))})

    parts = points.mapInArrow(run, "centre int, total array<double>")
    found = parts.groupBy("centre").agg(F.array(*[F.sum(F.get("total", i)) for i in range(width + 2)]).alias("total")).collect()  # a row a centre
    means, costs = flat.copy(), np.zeros(len(flat))
    for c, total in found:
        total = np.array(total)
        means[c], costs[c] = total[:width] / total[width], max(distance[c] @ total, 0.0)
    ends = np.cumsum(sizes)
    done = {i: (means[e - n : e], float(costs[e - n : e].sum())) for i, n, e in zip(order, sizes, ends, strict=True)}
    return [done[i] for i in range(len(sets))]


def lloyd(df: DataFrame, column: str, starts: list[np.ndarray], rounds: int = 20, tol: float = 1e-4) -> list[tuple[np.ndarray, float, int]]:
    """Centres, cost and rounds of a k-means run from each set of first centres, by the rules of MLlib's: at most `rounds`
    moves, until no centre moves farther than `tol`; the cost is that before the last move. A round is one pass over df
    for all runs together; a run that has ended takes no further part."""
    points = stored(df.select(vector_to_array(column).alias("point")), "points")
    runs, going = [(np.array(s, dtype=float), 0.0, 0) for s in starts], list(range(len(starts)))
    for r in range(rounds):
        still = []
        for i, (means, cost) in zip(going, moved(points, [runs[i][0] for i in going]), strict=True):
            if ((means - runs[i][0]) ** 2).sum(axis=1).max() > tol * tol:
                still.append(i)
            runs[i] = (means, cost, r + 1)
        going = still
        if not going:
            break
    return runs


def restarted(df: DataFrame, column: str, ks: list[int], restarts: int = 10) -> dict[int, KMeansModel]:
    """For each k the model of least cost among `restarts` seeds of k-means|| (ties to the smaller seed). MLlib draws the
    first centres of all of them; all are then run together, and MLlib fits the best seed of each k. df is read several
    times and must keep its order, as a stored table does."""
    base = KMeans(featuresCol=column, predictionCol="segment")
    grid = [{base.k: k, base.seed: seed} for k in ks for seed in range(1, restarts + 1)]
    first = fit_all(df, base.copy({base.maxIter: 0, base.solver: "block"}), grid)
    runs = lloyd(df, column, [np.array(m.clusterCenters()) for m in first], base.getMaxIter(), base.getTol())
    best: dict[int, tuple[float, dict]] = {}
    for setting, (_, cost, _) in zip(grid, runs, strict=True):
        k = setting[base.k]
        if k not in best or cost < best[k][0] * (1 - 1e-12):  # rounding chooses no seed
            best[k] = (cost, setting)
    return dict(zip(best, fit_all(df, base, [setting for _, setting in best.values()]), strict=True))


def elbow(table: DataFrame) -> DataFrame:
    """table (k, inertia, ...) with elbow: the distance to the chord from the first to the last k, both axes scaled to
    0..1, of a curve that falls; 0 if all inertias are equal."""
    ends = table.agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("inertia").alias("i0"), F.max("inertia").alias("i1"))
    x = F.try_divide(F.col("k") - F.col("k0"), F.col("k1") - F.col("k0"))
    y = F.try_divide(F.col("inertia") - F.col("i0"), F.col("i1") - F.col("i0"))
    distance = F.abs(F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)) - 1) / F.sqrt(F.lit(2.0))
    return table.crossJoin(ends).withColumn("elbow", F.round(F.when(F.col("i1") > F.col("i0"), distance).otherwise(F.lit(0.0)), 6)).drop("k0", "k1", "i0", "i1")  # one row


def segments(df: DataFrame, column: str, ks: list[int], restarts: int = 10) -> tuple[DataFrame, DataFrame, KMeansModel]:
    """k, inertia, silhouette, elbow, is_chosen (the largest silhouette, ties to the smaller k) and is_elbow (the largest
    distance, ties to the smaller k); df with segment and plane (two principal components) by the chosen model; the model."""
    judge = ClusteringEvaluator(featuresCol=column, predictionCol="segment")
    models = restarted(df, column, ks, restarts)
    widths = side_by_side([lambda m=m: float(judge.evaluate(m.transform(df))) if m.summary.k > 1 else None for _, m in sorted(models.items())])
    found = [(k, float(m.summary.trainingCost), width) for (k, m), width in zip(sorted(models.items()), widths, strict=True)]
    chosen = max(found, key=lambda r: (-2.0 if r[2] is None else r[2], -r[0]))[0]
    table = elbow(df.sparkSession.createDataFrame(found, "k int, inertia double, silhouette double"))
    bend = table.agg(F.max_by("k", F.struct("elbow", -F.col("k"))).alias("_bend"))
    table = table.crossJoin(bend).select("k", "inertia", "silhouette", "elbow", (F.col("k") == chosen).alias("is_chosen"), (F.col("k") == F.col("_bend")).alias("is_elbow"))  # one row
    done = models[chosen].transform(df)
    return table, PCA(k=2, inputCol=column, outputCol="plane").fit(done).transform(done), models[chosen]


def spread(rows: DataFrame, segment: str, values: dict[str, Column]) -> DataFrame:
    """feature, between, ratio: the variance of the segments' means, each segment counting once, and its ratio to the
    variance within segments; NULLs of a feature are left out. Two aggregates for all features together."""
    long = [(F.count(v).alias(f"n_{c}"), F.avg(v).alias(f"m_{c}"), F.var_pop(v).alias(f"v_{c}")) for c, v in values.items()]
    each = rows.groupBy(segment).agg(*[x for t in long for x in t])
    one = each.agg(*[x for c in values for x in (F.var_pop(f"m_{c}").alias(f"b_{c}"), (F.sum(F.col(f"v_{c}") * F.col(f"n_{c}")) / F.sum(f"n_{c}")).alias(f"w_{c}"))])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(f"b_{c}", 6).alias("between"), F.round(F.try_divide(F.col(f"b_{c}"), F.col(f"w_{c}")), 6).alias("ratio")) for c in values])
    return one.select(F.inline(parts))


def profile(rows: DataFrame, segment: str, label: str, values: list[str], names: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """segment, name, n, pct, rate (of the label, described only), feature, median (of the values as they are): a row for
    each segment and feature. Medians are mergeable sketches, exact up to `accuracy` rows a segment. names: segment, name;
    equal names get their segment's number."""
    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row a segment
    each = rows.groupBy(segment).agg(F.count("*").alias("n"), F.round(F.avg(F.col(label).cast("double")), 6).alias("rate"), *[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(f"m_{c}") for c in values])
    same = F.count("*").over(Window.partitionBy("name"))
    named = names.withColumn("name", F.when(same > 1, F.format_string("%s (%d)", "name", segment)).otherwise(F.col("name")))
    each = each.join(named, segment).withColumn("pct", F.round(F.col("n") / total, 6))
    medians = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("median")) for c in values])
    return each.select(segment, "name", "n", "pct", "rate", F.inline(medians))


def centre_name(frequency: Column, recency: Column, modes: Column, trend: Column) -> Column:
    """A name from a segment's standardised centre: how often, by how many modes, and whether use falls or rises."""
    often = F.when(frequency > 0.5, "frequent").when(frequency < -0.5, "occasional").otherwise("regular")
    course = F.when((trend < -0.5) | (recency > 0.5), "declining").when((trend > 0.5) & (recency <= 0), "rising")
    return F.concat_ws(" ", often, F.when(modes > 0.5, "multimodal"), course)


def centres(rows: DataFrame, segment: str, column: str, names: list[str]) -> DataFrame:
    """segment and the means of the named parts of a vector column."""
    parts = vector_to_array(column)
    return rows.groupBy(segment).agg(*[F.avg(F.get(parts, k)).alias(c) for k, c in enumerate(names)])


def named_centres(means: DataFrame, segment: str, frequency: str, recency: str, modes: str, trend: str) -> DataFrame:
    return means.select(segment, centre_name(*[F.col(c) for c in (frequency, recency, modes, trend)]).alias("name"))

