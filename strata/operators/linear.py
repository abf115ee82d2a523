"""Many logistic models at once: those of MLlib, with one pass over the rows for all of them.

MLlib fits a model by some seventy jobs, one after the other. Here each model takes the same steps (L-BFGS, or OWL-QN where
the penalty has a share of L1, with MLlib's scaling, line searches and ends), but what all models ask for next, loss and
gradient at a point each, comes from one job. Points and gradients are as long as a row; rows stay in blocks in tasks."""

from __future__ import annotations

import pickle
from collections.abc import Generator, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.storage import stored

Asked = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


class _NoStep(Exception):
    """A line search or a history without a next step; a search goes on from an empty history once."""


def _direction(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Two loops over the last steps and changes of gradient, the latest first."""
    towards, shares = gradient.copy(), []
    scale = 1.0
    if history:
        step, change = history[0]
        along = step @ change
        if not along >= 0:
            raise _NoStep
        scale = along / (change @ change) if change.any() else np.nan
    for step, change in history:
        shares.append(np.divide(step @ towards, step @ change))
        if np.isnan(shares[-1]):
            raise _NoStep
        towards -= shares[-1] * change
    towards *= scale
    for (step, change), share in zip(history[::-1], shares[::-1], strict=True):
        towards += (share - (change @ towards) / (step @ change)) * step
    return -towards


def _strong_wolfe(at, value: float, slope: float, t: float):
    """A step that meets the strong Wolfe conditions: at most ten longer ones, then at most ten cubic interpolations."""
    if slope > 0:
        raise _NoStep
    low = (0.0, value, slope)
    between = None
    for tried in range(10):
        f, d = yield from at(t)
        c = (t, f, d)
        if not np.isfinite(f):
            t /= 2
            continue
        if f > value + 1e-4 * t * slope or (f >= low[1] and tried > 0):
            between = low, c
            break
        if abs(d) <= 0.9 * abs(slope):
            return t
        if d >= 0:
            between = c, low
            break
        low, t = c, 1.5 * t
    if between is None:
        raise _NoStep
    low, high = between
    for _ in range(10):
        (a, fa, da), (b, fb, db) = (high, low) if low[0] > high[0] else (low, high)
        d1 = da + db - 3 * (fa - fb) / (a - b)
        d2 = np.sqrt(d1 * d1 - da * db)
        t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
        if np.isnan(t):
            raise _NoStep
        t = min(max(t, a + 0.1 * (b - a)), a + 0.9 * (b - a))
        f, d = yield from at(t)
        if f > value + 1e-4 * t * slope or f >= low[1]:
            high = (t, f, d)
        else:
            if abs(d) <= 0.9 * abs(slope):
                return t
            if d * (high[0] - low[0]) >= 0:
                high = low
            low = (t, f, d)
    raise _NoStep


def _backtracking(at, value: float, whole: float, slope: float, t: float, shrink: float):
    """A step by shrinking and growing. MLlib's library judges the first one by the value without the penalty."""
    f, (_, d) = value, (yield from at(t))
    for _ in range(20):
        factor = shrink if f > whole + t * slope * 1e-4 else 2.1 if d < 0.9 * slope else shrink if d > -0.9 * slope else 1.0
        if factor == 1.0:
            return t
        before, t = t, t * factor
        if not 1e-10 <= t <= 1e10:
            raise _NoStep
        f, d = yield from at(t)
    return before  # the twentieth


def minimum(start: np.ndarray, l1: np.ndarray | None, rounds: int = 60, memory: int = 10, tolerance: float = 1e-6) -> Asked:
    """A search for the least point of a function, l1 (weights of the absolute values) aside: yields points, is sent value
    and gradient there, returns the point and how many steps it took."""
    last: list = [None, None]

    def ask(x: np.ndarray):
        if last[0] is None or not np.array_equal(last[0], x):
            last[:] = x, (yield x)
        return last[1]

    def penalised(x: np.ndarray, value: float, gradient: np.ndarray) -> tuple[float, np.ndarray]:
        if l1 is None:
            return value, gradient
        up, down = gradient + l1, gradient - l1
        at_zero = np.where(l1 == 0, gradient, np.where(down > 0, down, np.where(up < 0, up, 0.0)))
        return value + float(l1 @ np.abs(x)), np.where(x == 0, at_zero, gradient + np.sign(x) * l1)

    x, step, history, failed = start, 0, [], False
    value, gradient = yield from ask(x)
    whole, slopes = penalised(x, value, gradient)
    first, values = whole, [np.inf]
    while True:
        if step >= rounds or (len(values) > 1 and abs(whole - max(values)) <= tolerance * abs(first)) or np.linalg.norm(slopes) <= max(tolerance * whole, 1e-8):
            return x, step
        try:
            towards = _direction(slopes, history)
            if l1 is not None:
                towards = np.where(towards * slopes < 0, towards, 0.0)
            side = np.where(x != 0, np.sign(x), np.sign(-slopes))

            def moved(t: float) -> np.ndarray:
                to = x + towards * t  # noqa: B023
                return to if l1 is None else np.where(np.sign(to) == side, to, 0.0)  # noqa: B023

            def at(t: float):
                to = moved(t)  # noqa: B023
                f, g = penalised(to, *(yield from ask(to)))
                return f, float(g @ towards)  # noqa: B023

            if l1 is None:
                t = yield from _strong_wolfe(at, value, float(gradient @ towards), 1 / np.linalg.norm(towards) if step == 0 else 1.0)
                if t * np.linalg.norm(gradient) < 1e-10:
                    raise _NoStep
            else:
                t = yield from _backtracking(at, value, whole, float(slopes @ towards), 0.5 / np.linalg.norm(gradient) if step == 0 else 1.0, 0.1 if step == 0 else 0.5)
        except _NoStep:
            if failed:
                return x, step
            failed, history = True, []
            continue
        to = moved(t)
        value, after = yield from ask(to)
        history = [(to - x, after - gradient), *history][:memory]
        x, gradient, step, failed = to, after, step + 1, False
        whole, slopes = penalised(x, value, gradient)
        values = [*values, whole][-20:]


def packed(x: np.ndarray) -> bytes:
    """The columns of a matrix, those of few values as their values and places in them: a sixth of the bytes or so."""
    columns = []
    for c in x.T:
        values, places = np.unique(c, return_inverse=True)
        columns.append((values, places.astype(np.min_scalar_type(len(values)))) if 8 * len(values) <= len(c) or len(values) == 1 else (None, c.copy()))
    return pickle.dumps(columns)


def unpacked(x: bytes, n: int) -> np.ndarray:
    """What was packed, a row a column, each of n values."""
    columns = pickle.loads(x)
    out = np.empty((len(columns), n))
    for to, (values, places) in zip(out, columns, strict=True):
        to[:] = places if values is None else values[places]
    return out


def blocked(rows: DataFrame, place: int, kept: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Scaled features (those in kept) and labels of rows in blocks: place, x, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)[:, kept] * scale
                y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([packed(x)], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["place", "x", "y"])

    return rows.select(vector_to_array("features"), "label").mapInArrow(run, "place int, x binary, y binary")


def losses(blocks: DataFrame, points: dict[int, np.ndarray], means: list[np.ndarray], chunk: int = 1024) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each table (its place) the sums over its rows of the loss and of its gradient at points, a row each: weights of
    features less their means, then the intercept. What a task returns is as large as the points."""
    at = {p: (w[:, :-1].copy(), w[:, -1] - w[:, :-1] @ means[p]) for p, w in points.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in batches:
            for place, xs, ys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if place not in at:
                    continue
                y_all, (weights, shift) = np.frombuffer(ys), at[place]
                x_all = unpacked(xs, len(y_all))
                if place not in sums:
                    sums[place] = [np.zeros(len(shift)), np.zeros(weights.shape), np.zeros(len(shift))]
                loss, slope, level = sums[place]
                for k in range(0, len(y_all), chunk):
                    x, y = x_all[:, k : k + chunk], y_all[k : k + chunk]
                    margin = weights @ x + shift[:, None]
                    small = np.exp(-np.abs(margin))
                    loss += (np.maximum(margin, 0) - y * margin + np.log(1 + small)).sum(1)
                    off = np.where(margin >= 0, 1.0, small) / (1 + small) - y
                    slope += off @ x.T
                    level += off.sum(1)
        for place, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in found]], ["place", "loss", "slope", "level"])

    out = {p: (np.zeros(len(w)), np.zeros(w.shape)) for p, w in points.items()}
    for r in blocks.mapInArrow(run, "place int, loss binary, slope binary, level binary").collect():  # a row a table and task
        loss, gradient = out[r["place"]]
        level = np.frombuffer(r["level"])
        loss += np.frombuffer(r["loss"])
        gradient[:, :-1] += np.frombuffer(r["slope"]).reshape(len(level), -1) - np.outer(level, means[r["place"]])
        gradient[:, -1] += level
    return out


def logistic_models(tables: list[DataFrame], settings: list[tuple[float, float]], rounds: int = 60) -> list[list[tuple[np.ndarray, float]]]:
    """For each table (features, label 0 or 1, both there) the models of all settings (lambda as a sum over rows, share of
    L1), each as coefficients and intercept: those of MLlib's logistic regression without standardisation. Where all labels
    are the same, weights are zero and the intercept is infinite."""
    found = []
    for rows in tables:
        r = rows.agg(Summarizer.metrics("mean", "std").summary(F.col("features")).alias("s"), F.count("*").alias("n"), F.sum("label").alias("p")).select("s.*", "n", "p").first()
        found.append((r["mean"].toArray(), r["std"].toArray(), r["n"], int(r["p"] or 0)))
    if not all(n for _, _, n, _ in found):
        raise ValueError("a table without rows")
    kept = [np.flatnonzero(sd) for _, sd, _, _ in found]  # a constant feature has no weight
    deviations = [sd[k] for (_, sd, _, _), k in zip(found, kept, strict=True)]
    means = [mean[k] / sd for (mean, _, _, _), k, sd in zip(found, kept, deviations, strict=True)]
    blocks = stored(reduce(DataFrame.unionAll, [blocked(rows, p, kept[p], 1 / deviations[p]) for p, rows in enumerate(tables)]), "blocks").persist()
    searches, asked, ended = {}, {}, {}

    def go_on(key: tuple[int, int], answer: tuple[float, np.ndarray] | None) -> None:
        try:
            asked[key] = searches[key].send(answer)
        except StopIteration as end:
            ended[key] = end.value[0]
            asked.pop(key, None)

    for p, (_, _, n, positive) in enumerate(found):
        for s, (strength, share) in enumerate(settings):
            if not 0 < positive < n:
                ended[p, s] = np.append(np.zeros(len(kept[p])), np.inf if positive else -np.inf)
                continue
            l1 = np.append(strength / n * share / deviations[p], 0.0)
            searches[p, s] = minimum(np.append(np.zeros(len(kept[p])), np.log(positive / (n - positive))), l1 if l1.any() else None, rounds)
            go_on((p, s), None)
    while asked:
        keys = {p: sorted(s for q, s in asked if q == p) for p in {p for p, _ in asked}}
        sums = losses(blocks, {p: np.array([asked[p, s] for s in own]) for p, own in keys.items()}, means)
        for p, own in keys.items():
            n = found[p][2]
            for place, s in enumerate(own):
                strength, share = settings[s]
                l2, at = strength / n * (1 - share), asked[p, s][:-1]
                pull = at / deviations[p] ** 2
                go_on((p, s), (sums[p][0][place] / n + 0.5 * l2 * float(at @ pull), sums[p][1][place] / n + l2 * np.append(pull, 0.0)))
    blocks.unpersist()
    out = []
    for p, (mean, _, _, _) in enumerate(found):
        own = []
        for s in range(len(settings)):
            weights = np.zeros(len(mean))
            weights[kept[p]] = ended[p, s][:-1] / deviations[p]
            own.append((weights, float(ended[p, s][-1] - weights @ mean)))
        out.append(own)
    return out
