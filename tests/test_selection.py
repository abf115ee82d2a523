"""Model selection, segments and saved models: against plain loops, and for what must not change."""

import math
import random
import statistics
import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strata.operators import linear, ml, model_store, segments, selection, tally


@pytest.fixture(scope="module")
def people(spark):
    """Units whose label follows x, not noise; missing values and kinds."""
    rng = random.Random(1)
    rows = []
    for u in range(240):
        x = rng.gauss(0, 1)
        rows.append((u, x if rng.random() > 0.1 else None, rng.gauss(0, 1), rng.choice(["a", "b", None]), int(x + rng.gauss(0, 0.4) > 0)))
    df = spark.createDataFrame(rows, "unit long, x double, noise double, kind string, label int")
    return ml.folds(df, "unit", "label").cache()


def average_precision(pairs):
    total, hits, seen, out = sum(y for _, y in pairs), 0, 0, 0.0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        p = [y for t, y in pairs if t == s]
        hits, seen = hits + sum(p), seen + len(p)
        out += hits / seen * sum(p) / total
    return out


def test_folds_are_fixed_and_stratified(spark, people):
    again = ml.folds(people.drop("fold").repartition(7), "unit", "label")
    assert again.join(people, ["unit", "fold"]).count() == 240
    sizes = {(r.fold, r.label): r["count"] for r in people.groupBy("fold", "label").count().collect()}
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) < 24


def test_the_path_chooses_by_the_folds_it_shows(spark, people):
    df, pre = ml.prepared(people, ["x", "noise"], ["kind"])
    path, rows, scores = selection.regularisation_path(df, pre, "unit", {"L2": 0.0, "L1": 1.0}, [0.01, 1.0, 100.0])
    path, scores = path.collect(), scores.collect()
    assert len(path) == 6 and sum(r.is_best for r in path) == 2
    for r in path:
        own = [s for s in scores if (s.penalty, s["lambda"]) == (r.penalty, r["lambda"])]
        seen = {k: average_precision([(s.score, s.label) for s in own if s.model == k and s.fold == k]) for k in range(5)}
        assert r.mean_ap == pytest.approx(statistics.mean(seen.values()), abs=2e-6) and r.sd_ap == pytest.approx(statistics.stdev(seen.values()), abs=2e-6)
        best = max((q for q in path if q.penalty == r.penalty), key=lambda q: (q.mean_ap, q["lambda"]))
        assert r.is_best == (r["lambda"] == best["lambda"])
        assert {(s.unit, s.model) for s in own} == {(u, k) for u in range(240) for k in range(5)}
    assert max(r.mean_ap for r in path) > 0.9


def test_metrics_read_scores_once_and_paths_store_no_scores(spark, people, monkeypatch):
    scored = spark.range(100).selectExpr("id", "id % 3 as g", "id / 100 as score", "cast(id % 2 as int) as label")
    one = ml.metrics(scored, by=["g"])
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    for r in one.collect():
        own = [(i / 100, i % 2) for i in range(100) if i % 3 == r.g]
        assert r.n == len(own) and r.brier == pytest.approx(sum((s - y) ** 2 for s, y in own) / len(own), abs=1e-6)
    assert ml.metrics(scored.where("id < 0")).first().n == 0
    names, store = [], selection.stored
    monkeypatch.setattr(selection, "stored", lambda df, name: names.append(name) or store(df, name))
    df, pre = ml.prepared(people, ["x", "noise"], ["kind"])
    selection.regularisation_path(df, pre, "unit", {"L2": 0.0}, [0.1])
    assert "path-rows" in names and "path-scores" not in names


def test_all_models_scores_equal_each_models_own(spark, people):
    df, pre = ml.prepared(people, ["x", "noise"], ["kind"])
    _, rows = selection.fold_tables(df, pre, "unit")[0]
    base = ml.logistic(1.0, 0.0, 200)
    models = selection.fit_all(rows.where("fold <> 0"), base, [{base.regParam: r} for r in (0.001, 0.1, 1.0)])
    got = {(r.unit, r.setting): r.score for r in selection.linear_scores(rows, models).collect()}
    for k, m in enumerate(models):
        assert m.getRegParam() == (0.001, 0.1, 1.0)[k]
        for r in m.transform(rows).select("unit", vector_to_array("probability")[1].alias("p")).collect():
            assert got[r.unit, k] == pytest.approx(r.p, abs=1e-6)


def test_models_of_a_path_share_their_passes_and_are_those_of_mllib(spark, people, monkeypatch):
    df, pre = ml.prepared(people, ["x", "noise"], ["kind"])
    tables = [rows.where(F.col("fold") != k) for k, (_, rows) in selection.fold_tables(df, pre, "unit").items()][:2]
    settings = [(lam, share) for share in (0.0, 1.0, 0.5) for lam in (0.001, 0.3, 10.0, 1e4)]
    passes, losses = [], linear.losses
    monkeypatch.setattr(linear, "losses", lambda *a, **b: passes.append(1) or losses(*a, **b))
    found = linear.logistic_models(tables, settings)
    steps = 0
    for rows, models in zip(tables, found, strict=True):
        n = rows.count()
        base = ml.logistic(1.0, 0.0, n)
        for (weights, intercept), own in zip(models, selection.fit_all(rows, base, [{base.regParam: lam / n, base.elasticNetParam: share} for lam, share in settings]), strict=True):
            assert np.allclose(weights, own.coefficients.toArray(), atol=1e-6) and intercept == pytest.approx(own.intercept, abs=1e-6)
            assert ((weights != 0) == (own.coefficients.toArray() != 0)).all()
            steps += own.summary.totalIterations
    assert steps > 2 * len(passes) > 0
    same = linear.logistic_models([tables[0].where("label = 1")], [(1.0, 0.0)])[0][0]
    assert not same[0].any() and same[1] == math.inf
    monkeypatch.setattr(selection, "fit_all", None)
    assert len(selection.refitted(df, pre, selection.regularisation_path(df, pre, "unit", {"L1": 1.0}, [0.1, 1.0])[0])) == 1


def test_blocks_are_as_they_were():
    x = np.column_stack([np.arange(64.0) / 7, np.arange(64) % 3 - 0.1, np.zeros(64)])
    assert (linear.unpacked(linear.packed(x), 64) == x.T).all() and len(linear.packed(x)) < x.nbytes


def test_counted_metrics_are_those_of_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(y), [float(v) for v in np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.3, 3), 0, 1), 6)]) for g, y in zip(rng.integers(0, 4, 500), rng.integers(0, 2, 500), strict=True)]
    rows += [(9, 1, [0.5, 0.5, 1.0]), (9, 0, [0.5, 0.1, 0.0])]
    df = spark.createDataFrame(rows, "g int, label int, features array<double>").repartition(5)
    want = {(r.g, r.setting): r for r in ml.metrics(df.select("g", "label", F.posexplode("features").alias("setting", "score")), by=["g", "setting"]).collect()}
    for most in (1, 1 << 23):
        got = tally.metrics(tally.tallied(df, ["g"], lambda x: x, most), ["g"]).collect()
        assert len(got) == len(want) == 15
        for r in got:
            w = want[r.g, r.setting]
            assert r.n == w.n and (r.average_precision, r.roc_auc, r.brier) == pytest.approx((w.average_precision, w.roc_auc, w.brier), abs=1e-6)
    one = tally.metrics(tally.tallied(df.where("g = 9 and label = 0"), ["g"], lambda x: x), ["g"]).first()
    assert one.n == 1 and one.average_precision is None and one.roc_auc is None


def test_coefficients_bear_the_features_names(spark, people):
    df, pre = ml.prepared(people, ["x", "noise"], ["kind"])
    model = Pipeline(stages=[*pre.getStages(), ml.logistic(1.0, 0.0, 240)]).fit(df)
    got = [tuple(r) for r in ml.coefficients(model, model.transform(df), 1, {"numbers": ["x", "noise"]}).collect()]
    assert got[1][0] == "x" and got[1][2] == "positive" and got[1][1] > 1 > got[0][1]


def test_ties_go_to_the_larger_lambda(spark):
    t = spark.createDataFrame([("a", 1.0, 0.5), ("a", 2.0, 0.5), ("a", 3.0, 0.4), ("b", 1.0, 0.1)], "penalty string, lambda double, mean_ap double")
    got = {(r.penalty, r["lambda"]) for r in selection.choose(t, "mean_ap", F.col("lambda"), by=["penalty"]).where("is_best").collect()}
    assert got == {("a", 2.0), ("b", 1.0)}


def test_first_trees_are_the_shorter_model(spark, people):
    df, pre = ml.prepared(people, ["x", "noise"], ["kind"])
    rows = pre.fit(df).transform(df).select("unit", "fold", "label", "features").cache()
    long, short = (GBTClassifier(featuresCol="features", labelCol="label", maxIter=n, maxDepth=2, seed=1).fit(rows) for n in (6, 3))
    staged = {(r.unit, r.setting): r.score for r in selection.staged_scores(long, rows, [3, 6], group=2).collect()}
    for k, m in enumerate((short, long)):
        for r in m.transform(rows).select("unit", vector_to_array("probability")[1].alias("p")).collect():
            assert staged[r.unit, k] == pytest.approx(r.p, abs=1e-6)


def test_folds_are_fitted_side_by_side(spark, people, monkeypatch):
    df, pre = ml.prepared(people, ["x", "noise"], ["kind"])
    together, forest = threading.Barrier(ml.FOLDS), ml.forest

    class Waits:
        def fit(self, rows):
            together.wait(timeout=60)  # until the forests of all folds are at it
            return forest(3).fit(rows)

    monkeypatch.setattr(ml, "forest", lambda trees: Waits())
    table, rows = selection.tree_path(df, pre, "unit", steps=[0.1], rounds=[2, 3], depths=[2], least=[1], trees=3)
    assert [(r.setting, r.kind, r.rounds) for r in table.orderBy("setting").collect()] == [(0, "boosted", 2), (1, "boosted", 3), (2, "forest", 3)]
    assert rows.where("part = 'validation'").groupBy("setting").agg(F.sum("n").alias("n")).select("n").distinct().collect() == [(people.count(),)]
    with pytest.raises(ZeroDivisionError):
        selection.side_by_side([lambda: 1, lambda: 1 / 0])
    assert selection.side_by_side([lambda k=k: k for k in range(20)]) == list(range(20)) and selection.side_by_side([]) == []


def test_all_trees_of_a_boosted_model_are_one_call_a_row_and_no_score_is_stored(spark, people, monkeypatch):
    df, pre = ml.prepared(people, ["x", "noise"], ["kind"])
    rows = pre.fit(df).transform(df).select("unit", "fold", "label", "features").cache()
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=12, maxDepth=3, seed=1).fit(rows)
    plan = selection.leaves(model, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(features") == 1
    got = {(r.unit, r.setting): r.score for r in selection.staged_scores(model, rows, [12, 1]).collect()}
    for r in model.transform(rows).select("unit", vector_to_array("probability")[1].alias("p")).collect():
        assert got[r.unit, 0] == pytest.approx(r.p, abs=1e-6)
    first = model.trees[0].setFeaturesCol("features").setPredictionCol("t")
    for r in first.transform(rows).select("unit", "t").collect():
        assert got[r.unit, 1] == pytest.approx(1 / (1 + math.exp(-2 * r.t)), abs=1e-6)
    tables, store = [], selection.stored
    monkeypatch.setattr(selection, "stored", lambda df, name: tables.append((name, df.columns)) or store(df, name))
    table, result = selection.tree_path(df, pre, "unit", steps=[0.1], rounds=[2, 3], depths=[2], least=[1], trees=3)
    assert [name for name, _ in tables].count("tree-cells") == 10 and not any("score" in columns for _, columns in tables)
    k, seen = 2, "validation"
    _, fold = selection.fold_tables(df, pre, "unit")[k]
    own = GBTClassifier(featuresCol="features", labelCol="label", maxIter=3, seed=1, maxBins=64, stepSize=0.1, maxDepth=2).fit(fold.where(F.col("fold") != k)).transform(fold.where(F.col("fold") == k))
    want = average_precision([(round(r.p, 6), r.label) for r in own.select("label", vector_to_array("probability")[1].alias("p")).collect()])
    assert result.where(f"setting = 1 and model = {k} and part = '{seen}'").first().average_precision == pytest.approx(want, abs=2e-6)


def test_values_are_dealt_within_folds_and_nothing_else_changes(spark, people):
    raw = people.select("unit", "fold", "label", "x", "kind")
    dealt = selection.permuted(raw, ["x", "kind"], "unit", 3, bucket_rows=50).collect()
    before = {r.unit: r for r in raw.collect()}
    assert len(dealt) == 240 * 2 * 3
    moved = 0
    for f, other in (("x", "kind"), ("kind", "x")):
        for k in range(3):
            rows = [r for r in dealt if (r.feature, r.repeat) == (f, k)]
            assert {r.unit for r in rows} == set(before) and all(r[other] == before[r.unit][other] and r.fold == before[r.unit].fold for r in rows)
            for fold in range(5):
                assert sorted(str(r[f]) for r in rows if r.fold == fold) == sorted(str(b[f]) for b in before.values() if b.fold == fold)
            moved += sum(r.x != before[r.unit].x for r in rows if f == "x")
    assert moved > 500


def test_what_matters_has_the_largest_importance(spark, people):
    models = {}
    for k in range(ml.FOLDS):
        df, pre = ml.prepared(people.where(F.col("fold") != k), ["x", "noise"], ["kind"])
        model = Pipeline(stages=[*pre.getStages(), ml.logistic(1.0, 0.0, 200)]).fit(df)
        models[k] = lambda seen, model=model: model.transform(ml.prepared(seen, ["x", "noise"], ["kind"])[0]).withColumn("score", vector_to_array("probability")[1])
    got = selection.permutation_importance(people, ["x", "noise", "kind"], "unit", models, repeats=3, top=2).collect()
    assert [r.place for r in got] == [1, 2] and got[0].feature == "x" and got[0].importance > 0.1 > abs(got[1].importance)


def test_terms_of_linear_models_give_the_same_importance(spark, people, monkeypatch):
    models, prepare = {}, lambda seen: ml.prepared(seen, ["x", "noise"], ["kind"])[0]
    for k in range(ml.FOLDS):
        df, pre = ml.prepared(people.where(F.col("fold") != k), ["x", "noise"], ["kind"])
        models[k] = Pipeline(stages=[*pre.getStages(), ml.logistic(1.0, 0.0, 200)]).fit(df)
    scored = {k: lambda seen, m=m: m.transform(prepare(seen)).withColumn("score", F.round(vector_to_array("probability")[1], 6)) for k, m in models.items()}
    want = selection.permutation_importance(people, ["x", "noise", "kind"], "unit", scored, repeats=3).collect()
    monkeypatch.setattr(selection, "permuted", None)  # no row is repeated
    got = selection.linear_permutation_importance(people, [["x", "noise"], ["kind"]], "unit", models, prepare, repeats=3).collect()
    assert got == want and len(got) == 3


def test_average_percentile_rank(spark):
    rng = random.Random(7)
    values = [rng.choice([None, *range(40)]) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(values)), "unit long, v int").repartition(6)
    known = sorted(v for v in values if v is not None)
    want = {u: 0.5 if v is None else round(statistics.mean(i + 1 for i, x in enumerate(known) if x == v) / len(known), 6) for u, v in enumerate(values)}
    ranked = ml.percentile_rank(df, "unit", "v")
    assert {r.unit: r.score for r in ranked.collect()} == pytest.approx(want, abs=1e-6)
    assert ml.percentile_rank(df.limit(0), "unit", "v").count() == 0


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal((6 * (i % 3), -6 * (i % 3), 0), 0.5)], i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "unit long, v array<double>, truth int")
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("numbers", array_to_vector("v")).withColumns({"a": F.get("v", 0), "b": F.get("v", 1), "c": F.get("v", 2), "label": (F.col("truth") == 1).cast("int")}).cache()


def test_segments_find_the_blobs(spark, blobs):
    table, rows, model = segments.segments(blobs.select("unit", "truth", "numbers"), "numbers", [2, 3, 4, 5], restarts=3)
    table = {r.k: r for r in table.collect()}
    assert [k for k, r in table.items() if r.is_chosen] == [3] == [k for k, r in table.items() if r.is_elbow]
    assert rows.groupBy("truth").agg(F.countDistinct("segment").alias("n")).where("n > 1").count() == 0
    one = KMeans(featuresCol="numbers", k=3, seed=1).fit(blobs).summary.trainingCost
    assert table[3].inertia <= one + 1e-6 and len(model.clusterCenters()) == 3


def test_runs_of_all_seeds_together_are_those_of_mllib(spark, blobs):
    rows = blobs.repartition(3).cache()
    grid = [(k, seed) for k in (2, 4, 7) for seed in (1, 2)]
    first = [KMeans(featuresCol="numbers", k=k, seed=seed, maxIter=0).fit(rows) for k, seed in grid]
    runs = segments.lloyd(rows, "numbers", [np.array(m.clusterCenters()) for m in reversed(first)])
    assert len({rounds for _, _, rounds in runs}) > 1
    for (k, seed), (centres, cost, rounds) in zip(reversed(grid), runs, strict=True):
        own = KMeans(featuresCol="numbers", k=k, seed=seed).fit(rows)
        assert np.allclose(centres, own.clusterCenters(), atol=1e-9) and rounds == own.summary.numIter
        assert cost == pytest.approx(own.summary.trainingCost, rel=1e-9)


def test_restarts_are_not_fitted_one_by_one(spark, blobs, monkeypatch):
    fitted, fit_all = [], segments.fit_all
    monkeypatch.setattr(segments, "fit_all", lambda df, e, grid: fitted.append((e.getMaxIter(), len(grid))) or fit_all(df, e, grid))
    models = segments.restarted(blobs, "numbers", [2, 4], restarts=4)
    assert sum(n for rounds, n in fitted if rounds > 0) == 2
    for k, model in models.items():
        costs = [KMeans(featuresCol="numbers", k=k, seed=seed).fit(blobs).summary.trainingCost for seed in range(1, 5)]
        assert model.summary.trainingCost == pytest.approx(min(costs), rel=1e-9)


def test_centres_move_to_their_points(spark):
    points = spark.createDataFrame([([float(v), 0.0],) for v in (0, 1, 2, 3, 4)], "point array<double>").repartition(2)
    sets = [np.array([[1.0, 0.0], [3.0, 0.0], [50.0, 0.0]]), np.array([[2.0, 1.0]])]
    (three, cost), (one, whole) = segments.moved(points, sets, chunk=2)
    assert three.tolist() == [[1.0, 0.0], [3.5, 0.0], [50.0, 0.0]] and cost == pytest.approx(3.0)  # 2 is as near to both
    assert one.tolist() == [[2.0, 0.0]] and whole == pytest.approx(15.0)


def test_spread_and_profile_by_plain_loops(spark, blobs):
    got = {r.feature: r for r in segments.spread(blobs, "truth", {c: F.col(c) for c in "abc"}).collect()}
    rows = blobs.collect()
    for c in "abc":
        groups = [[r[c] for r in rows if r.truth == t] for t in range(3)]
        between = statistics.pvariance([statistics.mean(g) for g in groups])
        within = sum(len(g) * statistics.pvariance(g) for g in groups) / 150
        assert got[c].between == pytest.approx(between, abs=1e-5) and got[c].ratio == pytest.approx(between / within, rel=1e-4)
    names = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "truth int, name string")
    profile = {(r.truth, r.feature): r for r in segments.profile(blobs, "truth", "label", ["a", "c"], names).collect()}
    assert len(profile) == 6 and {r.name for r in profile.values()} == {"x (0)", "y", "x (2)"} and profile[1, "a"].rate == 1.0 and profile[1, "a"].pct == pytest.approx(1 / 3, abs=1e-6)
    assert profile[2, "c"].median == sorted(r.c for r in rows if r.truth == 2)[24]


def test_elbow_of_a_bent_and_of_a_flat_curve(spark):
    bent = spark.createDataFrame([(2, 100.0), (3, 20.0), (4, 10.0), (5, 0.0)], "k int, inertia double")
    got = {r.k: r.elbow for r in segments.elbow(bent).collect()}
    assert got[2] == got[5] == 0 and got[3] == pytest.approx(abs(1 / 3 + 0.2 - 1) / math.sqrt(2), abs=1e-6)
    assert {r.elbow for r in segments.elbow(bent.withColumn("inertia", F.lit(1.0))).collect()} == {0.0}


def test_saved_models_are_refused_when_a_byte_changes(spark, people, tmp_path):
    df, pre = ml.prepared(people, ["x", "noise"], ["kind"])
    model = Pipeline(stages=[*pre.getStages(), ml.logistic(1.0, 0.0, 240)]).fit(df)
    folder = f"file://{tmp_path}"
    for version, threshold in (("1", 0.3), ("2", 0.4)):
        model_store.save(model, folder, version, ["x", "noise", "kind"], threshold, {"ap": 0.9})
    again, meta = model_store.load(folder)
    assert (meta["version"], meta["threshold"], meta["metrics"], meta["features"]) == ("2", 0.4, {"ap": 0.9}, ["x", "noise", "kind"])
    assert model_store.metadata(folder, "1")["threshold"] == 0.3
    a, b = ({r.unit: r.score for r in ml.scores_of(m, df, ["unit"]).collect()} for m in (model, again))
    assert a == b
    part = next(p for p in (tmp_path / "version=2/model/metadata").iterdir() if p.name.startswith("part-"))
    part.write_text(part.read_text().replace("PipelineModel", "PipelineMOdel"))
    for crc in part.parent.glob(f".{part.name}.crc"):
        crc.unlink()
    assert [(r.status) for r in model_store.changes(folder).collect()] == ["differs"]
    with pytest.raises(model_store.Refused, match="differs"):
        model_store.load(folder)
    (tmp_path / "version=1/model/metadata/part-more").write_text("more")
    with pytest.raises(model_store.Refused, match="unexpected"):
        model_store.load(folder, "1")
