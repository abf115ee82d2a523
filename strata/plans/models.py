"""Queries of models. Those whose numbers SQL can make have SQL; fitted models are checked by rows and tests."""

from __future__ import annotations

from functools import partial

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strata.functions.storage import scratch, stored
from strata.operators import ml, model_store, selection
from strata.operators import segments as segmenting
from strata.plans import churn
from strata.plans.register import registry
from strata.plans.tables import table

QUERIES, ORACLE, query = registry()
NUMBERS = ["events", "late_events", "week_1", "active_days", "active_days_1", "recency", "tenure", "active_weeks", "ratio", "weekly_cv", "modes", "mode_share_1", "mode_share_2", "mode_share_3", "mode_share_4", "peak_share", "weekend_share",
    "holiday_share", "spend", "mean_amount", "stations", "zones", "transfer_share", "active_cards", "mean_hour", "sd_hour", "closed_trips", "mean_minutes", "registry_events"]
KINDS = ["usual_mode", "profile"]


def training(spark, sf_dir, letters=("A",)):
    return stored(churn.dataset(spark, sf_dir, letters), "training")


def scored(spark, sf_dir):
    """A score that SQL knows, too: recency against its longest, with the label of cutoffs A and B."""
    d = churn.dataset(spark, sf_dir).where("label is not null")
    return d.select("letter", "unit", F.round(F.col("recency") / 728, 6).alias("score"), "label")


_S = f"{churn._B}, s AS (SELECT letter, unit, round(recency::DOUBLE / 728, 6) AS score, label FROM feat JOIN lab USING (letter, cutoff, unit) WHERE label IS NOT NULL)"


_A = f"""{churn._B}, a AS (SELECT feat.*, label FROM feat JOIN lab USING (letter, cutoff, unit) WHERE letter = 'A')"""
_FOLDS = f"""{_A}, h AS (SELECT unit, label, md5(unit || '|1') AS h, CAST('0x' || substr(md5(unit || '|1'), 1, 2) AS INTEGER) % 64 AS bucket FROM a),
fld AS (SELECT unit, label, CAST((row_number() OVER (PARTITION BY label, bucket ORDER BY h, unit) + bucket) % 5 AS INTEGER) AS fold FROM h)"""


@query(f"""WITH {_A}, m AS (SELECT quantile_disc(ratio, 0.5) AS r, quantile_disc(mean_minutes, 0.5) AS t, count(DISTINCT coalesce(usual_mode, 'NO DATA')) + count(DISTINCT coalesce(profile, 'NO DATA')) AS kinds FROM a)
SELECT unit, (ratio IS NULL)::BIGINT + (mean_minutes IS NULL)::BIGINT AS missing, coalesce(ratio, r) AS ratio, coalesce(mean_minutes, t) AS mean_minutes, (2 * {len(NUMBERS)} + kinds)::BIGINT AS width FROM a, m""")
def ml_preprocess(spark, sf_dir):
    """Missing values by unit, what the medians put in their place, and the length of the feature vector."""
    df, pre = ml.prepared(training(spark, sf_dir), NUMBERS, KINDS)
    done = pre.fit(df).transform(df)
    missing = sum((F.col(f"no_{c}") for c in NUMBERS), F.lit(0.0)).cast("long")
    return done.select("unit", missing.alias("missing"), F.col("f_ratio").alias("ratio"), F.col("f_mean_minutes").alias("mean_minutes"), F.size(vector_to_array("features")).cast("long").alias("width"))


@query(f"WITH {_FOLDS} SELECT unit, label, fold FROM fld")
def ml_folds(spark, sf_dir):
    return ml.folds(training(spark, sf_dir), "unit", "label").select("unit", "label", "fold")


@query(f"""WITH {_S}, r AS (SELECT letter, unit, round(avg(p) OVER (PARTITION BY score), 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score)::DOUBLE / count(*) OVER () AS p FROM s WHERE letter = 'A'))
SELECT unit, score, (SELECT round(avg(label::DOUBLE), 6) FROM s WHERE letter = 'A') AS rate FROM r""")
def ml_baselines(spark, sf_dir):
    s = scored(spark, sf_dir).where("letter = 'A'")
    rate = s.agg(F.round(F.avg(F.col("label").cast("double")), 6).alias("rate"))
    return ml.percentile_rank(s.withColumnRenamed("score", "v"), "unit", "v").crossJoin(rate)  # one row


@query(f"""WITH {_S}, g AS (SELECT letter, score, sum(label)::BIGINT AS p, count(*) AS c FROM s GROUP BY ALL), r AS (SELECT letter, p, c, sum(p) OVER w AS tp, sum(c) OVER w AS k, sum(p) OVER (PARTITION BY letter) AS allp, sum(c) OVER (PARTITION BY letter) AS n FROM g WINDOW w AS (PARTITION BY letter ORDER BY score DESC)),
m AS (SELECT letter, round(sum(tp::DOUBLE / k * p / allp), 6) AS average_precision, round(sum((c - p) * (tp - p / 2::DOUBLE)) / max(allp * (n - allp)), 6) AS roc_auc FROM r GROUP BY 1)
SELECT letter, count(*) AS n, any_value(average_precision) AS average_precision, any_value(roc_auc) AS roc_auc, round(avg((score - label) ** 2), 6) AS brier FROM s JOIN m USING (letter) GROUP BY letter""")
def ml_metrics(spark, sf_dir):
    return ml.metrics(scored(spark, sf_dir), by=["letter"])


@query(f"""WITH {_S}, t AS (SELECT range AS step FROM range(201)) SELECT step / 200::DOUBLE AS threshold, count(unit) AS contacted, coalesce(sum(label), 0)::BIGINT AS hits, 15.0::DOUBLE * coalesce(sum(label), 0) - 5.0::DOUBLE * count(unit) AS gain
FROM t LEFT JOIN (SELECT * FROM s WHERE letter = 'A') s ON floor(score * 200 + 1e-9) >= step GROUP BY step""")
def ml_gain_curve(spark, sf_dir):
    return ml.gain_curve(scored(spark, sf_dir).where("letter = 'A'"), 15.0, 5.0)


@query(f"""WITH {_S}, a AS (SELECT * FROM s WHERE letter = 'A'), c AS (SELECT unnest(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cut FROM a),
b AS (SELECT score, label, CAST((SELECT count(*) FROM c WHERE a.score > cut) AS INTEGER) AS bin FROM a) SELECT bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label::DOUBLE), 6) AS rate FROM b GROUP BY bin""")
def ml_calibration(spark, sf_dir):
    return ml.calibration(scored(spark, sf_dir).where("letter = 'A'"))


@query(f"""WITH {_S}, c AS (SELECT count(*) FILTER (score >= 0.34 AND label = 1) AS tp, count(*) FILTER (score >= 0.34 AND label = 0) AS fp, count(*) FILTER (score < 0.34 AND label = 1) AS fn, count(*) FILTER (score < 0.34 AND label = 0) AS tn FROM s WHERE letter = 'B')
SELECT *, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, 15.0::DOUBLE * tp - 5.0::DOUBLE * (tp + fp) AS gain, round((15.0::DOUBLE * tp - 5.0::DOUBLE * (tp + fp)) * 1000 / (tp + fp + fn + tn), 6) AS gain_per_1000 FROM c""")
def ml_confusion(spark, sf_dir):
    return ml.confusion(scored(spark, sf_dir).where("letter = 'B'"), 0.34, 15.0, 5.0)


@query(f"WITH {churn._B} SELECT letter, unit, CASE WHEN letter <> 'B' THEN label END AS label FROM lab")
def ml_label_guard(spark, sf_dir):
    return ml.guarded(churn.dataset(spark, sf_dir), "letter", ["B"], "label").select("letter", "unit", "label")


_DIAG = "CASE WHEN train - val >= 0.1 THEN 'variance' WHEN val - rate < 0.1 AND train - val < 0.05 THEN 'bias' ELSE 'balanced' END"


@query(f"WITH g AS (SELECT o_custkey % 200 AS model, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 6) AS train, round(count(*) FILTER (o_orderstatus = 'O')::DOUBLE / count(*), 6) AS val, round(count(*) FILTER (o_orderstatus = 'P')::DOUBLE / count(*), 6) AS rate FROM orders GROUP BY 1) SELECT *, {_DIAG} AS diagnosis FROM g")
def ml_bias_variance(spark, sf_dir):
    share = lambda s: F.round(F.count_if(F.col("o_orderstatus") == s) / F.count("*"), 6)
    g = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 200).alias("model")).agg(share("F").alias("train"), share("O").alias("val"), share("P").alias("rate"))
    return g.withColumn("diagnosis", ml.diagnosis(F.col("train"), F.col("val"), F.col("rate")))


def _folded(spark, sf_dir):
    """Cutoff A with folds, prepared for the pipeline, which is returned with it; in as many parts as its rows are worth."""
    raw_rows = ml.folds(training(spark, sf_dir), "unit", "label")
    df, pre = ml.prepared(raw_rows, NUMBERS, KINDS)
    return stored(df.coalesce(raw_rows.count() // 50_000 + 1), "folded"), pre


@query()
def ml_logistic(spark, sf_dir):
    """The whole path, three penalties by 13 lambdas: means over folds, is_best for the choice of each penalty (ties to the
    larger lambda), and for the chosen ones the out-of-fold metrics and the non-zero coefficients of the refit."""
    df, pre = _folded(spark, sf_dir)
    path, _, fitted, settings = selection.fitted_path(df, pre, "unit")
    path = stored(path, "path")
    oof = selection.best_out_of_fold(path, fitted, settings).select("penalty", F.lit(True).alias("is_best"), F.col("average_precision").alias("oof_ap"), F.col("roc_auc").alias("oof_auc"), F.col("brier").alias("oof_brier"))
    refit = [(p, int((weights != 0).sum())) for p, (weights, _) in selection.refitted(df, pre, path).items()]
    terms = spark.createDataFrame(refit, "penalty string, n_terms int").withColumn("is_best", F.lit(True))
    return path.join(oof, ["penalty", "is_best"], "left").join(terms, ["penalty", "is_best"], "left")


@query(f"""WITH {_FOLDS}, s AS (SELECT * FROM (VALUES ('L2', 0.1::DOUBLE), ('L2', 10.0::DOUBLE)) t(penalty, "lambda")) SELECT penalty, "lambda", k::INTEGER AS model, CASE WHEN fold = k THEN 'validation' ELSE 'train' END AS part, count(*) AS n, sum(label)::BIGINT AS positives, count(DISTINCT unit) AS units
FROM fld, range(5) r(k), s GROUP BY ALL""")
def ml_path_rows(spark, sf_dir):
    """Which rows the models of each fold were trained and judged on: a small path, counted."""
    df, pre = _folded(spark, sf_dir)
    _, _, scores = selection.regularisation_path(df, pre, "unit", {"L2": 0.0}, [0.1, 10.0])
    part = F.when(F.col("fold") == F.col("model"), "validation").otherwise("train")
    return scores.groupBy("penalty", "lambda", "model", part.alias("part")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.countDistinct("unit").alias("units"))


_GRID = """g AS (SELECT o_orderpriority AS penalty, o_custkey % 13 AS "lambda", o_orderkey % 5 AS fold, count(*) AS n, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 1) AS ap FROM orders GROUP BY ALL),
p AS (SELECT penalty, "lambda", round(avg(ap), 2) AS mean_ap FROM g GROUP BY ALL)"""


@query(f"""WITH {_GRID} SELECT *, row_number() OVER (PARTITION BY penalty ORDER BY mean_ap DESC, "lambda" DESC) = 1 AS is_best FROM p""")
def ml_choice(spark, sf_dir):
    """The choice on rows that SQL has, too: means that often tie, over folds, of a grid of priorities and customers."""
    ap = F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 1)
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("penalty"), (F.col("o_custkey") % 13).alias("lambda"), (F.col("o_orderkey") % 5).alias("fold")).agg(ap.alias("ap"))
    return selection.choose(g.groupBy("penalty", "lambda").agg(F.round(F.avg("ap"), 2).alias("mean_ap")), "mean_ap", F.col("lambda"), by=["penalty"])


@query()
def ml_trees(spark, sf_dir):
    """16 boosted settings and a forest of 400 trees on the folds, with the choice and the diagnosis."""
    df, pre = _folded(spark, sf_dir)
    table_, _ = selection.tree_path(df, pre, "unit", steps=[0.05, 0.1], rounds=[20, 40], depths=[3, 4], least=[1, 20], trees=400)
    return table_.drop("setting")


def _fitted(spark, sf_dir):
    df, pre = _folded(spark, sf_dir)
    return df, Pipeline(stages=[*pre.getStages(), ml.logistic(1.0, 0.0, df.count())]).fit(df)


@query()
def ml_coefficients(spark, sf_dir):
    df, model = _fitted(spark, sf_dir)
    return ml.coefficients(model, model.transform(df), 5, {"numbers": NUMBERS})


@query()
def ml_permutation(spark, sf_dir):
    """The ten features whose values matter most to a logistic model: all features, ten repeats, five validation folds."""
    rows = stored(ml.folds(training(spark, sf_dir), "unit", "label"), "folds")
    n, prepare = rows.count(), lambda seen: ml.prepared(seen, NUMBERS, KINDS)[0]

    def fitted(k):
        df, pre = ml.prepared(rows.where(F.col("fold") != k), NUMBERS, KINDS)
        return Pipeline(stages=[*pre.getStages(), ml.logistic(1.0, 0.0, n)]).fit(df)

    models = dict(enumerate(selection.side_by_side([partial(fitted, k) for k in range(ml.FOLDS)], 2)))
    return selection.linear_permutation_importance(rows.select("unit", "fold", "label", *NUMBERS, *KINDS), [NUMBERS, KINDS], "unit", models, prepare)


@query(f"""WITH {_FOLDS}, p AS (SELECT unit, fold, label, events, recency FROM fld JOIN (SELECT unit, events, recency FROM a) USING (unit)) SELECT feature, r::INTEGER AS repeat, fold, count(*) AS n, sum(label)::BIGINT AS positives, sum(events)::BIGINT AS events, sum(recency)::BIGINT AS recency FROM p, range(3) t(r), (VALUES ('events'), ('recency')) f(feature) GROUP BY ALL""")
def ml_permuted(spark, sf_dir):
    """What dealing values anew leaves as it was: rows, labels and each column's sum in each fold, for each column and repeat."""
    rows = ml.folds(training(spark, sf_dir), "unit", "label").select("unit", "fold", "label", "events", "recency")
    return selection.permuted(rows, ["events", "recency"], "unit", 3, bucket_rows=100).groupBy("feature", "repeat", "fold").agg(F.count("*").alias("n"), *[F.sum(a).cast("long").alias(b) for a, b in (("label", "positives"), ("events", "events"), ("recency", "recency"))])


@query()
def ml_score(spark, sf_dir):
    """Cutoff C scored by the model of cutoff A, with the card list of each unit."""
    _, model = _fitted(spark, sf_dir)
    c, _ = ml.prepared(training(spark, sf_dir, ("C",)), NUMBERS, KINDS)
    cards = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_name").alias("cards"))
    return ml.scores_of(model, c, ["unit"]).join(cards, "unit", "left").withColumn("contact", (F.col("score") >= 0.34).cast("int"))


@query(f"WITH {_A} SELECT count(*) AS n, 0::BIGINT AS differ, '3' AS version, 0.34::DOUBLE AS threshold, {len(NUMBERS + KINDS)} AS n_features, TRUE AS metrics_equal, '1,2' AS refused FROM a")
def ml_model_meta(spark, sf_dir):
    """A model saved in two versions and loaded by the pointer: scores as before, metadata as given; then one version's file
    is changed and one gets a file more, and loading them is refused."""
    df, model = _fitted(spark, sf_dir)
    scored_ = ml.scores_of(model, df, ["unit", "label"])
    ap = ml.metrics(scored_).first()["average_precision"]
    folder = scratch(spark, "models")
    for version in ("1", "2", "3"):
        model_store.save(model, folder, version, NUMBERS + KINDS, 0.34, {"average_precision": ap})
    again, meta = model_store.load(folder)
    same = scored_.join(ml.scores_of(again, df, ["unit"]).withColumnRenamed("score", "again"), "unit").agg(F.count("*").alias("n"), F.count_if(F.col("score") != F.col("again")).alias("differ"))
    model_store.spoil(folder, "1")
    spark.range(1).select(F.lit("more").alias("value")).write.mode("append").text(f"{folder}/version=2/model/metadata")
    refused = []
    for version in ("1", "2", "3"):
        try:
            model_store.load(folder, version)
        except model_store.Refused:
            refused.append(version)
    facts = [(meta["version"], float(meta["threshold"]), len(meta["features"]), meta["metrics"]["average_precision"] == ap, ",".join(refused))]
    return same.crossJoin(spark.createDataFrame(facts, "version string, threshold double, n_features int, metrics_equal boolean, refused string"))  # a row each


@query()
def ml_compare(spark, sf_dir):
    """Fold metrics of two models and the one of highest mean average precision."""
    df, pre = _folded(spark, sf_dir)
    long = None
    for name, estimator in (("logistic", ml.logistic(1.0, 0.0, df.count())), ("forest", ml.forest(20))):
        one = ml.metrics(ml.out_of_fold(df, pre, estimator, ["unit", "fold", "label"]), by=["fold"]).withColumn("model", F.lit(name))
        long = one if long is None else long.unionByName(one)
    table_ = stored(long, "folds").groupBy("model").agg(F.round(F.avg("average_precision"), 6).alias("mean_ap"), F.round(F.stddev_samp("average_precision"), 6).alias("sd_ap"), F.round(F.avg("roc_auc"), 6).alias("auc"), F.round(F.avg("brier"), 6).alias("brier"))
    best = table_.agg(F.max_by("model", F.struct("mean_ap", "model")).alias("chosen"))
    return table_.crossJoin(best).withColumn("chosen", F.col("chosen") == F.col("model"))  # one row


def _segmented(spark, sf_dir):
    df, pre = ml.prepared(training(spark, sf_dir), NUMBERS, KINDS)
    made = pre.fit(df).transform(df)
    done = stored(made.select("unit", "label", *[F.col(f"f_{c}").alias(c) for c in NUMBERS], "numbers").coalesce(df.count() // 50_000 + 1), "vectors")
    return segmenting.segments(done, "numbers", list(range(2, 11)))


@query()
def ml_segments(spark, sf_dir):
    """k from 2 to 10, ten restarts each: inertia, silhouette, elbow, and which k they choose."""
    return _segmented(spark, sf_dir)[0]


@query()
def ml_segment_profile(spark, sf_dir):
    """The chosen segments with names from their centres, sizes, label rate and the medians of the eight features whose
    centres lie farthest apart."""
    _, rows, _ = _segmented(spark, sf_dir)
    rows = stored(rows.select("unit", "label", "segment", *NUMBERS, "numbers"), "segments")
    means = stored(segmenting.centres(rows, "segment", "numbers", NUMBERS), "centres")
    apart = segmenting.spread(rows, "segment", {c: F.get(vector_to_array("numbers"), k) for k, c in enumerate(NUMBERS)}).orderBy(F.desc("between"), "feature").limit(8)  # the report's top eight
    shown = [r["feature"] for r in apart.select("feature").collect()]
    names = segmenting.named_centres(means, "segment", "events", "recency", "modes", "ratio")
    return segmenting.profile(rows, "segment", "label", shown, names).join(F.broadcast(apart), "feature")  # eight rows


_SEG = f"""{_A}, g AS (SELECT *, CAST(least(recency // 100, 3) AS INTEGER) AS segment FROM a), c AS (SELECT segment, count(*) AS n, round(avg(label::DOUBLE), 6) AS rate, quantile_disc(events::DOUBLE, 0.5) AS events, quantile_disc(spend, 0.5) AS spend,
  CASE WHEN avg(events) > 12 THEN 'often' ELSE 'rarely' END AS name FROM g GROUP BY 1), s AS (SELECT segment, count(*) AS n, avg(events) AS m1, var_pop(events) AS v1, avg(spend) AS m2, var_pop(spend) AS v2 FROM g GROUP BY 1),
b AS (SELECT 'events' AS feature, round(var_pop(m1), 6) AS between, round(var_pop(m1) / (sum(v1 * n) / sum(n)), 6) AS ratio FROM s UNION ALL SELECT 'spend', round(var_pop(m2), 6), round(var_pop(m2) / (sum(v2 * n) / sum(n)), 6) FROM s)"""


@query(f"""WITH {_SEG} SELECT segment, CASE WHEN count(*) OVER (PARTITION BY name, feature) > 1 THEN name || ' (' || segment || ')' ELSE name END AS name, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY feature), 6) AS pct, rate, feature, CASE feature WHEN 'events' THEN events ELSE spend END AS median, ratio FROM c, b""")
def ml_profile(spark, sf_dir):
    """The profile of segments that SQL knows, too: classes of recency."""
    rows = training(spark, sf_dir).withColumn("segment", F.least(F.floor(F.col("recency") / 100), F.lit(3)).cast("int"))
    names = rows.groupBy("segment").agg(F.when(F.avg("events") > 12, "often").otherwise("rarely").alias("name"))
    apart = segmenting.spread(rows, "segment", {c: F.col(c).cast("double") for c in ("events", "spend")}).select("feature", "ratio")
    return segmenting.profile(rows, "segment", "label", ["events", "spend"], names, 1_000_000).join(F.broadcast(apart), "feature")  # two rows


@query("""WITH t AS (SELECT CAST(o_custkey % 9 + 2 AS INTEGER) AS k, round(avg(o_totalprice) / (o_custkey % 9 + 2), 2) AS inertia FROM orders GROUP BY 1, o_custkey % 9), e AS (SELECT min(k) AS k0, max(k) AS k1, min(inertia) AS i0, max(inertia) AS i1 FROM t)
SELECT k, inertia, round(CASE WHEN i1 > i0 THEN abs((k - k0)::DOUBLE / (k1 - k0) + (inertia - i0) / (i1 - i0) - 1) / sqrt(2::DOUBLE) ELSE 0 END, 6) AS elbow FROM t, e""")
def ml_elbow(spark, sf_dir):
    """The elbow's distances on a falling curve that SQL has, too."""
    k = (F.col("o_custkey") % 9 + 2).cast("int")
    t = table(spark, sf_dir, "orders").groupBy(k.alias("k")).agg(F.round(F.avg("o_totalprice") / F.first(k), 2).alias("inertia"))
    return segmenting.elbow(t)
