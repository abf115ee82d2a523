"""Models at table scale: preprocessing, folds, exact metrics, thresholds, calibration, segments, scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.storage import stored

FOLDS = 5


def prepared(df: DataFrame, numbers: list[str], kinds: list[str]) -> tuple[DataFrame, Pipeline]:
    """df with missing indicators and 'NO DATA' categories, and the unfitted pipeline: median imputation, standard
    scaling, one-hot encoding in which unseen categories are all zero."""
    df = df.withColumns({f"no_{c}": F.col(c).isNull().cast("double") for c in numbers} | {c: F.col(c).cast("double") for c in numbers} | {c: F.coalesce(F.col(c).cast("string"), F.lit("NO DATA")) for c in kinds})
    stages = [
        Imputer(inputCols=numbers, outputCols=[f"f_{c}" for c in numbers], strategy="median", relativeError=0.0001),
        VectorAssembler(inputCols=[f"f_{c}" for c in numbers], outputCol="raw_numbers"), StandardScaler(inputCol="raw_numbers", outputCol="numbers", withMean=True),
        StringIndexer(inputCols=kinds, outputCols=[f"i_{c}" for c in kinds], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"i_{c}" for c in kinds], outputCols=[f"o_{c}" for c in kinds], dropLast=True),
        VectorAssembler(inputCols=["numbers", *[f"no_{c}" for c in numbers], *[f"o_{c}" for c in kinds]], outputCol="features"),
    ]
    return df, Pipeline(stages=stages)


def folds(df: DataFrame, unit: str, label: str, seed: int = 1) -> DataFrame:
    """Stratified folds that depend on units and labels only: order by digest within (label, digest bucket), dealt in turn."""
    h = F.md5(F.concat_ws("|", F.col(unit).cast("string"), F.lit(str(seed))))
    bucket = F.conv(F.substring(h, 1, 2), 16, 10).cast("int") % 64
    place = F.row_number().over(Window.partitionBy(label, bucket).orderBy(h, unit)) + bucket
    return df.withColumn("fold", F.pmod(place, F.lit(FOLDS)).cast("int"))


def percentile_rank(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Average percentile rank of a value, NULL 0.5: from counts of distinct values, which are dealt out in ranges. Running
    sums are made inside ranges and start from the sums of the ranges before, so no task sees all values; what does meet
    in one place is a row for each range."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranged = stored(counts.repartitionByRange(value).withColumn("_range", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = F.col("_before") + F.col("_upto")
    ranks = ranged.withColumn("_upto", inside).join(F.broadcast(starts), "_range").select(value, ((upto - (F.col("_n") - 1) / 2) / F.col("_all")).alias("score"))  # a row a range
    return df.join(ranks, value, "left").select(unit, F.round(F.coalesce("score", F.lit(0.5)), 6).alias("score"))


def metrics(scored: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Average precision, ROC-AUC (tied scores as one threshold) and Brier score, per group: from counts per distinct
    score (six decimals), whose running sums give every threshold's true and false positives. scored is read once."""
    by = by or []
    squares = F.sum((F.col(score) - F.col(label)) ** 2)
    points = scored.groupBy(*by, F.round(score, 6).alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_c"), squares.alias("_e"), F.count(F.col(score) - F.col(label)).alias("_ce"))
    down = Window.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = points.select(*by, "_p", "_c", "_e", "_ce", F.sum("_p").over(down).alias("_tp"), F.sum("_c").over(down).alias("_k"), F.sum("_p").over(all_).alias("_all"), F.sum("_c").over(all_).alias("_n"))
    ap = F.sum(F.col("_tp") / F.col("_k") * F.col("_p") / F.col("_all"))
    negative = F.col("_c") - F.col("_p")
    auc = F.sum(negative * (F.col("_tp") - F.col("_p") / 2)) / F.max(F.col("_all") * (F.col("_n") - F.col("_all")))
    brier = F.sum("_e") / F.sum("_ce")
    return run.groupBy(*by).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.round(ap, 6).alias("average_precision"), F.round(auc, 6).alias("roc_auc"), F.round(brier, 6).alias("brier"))


def gain_curve(scored: DataFrame, value: float, cost: float, steps: int = 200) -> DataFrame:
    """threshold, contacted, hits, gain for 0, 1/steps, ..., 1: scores are counted by the highest threshold they reach,
    and suffix sums over these few rows do the rest."""
    step = F.floor(F.col("score") * steps + 1e-9).cast("int")
    counts = scored.groupBy(step.alias("step")).agg(F.count("*").alias("c"), F.sum(F.col("label").cast("long")).alias("p"))
    grid = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    up = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = grid.join(counts, "step", "left").select("step", F.sum(F.coalesce("c", F.lit(0))).over(up).alias("contacted"), F.sum(F.coalesce("p", F.lit(0))).over(up).alias("hits"))
    return sums.select((F.col("step") / steps).alias("threshold"), "contacted", "hits", (F.lit(value) * F.col("hits") - F.lit(cost) * F.col("contacted")).alias("gain"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The threshold of the largest gain, ties to the larger threshold."""
    return curve.agg(F.max_by(F.struct("threshold", "gain", "contacted", "hits"), F.struct("gain", "threshold")).alias("b")).select("b.*")


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and rate by score quantile; the cuts are exact percentiles."""
    cuts = scored.agg(F.percentile("score", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("cuts"))
    binned = scored.crossJoin(cuts).withColumn("bin", F.aggregate("cuts", F.lit(0), lambda n, c: n + (F.col("score") > c).cast("int")))  # one row of cuts
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("label").cast("double")), 6).alias("rate"))


def confusion(scored: DataFrame, threshold: float, value: float, cost: float) -> DataFrame:
    yes, positive = F.col("score") >= threshold, F.col("label") == 1
    tp, fp, fn, tn = F.count_if(yes & positive), F.count_if(yes & ~positive), F.count_if(~yes & positive), F.count_if(~yes & ~positive)
    one = scored.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    gain = F.lit(value) * F.col("tp") - F.lit(cost) * (F.col("tp") + F.col("fp"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return one.select("*", F.round(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), 6).alias("recall"), gain.alias("gain"), F.round(gain * 1000 / n, 6).alias("gain_per_1000"))


def diagnosis(train: Column, val: Column, rate: Column, wide: float = 0.1, little: float = 0.1, narrow: float = 0.05) -> Column:
    """variance where average precision falls by `wide` or more from training to validation; else bias where it gains less
    than `little` over the positive rate and falls by less than `narrow`; else balanced."""
    gap = train - val
    return F.when(gap >= wide, "variance").when((val - rate < little) & (gap < narrow), "bias").otherwise("balanced")


def guarded(df: DataFrame, cutoff: str, held: list[str], label: str, unlocked: bool = False) -> DataFrame:
    """df whose label is NULL at held-out cutoffs, unless they are unlocked on purpose."""
    return df if unlocked else df.withColumn(label, F.when(~F.col(cutoff).isin(held), F.col(label)))


def scores_of(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    return model.transform(df).select(*keep, F.round(vector_to_array("probability")[1], 6).alias("score"))


def out_of_fold(df: DataFrame, pre: Pipeline, estimator, keep: list[str]) -> DataFrame:
    """Scores of each fold by a model of the others; preprocessing is fitted on the others, too."""
    out = None
    for k in range(FOLDS):
        model = Pipeline(stages=[*pre.getStages(), estimator]).fit(df.where(F.col("fold") != k))
        one = scores_of(model, df.where(F.col("fold") == k), keep)
        out = one if out is None else out.unionAll(one)
    return out


def logistic(regularisation: float, mix: float, n: int, label: str = "label") -> LogisticRegression:
    """lambda is a sum over rows in the grid's terms, a mean in the library's."""
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=regularisation / n, elasticNetParam=mix, maxIter=60, standardization=False)


def forest(trees: int, label: str = "label") -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, minInstancesPerNode=5, maxDepth=10, seed=1)


def coefficients(model: PipelineModel, features: DataFrame, top: int, parts: dict[str, list[str]] | None = None) -> DataFrame:
    """Names and weights of the strongest coefficients on each side, from the feature vector's own metadata. parts: for
    vector columns that keep no names (scaled ones) the names of what they hold, in order."""
    attrs = features.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a.get("name", str(a["idx"])) for group in attrs.values() for a in group}
    inside = {f"{column}_{k}": name for column, own in (parts or {}).items() for k, name in enumerate(own)}
    weights = sorted((float(w), inside.get(names.get(i, str(i)), names.get(i, str(i)))) for i, w in enumerate(model.stages[-1].coefficients))
    chosen = [(n, w, "negative") for w, n in weights[:top]] + [(n, w, "positive") for w, n in weights[-top:][::-1]]
    return features.sparkSession.createDataFrame(chosen, "feature string, weight double, side string")
