"""Models as they are kept: versions with metadata and file digests, a pointer to the current one, checks on loading."""

from __future__ import annotations

import json

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources import raw


class Refused(RuntimeError):
    """The saved model is not what its metadata say."""


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """place (below the model's folder), sha256 and length of every file of a saved model."""
    return raw.fingerprints(spark, path).select(F.regexp_extract("path", "/model/(.*)$", 1).alias("place"), "sha", "length")


def save(model: PipelineModel, folder: str, version: str, features: list[str], threshold: float, metrics: dict[str, float], seed: int = 1) -> str:
    """Save a model as <folder>/version=<version> with its metadata (features, threshold, metrics, seed, versions and the
    digests of its files), and point <folder>/current to it. The pointer is written last: a run that breaks off before
    leaves the model that was current. Returns the version's path."""
    spark = SparkSession.active()
    path = f"{folder}/version={version}"
    model.write().overwrite().save(f"{path}/model")
    files = [r.asDict() for r in _digests(spark, f"{path}/model").orderBy("place").collect()]  # a model has tens of files
    meta = {"version": version, "features": features, "threshold": threshold, "metrics": metrics, "seed": seed, "spark": pyspark.__version__, "files": files}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/current")
    return path


def _line(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"].strip()


def metadata(folder: str, version: str | None = None) -> dict:
    """The metadata of a version, of the current one by default."""
    spark = SparkSession.active()
    return json.loads(_line(spark, f"{folder}/version={version or _line(spark, f'{folder}/current')}/meta"))


def changes(folder: str, version: str | None = None) -> DataFrame:
    """place, status of the files that are not as saved: missing, unexpected or differs. No row: the model is whole."""
    spark, meta = SparkSession.active(), metadata(folder, version)
    said = spark.createDataFrame([(f["place"], f["sha"]) for f in meta["files"]], "place string, said string")
    there = _digests(spark, f"{folder}/version={meta['version']}/model").select("place", F.col("sha").alias("found"))
    return raw.compared(said, there, "place", "said", "found").where("status <> 'equal'")


def spoil(folder: str, version: str) -> None:
    """Change a saved model on purpose, for checks of the checks: the text of its metadata gets another time stamp."""
    spark, path = SparkSession.active(), f"{folder}/version={version}/model/metadata"
    line = _line(spark, path)
    spark.createDataFrame([(line.replace('"timestamp":', '"timestamp":1'),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(folder: str, version: str | None = None) -> tuple[PipelineModel, dict]:
    """A version (the current one by default) and its metadata. Refused if a file is missing, changed or new, or if
    another version of Spark saved it."""
    meta = metadata(folder, version)
    if meta["spark"] != pyspark.__version__:
        raise Refused(f"saved by Spark {meta['spark']}, this is {pyspark.__version__}")
    bad = changes(folder, meta["version"]).limit(5).collect()
    if bad:
        raise Refused(f"version {meta['version']}: " + ", ".join(f"{r['place']} {r['status']}" for r in bad))
    return PipelineModel.load(f"{folder}/version={meta['version']}/model"), meta
