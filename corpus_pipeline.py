"""A training-data pipeline of the llm operators: toxic documents go, near copies go, benchmark leaks go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import stored, table
from strata.llm.decontamination import decontaminated
from strata.llm.encoding import vocabulary
from strata.llm.jaccard_join import one_per_component
from strata.llm.packing import pack
from strata.llm.toxicity import held_out, train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones that are not held out, doesn't reject. Null and empty texts
    score as texts without words and stay; repeated rows are judged each; an empty table stays empty."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels").where(~held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join: that of the least key, by key and text. Documents without words
    or without key stay; of rows equal in key and text one stays; an empty table stays empty."""
    return one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; null items are never found; rows equal in key and
    text are judged alike; without items or documents nothing changes."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences. Null and empty texts are their end token alone; a
    document of any length is cut; no documents give no pieces."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
#: No stage has SQL: a fitted classifier, components of a graph, edit distances and a packing plan.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
