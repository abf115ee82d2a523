"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import slices, table
from strata.llm.encoding import token_counts, vocabulary


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", batch_bytes: int = 4 << 20) -> DataFrame:
    """Tokens of every text as the tokenizers library gives them, without added special tokens; strings of special
    tokens inside a text count as the library's default has it (one token each).

    The vocabulary must drop white space. An Arrow function gets the texts, cuts each batch into parts of about
    `batch_bytes`, splits long and short texts alike at ASCII white space, and returns lengths only.

    Returns one row per input row: key, n_bytes (UTF-8), n_tokens. Null and empty texts give 0 and 0. A null key stays
    null; repeated rows are counted each. Other columns of docs, whatever their names, are not read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, target=batch_bytes):
            size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(token_counts(part.column(1), path), pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "key long, n_bytes long, n_tokens long").withColumnRenamed("key", key)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
