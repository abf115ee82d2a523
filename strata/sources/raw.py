"""Sources and sinks: raw lines, envelopes, landing, partitioned tables, idempotent ingest, exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.storage import stored

RAW = T.StructType([T.StructField("raw", T.StringType())])
ENVELOPE = T.StructType([T.StructField(n, T.LongType() if n in ("offset", "line") else T.StringType()) for n in ("offset", "kafka_ts", "key", "file", "line", "file_sha", "raw", "ingest_ts")])


def read_raw_lines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """One string column per physical line, quoting off; partition columns come from the path."""
    return spark.read.schema(RAW).option("sep", "\t").option("quote", "").option("header", header).option("enforceSchema", True).csv(path)


def read_raw_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "raw")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Message envelopes with an explicit schema; topic and partition come from the path."""
    return spark.read.schema(ENVELOPE).json(path)


def catalogued(spark: SparkSession, folder: str, catalog: list[tuple[str, str, str]]) -> DataFrame:
    """file, source, route, present, n_rows of each declared source (Parquet) of a folder."""
    rows = None
    for file, source, route in catalog:
        there = exists(spark, f"{folder}/{file}")
        count = spark.read.parquet(f"{folder}/{file}").agg(F.count("*").alias("n_rows")) if there else spark.range(1).select(F.lit(0).cast("long").alias("n_rows"))
        one = count.select(F.lit(file).alias("file"), F.lit(source).alias("source"), F.lit(route).alias("route"), F.lit(there).alias("present"), "n_rows")
        rows = one if rows is None else rows.unionAll(one)
    return rows


def with_lineage(df: DataFrame) -> DataFrame:
    """The file that each row was read from, and its base name."""
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("source_path"), F.regexp_extract(path, "[^/]+$", 0).alias("source_file"))


def register(spark: SparkSession, sources: dict[str, tuple[str, T.StructType]]) -> DataFrame:
    """Temporary views of all sources; a path with nothing in it gives an empty view. Returns source, status, n_rows."""
    rows = None
    for name, (path, schema) in sources.items():
        there = exists(spark, path)
        df = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
        df.createOrReplaceTempView(name)
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("source"), F.lit("loaded" if there else "pending").alias("status"), "n_rows")
        rows = one if rows is None else rows.unionAll(one)
    return rows


def land(df: DataFrame, folder: str, source: str, day: str) -> str:
    """Append raw rows under <folder>/source=<source>/ingest_date=<day>; the same day again replaces it."""
    path = f"{folder}/source={source}/ingest_date={day}"
    df.write.mode("overwrite").text(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: str, cluster: list[str], rows_per_file: int = 5_000_000) -> None:
    """Full refresh of a table partitioned by a column and clustered within: ranges of (partition, cluster columns), so
    that a large day spreads over several tasks, sorted for row-group pruning."""
    parts = [by, *cluster]
    df.repartitionByRange(*parts).sortWithinPartitions(*parts).write.option("maxRecordsPerFile", rows_per_file).partitionBy(by).mode("overwrite").parquet(path)


def append_once(tables: dict[str, DataFrame], folder: str, run: str) -> None:
    """Append the rows of a run to each ops table, in one job each; the same run again replaces its own rows."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/run_id={run}")


def digest(line: str) -> Column:
    """A digest of all lines of a group, whatever their order: the number of lines, and the sums of two hashes of each."""
    sums = [F.sum(f(line).cast("decimal(38,0)")).cast("string") for f in (F.xxhash64, lambda c: F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10))]
    return F.sha2(F.concat_ws("-", F.count("*").cast("string"), *sums), 256)


def skip_known(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (name, sha) not in the manifest as complete, and those that are."""
    done = manifest.where(F.col("state").isin("complete", "published")).select("name", "sha").distinct()
    return files.join(done, ["name", "sha"], "left_anti"), files.join(done, ["name", "sha"], "left_semi")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of every data file below a path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path", "length")


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, sha (SHA-256 of the content) and length of every file below a path. Files are read whole, one row each;
    files without content have no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("sha"), "length")


def compared(expected: DataFrame, found: DataFrame, key: str, said: str, seen: str) -> DataFrame:
    """key and status (equal, differs, missing, unexpected) of the digests that are expected and those that are found."""
    status = F.when(F.col(seen).isNull(), "missing").when(F.col(said).isNull(), "unexpected").when(F.col(said) != F.col(seen), "differs").otherwise("equal")
    return expected.join(found, key, "full").select(key, status.alias("status"))


def ingest(spark: SparkSession, landing: str, manifest: str, pattern: str = "([^/]+)$", glob: str = "*") -> DataFrame:
    """name, action and n_rows of every file of a landing folder: `loaded` if no file of this name and content is complete
    in the manifest, `skipped` otherwise; a known name with other content is loaded again. Files are judged by SHA-256 of
    their whole content, and named by the first group of a pattern in their path. Loaded files are added to the manifest
    (name, sha, state, n_rows) as complete; the same landing again loads nothing. manifest: a table's path, which may not
    exist yet."""
    kind = "name string, sha string, state string, n_rows long"
    known = spark.read.schema(kind).parquet(manifest) if exists(spark, manifest) else spark.createDataFrame([], kind)
    there = fingerprints(spark, landing, glob).select(F.regexp_extract("path", pattern, 1).alias("name"), "sha")
    new, old = skip_known(there, known)
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(landing)
    counts = lines.groupBy(F.regexp_extract("_metadata.file_path", pattern, 1).alias("name")).agg(F.count("*").alias("n_rows"))
    done = stored(new.join(counts, "name", "left").select("name", "sha", F.coalesce("n_rows", F.lit(0)).alias("n_rows")), "ingested")
    skipped = stored(old.select("name"), "skipped")
    done.select("name", "sha", F.lit("complete").alias("state"), "n_rows").write.mode("append").parquet(manifest)
    return done.select("name", F.lit("loaded").alias("action"), "n_rows").unionByName(skipped.select("name", F.lit("skipped").alias("action"), F.lit(0).cast("long").alias("n_rows")))


def metrics(snapshot: DataFrame, names: list[str], layers: list[str]) -> DataFrame:
    """layer, table, metric, value from a snapshot (layer, table and a column for each name), with a TOTAL of each layer and
    metric; layers without any table have totals of 0."""
    long = snapshot.unpivot(["layer", "table"], names, "metric", "value")
    wanted = snapshot.sparkSession.createDataFrame([(x, n) for x in layers for n in names], "layer string, metric string")
    sums = wanted.join(long.groupBy("layer", "metric").agg(F.sum("value").alias("value")), ["layer", "metric"], "left")
    totals = sums.select("layer", F.lit("TOTAL").alias("table"), "metric", F.coalesce("value", F.lit(0)).alias("value"))
    return long.select("layer", "table", "metric", "value").unionByName(totals)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path has any file or folder in it, asked of Spark's own readers."""
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").limit(1).count())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return False


def score_lines(df: DataFrame, unit: str, score: str) -> DataFrame:
    """Unit, score with six fixed decimals: the same text for the same score everywhere."""
    return df.select(unit, F.format_string("%.6f", F.round(score, 6)).alias("score"))
