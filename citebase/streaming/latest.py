"""Streams: latest value for each key, duplicates dropped within a watermark, windows and idempotent sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citebase.session import checkpointed


def file_stream(spark: SparkSession, path: str, pattern: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as an unbounded source; the schema is that of the files there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_values(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: an aggregate whose state holds one row a key; late rows lose by their order columns."""
    rest = [c for c in stream.columns if c not in keys]
    best = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest)).select(*stream.columns)


def deduplicated(stream: DataFrame, keys: list[str], at: str, delay: str = "10 minutes") -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for the state of a stream, in the shared folder of checkpoints."""
    checkpointed(spark.range(0))  # sets the folder, or fails on a cluster that names none
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def run_available(result: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there into a table in the shared folder and give that table; nothing is kept in the driver.

    In complete mode each batch takes the place of the one before, else batches are added to those before. A batch that is
    run again after a failure overwrites its own folder, so nothing is counted twice.
    """
    spark = result.sparkSession
    folder = shared_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={0 if mode == 'complete' else number}")

    query = result.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{folder}/checkpoint").start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/table").select(*result.columns)


def idempotent_sink(path: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends only rows whose key is not in the Parquet folder yet.

    A batch that is repeated after a failure adds nothing, so delivery is exactly once by key. Rows are stored by a hash of
    their key, and a batch is compared only with the folders of its own hashes.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        one = batch.dropDuplicates(keys).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # any other failure to read it is an error
            held = [r["_bucket"] for r in one.select("_bucket").distinct().collect()]  # at most ``buckets``
            there = spark.read.schema(one.schema).parquet(path).where(F.col("_bucket").isin(held)).select("_bucket", *keys)
            same = F.col("n._bucket") == F.col("t._bucket")
            for k in keys:
                same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}"))
            one = one.alias("n").join(there.alias("t"), same, "left_anti")
        one.write.mode("append").partitionBy("_bucket").parquet(path)

    return write
