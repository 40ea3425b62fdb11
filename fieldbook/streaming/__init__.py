"""Change feeds as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldbook.operators import changes


def feed(spark: SparkSession, path: str, schema: str, files: int = 64) -> DataFrame:
    """A stream over a growing folder of change files; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def replicate(stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keep a replica: every batch is reduced to what the replica can apply and applied. Batches may be repeated after a failure; applying one again changes nothing."""

    def step(batch: DataFrame, _: int) -> None:
        replica = load()
        save(changes.apply(replica, changes.for_replica(batch, replica, key, order), key))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts of windows of fixed width; on a stream, ``late`` bounds how long a window stays open."""
    df = df if late is None else df.withWatermark(ts, late)
    return df.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


#: Of a row that keeps a bucket's folder when all its rows are gone.
MARK = "mark_"


def begin_replica(table: DataFrame, path: str, key: list[str], buckets: int) -> None:
    """A replica as a table in folders by bucket of its key, each with a row that only keeps its place."""
    spark = table.sparkSession
    empty = spark.range(buckets).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema], F.lit(True).alias(MARK), F.col("id").cast("int").alias("bucket_"))
    rows = table.withColumn(MARK, F.lit(False)).withColumn("bucket_", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    rows.unionByName(empty).repartition("bucket_").write.partitionBy("bucket_").parquet(path)


def replica_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(~F.col(MARK)).drop(MARK, "bucket_")


def apply_to_buckets(batch: DataFrame, path: str, key: list[str], order: list[str], buckets: int) -> int:
    """Apply a batch of events to a replica of ``begin_replica``; only the buckets of its keys are read and written anew. How many that were.

    Applying a batch again changes nothing, so a batch that failed half way is just repeated.
    """
    spark = batch.sparkSession
    marked = batch.withColumn("bucket_", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in marked.select("bucket_").distinct().collect()]  # numbers of buckets, at most ``buckets``
    if not touched:
        return 0
    here = spark.read.parquet(path).where(F.col("bucket_").isin(touched))
    rows = here.where(~F.col(MARK)).drop(MARK)
    found = changes.for_replica(marked, rows.drop("bucket_"), key, order)
    fresh = changes.apply(rows, found.select("operation", *rows.columns), key).withColumn(MARK, F.lit(False))
    kept = here.where(F.col(MARK)).select(fresh.columns)
    fresh.unionByName(kept).repartition("bucket_").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_").parquet(path)
    return len(touched)


def replicate_buckets(stream: DataFrame, path: str, log: str, key: list[str], txid: str, buckets: int, checkpoint: str) -> StreamingQuery:
    """Keep a bucketed replica of a feed. ``log`` notes the last transaction of each batch; events that an earlier batch brought are passed over."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            done = spark.read.json(log, schema="batch long, txid long").where(F.col("batch") < number).agg(F.max("txid")).first()[0] if _there(spark, log) else None
            fresh = held if done is None else held.where(F.col(txid) > done)
            last = fresh.agg(F.max(txid)).first()[0]
            if last is not None:
                apply_to_buckets(fresh, path, key, [txid], buckets)
                spark.createDataFrame([(number, last)], "batch long, txid long").write.mode("append").json(log)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
