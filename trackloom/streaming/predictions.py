"""The prediction log as a stream: resumable scoring with one result a message."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.text import key_text
from trackloom.session import cut
from trackloom.sources.documents import upsert


def once_a_message(log: DataFrame, lateness: str = "14 days") -> DataFrame:
    """The first delivery of each message within the watermark; state of older messages is dropped. log has delivered_at (timestamp)."""
    keyed = log.withColumns({"qa_id": key_text(F.col("qa_id")), "model": key_text(F.col("model"))})
    return keyed.withWatermark("delivered_at", lateness).dropDuplicatesWithinWatermark(["qa_id", "model"])


def rate_by_window(log: DataFrame, width: str = "1 day", lateness: str = "3 days") -> DataFrame:
    """Deliveries and errors by model and window of time."""
    w = F.window("delivered_at", width)
    return log.withWatermark("delivered_at", lateness).groupBy(w.alias("w"), key_text(F.col("model")).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors")).select(F.col("w.start").alias("start"), "model", "n", "errors")


#: Parts of a table that is brought up to date; a batch rewrites only those that its keys fall in.
BUCKETS = 64


def run_resumable(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, key: list[str]) -> None:
    """Take what is new in folder into the table at target, new rows winning; a second run without new files changes nothing.

    Of the rows of a key in one batch that of the latest file (by time, then name) counts. The table is partitioned by a hash of the key (column bucket); touched
    parts are put together first and then replace the old ones, the others aren't read. A batch that is run again gives the same table.
    """

    def take(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if not c.startswith("__")]
        last = batch.withColumn("__line", F.monotonically_increasing_id()).groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct("__time", "__file", "__line")).alias("r")).select("r.*")
        new = cut(last.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        try:
            old = spark.read.parquet(target).where(F.col("bucket").isin(touched))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old = new.limit(0)
        merged = cut(upsert(old, new, key))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    stream = spark.readStream.schema(schema).json(folder)
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("__time"), F.col("_metadata.file_name").alias("__file"))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
