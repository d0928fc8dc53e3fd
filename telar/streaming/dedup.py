"""Duplicates across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def distinct_stream(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key over the life of the query; the state grows with the keys, so prefer append_new for open-ended streams."""
    return stream.dropDuplicates(keys)


def append_new(stream: DataFrame, key: str, out: str, history: str, checkpoint: str, stop_after_empty: int = 5, order: str | None = None) -> int:
    """Append each micro-batch's rows whose key no earlier batch had to `out`, and the batch's keys to `history`; batches that brought rows.

    Each batch writes its own folder, so a batch that is run again after a failure replaces what it wrote. Rows of one batch may share
    a key. The query ends with the input at hand, or after `stop_after_empty` batches in a row without a new row. `history` keeps texts by
    their SHA-256, as each batch reads all of it.

    Files of a stream come in the order of their writing, not of their rows. With `order`, a column, rows also pass where all earlier
    batches had their key at larger values of it only: the smallest value of a key in `out` is that of the whole stream, however files come.
    """
    spark: SparkSession = stream.sparkSession
    seen = {"empty": 0, "full": 0}
    short = F.unhex(F.sha2(F.col(key), 256)) if stream.schema[key].dataType == StringType() else F.col(key)

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_key").agg(F.min("_least").alias("_least")) if order else rows.select("_key").distinct()

    def step(batch: DataFrame, number: int) -> None:
        if seen["empty"] >= stop_after_empty:
            return
        try:
            past = least(spark.read.option("recursiveFileLookup", True).parquet(history).filter(F.col("_batch") < number)).withColumnRenamed("_key", "_past")
        except Exception as e:  # no batch has written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            past = None
        earlier = (short == F.col("_past")) & (F.col("_least") <= F.col(order) if order else F.lit(True))
        fresh = batch if past is None else batch.join(past, earlier, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        n = spark.read.parquet(f"{out}/batch={number}").count()
        least(batch.select(short.alias("_key"), *[F.col(c).alias("_least") for c in [order] if c])).withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{history}/b{number}")
        seen["empty"] = 0 if n else seen["empty"] + 1
        seen["full"] += n > 0

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen["full"]
