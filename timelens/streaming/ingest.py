"""Structured Streaming ingest of interaction events and incremental post collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.skew import first_per_key
from ..sources.keyed import KeyedTable
from ..sources.landed import flatten_interactions
from ..schema import INTERACTION


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed JSON lines as a stream of raw text."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that parse as a JSON object (an empty line counts as ``{}``), and the rest with a reason."""
    raw = raw.withColumn("value", F.when(F.trim("value") == "", "{}").otherwise(F.col("value")))
    ok = F.coalesce(F.col("value").startswith("{") & F.try_parse_json("value").isNotNull(), F.lit(False))
    parsed = F.from_json("value", INTERACTION)
    good = raw.filter(ok & parsed.isNotNull())
    return good, raw.filter(~ok).withColumn("error", F.lit("not a JSON object"))


def ingest_events(spark: SparkSession, source: str, sink: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Each payload becomes one flat row; bad JSON goes to a side table.

    Batches are written under their own id, so a batch that is run again after a failure
    replaces its output instead of repeating it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # both halves come from one read of the batch
        try:
            good, bad = split_valid(batch)
            flatten_interactions(good).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (read_events(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def collect_stream(posts: DataFrame, sink: str, checkpoint: str, delay: str = "1 day", key: str = "id") -> StreamingQuery:
    """Append posts whose id did not arrive within the last ``delay``; state stays bounded by it.

    The watermark follows the time of arrival, not the posts' own times, so a post is never too old to be kept. A copy
    that arrives later than ``delay`` after the first is appended again; ``collect_exact`` has no such limit.
    """
    timed = posts.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return (timed.dropDuplicatesWithinWatermark([key]).drop("_arrived").writeStream.format("parquet")
            .option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def collect_exact(spark: SparkSession, posts: DataFrame, sink: str, checkpoint: str, key: str = "id", buckets: int = 64) -> StreamingQuery:
    """Exact keep-first append: each batch meets the stored keys by an anti join.

    The sink is partitioned by a digest of the key, so a batch reads the keys of its own buckets only. Output of batch
    ``n`` is written under ``batch=n`` and only earlier batches are read, so a repeated batch gives the same rows.
    """
    kind = posts.schema[key].dataType.simpleString()
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            fresh = first_per_key(batch, [key], [F.col("created_utc"), *[F.col(c) for c in batch.columns if c not in (key, "created_utc")]])
            fresh = fresh.withColumn("bucket", bucket)
            if batch_id > 0:
                touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
                stored = (spark.read.schema(f"{key} {kind}, batch long, bucket int").parquet(sink)
                          .filter((F.col("batch") < batch_id) & F.col("bucket").isin(touched)).select(key))
                fresh = fresh.join(stored, key, "left_anti")
            fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def collect_keyed(posts: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Exact keep-first append for a long history: a batch reads the keys of the leaves that its own keys fall into.

    The table remembers the last batch it holds, so a batch that is run again after a failure changes nothing. Of copies in
    one batch the oldest stays, as in ``collect_exact``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, [F.col("created_utc"), *[F.col(c) for c in batch.columns if c not in (table.key, "created_utc")]], batch_id)

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
