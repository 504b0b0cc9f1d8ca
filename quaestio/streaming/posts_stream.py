"""The post and question stages on a streaming source.

Load normalisation, post flags, sentence split and candidate extraction are stateless
per-row work, so the batch functions apply unchanged to a streaming DataFrame; the
classification (parse + rules) runs per micro-batch through ``foreachBatch`` into a
Parquet table. Progress lives in the checkpoint location, so a restarted query
resumes where it stopped and executor loss only replays the current micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as ST
from pyspark.sql.streaming import StreamingQuery

from quaestio.operators import post_features, sentences
from quaestio.sources import posts as P

RAW_POST_SCHEMA = ST.StructType([
    ST.StructField("id", ST.StringType()),
    ST.StructField("created_at", ST.StringType()),
    ST.StructField("full_text", ST.StringType()),
    ST.StructField("quoted_text", ST.StringType()),
    ST.StructField("hashtags", ST.StringType()),
    ST.StructField("favorite_count", ST.StringType()),
    ST.StructField("retweet_count", ST.StringType()),
    ST.StructField("dataset", ST.StringType()),
])


def read_post_stream(spark: SparkSession, path: str, schema: ST.StructType = RAW_POST_SCHEMA,
                     fmt: str = "csv", max_files_per_trigger: int | None = None) -> DataFrame:
    """New files under ``path`` as a stream of raw post rows (CSV as in S1, or Parquet)."""
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        reader = reader.options(**P.CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.format(fmt).load(path)


def analysed_post_stream(raw: DataFrame) -> DataFrame:
    """D2 over a stream (same functions as the batch job)."""
    return post_features.flag_posts(P.normalise_posts(P.type_posts(raw)))


def candidate_stream(raw: DataFrame) -> DataFrame:
    """Candidate questions over a stream."""
    return sentences.question_candidates(analysed_post_stream(raw))


def start_question_stream(raw: DataFrame, output_path: str, checkpoint_path: str,
                          classify: Callable[[DataFrame], DataFrame],
                          trigger_available_now: bool = True) -> StreamingQuery:
    """Classify each micro-batch of candidates into the partition ``epoch=<id>`` of a
    Parquet table; a batch that is replayed after a failure overwrites its partition."""

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        classify(batch).write.mode("overwrite").parquet(f"{output_path}/epoch={epoch_id}")

    w = candidate_stream(raw).writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()
