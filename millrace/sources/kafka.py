"""Kafka sources and the topic naming scheme."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Topic prefixes that carry table changes and words that mark media topics.
TABLE_TOPIC_PREFIXES = ["cdc_", "client.", "cdc."]
MEDIA_TOPIC_WORDS = ["image", "audio", "video", "document", "media"]


def stream_options(servers: str, pattern: str, max_offsets: int | None = None) -> dict[str, str]:
    """Options of the change stream: all matching topics from the start; ``max_offsets`` bounds a trigger."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribePattern": pattern,
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }
    return options if max_offsets is None else {**options, "maxOffsetsPerTrigger": str(max_offsets)}


def batch_options(servers: str, topics: list[str], since: dt.datetime | None = None) -> dict[str, str]:
    """Options of a bounded read; ``since`` starts at the first message not older than it."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "endingOffsets": "latest"}
    if since is None:
        options["startingOffsets"] = "earliest"
    else:
        options["startingTimestamp"] = str(int(since.timestamp() * 1000))
    return options


def _text(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp"
    )


def read_kafka_stream(spark: SparkSession, servers: str, pattern: str, max_offsets: int | None = None) -> DataFrame:
    return _text(spark.readStream.format("kafka").options(**stream_options(servers, pattern, max_offsets)).load())


def read_kafka_batch(
    spark: SparkSession, servers: str, topics: list[str], since: dt.datetime | None = None
) -> DataFrame:
    return _text(spark.read.format("kafka").options(**batch_options(servers, topics, since)).load())


def is_table_topic(topic: Column) -> Column:
    """True for topics with table changes: a known prefix and no media word."""
    known = F.lit(False)
    for prefix in TABLE_TOPIC_PREFIXES:
        known = known | topic.startswith(prefix)
    media = F.lit(False)
    for word in MEDIA_TOPIC_WORDS:
        media = media | F.lower(topic).contains(word)
    return known & ~media


def parse_topic(df: DataFrame, col: str = "topic") -> DataFrame:
    """Add source, schema, table and full name; three or more parts, two parts, or one."""
    parts = F.split(F.col(col), r"\.")
    count = F.size(parts)
    head, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    bare = F.regexp_replace(head, "cdc_", "")
    return (
        df.withColumn(
            "source",
            F.when(count >= 3, F.regexp_replace(bare, "client", "postgres"))
            .when(count == 2, bare)
            .otherwise(F.lit("unknown")),
        )
        .withColumn("schema", F.when(count >= 3, F.get(parts, F.lit(1))).otherwise(F.lit("public")))
        .withColumn("table", last)
        .withColumn(
            "full_name", F.when(count >= 3, F.regexp_replace(F.col(col), r"^[^.]*\.", "")).otherwise(last)
        )
    )


def table_slug(name: Column) -> Column:
    """A file key as a table name: lower case, runs of other characters become one underscore."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
