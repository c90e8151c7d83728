"""File sources: reading by extension, listings, change feeds between listings, type routing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Extension classes, destinations and type names the routing results depend on.
AUDIO_EXTENSIONS = ["mp3", "wav", "flac", "aac", "ogg", "m4a", "wma", "opus"]
VIDEO_EXTENSIONS = ["mp4", "avi", "mov", "mkv", "wmv", "flv", "webm", "m4v", "mpg", "mpeg"]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "tiff", "tif", "ico", "heic", "heif"]
DOCUMENT_EXTENSIONS = [
    "pdf", "doc", "docx", "txt", "csv", "xls", "xlsx", "ppt", "pptx", "odt", "rtf", "md", "json", "xml", "html", "htm",
]
READY, MEDIA_PENDING = "bronze-ready", "bronze-media-pending"
STORAGE_CLASSES = {
    "structured": ["csv", "json", "jsonl", "parquet"],
    "text": ["txt", "log"],
    "image": ["jpg", "jpeg", "png", "gif", "bmp"],
    "video": ["mp4", "avi", "mov", "mkv"],
    "document": ["pdf", "doc", "docx", "xls", "xlsx"],
}

READERS = {"csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet"}


def extension(name: Column) -> Column:
    """Lower-case extension of a file name or path, without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/.]\.([^./]+)$", 1))


def storage_class(ext: Column) -> Column:
    """structured, text, image, video, document or binary."""
    start = F
    for label, exts in STORAGE_CLASSES.items():
        start = start.when(ext.isin(exts), F.lit(label))
    return start.otherwise(F.lit("binary"))


def read_files(spark: SparkSession, paths: str | Sequence[str], fmt: str = "auto", multi_line: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV (header, strings, byte-order mark dropped), JSON, JSONL, Parquet.

    CSV and JSON are read by lines, so that large files are split over tasks; ``multi_line`` is for records (or one JSON
    array) that span lines, at one task per file. With a ``schema`` JSON is not read a first time for its columns.
    Any other type gives one row per file with its size and base64 content. ``auto`` looks at the
    extension, which must be the same for all paths.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt == "auto":
        kinds = {p.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in p.rsplit("/", 1)[-1] else "" for p in paths}
        if len(kinds) != 1:
            raise ValueError(f"paths mix the types {sorted(kinds)}; read them one type at a time")
        fmt = READERS.get(kinds.pop(), "binary")
    if fmt == "csv":
        reader = spark.read.option("header", "true").option("encoding", "UTF-8").option("multiLine", str(multi_line).lower())
        return (reader.schema(schema) if schema else reader).csv(paths)
    if fmt in ("json", "jsonl"):
        reader = spark.read.option("multiLine", str(multi_line and fmt == "json").lower())
        return (reader.schema(schema) if schema else reader).json(paths)
    if fmt == "parquet":
        return spark.read.parquet(*paths)
    return (
        spark.read.format("binaryFile")
        .load(paths)
        .select("path", F.col("length").alias("size"), F.base64("content").alias("content_base64"))
    )


def list_files(
    spark: SparkSession,
    prefix: str,
    since: object = None,
    exts: Sequence[str] | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Files below a prefix changed after ``since``: key, size, modified, etag, type.

    File contents are not read: ``content`` is pruned from the scan. The etag is made of size and time,
    which is what a listing knows.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(prefix)
        .select("path", "length", "modificationTime")
    )
    ext = extension(F.col("path"))
    if since is not None:
        files = files.filter(F.col("modificationTime") > F.lit(since).cast("timestamp"))
    if exts:
        files = files.filter(ext.isin([e.lower().lstrip(".") for e in exts]))
    if pattern:
        files = files.filter(F.col("path").rlike(pattern))
    return files.select(
        F.col("path").alias("key"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        F.md5(F.concat_ws("-", F.col("length").cast("string"), F.col("modificationTime").cast("string"))).alias("etag"),
        storage_class(ext).alias("type"),
    )


def diff_listing(
    previous: DataFrame, current: DataFrame, key: str = "key", etag: str = "etag", emit_deletes: bool = False
) -> DataFrame:
    """Change events between two listings: create, update (etag differs) and, on request, delete."""
    old = previous.select(F.col(key).alias("_old_key"), F.col(etag).alias("_old_etag"))
    joined = current.join(old, F.col(key) == F.col("_old_key"), "full_outer" if emit_deletes else "left")
    op = (
        F.when(F.col("_old_key").isNull(), F.lit("create"))
        .when(F.col(key).isNull(), F.lit("delete"))
        .when(~F.col(etag).eqNullSafe(F.col("_old_etag")), F.lit("update"))
    )
    return (
        joined.withColumn("op", op)
        .filter(F.col("op").isNotNull())
        .withColumn(key, F.coalesce(F.col(key), F.col("_old_key")))
        .drop("_old_key", "_old_etag")
    )


def route_files(df: DataFrame, name_col: str) -> DataFrame:
    """Add ``file_type`` and ``destination`` from the extension of the file name."""
    ext = extension(F.col(name_col))
    file_type = (
        F.when(ext.isin(AUDIO_EXTENSIONS), F.lit("audio"))
        .when(ext.isin(VIDEO_EXTENSIONS), F.lit("video"))
        .when(ext.isin(IMAGE_EXTENSIONS), F.lit("images"))
        .when(ext.isin(DOCUMENT_EXTENSIONS), ext)
        .otherwise(F.lit("other"))
    )
    return df.withColumn("file_type", file_type).withColumn(
        "destination", F.when(F.col("file_type").isin("audio", "video"), F.lit(MEDIA_PENDING)).otherwise(F.lit(READY))
    )


def media_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path with type, extension and size. Contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    )
    routed = route_files(files, "path")
    documents = reduce(lambda a, e: a | (F.col("file_type") == e), DOCUMENT_EXTENSIONS, F.lit(False))
    return routed.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        extension(F.col("path")).alias("extension"),
        F.when(documents, F.lit("document"))
        .when(F.col("file_type") == "images", F.lit("image"))
        .otherwise(F.col("file_type"))
        .alias("media_type"),
        F.col("length").alias("size_bytes"),
    )
