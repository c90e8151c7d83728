"""Quality rules over media metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.rules import Rule, mark, rule, rule_report
from millrace.operators.text import PII_PATTERNS

# Limits of the stock media rules.
MIN_WIDTH, MIN_HEIGHT = 1280, 720
MAX_IMAGE_MB = 50
MIN_BLUR_VARIANCE = 100
IMAGE_FORMATS = ["jpg", "jpeg", "png", "webp", "tiff"]
IMAGE_FIELDS = ["make", "model", "datetime"]
VIDEO_CODECS = ["h264", "h265", "hevc"]
MIN_FPS, MIN_VIDEO_SECONDS = 15, 1
MIN_SAMPLE_RATE, MAX_NOISE_DB = 16_000, -40
AUDIO_FORMATS = ["mp3", "wav", "flac", "aac", "ogg", "m4a"]
DOCUMENT_FIELDS = ["author", "creation_date"]
MIN_DOCUMENT_CHARS, MIN_TEXT_CHARS = 50, 10


def _num(name: str) -> str:
    return f"coalesce({name}, 0)"


def _no_pii() -> str:
    tests = [f"NOT rlike(extracted_text, r'{p}')" for p in PII_PATTERNS.values()]
    return " AND ".join(tests)


def media_rules(media_type: str, columns: list[str]) -> list[Rule]:
    """The stock rules of a media type that the metadata columns allow to check."""

    def sql(name: str, needs: list[str], expr: str, severity: str) -> tuple[list[str], Rule]:
        return needs, rule("sql", name=name, expr=expr, severity=severity, action="flag")

    def present(fields: list[str]) -> str:
        return " AND ".join(f"{f} IS NOT NULL" for f in fields)

    def listed(name: str, values: list[str]) -> str:
        return f"lower({name}) IN ({', '.join(repr(v) for v in values)})"

    catalogue = {
        "image": [
            sql("min_resolution", ["width", "height"], f"{_num('width')} >= {MIN_WIDTH} AND {_num('height')} >= {MIN_HEIGHT}", "high"),
            sql("max_file_size_mb", ["size_bytes"], f"{_num('size_bytes')} <= {MAX_IMAGE_MB * 1024 * 1024}", "low"),
            sql("blur_threshold", ["blur_variance"], f"{_num('blur_variance')} >= {MIN_BLUR_VARIANCE}", "medium"),
            sql("exif_completeness", IMAGE_FIELDS, present(IMAGE_FIELDS), "medium"),
            sql("format_whitelist", ["extension"], listed("extension", IMAGE_FORMATS), "high"),
        ],
        "video": [
            sql("codec_validation", ["codec"], listed("codec", VIDEO_CODECS), "medium"),
            sql("min_fps", ["fps"], f"{_num('fps')} >= {MIN_FPS}", "medium"),
            sql("min_duration_seconds", ["duration"], f"{_num('duration')} >= {MIN_VIDEO_SECONDS}", "low"),
        ],
        "audio": [
            sql("min_sample_rate", ["sample_rate"], f"{_num('sample_rate')} >= {MIN_SAMPLE_RATE}", "high"),
            sql("silence_detection", ["is_silent"], "NOT coalesce(is_silent, false)", "high"),
            sql("noise_threshold_db", ["noise_db"], f"noise_db < {MAX_NOISE_DB}", "low"),
            sql("duration_metadata", ["duration"], "duration IS NOT NULL", "medium"),
            sql("format_whitelist", ["extension"], listed("extension", AUDIO_FORMATS), "medium"),
        ],
        "document": [
            sql("not_corrupted", ["is_corrupted"], "NOT coalesce(is_corrupted, false)", "high"),
            sql("min_text_length", ["extracted_text"], f"length(coalesce(extracted_text, '')) >= {MIN_DOCUMENT_CHARS}", "medium"),
            sql("language_detected", ["language"], "language IS NOT NULL", "low"),
            sql("pii_redacted", ["extracted_text"], _no_pii(), "high"),
            sql("exif_completeness", DOCUMENT_FIELDS, present(DOCUMENT_FIELDS), "low"),
        ],
        "text": [
            sql("min_text_length", ["extracted_text"], f"length(coalesce(extracted_text, '')) >= {MIN_TEXT_CHARS}", "medium"),
            sql("language_detected", ["language"], "language IS NOT NULL", "low"),
            sql("pii_check", ["extracted_text"], _no_pii(), "medium"),
        ],
    }
    return [r for needs, r in catalogue[media_type] if set(needs) <= set(columns)]


def media_quality(df: DataFrame, media_type: str) -> DataFrame:
    """Per rule: total, passed, failed, pass rate (one decimal, 0 for an empty table)."""
    rules = media_rules(media_type, df.columns)
    report = rule_report(mark(df, rules), rules)
    rate = F.coalesce(F.try_divide(F.col("passed") * F.lit(100.0), F.col("processed")), F.lit(0.0))
    return report.select(
        F.lit(media_type).alias("media_type"),
        F.col("rule_id").alias("rule_key"),
        "severity",
        F.col("processed").alias("total"),
        "passed",
        "failed",
        F.round(rate, 1).alias("pass_rate"),
    )


def min_length(col: Column, media_type: str) -> Column:
    """True when the text is long enough for its type."""
    return F.length(F.coalesce(col, F.lit(""))) >= (MIN_DOCUMENT_CHARS if media_type == "document" else MIN_TEXT_CHARS)
