"""Text jobs over document tables: metrics, keywords, sentiment, extraction, redaction, chunks.

All of them are column expressions over the whole text. A text is one row, so even the keyword tables need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.scalars import exact

# Word pattern, word lists, limits and patterns the results depend on.
WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{4,}"
POSITIVE_WORDS = [
    "thank", "great", "excellent", "good", "happy", "glad", "found", "helpful", "appreciate", "wonderful", "pleased",
]
NEGATIVE_WORDS = [
    "problem", "issue", "error", "failed", "broken", "missing", "lost", "frustrated", "unhappy", "sorry", "apologize",
    "wrong",
]
SHORT_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]
LONG_STOP_WORDS = [
    "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "they",
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "shall",
    "should", "may", "might", "must", "can", "could", "not", "and", "or",
    "but", "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "up", "about", "into", "through", "during", "that", "this", "these",
    "those", "so", "just", "if", "then", "than", "too", "very", "s", "t",
    "ll", "d", "m", "re", "ve", "ain", "no", "yes", "there", "here",
]
_EDGE_BEFORE, _EDGE_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
FIELD_PATTERNS = {
    "Date": _EDGE_BEFORE + r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|[\p{L}\p{N}_]+ \d{1,2},? \d{4})" + _EDGE_AFTER,
    "Amount": r"(\$[\d,]+(?:\.\d{2})?)",
    "Reference Number": _EDGE_BEFORE + r"((?i:INV|ORDER|REF|CASE|TICKET)[#\-]?[\p{L}\p{N}_\-]{3,}[\p{L}\p{N}_])" + _EDGE_AFTER,
    "Email": r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})",
}
FIELD_CONFIDENCE = 0.75
PII_PATTERNS = {
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "credit_card": r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b",
    "passport": r"\b[A-Z]{1,2}[0-9]{6,9}\b",
}
CHUNK_SIZE = 1024


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def text_metrics(df: DataFrame, col: str, preview_chars: int | None = None) -> DataFrame:
    """Add line, word and character counts and the whole text; with ``preview_chars`` also its first characters."""
    text = F.col(col)
    preview = {} if preview_chars is None else {"text_preview": F.substring(text, 1, preview_chars)}
    return df.withColumns(
        {
            "line_count": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1,
            "word_count": F.regexp_count(text, F.lit(WORD)),
            "char_count": F.length(text),
            "text_content": text,
            **preview,
        }
    )


def _top_words(df: DataFrame, id_col: str, text_col: str, keep: Callable[[Column], Column], k: int) -> DataFrame:
    """(id, word, count, rank, highest) of the most frequent longer words for which ``keep`` holds; ties by first use.

    Every row is counted for itself, whatever ids it shares. The texts are dealt out whole, as they are smaller than the
    counts of their words, and evenly, so that the counts of a task fit in memory. A row's words are then added up and cut to
    ``k`` where the row lies; the second shuffle, which gathers the ranked words into fewer tasks, carries no more than these.
    """
    rows = df.select(exact(id_col), F.monotonically_increasing_id().alias("_row"), exact(text_col).alias("_text"))
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_row")
    kept = F.filter(words(F.col("_text"), LONG_WORD), keep)
    used = dealt.select(exact(id_col), "_row", F.posexplode(kept).alias("_first", "word"))
    counted = used.groupBy("_row", exact(id_col), "word").agg(F.count("*").alias("count"), F.min("_first").alias("_first"))
    of_row = Window.partitionBy(F.struct("_row", exact(id_col)))
    ranked = counted.withColumn("rank", F.row_number().over(of_row.orderBy(F.col("count").desc(), "_first"))).filter(F.col("rank") <= k)
    return ranked.select(exact(id_col), "word", "count", "rank", F.max("count").over(of_row).alias("_highest"))


def keywords(df: DataFrame, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent longer words per document; ties by first use."""
    return _top_words(df, id_col, text_col, lambda w: ~w.isin(SHORT_STOP_WORDS), k).drop("_highest")


def keyword_relevance(df: DataFrame, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """Top words of at least four plain letters, with relevance 0.6 + 0.4 · count / highest count."""
    top = _top_words(df, id_col, text_col, lambda w: w.rlike("^[a-z]{4,}$") & ~w.isin(LONG_STOP_WORDS), k)
    return top.withColumn("relevance", two_digits(60 + F.col("count") * 40.0 / F.col("_highest"))).drop("_highest")


def two_digits(percent: Column) -> Column:
    """A value given in hundredths, rounded half up to two decimals."""
    return F.floor(percent + 0.5) / 100.0


def sentiment(df: DataFrame, col: str) -> DataFrame:
    """Add ``sentiment`` and ``sentiment_score`` from the two word lists."""
    found = F.filter(words(F.col(col)), lambda w: w.isin(POSITIVE_WORDS + NEGATIVE_WORDS))
    pos = F.size(F.filter("_found", lambda w: w.isin(POSITIVE_WORDS)))
    balance = F.try_divide(2 * pos - F.size("_found"), F.size("_found"))
    s = F.col("_balance")
    label = F.when(s > 0.3, "positive").when(s < -0.3, "negative").otherwise("neutral")
    score = (
        F.when(s > 0.3, F.least(F.lit(95.0), 65 + s * 30))
        .when(s < -0.3, F.greatest(F.lit(5.0), 35 + s * 30))
        .otherwise(50 + s * 15)
    )
    scored = df.withColumn("_found", found).withColumn("_balance", F.coalesce(balance, F.lit(0.0)))
    return scored.withColumns({"sentiment": label, "sentiment_score": two_digits(score)}).drop("_found", "_balance")


def language(df: DataFrame, col: str) -> DataFrame:
    """Add ``language``: ``non-english`` when a non-ASCII character occurs, else ``en``."""
    return df.withColumn("language", F.when(F.col(col).rlike(r"[^\x00-\x7F]"), "non-english").otherwise("en"))


def extract_fields(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, field, value, confidence): the first date, amount, reference and email of every document."""
    entries = [
        F.when(F.col(col).rlike(p), F.struct(F.lit(name).alias("field"), F.regexp_extract(col, p, 1).alias("value")))
        for name, p in FIELD_PATTERNS.items()
    ]
    rows = df.select(id_col, F.inline(F.array_compact(F.array(*entries))))
    return rows.withColumn("confidence", F.lit(FIELD_CONFIDENCE))


def summarise(df: DataFrame, col: str, n: int = 2, name: str = "summary") -> DataFrame:
    """The first ``n`` sentences longer than 20 characters; the whole text if there are none."""
    parts = F.transform(F.split(F.col(col), "[.!?]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    sentences = F.filter(parts, lambda s: F.length(s) > 20)
    joined = F.array_join(F.slice(sentences, 1, n), " ")
    return df.withColumn(name, F.when(F.size(sentences) > 0, joined).otherwise(F.col(col)))


def speaker_stats(df: DataFrame, conversation: str, speaker: str, text: str) -> DataFrame:
    """Per conversation and speaker: segments, words, share of the words, dominant sentiment (ties by name)."""
    by_mood = (
        sentiment(df, text)
        .groupBy(conversation, speaker, F.col("sentiment").alias("_mood"))
        .agg(F.count("*").alias("_n"), F.sum(F.regexp_count(F.col(text), F.lit(r"\S+"))).alias("_w"))
    )
    per = by_mood.groupBy(conversation, speaker).agg(
        F.sum("_n").alias("segments"),
        F.sum("_w").alias("words"),
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("_mood").alias("mood"))).getField("mood").alias("sentiment"),
    )
    total = F.sum("words").over(Window.partitionBy(conversation))  # one row per speaker
    return per.withColumn("talk_share", F.round(F.coalesce(F.try_divide(F.col("words") * F.lit(100.0), total), F.lit(0.0)), 1))


def pii_flags(df: DataFrame, col: str) -> DataFrame:
    """Add ``has_<kind>`` per pattern and ``has_pii``."""
    flags = {f"has_{kind}": F.col(col).rlike(p) for kind, p in PII_PATTERNS.items()}
    return df.withColumns({**flags, "has_pii": reduce(lambda a, b: a | b, flags.values())})


def redact(df: DataFrame, col: str) -> DataFrame:
    """Replace every match by ``[KIND]``."""
    out = F.col(col)
    for kind, pattern in PII_PATTERNS.items():
        out = F.regexp_replace(out, pattern, f"[{kind.upper()}]")
    return df.withColumn(col, out)


def chunk(df: DataFrame, id_col: str, col: str, size: int = CHUNK_SIZE, overlap: int = 0) -> DataFrame:
    """(id, chunk_index, chunk_text): pieces of ``size`` characters, the whole text covered.

    Without overlap one regex pass cuts the text; with overlap every piece starts ``size - overlap`` later.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    text = F.col(col)
    if overlap == 0:
        pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))
    else:
        step = size - overlap
        last = F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int") - 1, F.lit(0))
        pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
        pieces = F.when(F.length(text) > 0, pieces)
    return df.select(id_col, F.posexplode(pieces).alias("chunk_index", "chunk_text"))
