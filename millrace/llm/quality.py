"""Quality rules: boosted trees over statistics of whole texts, with a plain base rule in front."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import boosting
from millrace.llm.common import col, hash_sample, texts_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# The features, in order, with the direction in which quality may move when the feature grows (0: either).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "distinct_word_share": 1,
    "letter_share": 0,
    "words_per_line": 0,
    "symbol_word_share": -1,
}
MONOTONE = np.array(list(FEATURES.values()))

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in BASE), ("base_failed", pa.bool_()), ("quality_score", pa.float64()), ("kept", pa.bool_())]
)
STATS_SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.float64()) for n in FEATURES)])


@dataclass(frozen=True)
class Statistics:
    """Counts of one whole text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_distinct: int
    n_letters: int
    n_lines: int
    n_symbol_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words

    def features(self) -> list[float]:
        words, chars = max(self.n_words, 1), max(self.word_chars, 1)
        return [
            float(np.log1p(self.n_words)),
            self.word_chars / words,
            self.n_symbols / chars,
            self.n_dup_lines / max(self.n_lines, 1),
            self.n_repeat_words / words,
            self.n_distinct / words,
            self.n_letters / chars,
            self.n_words / max(self.n_lines, 1),
            self.n_symbol_words / words,
        ]


def statistics(raw: bytes) -> Statistics:
    """Counts over all words (runs of anything but ASCII white space) and lines of a text."""
    text = raw.decode("utf-8", "replace")
    words = raw.split()  # bytes.split knows ASCII white space only
    spaces = len(raw) - sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated, distinct = _repeat_words(words)
    return Statistics(
        n_words=len(words),
        word_chars=len(text) - spaces,
        n_symbols=len(raw) - len(raw.translate(None, SYMBOLS)),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated,
        n_distinct=distinct,
        n_letters=_letters(raw),
        n_lines=len(lines),
        n_symbol_words=sum(w[-1] in SYMBOLS for w in words),
    )


_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha()) + bytes(range(0x80, 0xC0))


def _letters(raw: bytes) -> int:
    """ASCII letters plus all characters beyond ASCII (counted by their first byte)."""
    return len(raw.translate(None, _NOT_LETTERS))


def _repeat_words(words: list[bytes], width: int = 3) -> tuple[int, int]:
    """Words covered by windows that occur twice or more, and the number of distinct words."""
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(words) - width + 1
    if n < 2:
        return 0, len(number)
    window = codes[:n]
    for k in range(1, width):
        if len(number) ** (k + 1) >= 2**62:  # renumber, so that the product stays within 64 bits
            window = np.unique(window, return_inverse=True)[1]
        window = window * len(number) + codes[k : n + k]
    _, which, count = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[which] >= 2)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[starts + k] = True
    return int(covered.sum()), len(number)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> boosting.Trees:
    """Fit the trees on at most ``sample_rows`` labelled documents, the ones first by a hash of their id.

    ``labels`` has (doc_id, quality 0/1); rows with a null in either are left out, of repeated ids one counts, and so does of
    documents with the same id the one first by a hash of its text. The statistics of the sample are all that reaches the
    driver: a few numbers for each of ``sample_rows`` documents.
    Without labelled documents every document that passes the base rule is kept.
    """
    wanted = (
        labels.select(col("doc_id").cast("long").alias("doc_id"), col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    chosen = {r.doc_id: r.quality for r in hash_sample(wanted, ["doc_id"], sample_rows).collect()}
    if not chosen:
        return boosting.fit(np.zeros((0, len(FEATURES))), np.zeros(0), MONOTONE)
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in chosen], "doc_id long")  # sample_rows ids at most
    rows = texts_of(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    sample = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for batch in batches:
            values = [statistics(t).features() for t in batch.column(1).to_pylist()]
            columns = list(zip(*values)) if values else [[] for _ in FEATURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], schema=STATS_SCHEMA)

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in FEATURES)
    found = sorted(tuple(r) for r in sample.mapInArrow(run, schema).collect())
    x = np.array([r[1:] for r in found], float).reshape(-1, len(FEATURES))
    y = np.array([chosen[r[0]] > 0 for r in found], float)
    return boosting.fit(x, y, MONOTONE)


def _verdicts(model: boosting.Trees, texts: list[bytes], threshold: float) -> tuple[list[Statistics], np.ndarray, np.ndarray]:
    stats = [statistics(t) for t in texts]
    x = np.array([s.features() for s in stats], float).reshape(-1, len(FEATURES))
    score = model.probability(x)
    return stats, score, np.array([not s.base_failed for s in stats], bool) & (score >= threshold)


def score_documents(df: DataFrame, model: boosting.Trees, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, quality_score, kept) for every row.

    A null or empty text has zero words, so it fails the base rule. Repeated rows are scored like any other; a null
    id stays null. Other columns are not read, whatever their names.
    """

    def run(batches):
        for batch in batches:
            stats, score, kept = _verdicts(model, batch.column(1).to_pylist(), threshold)
            counts = [pa.array([getattr(s, n) for s in stats], pa.int64()) for n in BASE]
            failed = pa.array([s.base_failed for s in stats], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, failed, pa.array(score, pa.float64()), pa.array(kept, pa.bool_())], schema=SCHEMA)

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, quality_score double, kept boolean"
    return texts_of(df, id_col, text_col).mapInArrow(run, schema)


def keep_good(df: DataFrame, model: boosting.Trees, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, all columns unchanged; one pass, no join."""
    return filter_texts(df, text_col, lambda texts: _verdicts(model, texts, threshold)[2])


def filter_texts(df: DataFrame, text_col: str, keep) -> DataFrame:
    """Rows for which ``keep(list of text bytes)`` is true, with the columns of ``df`` whatever their names or types."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            texts = [(t or "").encode("utf-8", "replace") for t in column.cast(pa.string()).to_pylist()]
            yield batch.filter(pa.array(np.asarray(keep(texts), bool)))

    return df.mapInArrow(run, df.schema)
