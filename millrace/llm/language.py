"""Language identification with a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import col, hash_sample, remainder, texts_of
from millrace.llm.quality import filter_texts

WINDOW = 256  # bytes that the network sees at once
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 12  # for each width
BATCH_WINDOWS = 512
UNKNOWN = "und"

SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Byte embedding, filters of several widths, maximum over the window, softmax."""

    labels: list[str]
    embedding: np.ndarray  # [256, EMBEDDING]
    filters: list[np.ndarray]  # for each width [width * EMBEDDING, FILTERS]
    biases: list[np.ndarray]
    weights: np.ndarray  # [len(WIDTHS) * FILTERS, labels]
    offset: np.ndarray

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """[n, labels] for ``windows`` uint8 [n, length]."""
        return _log_softmax(self._pooled(windows)[0] @ self.weights + self.offset)

    def _pooled(self, windows: np.ndarray, keep: bool = False):
        n, length = windows.shape
        x = self.embedding[windows]  # [n, length, EMBEDDING]
        flat = x.reshape(n, length * EMBEDDING)
        pooled, kept = [], []
        for width, filters, bias in zip(WIDTHS, self.filters, self.biases):
            patches = sliding_window_view(flat, width * EMBEDDING, axis=1)[:, ::EMBEDDING]
            patches = np.ascontiguousarray(patches).reshape(-1, width * EMBEDDING)
            out = (patches @ filters).reshape(n, length - width + 1, FILTERS)
            if keep:
                where = out.argmax(axis=1)
                top = np.take_along_axis(out, where[:, None, :], axis=1)[:, 0] + bias
                kept.append((patches.reshape(n, -1, width * EMBEDDING), where, top > 0))
            else:
                top = out.max(axis=1) + bias  # the bias and the rectifier keep the order, so they come after
            pooled.append(np.maximum(top, 0))
        return np.concatenate(pooled, axis=1), kept


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, y: np.ndarray, labels: list[str], steps: int = 500, batch: int = 96, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on cross-entropy over ``windows`` (uint8 [n, length]) with label numbers ``y``; classes weigh the same."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Network(
        labels,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(f32),
        [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)).astype(f32) for w in WIDTHS],
        [np.zeros(FILTERS, f32) for _ in WIDTHS],
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(f32),
        np.zeros(len(labels), f32),
    )
    params = [net.embedding, *net.filters, *net.biases, net.weights, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_label = [np.flatnonzero(y == k) for k in range(len(labels))]
    for step in range(1, steps + 1):
        kind = rng.integers(len(labels), size=batch)
        pick = np.array([by_label[k][rng.integers(len(by_label[k]))] for k in kind])
        grads = _gradients(net, windows[pick], y[pick])
        for p, g, m, v in zip(params, grads, first, second):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n = len(y)
    hidden, kept = net._pooled(windows, keep=True)
    error = np.exp(_log_softmax(hidden @ net.weights + net.offset))
    error[np.arange(n), y] -= 1
    error /= n
    d_weights, d_offset = hidden.T @ error, error.sum(axis=0)
    d_hidden = error @ net.weights.T
    d_embedding = np.zeros_like(net.embedding)
    d_filters, d_biases = [], []
    for k, (width, filters) in enumerate(zip(WIDTHS, net.filters)):
        patches, where, active = kept[k]
        d_top = d_hidden[:, k * FILTERS : (k + 1) * FILTERS] * active  # [n, FILTERS]
        chosen = np.take_along_axis(patches, where[:, :, None], axis=1)  # [n, FILTERS, width * EMBEDDING]
        d_filters.append(np.einsum("nfe,nf->ef", chosen, d_top))
        d_biases.append(d_top.sum(axis=0))
        d_patch = d_top[:, :, None] * filters.T[None]  # [n, FILTERS, width * EMBEDDING]
        for j in range(width):
            seen = windows[np.arange(n)[:, None], where + j]
            np.add.at(d_embedding, seen, d_patch[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
    return [d_embedding, *d_filters, *d_biases, d_weights, d_offset]


def windows_of(raw: bytes) -> np.ndarray:
    """All of a text as windows of fixed length, the last one filled up with spaces."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b" "), np.uint8).reshape(n, WINDOW)


def predict(net: Network, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Label and score of each text: the mean of the log-probabilities of all its windows, weighted by their bytes."""
    has_letter = [_LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts]
    if not net.labels:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    parts = [windows_of(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    stops = np.cumsum(sizes)
    total = np.zeros((len(texts), len(net.labels)))
    at = 0
    while at < len(texts):  # as many texts as fill a batch; one long text may fill several
        end = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + BATCH_WINDOWS, "right")))
        windows = np.concatenate(parts[at:end])
        logp = np.concatenate([net.log_probabilities(windows[i : i + BATCH_WINDOWS]) for i in range(0, len(windows), BATCH_WINDOWS)])
        weight = np.full(len(windows), float(WINDOW))
        ends = np.cumsum(sizes[at:end])
        weight[ends - 1] = [max(1, len(t) - (s - 1) * WINDOW) for t, s in zip(texts[at:end], sizes[at:end])]
        starts = np.concatenate([[0], ends[:-1]])
        total[at:end] = np.add.reduceat(logp * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        at = end
    probability = np.exp(_log_softmax(total))
    best = probability.argmax(axis=1)
    names = [net.labels[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)]
    return names, np.where(has_letter, probability[np.arange(len(texts)), best], 0.0)


def fit(docs: DataFrame, docs_per_label: int = 300, windows_per_doc: int = 8, steps: int = 500, max_labels: int = 200) -> Network:
    """Train on at most ``docs_per_label`` documents of each language and ``windows_per_doc`` windows of each.

    Of more than ``max_labels`` different languages those with most documents are learned. Of documents with the same id
    and language the one first by a hash of its text counts.

    Only documents with a language whose crc32(doc_id as text) mod 4 is not 2 are used, chosen by a hash of their id;
    the windows are spread evenly over the whole text. Without such documents there are no labels and every text is
    ``und``.
    """
    labelled = docs.select(col("doc_id").cast("long").alias("doc_id"), col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    chosen = hash_sample(labelled, ["doc_id"], docs_per_label, by="lang", groups=max_labels, distinct=True)
    schema = pa.schema([("lang", pa.string()), ("window", pa.binary())])

    def run(batches):
        for batch in batches:
            langs, parts = [], []
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if _LETTER.search(raw.decode("utf-8", "replace")):
                    all_windows = windows_of(raw)
                    for i in np.unique(np.linspace(0, len(all_windows) - 1, windows_per_doc).astype(int)):
                        langs.append(lang)
                        parts.append(all_windows[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], schema=schema)

    rows = texts_of(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # docs_per_label rows for each of max_labels languages
    sample = rows.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")
    found = sorted((r.lang, bytes(r.window)) for r in sample.mapInArrow(run, "lang string, window binary").collect())
    labels = sorted({lang for lang, _ in found})
    if not labels:
        return Network([], np.zeros((256, 0)), [], [], np.zeros((0, 0)), np.zeros(0))
    y = np.array([labels.index(lang) for lang, _ in found])
    return train(np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, WINDOW), y, labels, steps=steps)


def identify(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from all windows of the text and nothing else.

    A null text or one without a letter is ``und`` with score 0. Repeated rows, null ids and further columns change
    nothing.
    """

    def run(batches):
        for batch in batches:
            names, score = predict(net, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], schema=SCHEMA)

    found = texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, net: Network, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose language is recognised with at least ``min_score``, all columns unchanged.

    Texts without a letter go. A network that had nothing to learn from rejects no other text.
    """

    def keep(texts):
        if not net.labels:
            return [_LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts]
        names, score = predict(net, texts)
        return (score >= min_score) & (np.array(names, object) != UNKNOWN)

    return filter_texts(df, text_col, keep)
