"""Language-model scores with a probabilistic suffix tree, next to an add-one word model.

The tree predicts a text byte by byte: a word is its bytes and a space, the end of a text is a line break (neither
occurs inside a word). Its states are contexts of up to ``DEPTH`` bytes. A context is considered if it makes up at
least ``MIN_SHARE`` of the training bytes, so the tree has at most DEPTH / MIN_SHARE states whatever the corpus, and is
kept if its next-byte distribution diverges from that of its longest kept suffix. Distributions are smoothed towards that
suffix. A byte is scored in the longest kept suffix of what precedes it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import remainder, texts_of
from millrace.session import stage

DEPTH = 5
MIN_SHARE = 5e-6
MIN_DIVERGENCE = 0.01  # nats for each time the context occurs
MIN_GAIN = 10.0  # nats over the training text
SMOOTHING = 6.0
# Words that every task knows, by their share of the training tokens (so there are at most 1 / FREQUENT_SHARE); the others
# are looked up by a join. Longer words are never among the frequent ones.
FREQUENT_SHARE = 2e-6
FREQUENT_BYTES = 64

END = b"\n"
POSITIONS = 1 << 20
# What a task holds of its counts before it gives them out; Spark adds them up before its shuffle, so small is as good.
HELD_WORDS = 100_000
HELD_GRAMS = 400_000

COUNTS = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])
SCORED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("frequent", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))]
)


def words_of(raw: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return raw.lower().split()


def symbols(words: list[bytes]) -> bytes:
    """The bytes that the tree predicts, after ``DEPTH`` line breaks as the first context."""
    return END * DEPTH + (b" ".join(words) + b" " if words else b"") + END


class _Counts:
    """Counts of words and of byte runs (DEPTH bytes of context and the next) of one task, given out when they are many."""

    def __init__(self):
        self.words: Counter[bytes] = Counter()
        self.grams, self.times, self.raw, self.size = [], [], [], 0

    def add(self, words: list[bytes]) -> None:
        self.words.update(words)
        text = symbols(words)
        self.raw.append(text)
        self.size += len(text)
        if self.size > POSITIONS:
            self._count()

    def _count(self) -> None:
        if not self.raw:
            return
        text = np.frombuffer(b"".join(self.raw), np.uint8)
        starts = np.cumsum([0, *map(len, self.raw)])[:-1]
        first = np.zeros(len(text), bool)
        for k in range(DEPTH):
            first[starts + k] = True
        n = len(text) - DEPTH
        key = np.zeros(n, np.int64)
        for k in range(DEPTH + 1):
            key = (key << 8) | text[k : n + k]
        grams, times = np.unique(key[~first[DEPTH:]], return_counts=True)
        self.grams.append(grams)
        self.times.append(times)
        self.raw, self.size = [], 0
        if sum(map(len, self.grams)) > HELD_GRAMS:
            self._merge()

    def _merge(self) -> None:
        grams, at = np.unique(np.concatenate(self.grams), return_inverse=True)
        self.grams, self.times = [grams], [np.bincount(at, np.concatenate(self.times)).astype(np.int64)]

    def full(self) -> bool:
        return len(self.words) > HELD_WORDS or (len(self.grams) == 1 and len(self.grams[0]) > HELD_GRAMS)

    def taken(self) -> Iterator[pa.RecordBatch]:
        self._count()
        if self.words:
            n = len(self.words)
            yield pa.RecordBatch.from_arrays([pa.array(list(self.words), pa.binary()), pa.nulls(n, pa.int64()), pa.array(list(self.words.values()), pa.int64())], schema=COUNTS)
        if self.grams:
            self._merge()
            n = len(self.grams[0])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), pa.array(self.grams[0], pa.int64()), pa.array(self.times[0], pa.int64())], schema=COUNTS)
        self.__init__()


def corpus_counts(training: DataFrame) -> DataFrame:
    """(word, n) and (gram, n) over all training texts, in one pass and one shuffle of the tasks' own counts."""

    def run(batches):
        counts = _Counts()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts.add(words_of(raw))
                if counts.full():
                    yield from counts.taken()
        yield from counts.taken()

    partial = training.select("text").mapInArrow(run, "word binary, gram long, n long")
    return partial.groupBy("word", "gram").agg(F.sum("n").alias("n"))


# Contexts of this length are found by one look into a table of all of them, longer ones from there byte by byte.
TABLE_DEPTH = 3


@dataclass
class SuffixTree:
    """Kept contexts and their smoothed next-class distributions; bounded by MIN_SHARE, so it travels with the tasks."""

    class_of: np.ndarray  # uint8 [256]: every byte of the training texts has a class, all others share the last one
    depths: np.ndarray
    codes: np.ndarray  # each context as a number to the base of the classes, the last byte being the lowest digit
    logp: np.ndarray  # float32 [states, classes], natural logarithm for a single byte of the class

    def ready(self) -> Lookup:
        return Lookup(self)


class Lookup:
    """The tree as arrays: nodes are the kept contexts and all their suffixes; a node knows its longest kept suffix."""

    def __init__(self, tree: SuffixTree):
        self.class_of, self.logp = tree.class_of, tree.logp
        self.classes = classes = tree.logp.shape[1]
        state = {(int(d), int(c)): i for i, (d, c) in enumerate(zip(tree.depths, tree.codes))}
        nodes = sorted({(k, c % classes**k) for d, c in state for k in range(d + 1)})
        number = {node: i for i, node in enumerate(nodes)}
        self.state = np.zeros(len(nodes), np.int32)
        self.child = np.zeros((len(nodes), classes), np.int32)
        self.table = np.zeros(classes**TABLE_DEPTH, np.int32)
        for i, (d, code) in enumerate(nodes):
            above = number[d - 1, code % classes ** (d - 1)] if d else 0
            self.state[i] = state.get((d, code), self.state[above])
            if d <= TABLE_DEPTH:
                self.table.reshape(-1, classes**d)[:, code] = i
            else:
                self.child[above, code // classes ** (d - 1)] = i

    def states(self, text: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """State in which each of the classes ``text[lo:hi]`` is predicted."""
        code = np.zeros(hi - lo, np.int32)
        for k in range(TABLE_DEPTH, 0, -1):
            code = code * self.classes + text[lo - k : hi - k]
        node = self.table[code]
        # Only nodes of the table's full depth have entries here, so a shorter match has no way on.
        at = np.arange(hi - lo)
        for k in range(TABLE_DEPTH + 1, DEPTH + 1):
            below = self.child[node[at], text[lo - k + at]]
            at, below = at[below > 0], below[below > 0]
            node[at] = below
        return self.state[node]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Natural logarithm of the probability of each of ``symbols(...)``."""
        text = self.class_of[np.frombuffer(b"".join(texts), np.uint8)]
        starts = np.cumsum([0, *map(len, texts)])
        total = np.zeros(len(text) + 1)
        for lo in range(DEPTH, len(text), POSITIONS):
            hi = min(lo + POSITIONS, len(text))
            total[lo + 1 : hi + 1] = self.logp[self.states(text, lo, hi), text[lo:hi]]
        np.cumsum(total, out=total)
        return total[starts[1:]] - total[starts[:-1] + DEPTH]


def grow(grams: DataFrame) -> SuffixTree:
    """The tree of the counted byte runs (gram, n).

    Contexts of every length and their next bytes are added up by Spark; those of at least MIN_SHARE reach the driver.
    """
    depths = F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    runs = grams.select("gram", "n", depths.alias("depth"))
    context = F.shiftright("gram", 8).bitwiseAND(F.expr("shiftleft(1L, 8 * depth) - 1"))
    summed = runs.groupBy("depth", context.alias("context"), F.col("gram").bitwiseAND(255).cast("int").alias("byte")).agg(F.sum("n").alias("n"))
    total = grams.agg(F.sum("n")).first()[0] or 0
    whole = summed.groupBy("depth", "context").agg(F.sum("n").alias("total"), F.collect_list(F.struct("byte", "n")).alias("next"))
    found = sorted(tuple(r) for r in whole.where(F.col("total") >= max(2, math.ceil(MIN_SHARE * total))).collect())
    return _tree([(d, c, t, sorted((x["byte"], x["n"]) for x in following)) for d, c, t, following in found])


def _tree(contexts: list[tuple[int, int, int, list[tuple[int, int]]]]) -> SuffixTree:
    by_byte = np.zeros(256, np.int64)
    for d, _, _, following in contexts:
        if d == 0:
            for byte, n in following:
                by_byte[byte] = n
    seen_bytes = np.flatnonzero(by_byte)
    classes = min(256, len(seen_bytes) + 1)
    class_of = np.full(256, classes - 1, np.uint8)
    class_of[seen_bytes] = np.arange(len(seen_bytes))

    def counts(following):
        c = np.zeros(classes)
        for byte, n in following:
            c[class_of[byte]] += n
        return c

    root = np.bincount(class_of, by_byte, classes) + 1.0
    states: dict[tuple[int, int], int] = {(0, 0): 0}
    probabilities, depths, codes = [root / root.sum()], [0], [0]
    for d, context, total, following in contexts:  # short ones first
        if d == 0:
            continue
        code = 0
        for k in range(d - 1, -1, -1):
            code = code * classes + int(class_of[(context >> (8 * k)) & 255])
        parent = next(states[k, code % classes**k] for k in range(d - 1, -1, -1) if (k, code % classes**k) in states)
        seen = counts(following)
        above = probabilities[parent]
        share = seen / total
        at = share > 0
        divergence = float((share[at] * np.log(share[at] / above[at])).sum())
        if divergence >= MIN_DIVERGENCE and total * divergence >= MIN_GAIN:
            states[d, code] = len(probabilities)
            probabilities.append((seen + SMOOTHING * above) / (total + SMOOTHING))
            depths.append(d)
            codes.append(code)
    logp = np.log(np.array(probabilities))
    unseen = 256 - len(seen_bytes)
    if unseen:
        logp[:, -1] -= math.log(unseen)
    return SuffixTree(class_of, np.array(depths), np.array(codes, np.int64), logp.astype(np.float32))


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The models learn from the rows whose crc32(doc_id as text) mod 7 is not 2 (a null id counts as 0). A null text is
    empty and consists of its end alone. Repeated rows count and are scored each for itself; without training rows all
    counts are 0 and the tree predicts every byte alike. Further columns are not read.
    """
    docs = texts_of(df, id_col, text_col)
    held_out = remainder(F.col("doc_id"), 7) == 2
    training = docs.where(~held_out)
    counts = stage(corpus_counts(training), "counts")
    words = counts.where("word is not null").select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = training.count()
    train_tokens, kinds = total + ends, distinct + (1 if ends else 0)
    tree = grow(counts.where("gram is not null").select("gram", "n"))
    frequent_words = words.where((F.octet_length("word") <= FREQUENT_BYTES) & (F.col("n") >= max(2, math.ceil(FREQUENT_SHARE * train_tokens))))
    frequent = {bytes(r.word): math.log10(r.n + 1) for r in frequent_words.collect()}
    shared = df.sparkSession.sparkContext.broadcast((tree, frequent, ends))  # bounded by MIN_SHARE, FREQUENT_SHARE and FREQUENT_BYTES

    def run(batches):
        tree, frequent, ends = shared.value
        lookup = tree.ready()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            split = [words_of(raw) for raw in batch.column(1).to_pylist()]
            made = [_by_word(words, frequent, ends) for words in split]
            score = _in_parts(lookup, split)
            columns = list(zip(*made)) if made else [[]] * 5
            n = len(split)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n), pa.int64()),
                    batch.column(0),
                    *(pa.array(list(c), f.type) for c, f in zip(columns[:3], list(SCORED)[2:5])),
                    pa.array(score / math.log(10), pa.float64()),
                    *(pa.array(list(c), f.type) for c, f in zip(columns[3:], list(SCORED)[6:])),
                ],
                schema=SCORED,
            )
            row += n

    ddl = "row long, doc_id long, n_tokens long, known long, frequent double, score double, words array<binary>, times array<long>"
    scored = stage(docs.mapInArrow(run, ddl), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(words, "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare"))
    per_token = math.log10(train_tokens + kinds + 1)
    return scored.join(met, "row", "left").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("frequent") + F.coalesce("rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        "score",
    )


def _by_word(words: list[bytes], frequent: dict[bytes, float], ends: int):
    """(tokens, known among frequent words and the end, sum of their log10(count + 1), other words, their counts)."""
    known, total = (1, math.log10(ends + 1)) if ends else (0, 0.0)
    rare, times = [], []
    for word, n in Counter(words).items():
        value = frequent.get(word)
        if value is None:
            rare.append(word)
            times.append(n)
        else:
            known += n
            total += n * value
    return len(words) + 1, known, total, rare, times


def _in_parts(lookup: Lookup, split: list[list[bytes]]) -> np.ndarray:
    """Scores of the texts, about POSITIONS bytes at a time."""
    scores, part, size = [], [], 0
    for words in split:
        text = symbols(words)
        part.append(text)
        size += len(text)
        if size > POSITIONS:
            scores.append(lookup.score(part))
            part, size = [], 0
    if part:
        scores.append(lookup.score(part))
    return np.concatenate(scores) if scores else np.zeros(0)
