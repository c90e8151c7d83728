"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from millrace.llm.common import col, rows, texts_of

# Longer texts are cut before they are encoded; the ids do not depend on it.
SEGMENT_CHARS = 1 << 16

# Places where no match of the usual byte-BPE patterns can reach across: white space begins after something else,
# or a run of letters or digits ends. (A mark before a letter is no such place: contractions join the two.)
_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[^\p{White_Space}\p{L}])|(?<=\p{N})(?=[^\p{White_Space}\p{N}])")
# The library's pattern matcher runs out of stack on about a million characters of white space; longer runs than this are
# handed to it as the pieces that the pattern makes of them.
LONG_RUN = 1 << 16
_RUN = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file (base64 bytes and rank per line); kept for the life of a Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """Cut a text at safe boundaries into segments of about ``size`` characters.

    A stretch without any safe boundary (one run of letters, say) stays whole however long it is.
    """
    parts, begin = [], 0
    while len(text) - begin > size:
        cut = _SAFE.search(text, begin + size)
        if cut is None:
            break
        parts.append(text[begin : cut.start()])
        begin = cut.start()
    parts.append(text[begin:])
    return parts


@functools.lru_cache(maxsize=4)
def whole_runs(pattern: str) -> bool:
    """Whether a pattern takes a run of white space as one piece, but for its last character where something follows."""
    probe = regex.compile(pattern)
    tail = [probe.findall(f"a{blank * 4}b") for blank in " \n\u3000"]
    return all(t[:2] == ["a", blank * 3] for t, blank in zip(tail, " \n\u3000")) and probe.findall("a \n\t ") == ["a", " \n\t "]


def encode(encoder: tiktoken.Encoding, text: str, size: int = SEGMENT_CHARS) -> list[int]:
    """Ids of a whole text."""
    if len(text) <= size:
        return encoder.encode_ordinary(text)
    ids, begin = [], 0
    if len(text) >= LONG_RUN and whole_runs(encoder._pat_str):
        for run in _RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += _by_segments(encoder, text[begin : run.start()], size)
            ids += encoder._encode_single_piece(text[run.start() : end])
            begin = end
    return ids + _by_segments(encoder, text[begin:], size)


def _by_segments(encoder: tiktoken.Encoding, text: str, size: int) -> list[int]:
    return [i for part in segments(text, size) for i in encoder.encode_ordinary(part)]


def decode(encoder: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The bytes behind the ids; a character may be spread over several ids, so bytes are joined before any decoding."""
    return encoder.decode_bytes(ids)


def tokenize(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the ids of the whole text.

    A null text counts as empty and has no ids. Repeated rows give repeated rows; other columns are not read.
    """

    def run(batches):
        encoder = encoding(path, pattern)
        yield from rows(batches, IDS_SCHEMA, lambda raw: (encode(encoder, raw.decode("utf-8", "replace")),))

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def detokenize(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids); null ids give null."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches):
        encoder = encoding(path, pattern)
        for batch in batches:
            made = [None if ids is None else decode(encoder, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], schema=schema)

    picked = df.select(col(id_col).cast("long").alias("doc_id"), col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, "doc_id long, decoded binary")


def round_trip_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids (little-endian 32 bit) and of the decoded bytes.

    Encodes and decodes in one pass, so that the ids of long texts are not written anywhere.
    """

    def digest(encoder, raw: bytes):
        ids = encode(encoder, raw.decode("utf-8", "replace"))
        return (
            len(ids),
            hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(decode(encoder, ids)).hexdigest(),
        )

    def run(batches):
        encoder = encoding(path, pattern)
        yield from rows(batches, SCHEMA, lambda raw: digest(encoder, raw))

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
