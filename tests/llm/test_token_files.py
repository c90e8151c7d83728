"""Simple-8b packing and token files: exact round trips and the library's own ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import simple8b, token_files
from millrace.llm.packing import word_ids
from millrace.llm.queries import QUERIES
from helpers import documents, none_of

PATH = public_tokenizers.path("word_bpe_49k.json")
NUMBERS = st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**32 - 1), st.integers(0, 2**64 - 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(NUMBERS, max_size=150), max_size=6))
def test_pack_and_unpack(lists):
    arrays = [np.array(x, np.uint64) for x in lists]
    packed = simple8b.pack(arrays)
    assert [x.tolist() for x in simple8b.unpack(packed)] == lists
    data = b"".join(token_files.to_bytes(i, p) + token_files.END.encode() for i, p in enumerate(packed))
    again = list(token_files.records(data))
    assert [r.doc_id for r in again] == list(range(len(lists)))
    assert [simple8b.unpack([r.packed])[0].tolist() for r in again] == lists


def plain_words(numbers):
    """Words of one block by the definition: the selector that takes most numbers, one word after the other."""
    words, i = [], 0
    while i < len(numbers):
        for selector in range(1, 15):
            n, width = int(simple8b.SLOTS[selector]), int(simple8b.WIDTHS[selector])
            part = numbers[i : i + n]
            if all(x < 1 << width for x in part):
                words.append(selector << 60 | sum(x << (width * j) for j, x in enumerate(part)))
                i += n
                break
        else:
            words.append("escape")
            i += 1
    return words


def test_words_by_definition():
    rng = random.Random(1)
    for widths in ([1], [3, 9], [12, 16], [16, 31, 61], [1, 20, 60, 64]):
        numbers = [rng.getrandbits(rng.choice(widths)) for _ in range(2 * simple8b.BLOCK + 77)]
        (packed,) = simple8b.pack([np.array(numbers, np.uint64)])
        blocks = [numbers[i : i + simple8b.BLOCK] for i in range(0, len(numbers), simple8b.BLOCK)]
        want = [plain_words(b) for b in blocks]
        escapes = iter(range(len(numbers)))
        assert packed.words.tolist() == [next(escapes) if w == "escape" else w for b in want for w in b]
        assert packed.offsets.tolist() == [sum(map(len, want[:i])) for i in range(len(want))]
        assert packed.escapes.tolist() == [x for x in numbers if x >= 1 << 60]
        for i, block in enumerate(blocks):
            assert simple8b.unpack_block(packed, i).tolist() == block


def test_ids_take_about_two_bytes():
    ids = np.array(Tokenizer.from_file(PATH).encode("the quick brown fox jumps over the lazy dog " * 500, add_special_tokens=False).ids, np.uint64)
    (packed,) = simple8b.pack([ids])
    assert len(packed.words) * 8 < 2.7 * len(ids)


def test_damaged_files_are_refused():
    data = bytearray(token_files.to_bytes(1, simple8b.pack([np.arange(5000, dtype=np.uint64)])[0]) + token_files.END.encode())
    data[500] ^= 1
    with pytest.raises(ValueError):
        list(token_files.records(bytes(data)))
    with pytest.raises(ValueError):
        list(token_files.records(bytes(data[:20])))


def ids_of(text, tokenizer=Tokenizer.from_file(PATH)):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def brute(rows):
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, text) rows."""
    made = sorted(((i, ids_of(t)) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    found, start = [], 0
    for i, ids in made:
        found.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return found


def by_start(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("file_text", [1 << 25, 100_000])
def test_files_equal_the_library(spark, tmp_path, file_text):
    df = documents(spark, "record value n_tokens file")
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    token_files.write(df, PATH, str(tmp_path / "files"), file_text=file_text)
    got = by_start(token_files.digests(spark, str(tmp_path / "files")))
    assert got == brute(rows)
    lists = {(r["file"], r["within"]): r for r in token_files.read(spark, str(tmp_path / "files")).collect()}
    in_order = [lists[k] for k in sorted(lists)]
    assert [(r["doc_id"], len(r["ids"]), crc(r["ids"])) for r in in_order] == [(i, n, c) for i, _, n, c in got]
    assert (len({f for f, _ in lists}) > 1) == (file_text == 100_000)


def test_a_hot_id_is_dealt_to_many_files(spark, tmp_path):
    rows = [(5, f"word{i % 7} and more of it") for i in range(3000)] + [(i, "other text") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    token_files.write(df, PATH, str(tmp_path / "files"), file_text=5_000)
    got = token_files.digests(spark, str(tmp_path / "files"))
    totals = token_files.read(spark, str(tmp_path / "files")).groupBy("file").count().collect()
    assert len(totals) > 4 and max(r["count"] for r in totals) < 1000
    want = brute(rows)
    got = by_start(got)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in want)
    assert [b[1] - a[1] for a, b in zip(got, got[1:])] == [r[2] for r in got[:-1]]


def test_empty_table(spark, tmp_path):
    token_files.write(none_of(spark), PATH, str(tmp_path / "files"))
    assert token_files.digests(spark, str(tmp_path / "files")).collect() == []


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|>", "n̈ <|endoftext|><|endoftext|> ß İ don't 12"])
def test_marks_as_the_library_takes_them(text):
    assert np.frombuffer(next(word_ids(PATH).encode([text.encode()])), "<u4").tolist() == ids_of(text)[:-1]


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_token_files"](spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert by_start(got) == brute(rows)


def test_long_text_spans_blocks(spark, tmp_path):
    text = " ".join(f"w{i} Ünïcode" for i in range(60_000))
    df = spark.createDataFrame([(2, "b"), (1, text)], "doc_id long, text string").withColumn("n", F.lit(1))
    token_files.write(df, PATH, str(tmp_path / "files"))
    assert by_start(token_files.digests(spark, str(tmp_path / "files"))) == brute([(1, text), (2, "b")])
