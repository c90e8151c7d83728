"""Range join, shard tree, packing, SimHash, components and licence scans against plain Python; the pipeline's stages."""

import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from helpers import documents, found, none_of, prose  # noqa: E402

import corpus_pipeline  # noqa: E402
from millrace.llm import common, components, gray_simhash, licences, packing, range_join, shard_tree  # noqa: E402
from millrace.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def joined(nodes, links):
    """Smallest node reachable from each."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_hash_sample(spark):
    df = spark.range(3000).selectExpr("id", "id % 3 as k", "'x' as extra")
    picked = common.hash_sample(df, ["id"], 100)
    assert picked.columns == df.columns and picked.count() == 100
    assert {r.id for r in picked.collect()} == {r.id for r in common.hash_sample(df.repartition(5), ["id"], 100).collect()}
    assert {(r.k, r["count"]) for r in common.hash_sample(df, ["id"], 100, by="k").groupBy("k").count().collect()} == {(0, 100), (1, 100), (2, 100)}
    assert common.hash_sample(df, ["id"], 5000).count() == 3000 and common.hash_sample(df.limit(0), ["id"], 5).count() == 0


def test_hash_sample_of_repeated_keys(spark):
    """A third of all rows have one id: it counts once, and the others are drawn all the same."""
    hot = spark.range(20_000).selectExpr("7L as id", "'en' as k")
    rest = spark.range(3000).selectExpr("id + 100 as id", "if(id % 2 = 0, 'en', 'de') as k")
    for by in (None, "k"):
        picked = common.hash_sample(hot.unionAll(rest), ["id"], 100, by=by, distinct=True).collect()
        assert len(picked) == len({(r.id, r.k) for r in picked}) == (200 if by else 100)
    many = spark.range(500).selectExpr("id", "cast(id % 50 as string) as k")
    assert common.hash_sample(many, ["id"], 5, by="k", groups=3).select("k").distinct().count() == 3


# ---- components


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    links = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(500, i) for i in range(300)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "none": [(7, 7)],
    }[shape]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == joined(nodes, [x for x in links if x[0] != x[1]])


def test_forest_joins_the_same_nodes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    nodes = set(a.tolist()) | set(b.tolist())
    x, y = components.forest(a, b)
    assert len(x) < len(nodes)
    assert joined(nodes, list(zip(x.tolist(), y.tolist()))) == joined(nodes, list(zip(a.tolist(), b.tolist())))


# ---- range join


def links_of(rows, cosine):
    def unit(v):
        if not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        x = np.array(v, float) / max(abs(c) for c in v)
        return x / np.sqrt((x * x).sum())

    units = [unit(v) if i is not None else None for i, v in rows]
    links = [(p, q) for p in range(len(rows)) for q in range(p) if units[p] is not None and units[q] is not None and len(units[p]) == len(units[q]) and units[p] @ units[q] >= cosine]
    n = [sum(p in link for link in links) for p in range(len(rows))]
    label = joined({i for i, _ in rows if i is not None}, [(rows[p][0], rows[q][0]) for p, q in links])
    return sorted(((i, k, label.get(i), i is None or label[i] == i) for (i, _), k in zip(rows, n)), key=repr)


@pytest.mark.parametrize("block", [4096, 16, 5])
def test_range_join_equals_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(0, rng.choice([0.05, 0.3]), 8)).tolist()) for i in range(300)]
    hot = rng.normal(size=8)
    rows += [(1000 + i, (hot + rng.normal(0, 0.02, 8)).tolist()) for i in range(120)]  # a third nearly equal
    rows += [(2000 + i, (3.0 * hot).tolist()) for i in range(30)]  # and some equal
    rows += [(3000 + i, rng.normal(size=5).tolist()) for i in range(6)]  # another length
    got = range_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block)
    assert found(got) == links_of(rows, 0.9)


def test_range_join_in_rounds(spark):
    """Small chunks: the same pairs over many rounds, with rings cut in two, a large core, floats beside doubles and three lengths."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 8))
    rows = [(i, (centres[rng.integers(10)] + rng.normal(0, rng.choice([0.05, 0.3]), 8)).tolist()) for i in range(200)]
    hot = rng.normal(size=8)
    rows += [(1000 + i, (hot + rng.normal(0, 0.02, 8)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(2000 + i, rng.normal(size=4).tolist()) for i in range(60)] + [(3000, [1.0] * 3), (3001, [1.0, 1.0, 1.1])]
    source = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block, chunk_bytes in ((20, 6000), (3, 1500)):
        assert found(range_join.near_duplicates(source, block=block, chunk_bytes=chunk_bytes)) == links_of(rows, 0.9)


def test_range_join_chunks():
    sizes = [(3, 10), (5, 1000), (6, 0), (9, 70)]
    chunks = range_join._chunks(sizes, 100)
    assert chunks[0][0] == 3 << range_join.MIX_BITS and chunks[-1][1] == 10 << range_join.MIX_BITS
    assert all(lo < hi for lo, hi in chunks) and [hi for _, hi in chunks[:-1]] == [lo for lo, _ in chunks[1:]]
    assert 11 <= len(chunks) <= 12 and len(range_join._chunks([(0, 5)], 100)) == 1


def test_range_join_bound_is_no_less_than_the_cosine():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + rng.normal(0, 0.05, (200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = range_join._base(x, 0.9)
    low = range_join._lowered(x, base)
    assert len(base) < 64 and (low @ low.T >= x @ x.T - range_join._blur(64)).all()


def peak_of_workers():
    """Largest MB that any of the Python workers alive has ever held."""
    mb = [0.0]
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if "pyspark" in (p / "cmdline").read_text():
                mb += [int(x.split()[1]) / 1024 for x in (p / "status").read_text().splitlines() if x.startswith("VmHWM") and "java" not in (p / "comm").read_text()]
        except OSError:
            pass
    return max(mb)


def test_range_join_memory_when_every_cell_is_visited(spark):
    """Vectors without clusters are in reach of nearly all cells; no copies of them are made for that."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).normal(size=(4000, 64)))]
    before = peak_of_workers()
    got = range_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2), block=4)
    assert {tuple(r) for r in got.collect()} == {(i, 0, i, True) for i in range(4000)}
    assert peak_of_workers() <= max(before, 500)


def test_range_join_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1e-320, 0.0]), (10, [1e300, 1e300]), (11, [1.0, 0.0, 0.0])]
    rows[11] = (10, [0.0, 1e300])
    source = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as kept", "2 as n_links")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in range_join.near_duplicates(source).collect()}
    # the rows 1, 2, 2 and 9 point the same way; both rows of 2 are one node with the links of either
    assert {(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (10, 0, 10, True), (11, 0, 11, True), (None, 0, None, True)} <= got
    assert (1, 3, 1, True) in got and (9, 3, 1, False) in got and (2, 3, 1, False) in got
    assert range_join.near_duplicates(none_of(spark, "vec_id long, embedding array<float>")).collect() == []


# ---- shard tree


def wait(key, node, weight):
    return -math.log(((xxhash.xxh64_intdigest(f"{key}/{node}", 42) >> 11) + 0.5) / (1 << 53)) / weight


def leaf_of(doc_id, tree):
    key, inside = "null" if doc_id is None else doc_id, tree
    for level in ("region", "rack", "shard"):
        nodes = {}
        for t in inside:
            nodes.setdefault(getattr(t, level), []).append(t)
        inside = nodes[min(nodes, key=lambda n: wait(key, f"{level}{n}", sum(t.weight for t in nodes[n])))]
    return inside[0].shard


def test_shards(spark):
    for source in (documents(spark, "shard slot law"), spark.read.parquet(f"{SF}/documents.parquet")):
        texts = source.collect()
        rows = shard_tree.assign(source, 16).collect()
        tree = shard_tree.even_tree(16)
        expected = sorted((r.doc_id or -1, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), leaf_of(r.doc_id, tree), leaf_of(r.doc_id, shard_tree.grown(tree))) for r in texts)
        assert sorted((r.doc_id or -1, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in rows) == expected
        for r in rows:
            assert r.law == "key" and r.grown_shard in (r.shard, 16)
        for s in {r.shard for r in rows}:
            slots = sorted(r.slot for r in rows if r.shard == s)
            assert slots == list(range(len(slots)))
    assert shard_tree.assign(none_of(spark)).collect() == []


def test_slots_do_not_depend_on_one_task(spark):
    rows = shard_tree.number(spark.range(5000).selectExpr("id as doc_id", "id as size", "id as text_crc32", "cast(id % 3 = 0 as int) as shard"), rows_per_block=64).collect()
    for s in (0, 1):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_equal_rows_share_no_block(spark):
    same = spark.range(4000).selectExpr("7L as doc_id", "3L as size", "1L as text_crc32", "0 as shard")
    numbered = shard_tree.number(same, rows_per_block=64)
    assert sorted(r.slot for r in numbered.select("slot").collect()) == list(range(4000))
    assert numbered.groupBy("_block").count().agg({"count": "max"}).first()[0] < 140


def test_weights_and_confined_movement(spark):
    Leaf = shard_tree.Leaf
    tree = [Leaf(0, 0, 0, 1.0), Leaf(1, 0, 0, 2.0), Leaf(2, 0, 1, 1.0), Leaf(3, 1, 2, 4.0), Leaf(4, 1, 2, 0.0), Leaf(5, 2, 3, 1.0), Leaf(6, 2, 4, 1.0)]
    heavier = [*tree[:2], Leaf(2, 0, 1, 3.0), *tree[3:]]
    from pyspark.sql import functions as F

    keys = spark.range(20_000).withColumn("key", F.col("id").cast("string"))
    both = shard_tree.descend(shard_tree.descend(keys, F.col("key"), tree, "a"), F.col("key"), heavier, "b").groupBy("a", "b").count().collect()
    share = {s: sum(r["count"] for r in both if r.a == s) / 20_000 for s in range(7)}
    assert share == pytest.approx({0: 1 / 10, 1: 2 / 10, 2: 1 / 10, 3: 4 / 10, 4: 0, 5: 1 / 10, 6: 1 / 10}, abs=0.02)
    moved = {(r.a, r.b) for r in both if r.a != r.b}
    # Into the heavier region from the others, inside of it into the heavier rack; nothing else, in particular nothing between
    # shards of the other racks or the other regions.
    assert moved == {(3, 0), (3, 1), (3, 2), (5, 0), (5, 1), (5, 2), (6, 0), (6, 1), (6, 2), (0, 2), (1, 2)}


def test_each_level_draws_for_itself(spark):
    from pyspark.sql import functions as F

    tree = shard_tree.even_tree(16)
    keys = spark.range(3000).withColumn("key", F.col("id").cast("string"))
    rows = shard_tree.descend(keys, F.col("key"), tree, "shard").collect()
    flat = [min(range(16), key=lambda s: wait(r.key, f"shard{s}", 1.0)) for r in rows]
    assert [r.shard for r in rows] == [leaf_of(r.id, tree) for r in rows]
    assert sum(r.shard != f for r, f in zip(rows, flat)) > 1000


# ---- packing


def test_differencing():
    rng = random.Random(5)
    for k in (1, 2, 3, 8):
        for n in (0, 1, 5, 60):
            sizes = [rng.randint(1, 500) for _ in range(n)]
            sums, bins = packing.difference(sizes, k)
            assert sorted(i for b in bins for i in b) == list(range(n)) and len(bins) == k
            assert sums == [sum(sizes[i] for i in b) for b in bins]
            if n == 60:
                assert max(sums) - min(sums) <= 60
    assert sorted(packing.difference([8, 7, 6, 5, 4], 2)[0]) == [14, 16]


def test_window_count_rises_until_everything_fits():
    sizes = [60] * 7  # 420 fill at least five windows of 100, but no two fit together
    assert len(packing.balance(sizes, 100)) == 7


def test_words_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    texts = ["", "ça va bien", "naïve ŒUVRE", "ÀÉÎ straße", "a\x1cb c", "İstanbul Σας ΣΑΣ", "x y", "don't 12²3 µm <|endoftext|> é 日本語 😀", "× ÷ a×b !!'s 'LL", prose(4), "z" * 20_000]
    got = list(packing.word_ids(WORDS).encode([t.encode() for t in texts]))
    assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("piece, windows", [(1024, 64), (100, 2)])
def test_packing(spark, piece, windows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    for source in (documents(spark, "start length"), spark.read.parquet(f"{SF}/documents.parquet")):
        ids = {}
        for r in source.collect():
            ids.setdefault(r.doc_id, []).append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2])
        rows = packing.pack(source, WORDS, piece_tokens=piece, batch_windows=windows).collect()
        assert sum(r.length for r in rows) == sum(len(x) for many in ids.values() for x in many)
        starts = {}
        for r in rows:
            own = ids[r.doc_id][0]
            assert r.doc_tokens == len(own) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
            starts.setdefault(r.doc_id, []).append((r.start, r.length))
        for doc_id, parts in starts.items():
            assert sorted(p for s, n in parts for p in range(s, s + n)) == sorted(list(range(len(ids[doc_id][0]))) * len(ids[doc_id]))
        windows_of = {}
        for r in rows:
            windows_of.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in windows_of.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
    assert packing.pack(none_of(spark), WORDS).collect() == []


def test_little_padding(spark):
    rows = QUERIES["op7_pack_windows"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.length for r in rows) / (4096 * len({r.sequence_id for r in rows})) > 0.97


# ---- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


def test_simhash_equals_all_pairs(spark):
    for source in (documents(spark, "fingerprint component_id"), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in source.collect()]
        links = [(a, b) for a, x in rows for b, y in rows if a is not None and b is not None and (x ^ y).bit_count() <= 3]
        label = joined({i for i, _ in rows if i is not None}, links)
        by_print = {f: label[i] for i, f in rows if i is not None}
        expected = sorted(((i, f"{f:016x}", label[i] if i is not None else by_print.get(f)) for i, f in rows), key=repr)
        assert found(gray_simhash.near_duplicates(source)) == expected
    assert gray_simhash.near_duplicates(none_of(spark)).collect() == []


@pytest.mark.parametrize("group_size", [1 << 16, 50])
def test_links_lose_nothing_in_dense_groups(spark, monkeypatch, group_size):
    monkeypatch.setattr(gray_simhash, "GROUP_SIZE", group_size)
    rng = random.Random(9)
    codes = {rng.getrandbits(64) for _ in range(400)}
    for _ in range(20):
        centre = rng.getrandbits(64)
        codes |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(40)}
    codes = sorted(c - (1 << 64) if c >> 63 else c for c in codes)
    got = {tuple(r) for r in gray_simhash.links(spark.createDataFrame([(c,) for c in codes], "fp long")).collect()}
    near = [(a, b) for i, a in enumerate(codes) for b in codes[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert all(((a ^ b) & (2**64 - 1)) for a, b in got)
    assert joined(set(codes), got) == joined(set(codes), near)


def test_index_search():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**63, 500).astype(np.uint64)
    codes[250:] = codes[:250] ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))
    codes = codes[np.argsort(gray_simhash.gray_rank(codes))]
    index = gray_simhash.Index.build(np.full(500, gray_simhash.ALL_BITS), codes)
    query, leaf = index.search(codes, 3)
    pairs = {(int(q), int(n)) for q, n in zip(query, leaf)}
    assert pairs == {(i, j) for i in range(500) for j in range(500) if int(codes[i] ^ codes[j]).bit_count() <= 3}


# ---- licence scans


def test_licences_of_given_documents(spark):
    notices = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "MIT": "Released under the MIT License.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    }
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op10_licence_scan"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        lines = docs[r.doc_id].split("\n")
        assert {f for f in r.licences if f in notices} == {f for f, notice in notices.items() if notice in lines}
        assert r.n_paragraphs == sum(bool(line.strip(" ")) for line in lines)


def test_licence_classifier_on_unseen_wording(spark):
    texts = {
        1: ("MIT", "This little tool is released under the MIT license, have fun."),
        2: ("Apache-2.0", "Files here are licensed under the Apache License, Version 2.0 by the authors"),
        3: ("GPL-3.0", "the whole work is licensed under the GNU General Public License, version 3 or so"),
        4: (None, "You need a driver's license to rent a car in this country."),
        5: (None, "The MIT campus lies on the north bank; Apache is a town."),
        6: (None, "GNU and gnat"),
        7: ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    }
    rows = licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licence for r in rows} == {i: f for i, (f, _) in texts.items()}
    assert all(r.probability >= licences.MIN_PROBABILITY for r in rows if r.licence)


def test_licences_of_wrapped_notices(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"
    texts = {
        1: (["BSD"], 1, "Some words before it.\n\n" + bsd + "\n\nMore words."),
        2: (["GPL-3.0"], 1, "    GNU GENERAL PUBLIC LICENSE\n       Version 3, 29 June 2007\n"),
        3: (["GPL-3.0"], 1, "\n".join(" * " + line for line in ["A tool.", "", *gpl.split("\n"), "", "End of it."])),
        4: (["MIT"], 1, "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files, to use it."),
        5: (["Apache-2.0"], 1, '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.'),
        6: (["Apache-2.0", "MIT"], 2, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."),
        7: (["GPL-3.0", "MIT"], 2, gpl + "\nReleased under the MIT License."),
        8: (["MPL-2.0"], 1, "This Source Code Form is subject to\nthe terms of the Mozilla Public\nLicense, v. 2.0."),
        9: (["LGPL"], 1, "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public License."),
        10: ([], 0, "Released under the\n\nMIT\n\nLicense."),
    }
    rows = licences.scan(spark.createDataFrame([(i, t) for i, (*_, t) in texts.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licences, r.n_licence_paragraphs) for r in rows} == {i: (f, n) for i, (f, n, _) in texts.items()}
    assert {r.doc_id: r.n_unknown_paragraphs for r in rows if r.doc_id in (1, 2, 6)} == {1: 0, 2: 0, 6: 0}


def test_licences_awkward_rows(spark):
    source = documents(spark, "licence probability row").unionByName(documents(spark, "licence probability row").limit(1).selectExpr("77 as doc_id", "'Released under the MIT License.\n\n ' as text", "lang", "source", "n_chars", "licence", "probability", "row"))
    rows = licences.scan(source).collect()
    assert len(rows) == source.count()
    assert {r.doc_id: (r.licences, r.n_paragraphs) for r in rows}[77] == (["MIT"], 1)
    assert all(r.licence is None and r.licences == [] for r in rows if r.doc_id != 77)
    assert licences.scan(none_of(spark)).collect() == []


def test_licence_plan_is_native(spark):
    plan = QUERIES["op10_licence_scan"](spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# ---- pipeline


def test_pipeline_stages(spark):
    from millrace.llm import language, quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sf_dir = "/root/testdata/sf0.01"
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "packing"]
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in quality.score_documents(docs, quality.fit(docs, labels)).where("kept").collect()}
    assert {r.doc_id for r in first.collect()} == kept and first.schema == docs.schema
    second = corpus_pipeline.STAGES[1][1](spark, first, sf_dir)
    assert second.schema == docs.schema and second.count() >= 0.99 * len(kept)
    net = language.fit(first)
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in language.identify(first, net).where("score >= 0.5 and lang_pred <> 'und'").collect()}
    third = corpus_pipeline.STAGES[2][1](spark, second, sf_dir)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in second.collect()]
    prints = np.array([f for _, f in rows], np.uint64)
    near = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)]
    label = joined({i for i, _ in rows}, near)
    assert sorted(r.doc_id for r in third.collect()) == sorted({label[i] for i, _ in rows}) and third.columns == docs.columns
    last = corpus_pipeline.STAGES[3][1](spark, third, sf_dir)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in third.collect()}


def test_pipeline_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for source in (documents(spark, "kept row fp _goes _n"), none_of(spark)):
        docs = source
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, str(tmp_path))
            assert docs.columns == source.columns
        ids = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
        assert len(ids) == len(set(ids))
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_rows_with_one_id_are_judged_each_for_itself(spark):
    texts = {name: prose(seed) for name, seed in (("a", 21), ("b", 22), ("c", 23), ("d", 24))}
    rows = [(5, texts["a"]), (5, texts["b"]), (3, texts["a"]), (3, texts["a"]), (None, texts["c"]), (None, texts["c"]), (None, texts["d"]), (9, texts["d"]), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as root")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(5, texts["b"]), (3, texts["a"]), (None, texts["c"]), (9, texts["d"]), (7, None)], key=repr)
