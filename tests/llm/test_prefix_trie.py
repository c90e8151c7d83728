"""Prefix trie against a plain one built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import prefix_trie
from millrace.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def mark(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def in_order(rows):
    """{conv_id: [(role, text)]} by turn."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        found.setdefault(conv, []).append(((turn is not None, turn or 0, role, mark((role, text))), (role, text)))
    return {conv: [t for _, t in sorted(turns)] for conv, turns in found.items()}


def rebuilt(own):
    made = {}
    for conv, turns in own.items():
        h = 0 if conv is None else zlib.crc32(str(conv).encode()) % 4
        head = own.get(conv - conv % 20, []) if conv is not None else []
        made[conv] = head[:h] + turns[h:]
    return made


def brute(conversations):
    """All nodes of the trie of {conv_id: turns}, as the query returns them."""
    members = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    first = {node: min((c for c in convs if c is not None), default=None) for node, convs in members.items()}
    children = {node: [] for node in members}
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
    found = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if c is not None and len(conversations[c]) == len(node))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        found.append((first[node], len(node), first[node[:-1]] if node else None, len(convs), len(children[node]), leaves[node], saved[node], sha))
    return sorted(found, key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def some_rows(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for conv in [None, -20, -3, *rng.sample(range(300), n)]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8])):
            role = rng.choice(["user", "assistant", "system", "", None])
            text = rng.choice(["a b c", "a  b\x0bc ", "", None, "one", "é b c", f"t{rng.randint(0, 3)} x"])
            rows.append((conv, rng.choice([turn, turn, 0, None]), role, text))
    return rows + rows[:20]


def hot_rows():
    """Half of all conversations are the same, and many others begin like them or stop earlier."""
    same = [(t, "user", f"turn {t} of many") for t in range(6)]
    rows = [(100 * i, *turn) for i in range(200) for turn in same]
    rows += [(100 * i + 7, *turn) for i in range(60) for turn in [*same[: i % 7], (9, "assistant", f"own {i % 5}")]]
    return rows


@pytest.mark.parametrize("rows", [some_rows(1), some_rows(2), hot_rows()], ids=["mixed", "mixed2", "hot"])
def test_trie_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "conv", "depth", "one", "words")}).repartition(5)
    assert got(prefix_trie.rebuilt_trie(df)) == brute(rebuilt(in_order(rows)))
    assert got(prefix_trie.conversation_trie(df)) == brute(in_order(rows))


def test_long_conversations_go_page_by_page(spark):
    rng = random.Random(3)
    long_one = [(t, "user", rng.choice(["a b", "c", "d e f"])) for t in range(230)]
    rows = [(1, *t) for t in long_one] + [(2, *t) for t in long_one[:150]] + [(3, *t) for t in long_one[:150]] + [(4, 0, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    turns, lengths = prefix_trie.as_they_are(prefix_trie.numbered_turns(df, page_turns=40))
    assert got(prefix_trie.trie(turns, lengths, page_turns=40)) == brute(in_order(rows))


def test_long_end_lists_are_put_together(spark, monkeypatch):
    rows = [(c, 0, "user", "hi") for c in range(-50, 3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    monkeypatch.setattr(prefix_trie, "PIECE", 100)
    assert got(prefix_trie.conversation_trie(df)) == brute(in_order(rows))


def test_turnless_and_empty(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    turnless = next(c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(turnless, 0, "user", "gone")]
    assert got(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute({turnless: []})


def test_no_products_in_the_plan(spark):
    df = spark.createDataFrame(some_rows(4), SCHEMA)
    plan = prefix_trie.rebuilt_trie(df)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_prefix_trie"](spark, sf)) == brute(rebuilt(in_order(rows)))
