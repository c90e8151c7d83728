"""Conversation repair against a plain search over all edits."""

import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import structure
from millrace.llm.queries import QUERIES
from millrace.llm.spool import Spool

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Report of one conversation from its rows (turn, role, text) in order, by trying every edit."""
    seen, faults, kinds = set(), [0, 0, 0], []
    for _, role, text in rows:
        kind = 0 if not text.strip(SPACE) else 1 if (role, text) in seen else 2 if text.rstrip(SPACE)[-1] not in ".!?" else 3
        seen.add((role, text))
        kinds.append(kind)
        if kind < 3:
            faults[kind] += 1
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.lru_cache(None)
    def best(i, state, inserted):
        """Least (cost, edits, repaired turns) of what follows."""
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def follow(cost, letter, state, turn, i, inserted=0):
            rest = best(i, state, inserted)
            if rest:
                ways.append((cost + rest[0], letter + rest[1], turn + rest[2]))

        for initial, name in (("u", "user"), ("a", "assistant")):
            if (state, initial) in step:
                after = step[state, initial]
                if inserted < 3:
                    follow(5, "I", after, (f"{name}:",), i, inserted + 1)
                if i < len(rows) and kinds[i] >= 2:
                    follow(1 + 5 * (kinds[i] == 2), "R", after, (f"{name}:{rows[i][2]}",), i + 1)
        if i < len(rows):
            follow(2, "D", state, (), i + 1)
            initial = rows[i][1][:1]
            if kinds[i] >= 2 and (state, initial) in step:
                follow(5 * (kinds[i] == 2), "K", step[state, initial], (f"{rows[i][1]}:{rows[i][2]}",), i + 1)
        return min(ways) if ways else None

    cost, audit, turns = best(0, 0, 0)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def by_turn(row):
    return (row[0] is not None, row[0] or 0, row[1], row[2])


def damaged(rows):
    """{conv_id: damaged rows in order} of (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        spelled = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(spelled.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        kept.extend([(turn, role, text)] * {0: 0, 3: 2}.get(hit, 1))
    return {conv: sorted(kept, key=by_turn) for conv, kept in found.items()}


def collected(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def some_rows(seed, n_convs=120):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n_convs)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choices(["user", "assistant", "system", "tool", "", None], [8, 7, 3, 1, 1, 1])[0]
            text = rng.choices(["Fine.", "Yes!\n", "broken off", "", " \t\x0c", None, "What? ", "é", f"t{turn}."], [5, 3, 2, 1, 1, 1, 1, 1, 6])[0]
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_search(spark, seed):
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    frame, there = structure.damage(df)
    got = collected(structure.report(frame, there=there))
    assert got == {conv: brute(kept) for conv, kept in damaged(rows).items()}


def test_undamaged_rows_and_turns(spark):
    rows = some_rows(3)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "fault", "at", "there")})
    kept = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {conv: brute(sorted(found, key=by_turn)) for conv, found in kept.items()}
    assert collected(structure.report(df)) == want
    turns = structure.repair(df)
    assert turns.columns == ["conv_id", "position", "edit", "role", "text"]
    made = {conv: [] for conv in want}
    for r in sorted(turns.collect(), key=lambda r: r["position"]):
        made[r["conv_id"]].append(r)
    for conv, found in made.items():
        assert [r["position"] for r in found] == list(range(len(found)))
        assert "".join(r["edit"] for r in found) == want[conv][6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in found).encode()).hexdigest() == want[conv][7]


def test_long_conversation_spills(spark, monkeypatch):
    """Several Arrow batches of one conversation, ways back and rows beyond what is held; the same rows in small pieces."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"Text {t}.", "no end", "", f"Again {t % 50}!"])) for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        first = collected(structure.report(df))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    conversation = structure.Conversation(structure.Program(), rows=Spool(200), back=Spool(200))
    monkeypatch.setattr(structure, "WAYS", 64)
    conversation.begin("7")
    seen = set()
    for _, turn, role, text in rows:
        fault = structure.BLANK if not text else structure.REPEATED if (role, text) in seen else structure.CUT if text[-1] not in ".!?" else structure.SOUND
        seen.add((role, text))
        conversation.add(str(turn), role, text, fault)
    assert conversation.rows.places and conversation.back.places
    cost, edits, tail = conversation.edits()
    assert (cost, "".join(edits) + tail) == first[7][5:7]
    # the search over all edits on a part that the stack can take
    part = rows[:60]
    assert collected(structure.report(spark.createDataFrame(part, SCHEMA)))[7] == brute([r[1:] for r in part])


def test_empty_table_and_dropped_conversation(spark):
    assert structure.damage_report(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = collected(structure.damage_report(spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.")], SCHEMA)
    plan = structure.damage_report(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Cartesian" not in plan


def test_query_equals_search(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op11_structure_repair"](spark, sf)) == {conv: brute(kept) for conv, kept in damaged(rows).items()}
