"""Lineage closures against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import lineage as L


def search(pairs, table, direction, depth=None):
    ways = {}
    for a, b in pairs:
        near, far = (a, b) if direction == "downstream" else (b, a)
        ways.setdefault(near, set()).add(far)
    found, front, hops = {table: 0}, [table], 0
    while front and (depth is None or hops < depth):
        hops += 1
        front = sorted({far for near in front for far in ways.get(near, ()) if far not in found})
        found.update(dict.fromkeys(front, hops))
    return {t: d for t, d in found.items() if t != table}


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source_table string, target_table string")


def found(df):
    got = [(r["direction"], r["table_name"], r["depth"]) for r in df.collect()]
    assert len(got) == len({g[:2] for g in got})
    return {d: {t: n for side, t, n in got if side == d} for d in ("downstream", "upstream")}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    pairs = [(f"t{i}", f"t{i + 1}") for i in range(1000)]
    rounds, real = [], L.stage
    monkeypatch.setattr(L, "stage", lambda df, label: (rounds.append(label), real(df, label))[1])
    got = found(L.closure(edges_of(spark, pairs), "t400"))
    assert got == {d: search(pairs, "t400", d) for d in ("downstream", "upstream")}
    assert rounds.count("stretch") <= 12 and rounds.count("front") <= 3


@pytest.mark.parametrize("seed", [0, 3])
def test_closure_equals_search(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(50 + 20 * seed)]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("n1", "c3"), ("c30", "n2"), ("c30", "c20")]
    pairs += [("r1", "r2"), ("r2", "r3"), ("r3", "r1")]  # a ring on its own
    pairs += pairs[:10]
    for table, depth in (("n1", None), ("c5", 9), ("r1", None), ("n1", 3)):
        got = found(L.closure(edges_of(spark, pairs), table, depth=depth))
        assert got == {d: search(pairs, table, d, depth) for d in ("downstream", "upstream")}, (table, depth)


def test_impact(spark):
    pairs = [("a", "b"), *[("b", f"c{i}") for i in range(6)]]
    row = L.impact(edges_of(spark, pairs), "b").first()
    assert (row["total_upstream"], row["total_downstream"], row["risk_level"]) == (1, 6, "high")
    assert L.lineage(edges_of(spark, pairs), "c1", "upstream").orderBy("depth").collect() == [("b", 1), ("a", 2)]
    assert L.closure(edges_of(spark, pairs), "b").filter(F.col("depth") < 1).isEmpty()


@pytest.mark.parametrize("depth", [None, 3, 9])
def test_short_lineage_is_walked_without_folding_the_whole_graph(spark, monkeypatch, depth):
    pairs = [("a", "b"), ("b", "c"), ("b", "d"), ("c", "a"), ("d", "c")] + [(f"x{i}", f"x{i + 1}") for i in range(50)]
    rounds, real = [], L.stage
    monkeypatch.setattr(L, "stage", lambda df, label: (rounds.append(label), real(df, label))[1])
    got = found(L.closure(edges_of(spark, pairs), "b", depth=depth))
    assert got == {d: search(pairs, "b", d, depth) for d in ("downstream", "upstream")}
    assert set(rounds) == {"hop"} and len(rounds) <= L.WALK
