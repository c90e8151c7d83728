"""Whole texts, whole closures: nothing is cut."""

import pytest

from millrace.operators import columns, lineage, text


def test_text_above_one_mebibyte_is_kept(spark):
    long = "word " * 250_000
    df = spark.createDataFrame([(1, long)], "id long, text string")
    row = text.text_metrics(df, "text", preview_chars=4).first()
    assert (row.text_content, row.text_preview, row.word_count) == (long, "word", 250_000)
    assert "text_preview" not in text.text_metrics(df, "text").columns


def test_summary_falls_back_to_the_whole_text(spark):
    df = spark.createDataFrame([("short. " * 100,)], "t string")
    assert text.summarise(df, "t").first().summary == "short. " * 100


def test_reference_number_ends_with_a_word_character(spark):
    df = spark.createDataFrame([(1, "see INV-2023- and go")], "id long, t string")
    assert [r.value for r in text.extract_fields(df, "id", "t").collect()] == ["INV-2023"]


def test_keywords_are_added_up_and_limited_before_each_shuffle(spark):
    """Counting inside the row, without a shuffle, was measured to take twice as long."""
    df = spark.createDataFrame([(1, "beta alpha beta gamma alpha beta the"), (2, "a b c"), (3, None), (1, "delta delta"), (None, "gamma")], "id long, t string")
    found = text.keywords(df, "id", "t", 2)
    want = [(1, "beta", 3, 1), (1, "alpha", 2, 2), (1, "delta", 2, 1), (None, "gamma", 1, 1)]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)
    plan = text.keywords(df, "id", "t", 2)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(1)" in plan and "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("start, up, down", [("t0", 0, 15), ("t7", 7, 8), ("t15", 15, 0)])
def test_impact_goes_to_the_end_of_long_chains(spark, start, up, down):
    edges = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(15)], "source_table string, target_table string")
    row = lineage.impact(edges, start).first()
    assert (row.total_upstream, row.total_downstream) == (up, down)
    assert lineage.lineage(edges, start, "downstream", 2).count() == min(2, down)


def test_ad_hoc_queries_are_not_cut(spark):
    assert columns.run_query(spark, "SELECT * FROM numbers", {"numbers": spark.range(5000)}).count() == 5000
    assert "ORDER BY id LIMIT 7" in columns.query_template("basic_preview", "numbers", order="id", rows=7)


def test_keywords_leave_only_the_ranked_words_of_a_row_to_the_second_shuffle(spark):
    df = spark.createDataFrame([(i, " ".join(f"word{(i * j) % 97}" for j in range(400))) for i in range(20)], "id long, t string")
    found = text.keywords(df, "id", "t", 3)
    assert found.count() == sum(min(3, len({(i * j) % 97 for j in range(400)})) for i in range(20))
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "word#" not in shuffles[-1] and "_row" in shuffles[-1]  # the first one carries whole texts, by row
