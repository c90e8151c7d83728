import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from millrace.operators import cleaning, columns, joins, lineage, quarantine, rules as R, sets, text, windows
from millrace.plans import presets, steps


def test_null_passes_every_rule_but_not_null(spark):
    df = spark.createDataFrame([(None, None)], "x double, s string")
    rules = [
        R.rule("range", "x", min=0, max=1), R.rule("email", "s"), R.rule("phone", "s"), R.rule("length", "s", min=3),
        R.rule("regex", "s", pattern="a"), R.rule("enum", "s", values=["a"]), R.rule("sql", name="q", expr="x > 1"),
        R.rule("not_empty", "s"), R.rule("data_type", "s", type="integer"), R.rule("not_null", "x", severity="warning"),
    ]
    split = R.apply_rules(df, rules)
    assert split.valid.count() == 1 and split.rejected.count() == 0
    assert split.valid.first()["_violations"] == ["not_null_x"]


def test_valid_plus_rejected_is_everything(spark):
    rows = [("a@b.com", 5), ("bad", 5), (None, 5), ("x@y.org", None), ("bad", -1)]
    df = spark.createDataFrame(rows, "email string, n int")
    split = R.apply_rules(df, [R.rule("email", "email"), R.rule("not_null", "n"), R.rule("range", "n", min=0)])
    assert split.valid.count() + split.rejected.count() == 5
    scores = {(r["email"], r["n"]): r["_quality_score"] for r in split.valid.unionAll(split.rejected).collect()}
    assert scores == {("a@b.com", 5): 100, ("bad", 5): 85, (None, 5): 100, ("x@y.org", None): 90, ("bad", -1): 85}


def test_actions(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -4.0)], "id int, x double")
    fixed = R.enforce(df, [R.rule("not_null", "x", action="auto_fix", fix=F.lit(0.0)), R.rule("range", "x", min=0)])
    assert sorted(r["id"] for r in fixed.valid.collect()) == [1, 2]
    with pytest.raises(R.BlockedTable):
        R.enforce(df, [R.rule("not_null", "x", action="block_table")])
    with pytest.raises(ValueError):
        R.enforce(df, [R.rule("not_null", "x", action="explode")])


def test_unique_counts_every_member_and_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "id int")
    report = R.run_checks(df, [R.rule("unique", columns=["id"])]).first()
    assert (report["failed"], report["table_score"]) == (4, 20.0)


def test_empty_table_scores_100(spark):
    df = spark.createDataFrame([], "id int")
    assert R.run_checks(df, [R.rule("not_null", "id")]).first()["table_score"] == 100.0


def test_rules_from_a_catalogue(spark):
    rows = [
        {"rule_name": "positive", "rule_type": "range_check", "condition_expression": "x > 0", "severity": "HIGH"},
        {"rule_name": "one id", "rule_type": "unique", "target_columns": ["id"], "severity": "CRITICAL", "execution_priority": 1},
        {"rule_name": "off", "rule_type": "not_null", "target_columns": ["id"], "is_active": False},
    ]
    df = spark.createDataFrame([(1, 1.0), (1, -1.0), (2, None)], "id int, x double")
    report = R.run_checks(df, R.from_catalogue(rows)).collect()
    assert [(r["rule_id"], r["failed"]) for r in report] == [("one id", 2), ("positive", 1)]


def test_contract(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert R.contract_issues(df, {"a": "numeric", "b": "numeric", "c": "any"}) == [
        "Column 'a' should be numeric.",
        "Missing column: c",
    ]


def test_domain_presets():
    assert len(R.domain_rules("finance")) == 5 and len(R.domain_rules("healthcare")) == 3
    assert [r.kind for r in R.domain_rules("general")] == ["not_null", "unique"]
    assert set(presets.PLANS) == {"user_data_cleaning", "transaction_data_cleaning", "customer_data_enrichment"}


def test_generated_rules(spark):
    rows = [(i, f"u{i}@x.com", float(i + 1), dt.date(2024, 1, 1), "ok") for i in range(20)]
    df = spark.createDataFrame(rows, "user_id int, email string, amount double, created date, status string")
    names = {r.id for r in quarantine.generate_rules(df)}
    assert {"user_id_unique", "email_email", "amount_positive_range", "created_not_future", "status_non_empty"} <= names


def test_validator(spark):
    df = spark.createDataFrame([(1, "ab1"), (None, "x-ab"), (90, None)], "n int, s string")
    report = {r["rule_id"]: r for r in quarantine.Validator().not_null("n", 0.5).range("n", 5, 50).pattern("s", "ab").validate(df).collect()}
    assert report["not_null_n"]["passed"] and report["not_null_n"]["affected_rows"] == 1
    assert report["n_below"]["affected_rows"] == 1 and report["n_above"]["affected_rows"] == 1
    assert report["s_pattern"]["affected_rows"] == 1


def test_standard_phones(spark):
    df = spark.createDataFrame([("012-345 6789",), ("+60123456789",), (None,), ("n/a",)], "p string")
    got = [r["p"] for r in columns.standardize_typed(df, phones=["p"]).collect()]
    assert got == ["+60123456789", "+60123456789", None, "n/a"]


def test_hash_does_not_mix_null_positions(spark):
    df = spark.createDataFrame([("x", None), (None, "x")], "a string, b string")
    now = F.lit("2024-01-01").cast("timestamp")
    safe = [r["_record_hash"] for r in columns.add_silver_metadata(df, "s", "e", "j", now).collect()]
    plain = [r["_record_hash"] for r in columns.add_silver_metadata(df, "s", "e", "j", now, null_safe=False).collect()]
    assert safe[0] != safe[1] and plain[0] == plain[1]


def test_select_guard():
    assert columns.check_select("SELECT updated_at, 'drop table' FROM t;") == "SELECT updated_at, 'drop table' FROM t"
    for bad in ("DELETE FROM t", "SELECT 1; DROP TABLE t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"):
        with pytest.raises(ValueError):
            columns.check_select(bad)


def test_flatten_depth(spark):
    df = spark.sql("SELECT named_struct('b', named_struct('c', named_struct('d', named_struct('e', 1)))) AS a, array(1, 2) AS l")
    row = columns.flatten(df).first().asDict()
    assert row == {"a_b_c_d": '{"e":1}', "l": "[1,2]"}


def test_clean_missing_drops_empty_columns(spark):
    rows = [(1.0, None, "a"), (None, None, None), (3.0, "x", "b")] * 4
    df = spark.createDataFrame(rows, "n double, mostly string, s string").withColumn("mostly", F.lit(None).cast("string"))
    out = cleaning.clean_missing(df)
    assert out.columns == ["n", "s"] and out.filter("n IS NULL OR s IS NULL").count() == 0
    assert out.filter("n = 2.0").count() == 4


def test_dedup_by_hash(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "h string, n int")
    out = windows.dedup_by_hash(df, "h", ["n"], "last")
    assert sorted(r["n"] for r in out.collect()) == [2, 3, 4]
    assert windows.removed_count(df, out).first()["rows_removed"] == 1


def test_schema_comparison(spark):
    def listing(cols):
        return spark.createDataFrame([("t", c, k) for c, k in cols.items()], "table_name string, column_name string, data_type string")

    old = listing({"id": "int", "name": "string", "age": "int"})
    row = sets.schema_diff(old, listing({"name": "string", "id": "int", "email": "string"})).first()
    assert (row["added"], row["removed"], row["is_compatible"]) == (["email"], ["age"], False)
    assert sets.schema_diff(old, listing({"age": "int", "id": "int", "name": "string"})).first()["summary"] == "no changes"
    assert sets.schema_diff(old, listing({"id": "long", "name": "string", "age": "int"})).first()["changed"] == ["id"]
    assert sets.schema_diff(old, listing({"id": "int"}), allow_breaking=True).first()["is_compatible"]


def test_schema_versions(spark):
    empty = spark.createDataFrame([], sets.CATALOG_SCHEMA)
    counts = spark.createDataFrame([("t", 5)], "table_name string, row_count long")
    catalog = empty
    for day, cols in enumerate(["a", "ab", "ab", "abc"], start=1):
        listing = spark.createDataFrame([("t", c, "int") for c in cols], "table_name string, column_name string, data_type string")
        new = sets.register(catalog, listing, counts, F.lit(f"2024-01-0{day}").cast("timestamp"), ["core"])
        catalog = catalog.unionByName(new)
    assert [r["version"] for r in catalog.orderBy("registered_at").collect()] == [1, 2, 2, 3]
    assert sets.search_catalog(catalog, "T", "core").count() == 4 and sets.search_catalog(catalog, tag="x").count() == 0


def test_align(spark):
    target = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([("x",)], "b string")
    assert sets.align(df, target).columns == ["a", "b"]
    with pytest.raises(ValueError):
        sets.align(spark.createDataFrame([(1,)], "b int"), target)
    with pytest.raises(ValueError):
        sets.align(df.withColumn("z", F.lit(1)), target, allow_new=False)


def test_identical_columns(spark):
    df = spark.createDataFrame([(1, 1, 1, "a"), (None, None, 2, "b")], "a int, b int, c int, s string")
    assert [tuple(r) for r in joins.identical_columns(df).collect()] == [("a", "b")]


def test_salted_join_equals_join(spark):
    left = spark.range(500).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionAll(right.filter("k < 3"))
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).select("k", "id", "v").collect()))
        got = sorted(map(str, joins.salted_join(left, right, ["k"], how, 8, min_rows=20).select("k", "id", "v").collect()))
        assert got == want
    with pytest.raises(ValueError):
        joins.salted_join(left, right, ["k"], "full_outer", 8)


def test_lineage_cycles_end(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]
    edges = spark.createDataFrame(rows, "source_table string, target_table string")
    got = {r["table_name"]: r["depth"] for r in lineage.lineage(edges, "a", "downstream", 3).collect()}
    assert got == {"b": 1, "c": 2, "d": 3}
    up = {r["table_name"]: r["depth"] for r in lineage.lineage(edges, "e", "upstream", 10).collect()}
    assert up == {"d": 1, "c": 2, "b": 3, "a": 4}
    assert lineage.impact(edges, "a").first()["risk_level"] == "medium"
    assert lineage.lineage(edges, "a", depth=11).count() == lineage.lineage(edges, "a", depth=None).count() == 4
    with pytest.raises(ValueError):
        lineage.lineage(edges, "a", depth=0)


def test_record_lineage_refuses_bad_edges(spark, tmp_path):
    with pytest.raises(ValueError):
        lineage.record_lineage(spark, str(tmp_path / "e"), {"source_layer": "moon", "source_table": "t"})


def test_steps(spark):
    df = spark.createDataFrame([(1, 4.0), (2, None), (2, 9.0)], "user_id int, amount double")
    out = steps.run_steps(
        df,
        [{"operation": "join_inner", "params": {"right": "me", "on": "user_id"}}, {"operation": "remove_nulls", "params": {"columns": "amount"}}],
        {"me": df.select("user_id")},
    )
    assert out.count() == 3
    with pytest.raises(ValueError):
        steps.run_steps(df, [{"operation": "fly"}])
    assert steps.run_steps(df, [{"operation": "fly"}], on_error="skip").count() == 3
    assert steps.run_steps(df, [{"operation": "fly", "enabled": False}]).count() == 3


def test_text_pieces_cover_the_text(spark):
    body = "é" * 2500 + "\n" + "x" * 100
    df = spark.createDataFrame([(1, body), (2, ""), (3, "short")], "id int, t string")
    parts = [r["chunk_text"] for r in text.chunk(df, "id", "t").orderBy("id", "chunk_index").collect() if r["id"] == 1]
    assert "".join(parts) == body and len(parts) == 3
    lapped = [r["chunk_text"] for r in text.chunk(df, "id", "t", 1000, 200).orderBy("chunk_index").collect() if r["id"] == 1]
    assert lapped[0] + "".join(p[200:] for p in lapped[1:]) == body


def test_redaction(spark):
    df = spark.createDataFrame([("SSN 123-45-6789, card 4111 1111 1111 1111, pass AB1234567.",)], "t string")
    assert text.redact(df, "t").first()["t"] == "SSN [SSN], card [CREDIT_CARD], pass [PASSPORT]."
    assert text.pii_flags(df, "t").first()["has_pii"]


def test_equal_quarantined_rows_all_come_back(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, None), (3, "x")], "id long, name string")
    rules = [R.rule("not_null", "name"), R.rule("range", "id", min=2)]
    held = quarantine.quarantine_records(df, rules, "t", F.lit("2024-01-01").cast("timestamp"))
    done = held.withColumn("resolution_status", F.lit("accepted"))
    assert sorted(r.id for r in quarantine.reprocess(done, df.schema).collect()) == [1, 1, 2]
    again = done.withColumn("quarantined_at", F.lit("2024-01-02").cast("timestamp"))
    assert quarantine.reprocess(done.unionAll(again), df.schema).count() == 3


def test_length_has_no_maximum_unless_given(spark):
    df = spark.createDataFrame([("x" * 20_000,), ("",)], "s string")
    assert R.apply_rules(df, [R.rule("length", "s", min=1)]).valid.count() == 1
    assert R.apply_rules(df, [R.rule("length", "s", min=1, max=5)]).valid.count() == 0
