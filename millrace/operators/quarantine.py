"""Quarantine records, generated rules, validation reports, gates, scores and alerts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.scalars import NUMERIC, columns_of, exact, missing
from millrace.operators.aggregates import column_stats
from millrace.operators.cleaning import iqr_bounds
from millrace.operators.rules import VIOLATIONS, Rule, contract_issues, mark, ordered, rule, rule_report
from millrace.operators.profiling import duplicate_rows


def quarantine_records(df: DataFrame, rules: Sequence[Rule], table: str, now: Column) -> DataFrame:
    """One row per (row, broken rule): severity, reason, the row as JSON, status pending."""
    about = F.create_map(*[x for r in ordered(rules) for x in (F.lit(r.id), F.lit(r.severity))])
    kinds = F.create_map(*[x for r in ordered(rules) for x in (F.lit(r.id), F.lit(r.kind))])
    data = df.columns
    record = F.to_json(F.struct(*[exact(c) for c in data]), {"ignoreNullFields": "false"})
    return (
        mark(df, rules)
        .filter(F.size(VIOLATIONS) > 0)
        .select(record.alias("record"), F.explode(VIOLATIONS).alias("rule_id"))
        .select(
            F.md5(F.concat_ws("|", F.lit(table), F.col("rule_id"), F.col("record"))).alias("quarantine_id"),
            F.lit(table).alias("source_table"),
            "rule_id",
            about[F.col("rule_id")].alias("severity"),
            F.concat(F.lit("failed "), kinds[F.col("rule_id")], F.lit(" rule "), F.col("rule_id")).alias("reason"),
            "record",
            F.lit("pending").alias("resolution_status"),
            now.alias("quarantined_at"),
        )
    )


def recurrence(quarantine: DataFrame) -> DataFrame:
    """Per record and rule: how often it came back, when first and last."""
    return quarantine.groupBy("source_table", "rule_id", "record").agg(
        F.count("*").alias("recurring_count"),
        F.min("quarantined_at").alias("first_seen"),
        F.max("quarantined_at").alias("last_seen"),
    )


# The states of a quarantine record, and those whose row may go back into the table.
RESOLUTIONS = ("pending", "fixed", "accepted", "rejected", "reprocessed", "ignored")
USABLE = ("fixed", "accepted", "reprocessed")


def resolve(quarantine: DataFrame, decisions: DataFrame, status: str, by: str, now: Column) -> DataFrame:
    """Set the status of the records listed in ``decisions`` (a ``quarantine_id`` column)."""
    if status not in RESOLUTIONS:
        raise ValueError(f"status must be one of {RESOLUTIONS}")
    chosen = decisions.select("quarantine_id").distinct().withColumn("_chosen", F.lit(True))
    joined = quarantine.join(chosen, "quarantine_id", "left")
    picked = F.col("_chosen").isNotNull()
    return (
        joined.withColumn("resolution_status", F.when(picked, F.lit(status)).otherwise(F.col("resolution_status")))
        .withColumn("resolved_by", F.when(picked, F.lit(by)))
        .withColumn("resolved_at", F.when(picked, now))
        .drop("_chosen")
    )


def reprocess(resolved: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of resolved records, read back from their JSON; equal rows come back as often as they were rejected.

    A row is in quarantine once for each rule it broke and each time it was checked, so the copies of a record are
    counted within one rule and time.
    """
    done = resolved.filter(F.col("resolution_status").isin(*USABLE))
    copies = done.groupBy("record", "rule_id", "quarantined_at").agg(F.count("*").alias("n"))
    rows = copies.groupBy("record").agg(F.max("n").alias("n"))
    again = rows.select("record", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return again.select(F.from_json("record", schema).alias("r")).select("r.*")


# Name words and limits the generated rules depend on.
AMOUNT_WORDS = ["amount", "price", "value", "cost", "balance"]
CODE_WORDS = ["status", "code", "type"]
REQUIRED_NULL_PERCENT = 10
UPPER_FACTOR = 10
UPPER_DEFAULT = 1_000_000_000


def generate_rules(df: DataFrame, as_of: Column | None = None, approx: bool = False) -> list[Rule]:
    """Rules suggested by the profile of the whole table (one row per column reaches the driver)."""
    out: list[Rule] = []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for s in column_stats(df, approx).collect():
        name, kind, low = s["column_name"], kinds[s["column_name"]], s["column_name"].lower()
        is_id = low.endswith("id") and s["distinct_count"] == s["row_count"]
        severity = "critical" if is_id else "high"
        if s["row_count"] == 0 or s["null_count"] * 100.0 / s["row_count"] < REQUIRED_NULL_PERCENT:
            out.append(rule("not_null", name, name=f"{name}_not_null", severity=severity, action="quarantine_row"))
        if is_id:
            out.append(rule("unique", columns=[name], name=f"{name}_unique", severity="critical", action="quarantine_row"))
        if isinstance(kind, NUMERIC) and any(w in low for w in AMOUNT_WORDS):
            top = float(s["max_value"]) if s["max_value"] is not None else 0.0
            limit = int(top * UPPER_FACTOR) if top > 0 else UPPER_DEFAULT
            test = f"`{name}` > 0 AND `{name}` < {limit}"
            out.append(rule("sql", name, name=f"{name}_positive_range", severity="high", action="quarantine_row", expr=test))
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) or "date" in low:
            extra = {} if as_of is None else {"as_of": as_of}
            out.append(rule("not_future", name, name=f"{name}_not_future", severity="high", action="quarantine_row", **extra))
        if isinstance(kind, T.StringType):
            if "email" in low:
                out.append(rule("email", name, name=f"{name}_email", severity="warning", action="log"))
            if any(w in low for w in CODE_WORDS):
                out.append(rule("not_empty", name, name=f"{name}_non_empty", severity="warning", action="quarantine_row"))
    return out


def rules_frame(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a table: name, kind, column, severity, action."""
    rows = [(r.id, r.kind, ",".join(r.targets), r.severity, r.action) for r in rules]
    return df.sparkSession.createDataFrame(rows, "rule_id string, rule_type string, columns string, severity string, action string")


class Validator:
    """Collects checks and reports them all from one aggregate.

    >>> Validator().not_null("id").range("qty", 1, 50).validate(df)
    """

    def __init__(self) -> None:
        self._rules: list[Rule] = []
        self._limits: dict[str, float] = {}

    def _add(self, r: Rule, limit: float = 0.0) -> Validator:
        self._rules.append(r)
        self._limits[r.id] = limit
        return self

    def not_null(self, column: str, threshold: float = 0.0, severity: str = "error") -> Validator:
        """Passes while the NULL share is at most ``threshold``."""
        return self._add(rule("not_null", column, severity=severity), threshold)

    def type(self, column: str, type_name: str, severity: str = "error") -> Validator:
        return self._add(rule("data_type", column, severity=severity, type=type_name))

    def range(self, column: str, low: float | None = None, high: float | None = None, severity: str = "error") -> Validator:
        """Reports below and above as two checks."""
        if low is not None:
            self._add(rule("range", column, name=f"{column}_below", severity=severity, min=low))
        if high is not None:
            self._add(rule("range", column, name=f"{column}_above", severity=severity, max=high))
        return self

    def pattern(self, column: str, pattern: str, severity: str = "error") -> Validator:
        """The pattern must match from the start of the value."""
        return self._add(rule("regex", column, name=f"{column}_pattern", severity=severity, pattern=f"^(?:{pattern})"))

    def unique(self, *columns: str, severity: str = "error") -> Validator:
        return self._add(rule("unique", columns=columns, severity=severity))

    def custom(self, name: str, fn: Callable[[DataFrame], Column], severity: str = "error") -> Validator:
        return self._add(rule("custom", name=name, severity=severity, fn=fn))

    def validate(self, df: DataFrame) -> DataFrame:
        """One row per check: affected rows and whether it passed."""
        report = rule_report(mark(df, self._rules), self._rules)
        limits = F.create_map(*[x for k, v in self._limits.items() for x in (F.lit(k), F.lit(float(v)))])
        share = F.coalesce(F.try_divide(F.col("failed"), F.col("processed")), F.lit(0.0))
        return report.select(
            "rule_id",
            "rule_type",
            "severity",
            F.col("processed").alias("total_rows"),
            F.col("failed").alias("affected_rows"),
            (share <= limits[F.col("rule_id")]).alias("passed"),
        )


def verdict(report: DataFrame) -> DataFrame:
    """One row over a validation report: passed, has errors, has warnings."""
    failed = ~F.col("passed")
    return report.agg(
        F.bool_and("passed").alias("passed"),
        F.bool_or(failed & (F.col("severity") == "error")).alias("has_errors"),
        F.bool_or(failed & (F.col("severity") == "warning")).alias("has_warnings"),
    )


def completeness(df: DataFrame, minimum: float = 0.95) -> DataFrame:
    """Per data column (no leading ``_``): share present; the mean as ``score`` and whether it is enough."""
    data = [c for c in df.columns if not c.startswith("_")]
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.avg((~missing(df, c)).cast("double")).alias("completeness")) for c in data
    ]
    one = df.agg(F.array(*entries).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda acc, e: acc + e["completeness"])
    scored = one.select(F.inline("c"), F.round(total / len(data), 4).alias("score"))
    return scored.withColumn("passed", F.col("score") >= minimum)


def quality_gate(df: DataFrame, expected: Mapping[str, str], min_rows: int, approx: bool = False) -> DataFrame:
    """Issue messages: schema, missing values, duplicates, outliers, too few rows, text columns."""
    fences = {c: b for c, b in iqr_bounds(df, columns_of(df, T.DoubleType, T.LongType), 1.5, approx).items() if b}
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(missing(df, c)).alias(f"m_{c}") for c in df.columns],
        *[F.count_if(~exact(c).between(*b)).alias(f"o_{c}") for c, b in fences.items()],
    ).first()
    repeats = duplicate_rows(df).first()["duplicate_rows"]
    issues = contract_issues(df, expected)
    issues += [f"Missing values found in column: {c}" for c in df.columns if row[f"m_{c}"]]
    if repeats:
        issues.append(f"{repeats} duplicate rows found.")
    issues += [f"Outliers found in column: {c}" for c in fences if row[f"o_{c}"]]
    if row["rows"] < min_rows:
        issues.append(f"Data volume check failed: only {row['rows']} rows present.")
    issues += [f"Column '{c}' has inconsistent types." for c in columns_of(df, T.StringType)]
    return df.sparkSession.createDataFrame([(i,) for i in issues], "issue string")


def score_retention(before: Column, after: Column, issues: Column) -> Column:
    """100 - min(row loss %, 30) - 5 per issue, kept between 0 and 100."""
    loss = F.coalesce(F.try_divide((before - after) * F.lit(100.0), before), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - F.least(loss, F.lit(30.0)) - issues * 5))


def quality_band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").otherwise("poor")


def quality_alerts(scores: DataFrame) -> DataFrame:
    """Alerts for tables (table, score, missing): critical below 60, else a warning above 20 % missing."""
    severity = F.when(F.col("score") < 60, "critical").when(F.col("missing") > 20, "warning")
    issue = F.when(
        F.col("score") < 60, F.concat(F.lit("Quality score below threshold ("), F.col("score").cast("string"), F.lit(")"))
    ).otherwise(F.concat(F.lit("High missing value rate ("), F.col("missing").cast("string"), F.lit("%)")))
    return scores.select(
        "table", "score", "missing", quality_band(F.col("score")).alias("band"), severity.alias("severity"), issue.alias("issue")
    ).filter(F.col("severity").isNotNull())
