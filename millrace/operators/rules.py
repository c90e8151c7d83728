"""Data-quality rules compiled to one boolean column each.

All row rules of a table become one projection (``flag_rows``); counts come from one aggregate over it. A rule
is violated or not, never unknown: NULL passes everywhere except in ``not_null``, so valid + rejected = total.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.scalars import EMAIL_PATTERN, NUMERIC, PHONE_PATTERN, exact, missing, phone_digits, safe_cast
from millrace.functions.stats import one_row
from millrace.operators.cleaning import iqr_bounds
from millrace.session import stage

# Score penalties, severity order, and what the actions do with a failing row.
PENALTIES = {"not_null": 10, "email": 15}
SEVERITIES = ["critical", "error", "high", "medium", "warning", "low", "info"]
REJECTING_SEVERITIES = ("critical", "error")
KEEP_ACTIONS = ("log", "warn", "flag", "alert")
SPLIT_ACTIONS = ("quarantine", "reject", "quarantine_row")
FLAG_NAMES = {"not_null": "NULL", "email": "INVALID_EMAIL"}

# Rule kinds as rule catalogues name them.
KIND_NAMES = {
    "range_check": "range",
    "regex_format": "regex",
    "enum_validation": "enum",
    "cross_column_logic": "cross_column",
    "anomaly_detection": "anomaly",
    "sql_expression": "sql",
    "data_type_check": "data_type",
}

VIOLATIONS = "_violations"


@dataclass(frozen=True)
class Rule:
    """One check. ``params`` depends on the kind: min, max, pattern, values, expr, parent, keys, type, …"""

    kind: str
    column: str | None = None
    columns: tuple[str, ...] = ()
    name: str = ""
    severity: str = "error"
    action: str = "quarantine"
    priority: int = 5
    params: Mapping[str, Any] = field(default_factory=dict)

    @property
    def id(self) -> str:
        return self.name or "_".join([self.kind, *self.targets])

    @property
    def targets(self) -> tuple[str, ...]:
        return self.columns or ((self.column,) if self.column else ())

    @property
    def flag(self) -> str:
        label = FLAG_NAMES.get(self.kind, f"INVALID_{self.kind.upper()}")
        return "_".join([label, *self.targets])


def rule(kind: str, column: str | None = None, *, columns: Sequence[str] = (), name: str = "", severity: str = "error",
         action: str = "quarantine", priority: int = 5, **params: Any) -> Rule:
    """Shorthand for ``Rule`` with the parameters as keywords; catalogue names of the kinds are accepted too."""
    return Rule(KIND_NAMES.get(kind, kind), column, tuple(columns), name, severity, action, priority, params)


def from_catalogue(rows: Sequence[Mapping[str, Any]]) -> list[Rule]:
    """Active rules of a rule catalogue: a condition is a passing SQL test, ``unique`` checks its columns."""
    out = []
    for row in rows:
        if not row.get("is_active", True):
            continue
        about = {
            "name": row["rule_name"],
            "severity": row.get("severity", "high").lower(),
            "action": row.get("action", "quarantine_row"),
            "priority": row.get("execution_priority", 5),
        }
        columns = tuple(row.get("target_columns") or ())
        if row["rule_type"] in ("unique", "not_null"):
            out.append(rule(row["rule_type"], columns=columns, **about))
        else:
            out.append(rule("sql", expr=row["condition_expression"], **about))
    return out


def _range(df: DataFrame, r: Rule) -> Column:
    value, out = exact(r.column), F.lit(False)
    if r.params.get("min") is not None:
        out = out | (value < r.params["min"])
    if r.params.get("max") is not None:
        out = out | (value > r.params["max"])
    return out


def _length(df: DataFrame, r: Rule) -> Column:
    size, out = F.length(r.column), F.lit(False)
    if r.params.get("min") is not None:
        out = out | (size < r.params["min"])
    if r.params.get("max") is not None:
        out = out | (size > r.params["max"])
    return out


def _not_future(df: DataFrame, r: Rule) -> Column:
    return exact(r.column) > r.params.get("as_of", F.current_timestamp())


def _data_type(df: DataFrame, r: Rule) -> Column:
    value = exact(r.column)
    return value.isNotNull() & safe_cast(value.cast("string"), r.params["type"]).isNull()


def _anomaly(df: DataFrame, r: Rule) -> Column:
    value = exact(r.column)
    if r.params.get("method", "iqr") == "zscore":
        s = one_row(df, m=F.avg(exact(r.column)), d=F.stddev_samp(exact(r.column)))
        return F.abs(value - s["m"]) > r.params.get("threshold", 3.0) * s["d"]
    bounds = iqr_bounds(df, [r.column], r.params.get("threshold", 1.5), r.params.get("approx", False))[r.column]
    return F.lit(False) if bounds is None else ~value.between(*bounds)


# Violation of each row rule; a NULL result counts as passed.
CHECKS: dict[str, Callable[[DataFrame, Rule], Column]] = {
    "not_null": lambda df, r: reduce(lambda a, b: a | b, [missing(df, c) for c in r.targets]),
    "email": lambda df, r: ~exact(r.column).rlike(EMAIL_PATTERN),
    "phone": lambda df, r: ~phone_digits(exact(r.column)).rlike(PHONE_PATTERN),
    "range": _range,
    "length": _length,
    "regex": lambda df, r: ~exact(r.column).rlike(r.params["pattern"]),
    "enum": lambda df, r: ~exact(r.column).isin(list(r.params["values"])),
    "sql": lambda df, r: ~F.expr(r.params["expr"]),
    "cross_column": lambda df, r: ~F.expr(r.params["expr"]),
    "data_type": _data_type,
    "not_empty": lambda df, r: F.length(F.trim(exact(r.column))) == 0,
    "not_future": _not_future,
    "anomaly": _anomaly,
    "custom": lambda df, r: ~r.params["fn"](df),
}
TABLE_KINDS = ("unique", "foreign_key")


def _with_unique(df: DataFrame, r: Rule, name: str) -> DataFrame:
    """Flag every member of a duplicate group. Only keys seen twice are joined back, NULLs equal."""
    repeated = df.groupBy(*r.targets).agg(F.count("*").alias("_n")).filter("_n > 1")
    keys = repeated.select(*[exact(c).alias(f"_k_{c}") for c in r.targets], F.lit(True).alias(name))
    match = reduce(lambda a, b: a & b, [exact(c).eqNullSafe(exact(f"_k_{c}")) for c in r.targets])
    return df.join(keys, match, "left").drop(*[f"_k_{c}" for c in r.targets])


def _with_foreign_key(df: DataFrame, r: Rule, name: str) -> DataFrame:
    """Flag rows whose non-NULL key has no parent. ``keys`` maps child to parent columns."""
    keys = r.params["keys"]
    parent = r.params["parent"].select(*[F.col(p).alias(f"_p_{p}") for p in keys.values()]).distinct()
    found = parent.withColumn("_found", F.lit(True))
    match = reduce(lambda a, b: a & b, [exact(c) == exact(f"_p_{p}") for c, p in keys.items()])
    present = reduce(lambda a, b: a & b, [exact(c).isNotNull() for c in keys])
    joined = df.join(found, match, "left").withColumn(name, present & F.col("_found").isNull())
    return joined.drop("_found", *[f"_p_{p}" for p in keys.values()])


def ordered(rules: Sequence[Rule]) -> list[Rule]:
    """By priority, then by severity."""
    return sorted(rules, key=lambda r: (r.priority, SEVERITIES.index(r.severity.lower())))


def mark(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``_violations``: the ids of the rules the row breaks, in rule order."""
    rules = ordered(rules)
    ids = [r.id for r in rules]
    if len(set(ids)) != len(ids):
        raise ValueError("two rules have the same name")
    wide, flags = df, []
    for i, r in enumerate(rules):
        if r.kind in TABLE_KINDS:
            add = _with_unique if r.kind == "unique" else _with_foreign_key
            wide = add(wide, r, f"_broken_{i}")
            broken = F.col(f"_broken_{i}")
        elif r.kind in CHECKS:
            broken = CHECKS[r.kind](df, r)
        else:
            raise ValueError(f"{r.kind!r} is not a row rule")
        flags.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(r.id)))
    helpers = [f"_broken_{i}" for i, r in enumerate(rules) if r.kind in TABLE_KINDS]
    found = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    return wide.withColumn(VIOLATIONS, found).drop(*helpers)


def flag_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add violations, ``_quality_flags`` (text), ``_quality_score`` (100 - penalties) and ``_is_valid``."""

    def broken(r: Rule) -> Column:
        return F.array_contains(VIOLATIONS, r.id)

    marked = mark(df, rules)
    flags = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(broken(r), F.lit(r.flag)) for r in ordered(rules)]))
    score, valid = F.lit(100), F.lit(True)
    for r in rules:
        if r.kind in PENALTIES:
            score = score - F.when(broken(r), PENALTIES[r.kind]).otherwise(0)
        if r.severity.lower() in REJECTING_SEVERITIES:
            valid = valid & ~broken(r)
    out = marked.withColumns({"_quality_flags": F.array_join(flags, ","), "_quality_score": score, "_is_valid": valid})
    phones = {f"_{r.column}_cleaned": phone_digits(exact(r.column)) for r in rules if r.kind == "phone"}
    return out.withColumns(phones) if phones else out


def rule_report(flagged: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: processed, passed, failed, pass rate. One aggregate over the flagged rows."""
    entries = [
        F.struct(
            F.lit(r.id).alias("rule_id"),
            F.lit(r.kind).alias("rule_type"),
            F.lit(r.severity).alias("severity"),
            F.lit(r.action).alias("action"),
            F.count("*").alias("processed"),
            F.count_if(F.array_contains(VIOLATIONS, r.id)).alias("failed"),
        )
        for r in ordered(rules)
    ]
    rows = flagged.agg(F.array(*entries).alias("r")).select(F.inline("r"))
    rate = F.coalesce(F.try_divide((F.col("processed") - F.col("failed")) * F.lit(100.0), F.col("processed")), F.lit(100.0))
    return rows.withColumn("passed", F.col("processed") - F.col("failed")).withColumn("pass_rate", F.round(rate, 2))


@dataclass(frozen=True)
class Split:
    """Rows that passed, rows that did not, and the report per rule."""

    valid: DataFrame
    rejected: DataFrame
    report: DataFrame


def needs_shuffle(rules: Sequence[Rule]) -> bool:
    return any(r.kind in TABLE_KINDS for r in rules)


def apply_rules(df: DataFrame, rules: Sequence[Rule], write_once: bool | None = None) -> Split:
    """Split a table into valid and rejected rows and report per rule.

    Row rules are cheap to evaluate again for each output. With rules that shuffle, the flagged rows are
    written once to the shared folder and all three outputs read them.
    """
    flagged = flag_rows(df, rules)
    if needs_shuffle(rules) if write_once is None else write_once:
        flagged = stage(flagged, "flagged")
    return Split(flagged.filter("_is_valid"), flagged.filter("NOT _is_valid"), rule_report(flagged, rules))


def run_checks(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The report of the rules plus ``table_score``: % of rows that break no rule (100 for an empty table)."""
    marked = mark(df, rules).select(VIOLATIONS)  # the report needs nothing else
    if needs_shuffle(rules):
        marked = stage(marked, "marked")
    clean = F.count_if(F.size(VIOLATIONS) == 0) * F.lit(100.0)
    score = one_row(marked, s=F.round(F.coalesce(F.try_divide(clean, F.count("*")), F.lit(100.0)), 2))["s"]
    return rule_report(marked, rules).withColumn("table_score", score)


class BlockedTable(Exception):
    """A rule with the action ``block_table`` was broken."""


def enforce(df: DataFrame, rules: Sequence[Rule]) -> Split:
    """Act on violations: keep (log, warn, flag, alert), split off (quarantine, reject), fix, or block.

    ``auto_fix`` rules carry ``fix``, a column expression that replaces the value where the rule is broken;
    they run first and the fixed table is what the other rules see.
    """
    known = (*KEEP_ACTIONS, *SPLIT_ACTIONS, "block_table", "auto_fix")
    unknown = [r.action for r in rules if r.action not in known]
    if unknown:
        raise ValueError(f"unknown actions {unknown}")
    fixes = [r for r in ordered(rules) if r.action == "auto_fix"]
    for r in fixes:
        marked = mark(df, [r])
        fixed = F.when(F.array_contains(VIOLATIONS, r.id), r.params["fix"]).otherwise(exact(r.column))
        df = marked.withColumn(r.column, fixed).drop(VIOLATIONS)
    rest = [r for r in rules if r.action != "auto_fix"]
    flagged = mark(df, rest)
    if needs_shuffle(rest):
        flagged = stage(flagged, "flagged")
    blocking = [r.id for r in rest if r.action == "block_table"]
    if blocking:
        counts = flagged.agg(*[F.count_if(F.array_contains(VIOLATIONS, i)).alias(i) for i in blocking]).first()
        broken = {i: counts[i] for i in blocking if counts[i]}
        if broken:
            raise BlockedTable(f"rules broken: {broken}")
    splitting = [r.id for r in rest if r.action in SPLIT_ACTIONS]
    out = F.arrays_overlap(VIOLATIONS, F.array(*[F.lit(i) for i in splitting])) if splitting else F.lit(False)
    return Split(flagged.filter(~out), flagged.filter(out), rule_report(flagged, rest))


def cross_table(name: str, left: DataFrame, right: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row: two one-row aggregates (first column each), their difference, and whether they agree."""
    a, b = left.columns[0], right.columns[0]
    other = right.select(F.col(b).cast("double")).scalar()
    return left.select(
        F.lit(name).alias("rule_id"), F.col(a).cast("double").alias("left_value"), other.alias("right_value")
    ).withColumns(
        {
            "difference": F.abs(F.col("left_value") - F.col("right_value")),
            "passed": F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, F.lit(False)),
        }
    )


def drift(current: DataFrame, baseline: DataFrame, columns: Sequence[str], tolerance: float = 0.1) -> DataFrame:
    """Per column: mean and NULL share now and in the baseline, and whether either moved too far.

    The mean may change by ``tolerance`` of its baseline value, the NULL share by ``tolerance`` absolute.
    """

    def profile(df: DataFrame) -> list[Column]:
        return [
            F.struct(
                F.lit(c).alias("column_name"),
                F.avg(F.when(~missing(df, c), exact(c))).cast("double").alias("mean"),
                F.avg(missing(df, c).cast("double")).alias("null_share"),
            )
            for c in columns
        ]

    now = current.agg(F.array(*profile(current)).alias("p")).select(F.inline("p"))
    then = baseline.agg(F.array(*profile(baseline)).alias("p")).select(F.inline("p"))
    then = then.select("column_name", F.col("mean").alias("base_mean"), F.col("null_share").alias("base_null_share"))
    joined = now.join(then, "column_name")
    moved = F.abs(F.try_divide(F.col("mean") - F.col("base_mean"), F.col("base_mean")))
    holes = F.abs(F.col("null_share") - F.col("base_null_share"))
    return joined.withColumn("mean_change", moved).withColumn(
        "drifted", F.coalesce(moved > tolerance, F.lit(False)) | F.coalesce(holes > tolerance, F.lit(False))
    )


def contract_issues(df: DataFrame, expected: Mapping[str, str]) -> list[str]:
    """Messages for missing columns and for columns that should be numeric. Schema only, no data."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name, wanted in expected.items():
        if name not in kinds:
            out.append(f"Missing column: {name}")
        elif wanted == "numeric" and not isinstance(kinds[name], NUMERIC):
            out.append(f"Column '{name}' should be numeric.")
    return out


def contract_report(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row per broken expectation; it affects every row of the table."""
    issues = F.array(*[F.lit(i) for i in contract_issues(df, expected)]).cast("array<string>")
    return df.agg(F.count("*").alias("affected_rows")).select(F.explode(issues).alias("issue"), "affected_rows")


# Key prefixes, statuses and event types an asset row may have.
ASSET_PREFIXES = {"bronze_key": "bronze/", "silver_key": "silver/"}
ASSET_STATUSES = ["success", "failed", "pending"]
LINEAGE_EVENTS = ["bronze_ingested", "silver_processed", "silver_failed", "gold_promoted", "quality_check"]


def asset_rules() -> list[Rule]:
    """Constraints of the asset table."""
    prefixes = [
        rule("sql", column, name=f"{column}_prefix", expr=f"startswith({column}, '{prefix}')")
        for column, prefix in ASSET_PREFIXES.items()
    ]
    return [
        rule("not_null", "bronze_key", name="bronze_key_present"),
        *prefixes,
        rule(
            "sql",
            "silver_key",
            name="silver_key_on_success",
            expr="extraction_status IS DISTINCT FROM 'success' OR silver_key IS NOT NULL",
        ),
        rule("range", "confidence", name="confidence_range", min=0, max=1),
        rule("enum", "extraction_status", name="known_status", values=ASSET_STATUSES),
        rule("enum", "event_type", name="known_event", values=LINEAGE_EVENTS),
    ]


# The stock rule sets per domain.
FINANCE_COLUMNS = ["transaction_id", "customer_id", "amount"]
FINANCE_AMOUNT = (0, 1_000_000)
FINANCE_CURRENCIES = ["USD", "EUR", "GBP"]
FINANCE_MASKS = {"account_number": "hash", "customer_id": "hash"}
HEALTH_COLUMNS = ["patient_id", "admission_date"]
HEALTH_CODE = r"^[A-Z][0-9]{2}(\.[0-9]{1,2})?$"
HEALTH_MASKS = {"patient_id": "encrypt", "ssn": "encrypt", "medical_record_number": "encrypt"}


def domain_rules(domain: str) -> list[Rule]:
    """Stock rules for finance, healthcare or general tables."""
    if domain == "finance":
        return [
            *[rule("not_null", c) for c in FINANCE_COLUMNS],
            rule("range", "amount", min=FINANCE_AMOUNT[0], max=FINANCE_AMOUNT[1]),
            rule("enum", "currency", values=FINANCE_CURRENCIES),
        ]
    if domain == "healthcare":
        return [*[rule("not_null", c) for c in HEALTH_COLUMNS], rule("regex", "icd_code", pattern=HEALTH_CODE)]
    if domain == "general":
        return [rule("not_null", "id"), rule("unique", columns=["id"])]
    raise ValueError(f"unknown domain {domain!r}")
