"""Stock cleaning plans for user, transaction and customer tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from millrace.operators import columns
from millrace.operators.rules import Rule, Split, apply_rules, rule
from millrace.operators.windows import deduplicate

SCORE = "_quality_score"


@dataclass(frozen=True)
class CleaningPlan:
    """Rules, normalisation, casts and the key rows are made unique on."""

    rules: list[Rule]
    normalization: dict[str, dict[str, object]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    dedup: list[str] = field(default_factory=list)


# The three ready plans.
PLANS = {
    "user_data_cleaning": CleaningPlan(
        rules=[
            rule("not_null", "email", name="email_required"),
            rule("email", "email", name="email_valid"),
            rule("not_null", "name", name="name_required"),
            rule("phone", "phone", name="phone_valid", severity="warning"),
        ],
        normalization={
            "email": {"type": "lowercase", "trim": True},
            "name": {"type": "titlecase", "trim": True},
            "phone": {"type": "phone_format"},
        },
        dedup=["email"],
    ),
    "transaction_data_cleaning": CleaningPlan(
        rules=[
            rule("not_null", "amount", name="amount_required"),
            rule("range", "amount", name="amount_positive", min=0),
            rule("not_null", "transaction_id", name="transaction_id_required"),
        ],
        normalization={
            "amount": {"type": "round", "decimals": 2},
            "currency": {"type": "uppercase", "trim": True},
        },
        types={"amount": "double", "transaction_date": "timestamp"},
        dedup=["transaction_id"],
    ),
    "customer_data_enrichment": CleaningPlan(
        rules=[
            rule("not_null", "customer_id", name="customer_id_required"),
            rule("email", "email", name="email_valid", severity="warning"),
            rule("range", "age", name="age_range", severity="warning", min=18, max=120),
        ],
        normalization={
            "email": {"type": "lowercase", "trim": True},
            "first_name": {"type": "titlecase", "trim": True},
            "last_name": {"type": "titlecase", "trim": True},
            "country": {"type": "uppercase", "trim": True},
        },
        types={"age": "integer", "registration_date": "date"},
    ),
}


def run_plan(df: DataFrame, name: str, order_by: list[str]) -> Split:
    """Check, normalise, make unique (last row by ``order_by``) and cast; rejected rows keep their raw values."""
    plan = PLANS[name]
    split = apply_rules(df, [r for r in plan.rules if set(r.targets) <= set(df.columns)])
    clean = columns.normalize(split.valid, plan.normalization)
    if plan.dedup:
        clean = deduplicate(clean, plan.dedup, order_by, "last")
    return Split(columns.cast_types(clean, plan.types), split.rejected, split.report)
