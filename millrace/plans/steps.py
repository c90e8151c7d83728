"""Run an ordered list of ``{operation, params, enabled}`` steps as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from millrace.operators import aggregates, binning, cleaning, columns, encoding, features, joins, scaling, sets, windows

Tables = Mapping[str, DataFrame]


def _join(how: str) -> Callable[..., DataFrame]:
    def run(df: DataFrame, tables: Tables, right: str, on: str | Sequence[str]) -> DataFrame:
        return joins.join_tables(df, tables[right], on, how)

    return run


def _union(df: DataFrame, tables: Tables, others: str | Sequence[str], by: str = "position") -> DataFrame:
    names = [others] if isinstance(others, str) else others
    return sets.union_tables(df, [tables[n] for n in names], by)


def _lookup(df: DataFrame, tables: Tables, table: str, key: str, columns: Sequence[str]) -> DataFrame:
    return joins.lookup(df, tables[table], key, columns)


def _hierarchy(df: DataFrame, tables: Tables, column: str, level: str, mapping: str) -> DataFrame:
    return features.hierarchy_rollup(df, column, level, tables[mapping])


def _filter(df: DataFrame, condition: str) -> DataFrame:
    return columns.filter_expr(df, condition)


# Operations over the table alone.
OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "filter": _filter,
    "select": columns.select_columns,
    "custom_sql": columns.apply_sql,
    "trim_strings": columns.trim_strings,
    "cast_types": columns.cast_types,
    "normalize_columns": columns.normalize,
    "remove_nulls": cleaning.remove_nulls,
    "fill_nulls": cleaning.fill_nulls,
    "remove_duplicates": cleaning.remove_duplicates,
    "remove_outliers": cleaning.remove_outliers,
    "fix_typos": cleaning.fix_typos,
    "minmax_scale": scaling.minmax_scale,
    "zscore_normalize": scaling.zscore_normalize,
    "robust_scale": scaling.robust_scale,
    "maxabs_scale": scaling.maxabs_scale,
    "unit_vector": scaling.unit_vector,
    "one_hot": encoding.one_hot,
    "label_encode": encoding.label_encode,
    "binary_encode": encoding.binary_encode,
    "target_encode": encoding.target_encode,
    "frequency_encode": encoding.frequency_encode,
    "group_sum": aggregates.group_sum,
    "group_avg": aggregates.group_avg,
    "group_count": aggregates.group_count,
    "group_min_max": aggregates.group_min_max,
    "rolling_agg": windows.rolling_agg,
    "equal_width_bin": binning.equal_width_bin,
    "equal_freq_bin": binning.equal_freq_bin,
    "custom_bin": binning.custom_bin,
    "quantile_bin": binning.quantile_bin,
    "extract_datetime": features.extract_datetime,
    "calculate_age": features.calculate_age,
    "combine_features": features.combine_features,
    "polynomial_features": features.polynomial_features,
    "interaction_features": features.interaction_features,
    "split_column": features.split_column,
    "extract_regex": features.extract_regex,
    "parse_json": features.parse_json,
    "parse_url": features.parse_url,
    "log_transform": features.log_transform,
    "sqrt_transform": features.sqrt_transform,
    "power_transform": features.power_transform,
    "reciprocal": features.reciprocal,
    "box_cox": features.box_cox,
    "categorize": features.categorize,
    "round_values": features.round_values,
    "pivot_wide": features.pivot_wide,
    "melt_long": features.melt_long,
}
# Operations that read a second table, named in their parameters.
TABLE_OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "join_inner": _join("inner"),
    "join_left": _join("left"),
    "join_right": _join("right"),
    "join_outer": _join("outer"),
    "union": _union,
    "lookup": _lookup,
    "hierarchy_rollup": _hierarchy,
}
ALIASES = {
    "normalize": "minmax_scale",
    "standardize": "zscore_normalize",
    "drop_duplicates": "remove_duplicates",
    "fill_null": "fill_nulls",
}


def run_steps(
    df: DataFrame,
    steps: Sequence[Mapping[str, Any]],
    tables: Tables | None = None,
    on_error: str = "raise",
) -> DataFrame:
    """Apply the enabled steps in order. Nothing is counted or written between steps.

    ``on_error="skip"`` leaves out a step that cannot be planned; unknown operations are errors too.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be 'raise' or 'skip'")
    for step in steps:
        if not step.get("enabled", True):
            continue
        name = ALIASES.get(step["operation"], step["operation"])
        params = dict(step.get("params") or {})
        try:
            if name in OPERATIONS:
                df = OPERATIONS[name](df, **params)
            elif name in TABLE_OPERATIONS:
                df = TABLE_OPERATIONS[name](df, tables or {}, **params)
            else:
                raise ValueError(f"unknown operation {name!r}")
        except Exception:
            if on_error == "raise":
                raise
    return df


def step_metrics(before: DataFrame, after: DataFrame, steps: Sequence[Mapping[str, Any]]) -> DataFrame:
    """One row: input rows, output rows, output columns, steps that ran."""
    total = after.agg(F.count("*").alias("n")).scalar()
    ran = len([s for s in steps if s.get("enabled", True)])
    return before.agg(F.count("*").alias("input_rows")).select(
        "input_rows", total.alias("output_rows"), F.lit(len(after.columns)).alias("output_columns"), F.lit(ran).alias("steps_run")
    )
