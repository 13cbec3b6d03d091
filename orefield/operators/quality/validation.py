"""Running suites and checkpoints, and gates that raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.functions import percent
from orefield.operators.quality.rules import FAILS, Rule, evaluate
from orefield.operators.quality.suites import (
    ASSETS,
    MODEL_TO_SUITE_NAMES,
    SUITES,
    suites_in_scope,
)

SHOWN_FAILURES = 5


class ValidationError(Exception):
    """A gate did not hold."""


def run_suite(df: DataFrame, suite: str, rules: list[Rule] | None = None) -> DataFrame:
    results = evaluate(df, rules if rules is not None else SUITES[suite])
    return results.select(F.lit(suite).alias("suite"), "*")


def with_suite_names(df: DataFrame, suite: str) -> DataFrame:
    return df.withColumnsRenamed(MODEL_TO_SUITE_NAMES.get(suite, {}))


def summarise(results: DataFrame) -> DataFrame:
    """One row per suite: evaluated, successful, unsuccessful rules and success percent."""
    ok = F.count_if("success")
    total = F.count("*")
    return results.groupBy("suite").agg(
        total.alias("evaluated"),
        ok.alias("successful"),
        (total - ok).alias("unsuccessful"),
        percent(ok, total, empty=0).cast("decimal(5,2)").alias("success_percent"),
        (ok == total).alias("success"),
    )


def run_checkpoint(assets: dict[str, DataFrame], scope: str = "full", renamed: bool = True) -> DataFrame:
    """Rule results of every suite in scope; ``assets`` maps table name to DataFrame."""
    parts = []
    for suite in suites_in_scope(scope):
        df = assets[ASSETS[suite]]
        parts.append(run_suite(with_suite_names(df, suite) if renamed else df, suite))
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    return results


def require_success(results: DataFrame) -> None:
    """Raise with the first few failed rules; the failures are counted on the cluster."""
    failed = results.where(~F.col("success"))
    total = failed.count()
    if not total:
        return
    shown = failed.orderBy("suite", "rule_no").limit(SHOWN_FAILURES).collect()
    names = ", ".join(f"{r['suite']}: {r['rule']}({r['column_name'] or ''})" for r in shown)
    more = f" and {total - len(shown)} more" if total > len(shown) else ""
    raise ValidationError(f"{total} rules failed: {names}{more}")


def run_scalar_checks(
    checks: DataFrame, min_threshold: float | None = None, max_threshold: float | None = None
) -> DataFrame:
    """Turn a one-row frame of named scalars into one pass/fail row each.

    A null fails; without thresholds a zero fails; otherwise the value must lie within them.
    """
    value = F.col("v.value")
    if min_threshold is None and max_threshold is None:
        ok = value != 0
    else:
        ok = F.lit(True)
        if min_threshold is not None:
            ok = ok & (value >= min_threshold)
        if max_threshold is not None:
            ok = ok & (value <= max_threshold)
    named = [
        F.struct(F.lit(c).alias("check_name"), F.col(c).cast("double").alias("value"))
        for c in checks.columns
    ]
    return checks.select(F.explode(F.array(*named)).alias("v")).select(
        "v.check_name", "v.value", F.coalesce(ok, F.lit(False)).alias("passed")
    )


def require_checks(outcome: DataFrame) -> None:
    rows = outcome.collect()
    failed = [r["check_name"] for r in rows if not r["passed"]]
    if failed:
        raise ValidationError(f"checks failed ({len(failed)}/{len(rows)}): {', '.join(failed)}")


def mark_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add broken_rules: the row-level rules each row does not meet."""
    broken = []
    for r in rules:
        c = F.col(r.column)
        if r.kind == "not_null":
            fails = c.isNull()
        elif r.kind in FAILS:
            fails = c.isNotNull() & F.coalesce(FAILS[r.kind](c, r.args), F.lit(False))
        else:
            raise ValueError(f"{r.kind} does not judge single rows")
        broken.append(F.when(fails, F.lit(f"{r.kind}:{r.column}")))
    return df.withColumn("broken_rules", F.array_compact(F.array(*broken)))
