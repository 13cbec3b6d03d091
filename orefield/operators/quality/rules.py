"""Rules and their compilation to aggregate columns.

A column rule contributes counters to a single ``agg`` over the table, so a suite costs one scan
whatever its length. A uniqueness rule adds one grouped count over its own column, over hashes where
values are wide: the map-side combine sends each value once per task, which also holds for a value that
fills a third of a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefield.functions import percent
from orefield.sources.schemas import portable_type

# Fixed value: currency codes accepted where a rule names none.
CURRENCY_CODES = ["USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD"]


#: Types whose values may be much longer than a hash of them. Maps have no hash, and cannot be grouped either.
WIDE = (T.StringType, T.BinaryType, T.StructType, T.ArrayType)


@dataclass(frozen=True)
class Rule:
    kind: str
    column: str | None = None
    mostly: float = 1.0
    args: dict = field(default_factory=dict)


def rule(kind: str, column: str | None = None, mostly: float = 1.0, **args) -> Rule:
    return Rule(kind, column, mostly, args)


# Column rules: name -> function giving the condition under which a non-null value fails.
FAILS: dict[str, Callable[[Column, dict], Column]] = {}


def column_rule(name: str):
    def register(fn):
        FAILS[name] = fn
        return fn

    return register


@column_rule("between")
def _between(c, args):
    low, high = args.get("min"), args.get("max")
    fails = F.lit(False)
    if low is not None:
        fails = fails | (c <= low if args.get("strict_min") else c < low)
    if high is not None:
        fails = fails | (c >= high if args.get("strict_max") else c > high)
    return fails


@column_rule("in_set")
def _in_set(c, args):
    return ~c.isin(list(args["values"]))


@column_rule("matches")
def _matches(c, args):
    return ~c.cast("string").rlike(args["regex"])


@column_rule("length_between")
def _length_between(c, args):
    return _between(F.char_length(c.cast("string")), args)


@column_rule("currency_code")
def _currency_code(c, args):
    return ~F.upper(c).isin(list(args.get("codes") or CURRENCY_CODES))


@column_rule("positive_amount")
def _positive_amount(c, args):
    amount = c.cast("string").try_cast("double")
    bad = amount <= 0 if args.get("strictly_positive", True) else amount < 0
    return F.coalesce(bad, F.lit(True))


@column_rule("recent")
def _recent(c, args):
    days = args.get("max_age_days", 7)
    if days <= 0:
        raise ValueError("max_age_days must be positive")
    oldest = F.lit(args["as_of"]).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    moment = c.cast("string").try_cast("timestamp").cast("timestamp_ntz")
    return F.coalesce(moment < oldest, F.lit(True))


SCHEMA_RULES = {"exists", "column_set", "column_list", "of_type"}


def schema_rule_holds(df: DataFrame, r: Rule) -> bool:
    """Rules the plan alone answers; no row is read."""
    if r.kind == "exists":
        return r.column in df.columns
    if r.kind == "column_set":
        missing = set(r.args["columns"]) - set(df.columns)
        extra = set(df.columns) - set(r.args["columns"])
        return not missing and not (extra and r.args.get("exact", True))
    if r.kind == "column_list":
        return list(r.args["columns"]) == df.columns
    if r.column not in df.columns:
        return False
    dtype = df.schema[r.column].dataType
    if r.args["type"] == "timestamp":  # a date is no timestamp
        return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))
    return portable_type(dtype) == r.args["type"]


def _needed(r: Rule) -> list[str]:
    if r.kind == "pair_at_least":
        return [r.column, r.args["other"]]
    return [r.column] if r.column else []


def _counters(df: DataFrame, r: Rule, i: int) -> list[Column]:
    """evaluated (non-null) and unexpected row counts of a rule."""
    if r.kind == "not_null":
        return [F.count("*").alias(f"e{i}"), F.count_if(F.col(r.column).isNull()).alias(f"u{i}")]
    if r.kind == "pair_at_least":
        a, b = F.col(r.column), F.col(r.args["other"])
        fails = a < b if r.args.get("or_equal") else a <= b
        both = a.isNotNull() & b.isNotNull()
        return [F.count_if(both).alias(f"e{i}"), F.count_if(fails).alias(f"u{i}")]
    c = F.col(r.column)
    if r.kind == "unique":
        return [F.count(c).alias(f"e{i}")]
    fails = FAILS[r.kind](c, r.args)
    return [F.count(c).alias(f"e{i}"), F.count_if(c.isNotNull() & fails).alias(f"u{i}")]


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Rows that share their value with another row: every member of a group counts.

    Wide values (text, binary, structs) are not shuffled whole: their 64-bit hashes are counted first, and
    only values whose hash came twice are compared as they are. The join with those hashes is an inner
    one, which AQE splits on a busy value.
    """
    own = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    if isinstance(df.schema[column].dataType, WIDE):
        hashed = own.withColumn("h", F.xxhash64("v"))
        twice = hashed.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
        own = hashed.join(twice, "h").select("v")
    groups = own.groupBy("v").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("u"))


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule: kind, column, success, element, unexpected count and percent."""
    counters = [F.count("*").alias("row_count")]
    for i, r in enumerate(rules):
        if _counted(df, r):
            counters += _counters(df, r, i)
    totals = df.agg(*counters)
    derived = {}
    for i, r in enumerate(rules):
        if r.kind == "unique" and r.column in df.columns:
            derived[f"u{i}"] = repeated_values(df, r.column).scalar()
        elif r.kind == "row_count":
            derived[f"ok{i}"] = ~_between(F.col("row_count"), r.args)
    if derived:
        totals = totals.withColumns(derived)
    found = F.expr(f"explode(array({', '.join(_finding(df, r, i) for i, r in enumerate(rules))}))")
    kept = F.try_divide(
        (F.col("evaluated") - F.col("unexpected_count")).cast("double"),
        F.col("evaluated").cast("double"),
    )
    success = (
        F.when(F.col("settled").isNotNull(), F.col("settled"))
        .when(F.col("mostly") >= 1, F.col("unexpected_count") == 0)
        .otherwise(F.coalesce(kept >= F.col("mostly"), F.lit(True)))
    )
    return (
        totals.select(found.alias("r"))
        .select("r.*")
        .select(
            "rule_no",
            "rule",
            "column_name",
            success.alias("success"),
            "element_count",
            "unexpected_count",
            percent(F.col("unexpected_count"), F.col("evaluated"), digits=None).alias(
                "unexpected_percent"
            ),
        )
    )


def _counted(df: DataFrame, r: Rule) -> bool:
    """Whether the rule needs counters and all its columns are there."""
    if r.kind in SCHEMA_RULES or r.kind == "row_count":
        return False
    return all(c in df.columns for c in _needed(r))


def _finding(df: DataFrame, r: Rule, i: int) -> str:
    """A rule's counts as one SQL struct; ``settled`` where no count decides the outcome."""
    element = evaluated = unexpected = "CAST(NULL AS BIGINT)"
    settled = "CAST(NULL AS BOOLEAN)"
    if r.kind in SCHEMA_RULES:
        settled = str(schema_rule_holds(df, r)).lower()
    elif r.kind == "row_count":
        element, settled = "row_count", f"ok{i}"
    elif _counted(df, r):
        element, evaluated, unexpected = "row_count", f"e{i}", f"u{i}"
    else:
        settled = "false"
    column = "CAST(NULL AS STRING)" if r.column is None else _quoted(r.column)
    return (
        f"named_struct('rule_no', {i + 1}, 'rule', {_quoted(r.kind)}, 'column_name', {column}, "
        f"'settled', {settled}, 'element_count', {element}, 'evaluated', {evaluated}, "
        f"'unexpected_count', {unexpected}, 'mostly', {float(r.mostly)}D)"
    )


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
