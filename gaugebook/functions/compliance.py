"""Expressions over a site's total and its limit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugebook.schemas import LIMIT_EXCEEDED, TOTAL, WITHIN_LIMIT


def compliance_status(total: Column, limit: Column) -> Column:
    """Exceeded only strictly above the limit."""
    return F.when(total > limit, LIMIT_EXCEEDED).otherwise(WITHIN_LIMIT)


def utilization_pct(total: Column, limit: Column) -> Column:
    # The limit has scale 3 and the quotient keeps at least 6 digits, so one
    # rounding to two places is the only one that happens.
    return F.round(total.cast(TOTAL) * 100 / limit, 2).cast("decimal(18,2)")


def utilization_band(total: Column, limit: Column) -> Column:
    """`over` follows the status, so a site exactly at its limit is only `warn`."""
    pct = F.when(limit == 0, F.lit(0)).otherwise(
        F.try_divide(total.cast(TOTAL) * 100, limit)
    )
    return (
        F.when(compliance_status(total, limit) == LIMIT_EXCEEDED, "over")
        .when(pct >= 80, "warn")
        .otherwise("ok")
    )


def operator_name(metadata: Column) -> Column:
    """metadata.operator when it is a JSON string, else NULL."""
    value = F.try_variant_get(F.try_parse_json(metadata), "$.operator", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def total_verdict(stored: Column, actual: Column) -> Column:
    return (
        F.when(stored > actual, "double counted")
        .when(stored < actual, "update lost")
        .otherwise("ok")
    )


def span_verdict(
    stored_first: Column, stored_last: Column, first_at: Column, last_at: Column
) -> Column:
    empty = first_at.isNull()
    return (
        F.when(empty & (stored_first.isNotNull() | stored_last.isNotNull()), "span without readings")
        .when(~empty & ~stored_first.eqNullSafe(first_at), "first reading differs")
        .when(~empty & ~stored_last.eqNullSafe(last_at), "last reading differs")
        .otherwise("ok")
    )
