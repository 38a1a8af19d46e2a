"""Batch deltas, running totals and limit crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugebook.functions.identity import arrival_of, position_of
from gaugebook.operators.dedup import ACCEPT, DUPLICATE
from gaugebook.operators.prefix import running_total
from gaugebook.schemas import CONFLICT, MIXED_IDENTITY, TOTAL, VALUE_CONFLICT


def batch_deltas(verdicts: DataFrame) -> DataFrame:
    """AG-1 / AG-2 / AG-3 per arrival: what landed, what was a duplicate, conflicts."""
    accepted = F.col("verdict") == ACCEPT
    arrival = arrival_of(F.col("ord")).alias("arrival_seq")
    # Positions run 0..n-1, so a second arrival under the same number shows up as
    # more readings than positions; going on would count its readings twice.
    n, top = F.count("*"), F.max(position_of(F.col("ord")))
    submitted = F.when(n == top + 1, n).otherwise(
        F.raise_error(F.lit("arrival_seq is not unique")).cast("bigint")
    )
    counted = verdicts.groupBy(arrival).agg(
        submitted.cast("int").alias("readings_submitted"),
        F.count_if(accepted).cast("int").alias("readings_accepted"),
        F.count_if(F.col("verdict") == DUPLICATE).cast("int").alias("readings_duplicate"),
        F.coalesce(F.sum(F.when(accepted, F.col("ch4_kg"))), F.lit(0)).cast(TOTAL)
        .alias("accepted_ch4_kg"),
        F.min(F.when(accepted, F.col("reading_ts"))).alias("first_ts"),
        F.max(F.when(accepted, F.col("reading_ts"))).alias("last_ts"),
    )
    return counted.join(conflict_lists(verdicts), "arrival_seq", "left").withColumn(
        "conflicts",
        F.coalesce("conflicts", F.array().cast(f"array<{CONFLICT.simpleString()}>")),
    )


def conflict_rows(verdicts: DataFrame) -> DataFrame:
    """Withheld readings, one row each."""
    return verdicts.filter(F.col("verdict").isin(MIXED_IDENTITY, VALUE_CONFLICT)).select(
        arrival_of(F.col("ord")).alias("arrival_seq"),
        position_of(F.col("ord")).alias("pos"),
        F.col("verdict").alias("reason"),
        "reading_id",
        "device_id",
        "reading_ts",
        F.col("ch4_kg").alias("submitted_kg"),
        "stored_kg",
    )


def conflict_lists(verdicts: DataFrame) -> DataFrame:
    """AG-3: the conflicts of an arrival as one list (at most 100 entries).

    Order: scheme clashes, then by reading id, then by instant; input order inside.
    Kept apart from the counts, which then stay a plain hash aggregation.
    """
    kind = (
        F.when(F.col("reason") == MIXED_IDENTITY, 0)
        .when(F.col("reading_id").isNotNull(), 1)
        .otherwise(2)
    )
    entry = F.struct("reason", "device_id", "reading_ts", "submitted_kg", "stored_kg")
    ranked = conflict_rows(verdicts).select(
        "arrival_seq", F.struct(kind.alias("kind"), "pos", entry.alias("entry")).alias("ranked")
    )
    return ranked.groupBy("arrival_seq").agg(
        F.expr("transform(array_sort(collect_list(ranked)), x -> x.entry)")
        .cast(f"array<{CONFLICT.simpleString()}>")
        .alias("conflicts")
    )


def totals_after(batches: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """WN-3: `total_before` and `total_kg` of the site around each claimed batch.

    `batches`: site_id, arrival_seq, accepted_ch4_kg, ...; `opening`: site_id and
    the site's total before the epoch. `batches` is read twice, so stage what is costly.
    """
    running = running_total(batches, "site_id", "arrival_seq", "accepted_ch4_kg", "_moved")
    if opening is None:
        running = running.withColumn("_opening", F.lit(0).cast(TOTAL))
    else:
        running = running.join(
            opening.select("site_id", F.col("total_kg").alias("_opening")), "site_id", "left"
        )
    total = (F.coalesce("_opening", F.lit(0)) + F.col("_moved")).cast(TOTAL)
    return (
        running.withColumn("total_kg", total)
        .withColumn("total_before", (F.col("total_kg") - F.col("accepted_ch4_kg")).cast(TOTAL))
        .drop("_moved", "_opening")
    )


def crossings(batches: DataFrame) -> DataFrame:
    """WN-4: the batch that took a site over its limit; totals never fall, so at
    most one per site. Needs total_before, total_kg, emission_limit_kg."""
    limit = F.col("emission_limit_kg")
    return batches.filter((F.col("total_before") <= limit) & (F.col("total_kg") > limit))


def site_deltas(batches: DataFrame) -> DataFrame:
    """AG-4: one row per site touched; every claimed batch counts as a version."""
    return batches.groupBy("site_id").agg(
        F.sum("accepted_ch4_kg").alias("moved_kg"),
        F.sum("readings_accepted").alias("moved_count"),
        F.count("*").cast("int").alias("moved_version"),
        F.min("first_ts").alias("moved_first"),
        F.max("last_ts").alias("moved_last"),
    )


def advance_summary(previous: DataFrame, deltas: DataFrame, as_of) -> DataFrame:
    """SNK-3: the next snapshot. Spans only widen; sites not touched are carried over."""
    touched = F.col("moved_version").isNotNull()
    return previous.join(deltas, "site_id", "full_outer").select(
        "site_id",
        (F.coalesce("total_kg", F.lit(0)) + F.coalesce("moved_kg", F.lit(0))).cast(TOTAL)
        .alias("total_kg"),
        (F.coalesce("measurement_count", F.lit(0)) + F.coalesce("moved_count", F.lit(0)))
        .cast("bigint").alias("measurement_count"),
        (F.coalesce("version", F.lit(0)) + F.coalesce("moved_version", F.lit(0)))
        .cast("int").alias("version"),
        F.least("first_reading_at", "moved_first").alias("first_reading_at"),
        F.greatest("last_reading_at", "moved_last").alias("last_reading_at"),
        F.when(touched, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )
