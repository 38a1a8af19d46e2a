"""Read-side reports: functions of tables, so they run on a store or on any frames
of the same shape."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugebook.functions.compliance import (
    compliance_status,
    operator_name,
    utilization_band,
    utilization_pct,
)
from gaugebook.functions.values import mass_text
from gaugebook.schemas import (
    DEFAULT_PAGE_SIZE,
    EXCEEDED_EVENT,
    MAX_PAGE_SIZE,
    TOTAL,
)


def site_view(sites: DataFrame, summary: DataFrame) -> DataFrame:
    """PRJ-10: every site with its running figures and status."""
    figures = summary.select(
        F.col("site_id").alias("id"),
        "total_kg", "measurement_count", "version",
        "first_reading_at", "last_reading_at", "updated_at",
    )
    zero = F.lit(0)
    return (
        sites.select("id", "name", "emission_limit_kg", "metadata", "created_at")
        .join(figures, "id", "left")
        .withColumns(
            {
                "total_kg": F.coalesce("total_kg", zero).cast(TOTAL),
                "measurement_count": F.coalesce("measurement_count", zero).cast("bigint"),
                "version": F.coalesce("version", zero),
                "updated_at": F.coalesce("updated_at", "created_at"),
            }
        )
        .withColumn("compliance_status", compliance_status(F.col("total_kg"), F.col("emission_limit_kg")))
    )


def months_between(first: datetime, last: datetime) -> list[str]:
    """Month partitions a closed window touches."""
    months, year, month = [], first.year, first.month
    while (year, month) <= (last.year, last.month):
        months.append(f"{year:04d}-{month:02d}")
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return months


def recent_mass(measurements: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """FLT-8 / AG-5: mass per site in the closed window ending at `as_of`.

    Both bounds matter: a device with a fast clock must not count as recent. The
    month predicate prunes partitions, the time predicate prunes row groups.
    """
    since = as_of - timedelta(hours=hours)
    window = measurements.filter(
        F.col("month").isin(months_between(since, as_of))
        & F.col("reading_ts").between(F.lit(since), F.lit(as_of))
    )
    return window.groupBy("site_id").agg(F.sum("ch4_kg").cast(TOTAL).alias("last_24h_kg"))


def site_metrics(
    sites: DataFrame, summary: DataFrame, measurements: DataFrame, as_of: datetime
) -> DataFrame:
    """REP-1: the compliance summary of all sites in one job."""
    recent = recent_mass(measurements, as_of).withColumnRenamed("site_id", "id")
    return (
        site_view(sites, summary)
        .join(recent, "id", "left")
        .select(
            "id",
            "name",
            "emission_limit_kg",
            "total_kg",
            "measurement_count",
            "compliance_status",
            utilization_pct(F.col("total_kg"), F.col("emission_limit_kg")).alias("utilization_pct"),
            F.coalesce("last_24h_kg", F.lit(0)).cast(TOTAL).alias("last_24h_kg"),
            "first_reading_at",
            "last_reading_at",
        )
    )


def site_listing(sites: DataFrame, summary: DataFrame) -> DataFrame:
    """REP-8: the dashboard's table, in (name, id) order."""
    total, limit = F.col("total_kg"), F.col("emission_limit_kg")
    return (
        site_view(sites, summary)
        .select(
            "id",
            "name",
            operator_name(F.col("metadata")).alias("operator"),
            "total_kg",
            "emission_limit_kg",
            utilization_pct(total, limit).alias("utilization_pct"),
            utilization_band(total, limit).alias("band"),
            "measurement_count",
            "compliance_status",
        )
        .orderBy("name", "id")
    )


def site_page(
    sites: DataFrame,
    summary: DataFrame,
    after: tuple[str, str] | None = None,
    limit: int = DEFAULT_PAGE_SIZE,
) -> tuple[list, tuple[str, str] | None]:
    """ORD-2: one page in (name, id) order and the key to continue from, if any."""
    rows = page_rows(site_view(sites, summary), after, limit).collect()
    more = len(rows) > limit
    page = rows[:limit]
    return page, ((page[-1].name, page[-1].id) if more else None)


def page_rows(
    sites: DataFrame, after: tuple[str, str] | None = None, limit: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """FLT-10 / ORD-2: `limit` rows after a key, plus one to learn if more exist."""
    if not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE_SIZE}")
    if after is not None:
        name, id_ = after
        sites = sites.filter(
            F.struct("name", "id") > F.struct(F.lit(name).alias("name"), F.lit(id_).alias("id"))
        )
    return sites.orderBy("name", "id").limit(limit + 1)


def one_site(view: DataFrame, site_id: str) -> DataFrame:
    """FLT-9: a site by id; no row when it does not exist."""
    return view.filter(F.col("id") == site_id)


def responses(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """STR-8 / JN-3: what each accepted or repeated arrival was answered.

    The stored response is read back, never recomputed, so a replay equals the
    original but for its flag.
    """
    stored = ledger.select(F.col("id").alias("batch_id"), "response")
    r = F.col("response")
    return (
        results.select("arrival_seq", "api_version", "batch_id", "idempotent_replay")
        .join(stored, "batch_id")
        .select(
            "arrival_seq",
            "api_version",
            "batch_id",
            r["site_id"].alias("site_id"),
            r["readings_submitted"].alias("readings_submitted"),
            r["readings_accepted"].alias("readings_accepted"),
            r["accepted_ch4_kg"].alias("accepted_ch4_kg"),
            r["total_kg"].alias("total_kg"),
            r["compliance_status"].alias("compliance_status"),
            "idempotent_replay",
            r["conflicts"].alias("conflicts"),
        )
    )


def response_text(rows: DataFrame) -> DataFrame:
    """The wire spelling of `responses`: decimals as text, instants as ISO-8601."""
    return rows.select(
        F.col("arrival_seq"),
        F.to_json(
            F.struct(
                F.col("batch_id").alias("batchId"),
                F.col("site_id").alias("siteId"),
                F.col("readings_submitted").alias("readingsSubmitted"),
                F.col("readings_accepted").alias("readingsAccepted"),
                mass_text(F.col("accepted_ch4_kg")).alias("acceptedCh4Kg"),
                F.col("total_kg").cast("string").alias("totalEmissionsToDateKg"),
                F.col("compliance_status").alias("complianceStatus"),
                F.col("idempotent_replay").alias("idempotentReplay"),
                F.expr(
                    "transform(conflicts, c -> named_struct('reason', c.reason, "
                    "'deviceId', c.device_id, "
                    "'readingTs', date_format(c.reading_ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), "
                    "'submittedCh4Kg', CAST(c.submitted_kg AS string), "
                    "'storedCh4Kg', CAST(c.stored_kg AS string)))"
                ).alias("conflicts"),
            )
        ).alias("response"),
    )


def conflicts_view(ledger: DataFrame) -> DataFrame:
    """Stored conflicts, one row each, in the order they were reported."""
    return ledger.select(
        "arrival_seq", F.posexplode(F.col("response.conflicts")).alias("pos", "c")
    ).select("arrival_seq", "pos", "c.*")


def latest_batches(ledger: DataFrame, n: int = 5) -> DataFrame:
    """ORD-4: newest batches, submitted against accepted."""
    return (
        ledger.orderBy(F.desc("created_at"), F.desc("arrival_seq"))
        .limit(n)
        .select(
            "arrival_seq", "idempotency_key", "status",
            "readings_submitted", "readings_accepted", "accepted_ch4_kg",
        )
    )


def outcome_tally(results: DataFrame, rejects: DataFrame) -> DataFrame:
    """AG-11: arrivals by (api_version, outcome), rejections by their code too."""
    outcome = F.when(F.col("idempotent_replay"), "replayed").otherwise("accepted")
    return (
        results.select("api_version", outcome.alias("outcome"))
        .unionByName(rejects.select("api_version", F.col("code").alias("outcome")))
        .groupBy("api_version", "outcome")
        .agg(F.count("*").alias("batches"))
    )


def duplicate_tally(results: DataFrame, rejects: DataFrame, ledger: DataFrame) -> DataFrame:
    """AG-10: what was recognised as a repeat, by the rule that caught it.

    A conflict counts under its own reason whether it was found by reading id or
    by instant; the rest of the gap between submitted and accepted are duplicates.
    """
    def conflicts_of(reason: str) -> Column:
        return F.expr(f"size(filter(response.conflicts, c -> c.reason = '{reason}'))")

    gap = F.col("readings_submitted") - F.col("readings_accepted")
    per_batch = ledger.select(
        F.explode(
            F.create_map(
                F.lit("duplicate_reading"), gap - F.size("response.conflicts"),
                F.lit("value_conflict"), conflicts_of("value_conflict"),
                F.lit("mixed_identity"), conflicts_of("mixed_identity"),
            )
        ).alias("reason", "n")
    )
    per_request = results.filter("idempotent_replay").select(
        F.lit("idempotent_replay").alias("reason"), F.lit(1).alias("n")
    ).unionByName(
        rejects.filter("code = 'IDEMPOTENCY_KEY_REUSED'").select(
            F.lit("key_reused").alias("reason"), F.lit(1).alias("n")
        )
    )
    return (
        per_batch.unionByName(per_request)
        .groupBy("reason")
        .agg(F.sum("n").alias("n"))
        .filter("n > 0")
    )


def activity(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """AG-12: rows persisted and limit crossings."""
    return ledger.agg(F.sum("readings_accepted").alias("readings_persisted")).crossJoin(
        # One row each side.
        events.agg(F.count_if(F.col("event_type") == EXCEEDED_EVENT).alias("limit_crossings"))
    )
