"""Alert events and the state of their delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugebook.functions.values import derived_uuid, mass_text
from gaugebook.operators.totals import crossings
from gaugebook.schemas import (
    DELIVERY_BATCH,
    DELIVERY_LEASE_SECONDS,
    DELIVERY_MAX_ATTEMPTS,
    EVENT_POSITION_BITS,
    EXCEEDED_EVENT,
    INGESTED_EVENT,
    LAST_ERROR_CHARS,
    LIMIT,
)
from gaugebook.session import stage

# Bits of a row in Spark's monotonically increasing ids.
_ROW_BITS = 33


#: What the payloads are made of.
_TOLD = [
    "site_id", "idempotency_key", "api_version", "readings_accepted", "accepted_ch4_kg", "total_kg",
]


def event_seeds(batches: DataFrame) -> DataFrame:
    """STR-5 / STR-6: a narrow row per event to be: one per claimed batch, one more on the
    crossing batch.

    `id` follows arrival order; within a batch the crossing comes second. It is an order
    inside the epoch only: see `numbered`.
    """

    def seed(source: DataFrame, offset: int, name: Column, limit: Column) -> DataFrame:
        return source.select(
            (F.col("arrival_seq") * 2 + offset).alias("id"), F.lit(offset == 1).alias("crossing"),
            name.alias("site_name"), limit.alias("emission_limit_kg"), *_TOLD)

    none = F.lit(None)
    return seed(batches, 0, none.cast("string"), none.cast(LIMIT)).unionByName(
        seed(crossings(batches), 1, F.col("site_name"), F.col("emission_limit_kg")))


def event_rows(seeds: DataFrame, as_of: Column) -> DataFrame:
    """The events of `event_seeds`, in full, next to the other columns of the rows."""
    total = F.col("total_kg").cast("string")
    batch_id = derived_uuid(F.col("site_id"), F.col("idempotency_key"))
    ingested = F.struct(
        batch_id.alias("batchId"),
        F.col("site_id").alias("siteId"),
        F.col("readings_accepted").alias("readingsAccepted"),
        mass_text(F.col("accepted_ch4_kg")).alias("acceptedCh4Kg"),
        total.alias("totalEmissionsToDateKg"),
        F.col("api_version").alias("apiVersion"),
    )
    exceeded = F.struct(
        F.col("site_id").alias("siteId"),
        F.col("site_name").alias("siteName"),
        F.col("emission_limit_kg").cast("string").alias("emissionLimitKg"),
        total.alias("totalEmissionsToDateKg"),
        batch_id.alias("crossedByBatchId"),
    )
    crossing = F.col("crossing")
    return seeds.withColumns({
        "aggregate_type": F.lit("site"),
        "aggregate_id": F.col("site_id"),
        "event_type": F.when(crossing, EXCEEDED_EVENT).otherwise(INGESTED_EVENT),
        "payload": F.when(crossing, F.to_json(exceeded)).otherwise(F.to_json(ingested)),
        "created_at": as_of,
    })


def numbered(events: DataFrame, epoch: int) -> DataFrame:
    """Ids for good: the epoch, and the event's position in it by arrival.

    Positions in the arrival log may come again in later epochs, ids do not. Events are
    sorted by ranges; one count a range comes to the driver.
    """
    spark = events.sparkSession
    ordered = stage(events.repartitionByRange("id").sortWithinPartitions("id").withColumn(
        "_at", F.monotonically_increasing_id()), "events", "zstd")
    part = F.shiftright("_at", _ROW_BITS)
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, start = [], epoch << EVENT_POSITION_BITS
    for range_, n in sizes:
        starts.append((range_, start))
        start += n
    first = spark.createDataFrame(starts, "_part long, _start long")
    row = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    # A row a range: without the hint Spark takes a local table for a large one and shuffles the events.
    return ordered.join(F.broadcast(first), part == F.col("_part")).withColumn("id", F.col("_start") + row).select(*events.columns)


def repeated_events(events: DataFrame) -> DataFrame:
    """Ids that more than one event has: none, or a report of delivery would count for several."""
    return events.groupBy("id").agg(F.count("*").alias("rows"), F.min("aggregate_id").alias("site_id")).filter("rows > 1")


def folded_attempts(attempts: DataFrame) -> DataFrame:
    """The attempt log by event: published_at, claimed_at, failures, last_error, requeued.

    An attempt that has not reported yet has `ok` NULL and only stamps the claim. What was
    put back (`requeued`) starts afresh: earlier failures and claims no longer count. The
    order is that of the commits, and of time inside a commit.
    """
    if "requeued" not in attempts.columns:
        attempts = attempts.withColumn("requeued", F.lit(None).cast("boolean"))
    commit = F.col("epoch") if "epoch" in attempts.columns else F.lit(0).cast("long")
    log = attempts.select(F.col("event_id").alias("id"), F.struct(commit.alias("commit"), "attempted_at").alias("at"),
                          "attempted_at", "ok", "error", F.coalesce("requeued", F.lit(False)).alias("requeued"))
    back = log.filter("requeued").groupBy("id").agg(F.max("at").alias("back"))
    log = log.join(back, "id", "left")
    counts = ~F.col("requeued") & (F.col("back").isNull() | (F.col("at") > F.col("back")))
    failed = counts & (F.col("ok") == F.lit(False))
    return log.groupBy("id").agg(
        F.min(F.when(F.col("ok"), F.col("attempted_at"))).alias("published_at"),
        F.max(F.when(counts, F.col("attempted_at"))).alias("claimed_at"),
        F.count_if(failed).cast("int").alias("attempts"),
        F.max_by(F.substring("error", 1, LAST_ERROR_CHARS), F.when(F.col("ok") == F.lit(False), F.col("at"))).alias("last_error"),
        F.max("requeued").alias("requeued"),
    )


def delivery_state(events: DataFrame, attempts: DataFrame) -> DataFrame:
    """STR-7: published_at / claimed_at / attempts / last_error of every event, from the whole log."""
    return (
        events.join(folded_attempts(attempts).drop("requeued"), "id", "left")
        .withColumn("attempts", F.coalesce("attempts", F.lit(0)))
        .select(*events.columns, "published_at", "claimed_at", "attempts", "last_error")
    )


def newly_pending(events: DataFrame) -> DataFrame:
    """Events as they enter the pending table."""
    none = lambda kind: F.lit(None).cast(kind)
    return events.withColumns({"claimed_at": none("timestamp"), "attempts": F.lit(0), "last_error": none("string")})


def advance_pending(pending: DataFrame, attempts: DataFrame) -> DataFrame:
    """The pending events after new attempts: delivered ones go, failures add up."""
    new = folded_attempts(attempts).select("id", *[
        F.col(c).alias(f"n_{c}") for c in ("published_at", "claimed_at", "attempts", "last_error", "requeued")])
    kept = F.coalesce(~F.col("n_requeued"), F.lit(True))
    return pending.join(new, "id", "left").filter("n_published_at IS NULL").withColumns({
        "claimed_at": F.greatest(F.when(kept, F.col("claimed_at")), F.col("n_claimed_at")),
        "attempts": (F.when(kept, F.col("attempts")).otherwise(0) + F.coalesce("n_attempts", F.lit(0))).cast("int"),
        "last_error": F.coalesce("n_last_error", "last_error"),
    }).select(*pending.columns)


def eligible(state: DataFrame, as_of: Column) -> DataFrame:
    """FLT-11: not delivered, not set aside, not held by a live claim. `state` may hold all
    events or the pending ones only."""
    lapsed = F.col("claimed_at") < as_of - F.expr(f"INTERVAL {DELIVERY_LEASE_SECONDS} SECONDS")
    return state.filter(
        F.col("published_at").isNull()
        & (F.col("attempts") < DELIVERY_MAX_ATTEMPTS)
        & (F.col("claimed_at").isNull() | lapsed)
    )


def next_deliveries(state: DataFrame, as_of: Column, limit: int = DELIVERY_BATCH) -> DataFrame:
    """ORD-3: the oldest eligible events; a bounded top-k, not a full sort."""
    return eligible(state, as_of).orderBy("id").limit(limit)


def backlog(state: DataFrame) -> DataFrame:
    """AG-9 over undelivered events: pending, and set aside for good."""
    return state.filter("published_at IS NULL").agg(
        F.count_if(F.col("attempts") < DELIVERY_MAX_ATTEMPTS).alias("pending"),
        F.count_if(F.col("attempts") >= DELIVERY_MAX_ATTEMPTS).alias("dead_lettered"),
    )


def delivery_tally(state: DataFrame) -> DataFrame:
    """AG-12: delivered events and failed attempts by type."""
    return state.groupBy("event_type").agg(
        F.count("published_at").alias("published"), F.sum("attempts").alias("failed")
    )
