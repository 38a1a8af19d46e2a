"""Request-level idempotency: the first arrival of a (site, key) owns it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugebook.functions.values import derived_uuid
from gaugebook.operators.lookups import met
from gaugebook.schemas import IDEMPOTENCY_KEY_REUSED, SITE_NOT_FOUND, VALIDATION_ERROR
from gaugebook.session import stage

BATCH_KEY = ["site_id", "idempotency_key"]


def first_claims(arrivals: DataFrame) -> DataFrame:
    """WN-1 as an aggregation: the lowest arrival per key and its fingerprint.

    A window would sort every retry of a hot key in one task; this combines
    retries before the shuffle and keeps one row per key.
    """
    return arrivals.groupBy(*BATCH_KEY).agg(
        F.min("arrival_seq").alias("owner_seq"),
        F.min_by("fingerprint", "arrival_seq").alias("owner_hash"),
    )


def redelivered(checked: DataFrame) -> DataFrame:
    """Arrivals with `again`: whether a copy of the arrival precedes it under its number.

    At-least-once feeds repeat arrivals; a copy is answered as a replay. A number that
    another valid arrival holds too is refused, except for one of them (and its copies).
    `checked` must be staged: copies are told apart by a row number given here.
    """
    valid = F.size("details") == 0
    told = F.when(valid, F.xxhash64("site_id", "idempotency_key", "fingerprint"))
    numbered = stage(
        checked.withColumns({"_told": told, "_copy": F.monotonically_increasing_id()}), "numbered", "zstd")
    # Numbers are counted alone, and only repeated ones looked into: the feed itself stays where it is.
    counted = numbered.filter(valid).groupBy("arrival_seq").agg(F.count("*").alias("_n"))
    repeats = stage(counted.filter("_n > 1").select("arrival_seq"), "repeats")
    first = stage(
        numbered.filter(valid).join(repeats, "arrival_seq", "left_semi").groupBy("arrival_seq").agg(
            F.min(F.struct("_told", "_copy")).alias("_first")),
        "first-copies",
    )
    joined = numbered.join(first, "arrival_seq", "left")
    repeated = valid & F.col("_first").isNotNull() & (F.col("_copy") != F.col("_first._copy"))
    taken = repeated & (F.col("_told") != F.col("_first._told"))
    issue = F.array(F.struct(
        F.lit("arrival_seq").alias("path"), F.lit("another arrival has this position").alias("message")))
    return joined.select(
        *[F.when(taken, issue).otherwise(F.col(c)).alias(c) if c == "details" else F.col(c) for c in checked.columns],
        (repeated & ~taken).alias("again"),
    )


def odd_sites(checked: DataFrame, site_ids: DataFrame) -> DataFrame:
    """Sites of the arrivals that are not registered once, usually none: `unknown` ones, and a
    row per registration of the others."""
    times = site_ids.groupBy("site_id").agg(F.count("*").alias("n"))
    seen = checked.select("site_id").distinct().join(times, "site_id", "left")
    return seen.filter("site_id IS NOT NULL AND (n IS NULL OR n > 1)").select(
        "site_id",
        F.col("n").isNull().alias("unknown"),
        F.explode(F.sequence(F.lit(1), F.coalesce(F.col("n"), F.lit(1)).cast("int"))).alias("nth"),
    ).drop("nth")


def decide_claims(
    checked: DataFrame, site_ids: DataFrame, ledger: DataFrame | None = None
) -> DataFrame:
    """One `code` (NULL unless rejected) and `owns` / `batch_id` per arrival.

    Order of outcomes: body and key, site, claim. `site_ids` has one column
    `site_id`; `ledger` holds (site_id, idempotency_key, request_hash, id) of
    every batch committed earlier.

    What is looked up are exceptions: sites that are not registered once, and owners of keys
    that come again or are in the ledger. They are written out first, so that the planner
    knows their size and the arrivals, which carry their readings, need no shuffle while the
    exceptions are few. A key that comes once and is not in the ledger owns itself.
    """
    odd = stage(odd_sites(checked, site_ids), "odd-sites")
    valid = F.size("details") == 0
    unknown = F.col("site_id").isNull() | F.coalesce("unknown", F.lit(False))
    gated = checked.join(odd, "site_id", "left").withColumn(
        "code", F.when(~valid, VALIDATION_ERROR).when(unknown, SITE_NOT_FOUND)
    ).drop("unknown")

    open_ = gated.filter("code IS NULL")
    meeting = met(BATCH_KEY, open_, ledger)
    owners = first_claims(meeting.only(open_))
    if ledger is None:
        owners = owners.withColumn("stored_hash", F.lit(None).cast("string"))
    else:
        # Only keys seen in this epoch leave the ledger scan, whatever its size.
        stored = meeting.only(ledger).join(owners.select(*BATCH_KEY), BATCH_KEY, "left_semi").select(
            *BATCH_KEY, F.col("request_hash").alias("stored_hash")
        )
        owners = owners.join(stored, BATCH_KEY, "left")
    owners = owners.select(
        *BATCH_KEY,
        F.when(F.col("stored_hash").isNull(), F.col("owner_seq")).alias("owner_seq"),
        F.coalesce("stored_hash", "owner_hash").alias("claim_hash"),
        F.lit(True).alias("contested"),
    )

    claimed = gated.join(stage(owners, "owners", "zstd"), BATCH_KEY, "left")
    keyed = F.col("site_id").isNotNull() & F.col("idempotency_key").isNotNull()
    mine = F.when(F.col("contested").isNull(), keyed).otherwise(
        F.coalesce(F.col("owner_seq") == F.col("arrival_seq"), F.lit(False)))
    if "again" in checked.columns:
        mine = mine & ~F.col("again")
    return claimed.select(
        *[c for c in checked.columns if c != "again"],
        F.coalesce(
            F.col("code"),
            F.when(F.col("fingerprint") != F.col("claim_hash"), IDEMPOTENCY_KEY_REUSED),
        ).alias("code"),
        (F.col("code").isNull() & mine).alias("owns"),
        F.when(F.col("code").isNull(), derived_uuid(F.col("site_id"), F.col("idempotency_key"))).alias("batch_id"),
    )
