"""Reading-level de-duplication: one verdict per reading, as if batches had been
applied one after the other.

Verdicts: accept, duplicate, value_conflict, mixed_identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugebook.functions.identity import IDENTIFIED_KEY, INSTANT_KEY, arrival_of
from gaugebook.operators.contested import CANDIDATE, ORDERED_PASS_ROWS, settle
from gaugebook.operators.lookups import met
from gaugebook.schemas import MASS, MIXED_IDENTITY, VALUE_CONFLICT
from gaugebook.session import dropping_stages, stage

ACCEPT = "accept"
DUPLICATE = "duplicate"


def _anonymous(readings: DataFrame) -> DataFrame:
    return readings.filter("reading_id IS NULL")


def _named(readings: DataFrame) -> DataFrame:
    return readings.filter("reading_id IS NOT NULL")


def instant_profile(readings: DataFrame) -> DataFrame:
    """Per (site, device, instant): the first anonymous reading, and whether
    identified ones are there too.

    Only bigints and decimals are aggregated, so this is a hash aggregation whose
    partial step folds repeats of a hot reading before the shuffle.
    """
    anonymous_ord = F.when(F.col("reading_id").isNull(), F.col("ord"))
    return readings.groupBy(*INSTANT_KEY).agg(
        F.min(anonymous_ord).alias("a_ord"),
        F.min_by("ch4_kg", anonymous_ord).alias("a_kg"),
        F.count("reading_id").alias("named"),
    )


def first_by_id(readings: DataFrame) -> DataFrame:
    """WN-2 for identified readings: first arrival per reading id at any instant."""
    return _named(readings).groupBy(*IDENTIFIED_KEY).agg(
        F.min("ord").alias("i_ord"), F.min_by("ch4_kg", "ord").alias("i_kg")
    )


def stored_scheme(measurements: DataFrame) -> DataFrame:
    """JN-4: what is stored at each instant; the first identified mass there."""
    named_at = F.when(
        F.col("reading_id").isNotNull(), F.struct("epoch", "arrival_ord")
    )
    return measurements.groupBy(*INSTANT_KEY).agg(
        F.max(F.when(F.col("reading_id").isNull(), F.col("ch4_kg"))).alias("s_a_kg"),
        F.min_by("ch4_kg", named_at).alias("s_i_kg"),
    )


def _collision(ord_: Column, owner_ord: Column, kg: Column, owner_kg: Column) -> Column:
    """Equal mass is a silent duplicate; so is a repeat inside the owner's own batch."""
    same_batch = arrival_of(ord_) == arrival_of(owner_ord)
    return F.when((kg == owner_kg) | F.coalesce(same_batch, F.lit(False)), DUPLICATE).otherwise(
        VALUE_CONFLICT
    )


def resolve(
    readings: DataFrame,
    stored_instants: DataFrame | None = None,
    stored_ids: DataFrame | None = None,
    ordered_pass_rows: int = ORDERED_PASS_ROWS,
) -> DataFrame:
    """Add `verdict` and `stored_kg` (the mass a withheld reading lost to).

    `readings`: site_id, device_id, reading_id, reading_ts, ch4_kg, ord, plus any
    payload. `stored_instants`: INSTANT_KEY, s_a_kg, s_i_kg. `stored_ids`:
    IDENTIFIED_KEY, s_kg. Both only need the keys that occur in `readings`.

    A reading is accepted if no other one, arriving or stored, has its id and no anonymous
    one is involved at its instant. Only keys that do meet others (see `lookups`) are
    aggregated and written to the checkpoint folder, so that the readings themselves need
    no shuffle while those are few. Instants that carry both schemes (usually fewer still)
    take the contested path.
    """
    # Each block removes its stages but the one that the verdicts read.
    spark = readings.sparkSession
    has_anonymous = F.col("a_ord").isNotNull() | F.col("s_a_kg").isNotNull()
    has_named = (F.col("named") > 0) | F.col("s_i_kg").isNotNull()
    with dropping_stages(spark):
        at = met(
            INSTANT_KEY, readings, stored_instants, F.col("reading_id").isNull(),
            F.col("s_a_kg").isNotNull() if stored_instants is not None else None)
        instants = instant_profile(at.only(readings))
        if stored_instants is None:
            instants = instants.withColumns(
                {"s_a_kg": F.lit(None).cast(MASS), "s_i_kg": F.lit(None).cast(MASS)}
            )
        else:
            instants = instants.join(stored_instants, INSTANT_KEY, "left")
        profile = stage(instants.filter(has_anonymous), "instants", outlives=True)
    mixed = profile.filter(has_named).drop("named")
    n_mixed = profile.agg(F.count_if(has_named)).first()[0]

    decided = None
    if n_mixed:
        with dropping_stages(spark):
            decided = stage(
                _settle_mixed(readings, mixed, stored_ids, ordered_pass_rows), "contested", "zstd", outlives=True)

    with dropping_stages(spark):
        ids = first_by_id(met(IDENTIFIED_KEY, _named(readings), stored_ids).only(_named(readings)))
        if stored_ids is None:
            ids = ids.withColumn("s_kg", F.lit(None).cast(MASS))
        else:
            ids = ids.join(stored_ids, IDENTIFIED_KEY, "left")
        named = _judge_named(readings, ids, mixed if n_mixed else None, decided)
    return _judge_anonymous(readings, profile, decided).unionByName(named)


def _settle_mixed(
    readings: DataFrame,
    mixed: DataFrame,
    stored_ids: DataFrame | None,
    ordered_pass_rows: int,
) -> DataFrame:
    """Accepted candidates among the readings whose verdict hangs on a mixed instant.

    Those are the anonymous readings at a mixed instant, and every candidate of a
    reading id that occurs at one.
    """
    named = _named(readings)
    touched = named.join(mixed.select(*INSTANT_KEY), INSTANT_KEY, "left_semi")
    tainted = touched.select(*IDENTIFIED_KEY).distinct()
    named_candidates = (
        named.join(tainted, IDENTIFIED_KEY, "left_semi")
        .groupBy(*IDENTIFIED_KEY, "reading_ts")
        .agg(F.min("ord").alias("ord"), F.min_by("ch4_kg", "ord").alias("ch4_kg"))
        # Refused by what is stored, whatever else arrives: not candidates.
        .join(mixed.filter("s_a_kg IS NOT NULL").select(*INSTANT_KEY), INSTANT_KEY, "left_anti")
    )
    if stored_ids is not None:
        named_candidates = named_candidates.join(
            stored_ids.select(*IDENTIFIED_KEY), IDENTIFIED_KEY, "left_anti"
        )
    anonymous_candidates = mixed.filter(
        "a_ord IS NOT NULL AND s_a_kg IS NULL AND s_i_kg IS NULL"
    ).select(
        *INSTANT_KEY,
        F.lit(None).cast("string").alias("reading_id"),
        F.col("a_ord").alias("ord"),
        F.col("a_kg").alias("ch4_kg"),
    )
    candidates = named_candidates.select(*CANDIDATE).unionByName(
        anonymous_candidates.select(*CANDIDATE)
    )
    tainted_marks = tainted.select(
        *IDENTIFIED_KEY,
        F.lit(None).cast("timestamp").alias("reading_ts"),
        F.lit(None).cast("bigint").alias("ord"),
        F.lit(None).cast(MASS).alias("ch4_kg"),
    )
    # Rows without an ord record that an id took this path; accepted rows carry one.
    return settle(candidates, ordered_pass_rows).unionByName(
        tainted_marks.select(*CANDIDATE)
    )


def _judge_anonymous(
    readings: DataFrame, instants: DataFrame, decided: DataFrame | None
) -> DataFrame:
    # An instant that is not listed holds this reading alone.
    rows = _anonymous(readings).dropna(subset=INSTANT_KEY).join(
        instants.select(*INSTANT_KEY, "a_ord", "a_kg", "s_a_kg", "s_i_kg"), INSTANT_KEY, "left"
    )
    if decided is None:
        rows = rows.withColumns(
            {"n_ord": F.lit(None).cast("bigint"), "n_kg": F.lit(None).cast(MASS)}
        )
    else:
        # First accepted identified reading per instant; only contested ones matter.
        first_named = (
            decided.filter("reading_id IS NOT NULL AND ord IS NOT NULL")
            .groupBy(*INSTANT_KEY)
            .agg(F.min("ord").alias("n_ord"), F.min_by("ch4_kg", "ord").alias("n_kg"))
        )
        rows = rows.join(first_named, INSTANT_KEY, "left")
    ord_, kg = F.col("ord"), F.col("ch4_kg")
    named_before = F.coalesce(F.col("n_ord") < ord_, F.lit(False))
    by_scheme = F.col("s_i_kg").isNotNull() | named_before
    stored = F.col("s_a_kg").isNotNull()
    verdict = (
        F.when(by_scheme, MIXED_IDENTITY)
        .when(stored, _collision(ord_, F.lit(None).cast("bigint"), kg, F.col("s_a_kg")))
        .when(F.col("a_ord").isNull() | (ord_ == F.col("a_ord")), ACCEPT)
        .otherwise(_collision(ord_, F.col("a_ord"), kg, F.col("a_kg")))
    )
    lost_to = F.when(by_scheme, F.coalesce("s_i_kg", "n_kg")).otherwise(
        F.coalesce("s_a_kg", "a_kg")
    )
    return _verdicts(readings, rows, verdict, lost_to)


def _judge_named(
    readings: DataFrame,
    ids: DataFrame,
    mixed: DataFrame | None,
    decided: DataFrame | None,
) -> DataFrame:
    """An id that is not in `ids` is carried by one reading alone. `ids` is staged to outlive
    the block that its lookups are staged in."""
    rows = _named(readings).dropna(subset=IDENTIFIED_KEY)
    met_before = F.lit(True).alias("met")
    if decided is None:
        ids = stage(ids.select("*", met_before), "ids", "zstd", outlives=True)
        rows = rows.join(ids, IDENTIFIED_KEY, "left").withColumns(
            {"x_ord": F.lit(None).cast("bigint"), "x_kg": F.lit(None).cast(MASS)}
        )
    else:
        # What a contested id settled on replaces its plain first arrival.
        settled = (
            decided.filter("reading_id IS NOT NULL")
            .groupBy(*IDENTIFIED_KEY)
            .agg(F.min("ord").alias("c_ord"), F.min_by("ch4_kg", "ord").alias("c_kg"))
            .withColumn("contested", F.lit(True))
        )
        contested = F.col("contested").isNotNull()
        ids = (
            ids.join(settled, IDENTIFIED_KEY, "full_outer")
            .withColumn("i_ord", F.when(contested, F.col("c_ord")).otherwise(F.col("i_ord")))
            .withColumn("i_kg", F.when(contested, F.col("c_kg")).otherwise(F.col("i_kg")))
            .drop("contested", "c_ord", "c_kg")
        )
        # The anonymous reading an instant holds: stored (before all), or accepted now.
        anonymous_at = (
            mixed.filter("s_a_kg IS NOT NULL")
            .select(*INSTANT_KEY, F.lit(-1).cast("bigint").alias("x_ord"), F.col("s_a_kg").alias("x_kg"))
            .unionByName(
                decided.filter("reading_id IS NULL").select(
                    *INSTANT_KEY, F.col("ord").alias("x_ord"), F.col("ch4_kg").alias("x_kg")
                )
            )
        )
        ids = stage(ids.select("*", met_before), "ids", "zstd", outlives=True)
        rows = rows.join(ids, IDENTIFIED_KEY, "left").join(anonymous_at, INSTANT_KEY, "left")
    ord_, kg = F.col("ord"), F.col("ch4_kg")
    by_scheme = F.coalesce(F.col("x_ord") < ord_, F.lit(False))
    verdict = (
        F.when(by_scheme, MIXED_IDENTITY)
        .when(F.col("met").isNull(), ACCEPT)
        .when(
            F.col("s_kg").isNotNull(),
            _collision(ord_, F.lit(None).cast("bigint"), kg, F.col("s_kg")),
        )
        .when(ord_ == F.col("i_ord"), ACCEPT)
        .otherwise(_collision(ord_, F.col("i_ord"), kg, F.col("i_kg")))
    )
    lost_to = F.when(by_scheme, F.col("x_kg")).otherwise(F.coalesce("s_kg", "i_kg"))
    return _verdicts(readings, rows, verdict, lost_to)


def _verdicts(readings: DataFrame, rows: DataFrame, verdict: Column, lost_to: Column) -> DataFrame:
    return rows.withColumn("verdict", verdict).select(
        *readings.columns,
        "verdict",
        F.when(F.col("verdict") != ACCEPT, lost_to).alias("stored_kg"),
    )
