"""Arrival feeds and table sets derived from the driver tables.

E  events, anonymous: a site per user, a device per event type, day-grain instants.
L  lineitem, identified: a site per customer, a device per order, one reading a batch.
M  events with and without reading ids at the same instants.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugebook.plans.ingest import ingest, register_sites
from gaugebook.session import prepare, scratch_path, stage
from gaugebook.sources.store import Store

AS_OF = datetime(2026, 1, 1, tzinfo=timezone.utc)
BLOCK = 1000
SEQ_STRIDE = 1 << 24

# Feeds and stores are tables derived once per session and table folder.
_derived: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build):
    prepare(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _derived:
        _derived[key] = build()
    return _derived[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table is one file and one task; large inputs split by themselves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def site_uuid(number: Column) -> Column:
    return F.concat(
        F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0")
    )


def text_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# ---- E -----------------------------------------------------------------------


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.date_trunc("day", "ts").alias("day"),
        F.col("value").cast("decimal(14,4)").alias("kg"),
        F.floor(F.col("event_id") / BLOCK).alias("blk"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def event_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        site_uuid(user).alias("id"),
        F.concat(F.lit("Site "), F.lpad(user.cast("string"), 8, "0")).alias("name"),
        F.concat((2000 + 100 * (user % 10)).cast("string"), F.lit(".000")).alias("emissionLimitKg"),
        F.when(user % 3 == 0, F.concat(F.lit('{"operator":"op-'), (user % 7).cast("string"), F.lit('"}')))
        .when(user % 3 == 1, F.lit('{"operator":5}'))
        .alias("metadata"),
    )


def _event_batches(spark: SparkSession, sf_dir: str, reading: Column) -> DataFrame:
    """Readings of one user and block of events; a block bounds the list. They are dealt by
    their key first: lists gathered before the shuffle would be sorted in the few tasks that
    read the table, and save nothing, since a block's events of a user are few."""
    return (
        event_readings(spark, sf_dir)
        .repartition("user_id", "blk")
        .groupBy("user_id", "blk")
        .agg(F.array_sort(F.collect_list(F.struct("event_id", reading.alias("r")))).alias("rs"))
        .select(
            (F.col("blk") * SEQ_STRIDE + F.col("user_id")).alias("arrival_seq"),
            site_uuid(F.col("user_id")).alias("site_id"),
            "user_id",
            "blk",
            F.expr("transform(rs, x -> x.r)").alias("readings"),
        )
    )


def events_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed E in the legacy format: epoch seconds and grams, repeats allowed."""
    reading = F.struct(
        F.col("event_type").alias("device_id"),
        F.unix_seconds("day").alias("ts"),
        (F.col("kg") * 1000).cast("decimal(28,10)").alias("ch4_g"),
    )
    return _event_batches(spark, sf_dir, reading).select(
        "arrival_seq",
        "site_id",
        F.concat(
            F.lpad(F.col("blk").cast("string"), 8, "0"), F.lit("-0000-4000-8000-"),
            F.lpad(F.col("user_id").cast("string"), 12, "0"),
        ).alias("batch_id"),
        "readings",
    )


def wire_reading(rid: Column, device: Column, ts: Column, kg: Column, source: Column | None = None):
    return F.struct(
        rid.cast("string").alias("readingId"),
        device.cast("string").alias("deviceId"),
        ts.cast("string").alias("readingTs"),
        kg.cast("string").alias("ch4Kg"),
        (F.lit("sensor") if source is None else source).alias("source"),
    )


def events_current(spark: SparkSession, sf_dir: str, rid: Column | None = None) -> DataFrame:
    """Feed E in the current format, which refuses repeats inside a batch."""
    reading = wire_reading(
        F.lit(None) if rid is None else rid, F.col("event_type"), text_instant(F.col("day")),
        F.col("kg"),
    )
    return _event_batches(spark, sf_dir, reading).select(
        "arrival_seq",
        F.lit("2").alias("api_version"),
        F.concat_ws("-", "user_id", "blk").alias("idempotency_key"),
        "site_id",
        "readings",
    )


# ---- L -----------------------------------------------------------------------

LINE_ORDER = [
    "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def customer_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        site_uuid(F.col("c_custkey")).alias("id"),
        F.col("c_name").alias("name"),
        F.concat((500 + 100 * F.col("c_nationkey")).cast("string"), F.lit(".000"))
        .alias("emissionLimitKg"),
        F.to_json(F.struct(F.col("c_mktsegment").alias("operator"))).alias("metadata"),
    )


def lineitem_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed L. Lines have no sequence, so a range sort numbers them: ids grow with
    the partition, then with the row. Written once, so every reader sees the same
    numbers."""

    def build() -> DataFrame:
        lines = table(spark, sf_dir, "lineitem")
        owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        numbered = (
            lines.join(owners, lines["l_orderkey"] == owners["o_orderkey"])
            .orderBy(*LINE_ORDER)
            .withColumn("arrival_seq", F.monotonically_increasing_id())
        )
        reading = wire_reading(
            F.col("l_linenumber"), F.col("l_orderkey"), text_instant(F.col("l_shipdate")),
            F.col("l_quantity").cast("decimal(14,4)"),
        )
        return stage(
            numbered.select(
                "arrival_seq",
                F.lit("2").alias("api_version"),
                F.concat_ws("-", "l_suppkey", "l_orderkey", "l_linenumber").alias("idempotency_key"),
                site_uuid(F.col("o_custkey")).alias("site_id"),
                F.array(reading).alias("readings"),
                "l_suppkey",
            ),
            "lineitem-arrivals",
            "zstd",
        )

    return once(spark, sf_dir, "lineitem_arrivals", build)


# ---- M -----------------------------------------------------------------------


def mixed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed M: an id on even k only, so most instants see both schemes."""
    k = F.col("k")
    return spread(event_readings(spark, sf_dir)).select(
        F.col("event_id").alias("arrival_seq"),
        F.lit("2").alias("api_version"),
        F.col("event_id").cast("string").alias("idempotency_key"),
        site_uuid(F.col("user_id")).alias("site_id"),
        F.array(
            wire_reading(
                F.when(k % 2 == 0, k), F.col("event_type"), text_instant(F.col("day")), F.col("kg")
            )
        ).alias("readings"),
    )


# ---- table sets: two epochs each, so the second meets stored state -----------------


def _store(spark: SparkSession, label: str) -> Store:
    return Store(spark, scratch_path(spark, label))


def halfway(df: DataFrame, column: str) -> int:
    low, high = df.agg(F.min(column), F.max(column)).first()
    return (low + high + 1) // 2


def new_store(spark: SparkSession, sf_dir: str) -> Store:
    """An empty table set with the sites of feed E."""
    store = _store(spark, "events-store")
    register_sites(store, event_sites(spark, sf_dir), as_of=AS_OF)
    return store


def new_events_store(spark: SparkSession, sf_dir: str) -> Store:
    """A table set of its own for a query that changes it."""
    store = new_store(spark, sf_dir)
    feed = stage(events_legacy(spark, sf_dir), "events-legacy", "zstd")
    half = halfway(feed, "arrival_seq") // SEQ_STRIDE * SEQ_STRIDE
    ingest(store, legacy=feed.filter(F.col("arrival_seq") < half), as_of=AS_OF)
    ingest(store, legacy=feed.filter(F.col("arrival_seq") >= half), as_of=AS_OF)
    return store


def events_store(spark: SparkSession, sf_dir: str) -> Store:
    """Shared by the queries that only read it."""
    return once(spark, sf_dir, "events_store", lambda: new_events_store(spark, sf_dir))


def lineitem_store(spark: SparkSession, sf_dir: str) -> Store:
    def build() -> Store:
        store = _store(spark, "lineitem-store")
        register_sites(store, customer_sites(spark, sf_dir), as_of=AS_OF)
        feed = lineitem_arrivals(spark, sf_dir)
        # Arrival order is led by the supplier, so this cuts the feed in two.
        half = halfway(feed, "l_suppkey")
        ingest(store, feed.filter(F.col("l_suppkey") < half).drop("l_suppkey"), as_of=AS_OF)
        ingest(store, feed.filter(F.col("l_suppkey") >= half).drop("l_suppkey"), as_of=AS_OF)
        return store

    return once(spark, sf_dir, "lineitem_store", build)


def mixed_store(spark: SparkSession, sf_dir: str) -> Store:
    def build() -> Store:
        store = _store(spark, "mixed-store")
        register_sites(store, event_sites(spark, sf_dir), as_of=AS_OF)
        feed = mixed_arrivals(spark, sf_dir)
        half = halfway(feed, "arrival_seq")
        ingest(store, feed.filter(F.col("arrival_seq") < half), as_of=AS_OF)
        ingest(store, feed.filter(F.col("arrival_seq") >= half), as_of=AS_OF)
        return store

    return once(spark, sf_dir, "mixed_store", build)
