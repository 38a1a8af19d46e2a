"""What few keys have in common must not make all rows move."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from gaugebook.operators.claims import decide_claims
from gaugebook.operators.dedup import resolve
from gaugebook.operators.events import numbered
from gaugebook.operators.lookups import met, shared
from gaugebook.schemas import DETAIL, EVENT_POSITION_BITS
from gaugebook.session import FREE_SHUFFLES, dropping_stages, stage
from support import AS_OF, site_uuid

N = 20_000


@pytest.fixture
def little_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, str(64 << 10))  # lookups of a few rows fit, those of all rows do not
    yield
    spark.conf.set(key, old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def readings(spark):
    """Every third is anonymous; number 7 comes again as N, with another mass."""
    rows = spark.range(N + 1).withColumn("same", F.when(F.col("id") == N, 7).otherwise(F.col("id")))
    return stage(rows.select(
        F.lit(site_uuid(1)).alias("site_id"),
        F.concat(F.lit("d"), "same").alias("device_id"),
        F.when(F.col("same") % 3 != 0, F.col("same").cast("string")).alias("reading_id"),
        F.lit(AS_OF).alias("reading_ts"),
        F.when(F.col("id") == N, 2).otherwise(1).cast("decimal(14,4)").alias("ch4_kg"),
        (F.col("id") * 128).alias("ord"),
    ), "readings")


def test_readings_that_meet_no_other_are_not_shuffled(spark, little_broadcast):
    got = resolve(readings(spark))
    assert "hashpartitioning" not in plan(got)
    verdicts = {r["verdict"]: (r["n"], r["last"]) for r in got.groupBy("verdict").agg(
        F.count("*").alias("n"), F.max("ord").alias("last")).collect()}
    assert verdicts == {"accept": (N, (N - 1) * 128), "value_conflict": (1, N * 128)}


def test_arrivals_whose_keys_come_once_are_not_shuffled(spark, little_broadcast):
    """Key 7 comes again with another body, key 8 is in the ledger, site 3 is not known."""
    rows = spark.range(N + 1).withColumn("same", F.when(F.col("id") == N, 7).otherwise(F.col("id")))
    checked = stage(rows.select(
        F.col("id").alias("arrival_seq"),
        F.when(F.col("id") == 9, site_uuid(3)).otherwise(site_uuid(1)).alias("site_id"),
        F.col("same").cast("string").alias("idempotency_key"),
        F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"),
        F.array().cast(f"array<{DETAIL.simpleString()}>").alias("details"),
    ), "checked")
    sites = spark.createDataFrame([(site_uuid(1),)], "site_id string")
    ledger = spark.range(8, 9).select(
        F.lit(site_uuid(1)).alias("site_id"), F.col("id").cast("string").alias("idempotency_key"),
        F.sha2(F.col("id").cast("string"), 256).alias("request_hash"))
    got = decide_claims(checked, sites, ledger)
    assert "hashpartitioning" not in plan(got)
    rest = {r["arrival_seq"]: r["code"] for r in got.filter("NOT owns").collect()}
    assert rest == {8: None, 9: "SITE_NOT_FOUND", N: "IDEMPOTENCY_KEY_REUSED"}
    assert got.count() == N + 1


def test_sites_registered_twice_still_give_a_row_each(spark):
    checked = spark.createDataFrame(
        [(1, site_uuid(1), "a", "h", [])],
        f"arrival_seq long, site_id string, idempotency_key string, fingerprint string, details array<{DETAIL.simpleString()}>")
    sites = spark.createDataFrame([(site_uuid(1),), (site_uuid(1),)], "site_id string")
    assert [r["code"] for r in decide_claims(checked, sites).collect()] == [None, None]


def test_events_are_numbered_without_another_shuffle(spark):
    events = spark.range(100).select((F.col("id") * 2).alias("id"), F.lit("x").alias("payload"))
    got = numbered(events, 3)
    assert "hashpartitioning" not in plan(got)
    start = 3 << EVENT_POSITION_BITS
    assert sorted(r["id"] for r in got.collect()) == list(range(start, start + 100))


def test_keys_that_meet(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, False), (2, False), (3, True), (4, False)], "k int, a boolean")
    stored = spark.createDataFrame([(3, False), (4, False), (5, True), (5, True)], "k int, a boolean")
    keys = lambda df: sorted({r["k"] for r in df.collect()})
    assert keys(met(["k"], rows).only(rows)) == [1, 2]
    assert keys(met(["k"], rows, stored).only(rows)) == [1, 2, 3, 4]
    assert keys(met(["k"], rows, stored, F.col("a"), F.col("a")).only(rows)) == [1, 3]
    assert keys(shared(["k"], rows, stored).only(stored)) == [3, 4]


def test_shuffle_files_go_with_their_query(spark):
    def blocks():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {str(every.apply(i)) for i in range(every.size())}

    before, setting = blocks(), spark.conf.get(FREE_SHUFFLES)
    with dropping_stages(spark):
        staged = stage(spark.range(N).repartition(7, "id"), "shuffled")
        assert staged.count() == N and spark.conf.get(FREE_SHUFFLES) == "true"
        until = time.time() + 20  # files are removed behind the query's back
        while (left := {b for b in blocks() - before if b.startswith("shuffle_")}) and time.time() < until:
            time.sleep(0.2)
    assert not left and spark.conf.get(FREE_SHUFFLES) == setting
