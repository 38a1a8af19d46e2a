"""Lookups by bucket and key range, snapshots by bucket, pending events."""

import re
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from support import AS_OF, site_uuid

from gaugebook.operators.events import backlog, delivery_state, eligible, next_deliveries
from gaugebook.plans import ingest as plan
from gaugebook.plans.ingest import backfill_spans, ingest, log_delivery_attempts, requeue
from gaugebook.plans.reconcile import findings
from gaugebook.schemas import ARRIVALS, DELIVERY_ATTEMPTS
from gaugebook.sources.store import Keys, Store

EPOCHS = 200


@pytest.fixture(scope="module")
def long_store(spark, tmp_path_factory):
    """Identities of 200 epochs, each of other devices of its own site."""
    store = Store(spark, str(tmp_path_factory.mktemp("long")))
    head, wrote = store.head(), []
    for n in range(EPOCHS):
        rows = spark.range(2).select(
            F.lit(site_uuid(n)).alias("site_id"), F.concat(F.lit("d"), "id").alias("device_id"), F.lit("r").alias("reading_id"),
            F.lit(AS_OF).alias("first_ts"), F.lit(n).cast("decimal(14,4)").alias("ch4_kg"), F.lit("b").alias("batch_id"))
        wrote.append(store.write(rows, "reading_identities", n + 1, head))
    store.commit(head, wrote, AS_OF)
    return store


def scan_of(df):
    plan_text = df._jdf.queryExecution().executedPlan().toString()
    return plan_text, len(df.inputFiles())


def test_lookup_opens_folders_and_buckets_of_its_keys_only(spark, long_store):
    store, head = long_store, long_store.head()
    assert len(head.folders["reading_identities"]) == EPOCHS
    wanted = spark.createDataFrame([(site_uuid(17), "d0"), (site_uuid(18), "d1")], "site_id string, device_id string")
    keys = store.keys(wanted, "reading_identities", head)
    assert 1 <= len(keys.buckets) <= 2
    found = store.read("reading_identities", head, keys)
    text, files = scan_of(found)
    filters = re.search(r"PartitionFilters: \[(.*?)\], ", text).group(1)
    named = {int(n) for n in re.findall(r"(?:IN \(|,|= )\s*(\d+)", filters)}
    assert "bucket" in filters and named == set(keys.buckets)
    # Of 200 folders only those whose range and buckets meet the keys are listed.
    assert files <= 4
    assert {(r.site_id, r.device_id) for r in found.join(wanted, ["site_id", "device_id"], "left_semi").collect()} == {
        (site_uuid(17), "d0"), (site_uuid(18), "d1")}


def test_lookup_finds_what_a_scan_finds(spark, long_store):
    store, head = long_store, long_store.head()
    whole = store.read("reading_identities", head)
    for low in (0, 63, 150):
        wanted = spark.createDataFrame([(site_uuid(n), f"d{n % 3}") for n in range(low, low + 40, 7)], "site_id string, device_id string")
        got = store.read("reading_identities", head, store.keys(wanted, "reading_identities", head))
        on = ["site_id", "device_id"]
        rows = lambda df: Counter(map(tuple, df.join(wanted, on, "left_semi").collect()))
        assert rows(got) == rows(whole) and rows(whole)
    assert store.read("reading_identities", head, Keys(())).count() == 0


def feed(spark, seq, site, kg="5", key=None, rid=None):
    return spark.createDataFrame(
        [(seq, "2", key or f"k{seq}", site_uuid(site), [(rid, "d", f"2026-08-09T12:{seq:02d}:00Z", kg, "sensor")])], ARRIVALS)


def test_repeats_are_found_across_epochs_and_compaction(spark, store, add_sites):
    add_sites(store, (1, "100"), (2, "100"))
    ingest(store, feed(spark, 1, 1, rid="a"), as_of=AS_OF)
    ingest(store, feed(spark, 2, 2, rid="a"), as_of=AS_OF)
    store.compact(folders=1)
    ingest(store, feed(spark, 3, 1, key="k1", rid="a").unionByName(feed(spark, 4, 1, kg="6", rid="a")), as_of=AS_OF)
    assert [r.code for r in store.read("rejects").collect()] == ["IDEMPOTENCY_KEY_REUSED"]
    assert {r.site_id: (str(r.total_kg), r.version) for r in store.summary().collect()} == {
        site_uuid(1): ("5.0000", 2), site_uuid(2): ("5.0000", 1)}
    assert findings(store).collect() == []


def test_an_epoch_writes_the_buckets_of_its_sites_only(spark, store, add_sites):
    add_sites(store, *[(n, "100") for n in range(1, 41)])
    everyone = feed(spark, 1, 1)
    for n in range(2, 41):
        everyone = everyone.unionByName(feed(spark, n, n))
    ingest(store, everyone.coalesce(2), as_of=AS_OF)
    first = store.head()
    before = {r.site_id: r for r in store.summary().drop("epoch").collect()}
    assert len(before) == 40
    ingest(store, feed(spark, 50, 7, "8"), as_of=AS_OF)
    head = store.head()
    old, new = head.folders["site_summary"]
    assert old == first.folders["site_summary"][0]
    written = store.spark.read.parquet(f"{store.root}/site_summary/{new}")
    bucket = written.select("bucket").distinct().collect()
    assert len(bucket) == 1 and written.count() < 10
    assert bucket[0][0] not in head.holds[old]["buckets"] and bucket[0][0] in head.holds[old]["written"]
    after = {r.site_id: r for r in store.summary().drop("epoch").collect()}
    assert after.keys() == before.keys()
    assert {k for k in after if after[k] != before[k]} == {site_uuid(7)} and str(after[site_uuid(7)].total_kg) == "13.0000"
    assert findings(store).collect() == []
    store.compact(["site_summary"], folders=1)
    assert {r.site_id: r for r in store.summary().drop("epoch").collect()} == after


def test_spans_are_backfilled_by_a_commit(spark, store, add_sites):
    add_sites(store, (1, "100"))
    ingest(store, feed(spark, 1, 1), as_of=AS_OF)
    good = store.summary().drop("epoch").collect()
    head = store.head()
    none = F.lit(None).cast("timestamp")
    bare = store.summary(head).drop("epoch").withColumns({"first_reading_at": none, "last_reading_at": none})
    store.commit(head, [store.write(bare, "site_summary", head.epoch + 1, head, tuple(range(32)))], AS_OF)
    assert [r["verdict"] for r in findings(store).collect()] != []
    backfill_spans(store, as_of=AS_OF)
    assert store.summary().drop("epoch").collect() == good and findings(store).collect() == []


def attempts(spark, *rows):
    at = lambda seconds: AS_OF + timedelta(seconds=seconds)
    return spark.createDataFrame([(i, at(s), ok, e) for i, s, ok, e in rows], DELIVERY_ATTEMPTS)


def test_pending_events_follow_every_commit(spark, store, add_sites):
    """The table agrees with the fold of the whole log after each step."""
    add_sites(store, (1, "3"))

    def agrees():
        state = delivery_state(store.read("events_out").drop("epoch"), store.read("delivery_attempts"))
        columns = ["id", "event_type", "attempts", "claimed_at", "last_error"]
        want = sorted(map(tuple, state.filter("published_at IS NULL").select(*columns).collect()))
        assert sorted(map(tuple, store.pending().select(*columns).collect())) == want
        return {r.id: r.attempts for r in store.pending().collect()}

    ingest(store, feed(spark, 1, 1, "2").unionByName(feed(spark, 2, 1, "2")), as_of=AS_OF)
    a, b, c = ((2 << 36) + n for n in range(3))  # c: the crossing
    assert agrees() == {a: 0, b: 0, c: 0}
    log_delivery_attempts(store, attempts(spark, (a, 1, True, None), (b, 1, False, "e1"), (b, 2, False, "e2"), (c, 1, None, None)), as_of=AS_OF)
    assert agrees() == {b: 2, c: 0}
    log_delivery_attempts(store, attempts(spark, *[(b, 10 + n, False, f"f{n}") for n in range(8)]), as_of=AS_OF)
    assert agrees() == {b: 10, c: 0}
    assert tuple(backlog(store.pending()).first()) == (1, 1)
    requeue(store, spark.createDataFrame([(b,), (a,)], "id long"), as_of=AS_OF)
    assert agrees() == {b: 0, c: 0}
    now = F.lit(AS_OF + timedelta(seconds=1))
    assert [r.id for r in next_deliveries(store.pending(), now).collect()] == [b]  # c is claimed, a is delivered
    log_delivery_attempts(store, attempts(spark, (b, 60, False, "again"), (c, 61, True, None)), as_of=AS_OF)
    assert agrees() == {b: 1}
    # A position of the first epoch comes again: the event's id does not.
    ingest(store, feed(spark, 1, 1, "1", key="k9"), as_of=AS_OF)
    assert agrees() == {b: 1, 7 << 36: 0} and findings(store).collect() == []
    store.compact(folders=1)
    assert agrees() == {b: 1, 7 << 36: 0}
    assert all("/events_pending/" in file for file in eligible(store.pending(), now).inputFiles())


def test_repeated_event_ids_are_found(spark, store, add_sites):
    add_sites(store, (1, "100"))
    ingest(store, feed(spark, 1, 1), as_of=AS_OF)
    head = store.head()
    store.commit(head, [store.write(store.read("events_out", head).drop("epoch"), "events_out", head.epoch + 1, head)], AS_OF)
    assert [(r["check"], r.site_id, r.actual) for r in findings(store).collect()] == [("events", site_uuid(1), "1")]


def test_an_empty_log_changes_nothing(spark, store, add_sites):
    add_sites(store, (1, "100"))
    ingest(store, feed(spark, 1, 1), as_of=AS_OF)
    before = store.pending().collect()
    log_delivery_attempts(store, attempts(spark, (2, 1, None, None)).filter("false"), as_of=AS_OF)
    assert store.pending().collect() == before and plan._from_newest_head(store, lambda head: head.epoch) == 3
