"""What an epoch keeps on disk."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gaugebook.functions.values import or_else, packed_digest, unless, unpacked_digest
from gaugebook.operators.events import delivery_state
from gaugebook.plans.ingest import ingest, log_delivery_attempts
from gaugebook.plans.reconcile import findings
from gaugebook.schemas import ARRIVALS, DELIVERY_ATTEMPTS
from gaugebook.sources.store import Store
from support import AS_OF, site_uuid
from test_stages import labels, staged


def arrivals(spark, *numbers):
    rows = [(n, "2", f"k{n}", site_uuid(1), [(f"r{n}", "d", f"2026-08-09T12:{n:02d}:00Z", "5", None)]) for n in numbers]
    return spark.createDataFrame(rows, ARRIVALS)


def values(store, table, column):
    """The values of a column in the files of a table, whatever readers make of them."""
    field, _, part = column.partition(".")
    found = []
    for file in Path(store.root, table).glob("**/*.parquet"):
        for value in pq.ParquetFile(file).read(columns=[field]).column(field).to_pylist():
            found.append(value[part] if part and value is not None else value)
    return found


def test_stages_go_before_the_next_tables_are_written(spark, store, add_sites, monkeypatch):
    """The ledger is written when claims, lookups and verdicts are off the disk, events after the ledger."""
    add_sites(store, (1, "100"))
    before, left, real = staged(spark), {}, Store.write

    def write(self, df, table, *args):
        left[table] = labels(staged(spark) - before)
        return real(self, df, table, *args)

    monkeypatch.setattr(Store, "write", write)
    ingest(store, arrivals(spark, 1, 2), as_of=AS_OF)
    assert left["measurements"] == ["batches", "claims", "verdicts"]
    assert left["batch_ledger"] == ["batches"] and left["events_pending"] == ["events"]
    assert findings(store).collect() == []


def test_files_leave_out_what_a_row_tells(spark, store, add_sites):
    add_sites(store, (1, "100"))
    ingest(store, arrivals(spark, 1, 2), as_of=AS_OF)
    for table, column in (("measurements", "id"), ("batch_ledger", "id"), ("batch_ledger", "response.batch_id"),
                          ("batch_ledger", "response.site_id"), ("ingest_results", "batch_id")):
        assert values(store, table, column) == [None, None], (table, column)
    ids = {r.id for r in store.read("batch_ledger").collect()}
    assert len(ids) == 2 and None not in ids
    assert {r.response.batch_id for r in store.read("batch_ledger").collect()} == ids
    assert {r.response.site_id for r in store.read("batch_ledger").collect()} == {site_uuid(1)}
    assert {r.batch_id for r in store.read("ingest_results").collect()} == ids
    assert {r.batch_id for r in store.read("measurements").collect()} == ids
    assert None not in {r.id for r in store.read("measurements").collect()}


def test_other_ids_are_read_as_they_were_written(spark, store, add_sites):
    add_sites(store, (1, "100"))
    ingest(store, arrivals(spark, 1, 2, 3, 4, 5), as_of=AS_OF)
    n = F.col("arrival_seq")
    odd = F.when(n == 1, F.lit(None)).when(n == 2, "-").when(n == 3, "--x").when(n == 4, "").otherwise(F.col("id"))
    rows = store.read("batch_ledger").drop("epoch").withColumn("id", odd).withColumn(
        "response", F.when(n != 4, F.col("response").withField("batch_id", odd)))
    head = store.head()
    store.commit(head, [store.write(rows, "batch_ledger", head.following, head)], AS_OF)
    want = sorted(map(str, rows.select("arrival_seq", "id", "response").collect()))
    got = store.read("batch_ledger").filter(F.col("epoch") == head.following).select("arrival_seq", "id", "response")
    assert sorted(map(str, got.collect())) == want


def test_events_are_written_once(spark, store, add_sites):
    add_sites(store, (1, "7"))
    ingest(store, arrivals(spark, 1, 2), as_of=AS_OF)
    assert not Path(store.root, "events_out").exists()
    events = sorted(map(str, store.read("events_out").collect()))
    ids = [r.id for r in store.read("events_out").collect()]
    assert len(ids) == 3 == store.pending().count()
    tried = spark.createDataFrame([(i, AS_OF, True, None) for i in ids], DELIVERY_ATTEMPTS)
    log_delivery_attempts(store, tried, as_of=AS_OF)
    assert store.pending().count() == 0
    # What was pending is replaced, but its folder still holds the events.
    store.vacuum(older_than_seconds=-1)
    assert sorted(map(str, store.read("events_out").collect())) == events
    state = delivery_state(store.read("events_out").drop("epoch"), store.read("delivery_attempts"))
    assert state.filter("published_at IS NULL").count() == 0
    ingest(store, arrivals(spark, 3), as_of=AS_OF)
    store.compact(folders=1)
    store.vacuum(older_than_seconds=-1)
    assert set(events) < set(map(str, store.read("events_out").collect())) and store.pending().count() == 1
    assert findings(store).collect() == []


def test_events_of_a_folder_of_their_own_are_read_too(spark, store, add_sites):
    """As earlier versions wrote them: not in buckets."""
    add_sites(store, (1, "100"))
    ingest(store, arrivals(spark, 1), as_of=AS_OF)
    head = store.head()
    more = store.read("events_out", head).drop("epoch").withColumn("id", F.col("id") + 1)
    store.commit(head, [store.write(more, "events_out", head.following, head)], AS_OF)
    assert len({r.id for r in store.read("events_out").collect()}) == 2


def test_packed_texts_lose_nothing(spark):
    texts = ["a" * 64, "0123456789abcdef" * 4, "A" * 64, "g" * 64, "", "-", "--", "h", "x" * 31, "y" * 32, "é", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = rows.select(
        t, F.octet_length(packed_digest(t)).alias("n"), unpacked_digest(packed_digest(t)).alias("digest"),
        or_else(unless(t, F.lit("h")), F.lit("h")).alias("text"), unless(t, F.lit("h")).alias("kept")).collect()
    assert all(r.t == r.digest == r.text for r in got)
    assert [r.n for r in got[:2]] == [32, 32] and [r.t for r in got if r.kept is None] == ["h"]
