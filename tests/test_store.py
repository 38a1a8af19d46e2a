"""Commits: what readers see, and what a rerun does."""

from decimal import Decimal

import pytest
from support import AS_OF, site_uuid
from pyspark.sql import functions as F

from gaugebook.plans import ingest as plan
from gaugebook.plans.ingest import ingest
from gaugebook.plans.reconcile import findings
from gaugebook.schemas import ARRIVALS, SITE_FEED


def arrivals(spark, *rows):
    """rows: (seq, key, [(rid, device, ts, kg)])"""
    return spark.createDataFrame(
        [(s, "2", k, site_uuid(1), [(*r, "sensor") for r in rs]) for s, k, rs in rows], ARRIVALS
    )


def one(spark, seq, kg="5", key=None):
    return arrivals(
        spark, (seq, key or f"k{seq}", [(None, "d", f"2026-08-09T12:00:{seq:02d}Z", kg)]))


def figures(store):
    total = {r.site_id: (str(r.total_kg), r.measurement_count) for r in store.summary().collect()}
    return total.get(site_uuid(1)), store.read("measurements").count()


def test_crash_between_sinks_then_rerun(spark, store, add_sites, monkeypatch):
    add_sites(store, (1, "100"))
    ingest(store, one(spark, 1), as_of=AS_OF)
    before = figures(store)

    def half(store_, head, tables, epoch, replaces):
        for name in ("measurements", "site_summary"):
            store_.write(tables[name], name, epoch)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(plan, "_write_all", half)
        with pytest.raises(RuntimeError):
            ingest(store, one(spark, 2), as_of=AS_OF)
    assert figures(store) == before
    assert findings(store).collect() == []
    # The rerun carries other input: nothing of the lost attempt may remain.
    ingest(store, one(spark, 3, "7"), as_of=AS_OF)
    assert figures(store) == (("12.0000", 2), 2)
    assert findings(store).collect() == []


def test_stages_are_dropped(spark, store, add_sites):
    from pathlib import Path

    from gaugebook.session import checkpoint_root

    folder = Path(checkpoint_root(spark).removeprefix("file:")) / "gaugebook"
    before = {p for p in folder.glob("*/*")}
    add_sites(store, (1, "100"))
    ingest(store, one(spark, 1), as_of=AS_OF)
    assert {p for p in folder.glob("*/*")} == before
    assert figures(store) == (("5.0000", 1), 1)


def test_a_stream_batch_is_applied_once(spark, store, add_sites):
    add_sites(store, (1, "100"))
    first = ingest(store, one(spark, 1), as_of=AS_OF, stream=("s", 0))
    again = ingest(store, one(spark, 2), as_of=AS_OF, stream=("s", 0))
    assert first == again and figures(store) == (("5.0000", 1), 1)
    ingest(store, one(spark, 2), as_of=AS_OF, stream=("s", 1))
    ingest(store, one(spark, 3), as_of=AS_OF, stream=("other", 0))
    assert figures(store) == (("15.0000", 3), 3)
    assert store.head().streams == {"s": 1, "other": 0}


def test_empty_epoch(spark, store, add_sites):
    add_sites(store, (1, "100"))
    ingest(store, one(spark, 1), as_of=AS_OF)
    ingest(store, one(spark, 2).filter("false"), as_of=AS_OF)
    assert figures(store) == (("5.0000", 1), 1)


def test_unknown_site_and_order_of_outcomes(spark, store, add_sites):
    add_sites(store, (1, "100"))
    ts = "2026-08-09T12:00:00Z"
    rows = [
        (1, "2", "k", site_uuid(9), [(None, "d", ts, "1", "sensor")]),  # site missing
        (2, "2", "", site_uuid(9), [(None, "d", ts, "1", "sensor")]),  # key first
        (3, "2", "", site_uuid(9), [(None, "d", ts, "x", "sensor")]),  # body first
        (4, "2", "k", "nowhere", [(None, "d", ts, "1", "sensor")]),
    ]
    ingest(store, spark.createDataFrame(rows, ARRIVALS), as_of=AS_OF)
    got = {r.arrival_seq: (r.code, [d.path for d in r.details]) for r in store.read("rejects").collect()}
    assert got == {
        1: ("SITE_NOT_FOUND", []),
        2: ("VALIDATION_ERROR", ["Idempotency-Key"]),
        3: ("VALIDATION_ERROR", ["readings.0.ch4Kg"]),
        4: ("VALIDATION_ERROR", ["siteId"]),
    }
    assert store.read("measurements").count() == 0


def test_detail_paths_of_cross_reading_rules(spark, store, add_sites):
    add_sites(store, (1, "100"))
    t = "2026-08-09T12:00:0{}Z".format
    ingest(store, arrivals(
        spark,
        (1, "a", [(None, "d", t(0), "1"), (None, "d", t(1), "1"), (None, "d", t(0), "2")]),
        (2, "b", [("x", "d", t(0), "1"), (None, "e", t(0), "1"), (None, "d", t(0), "2"),
                  ("x", "d", t(3), "2")]),
    ), as_of=AS_OF)
    got = {r.arrival_seq: [d.path for d in r.details] for r in store.read("rejects").collect()}
    assert got == {1: ["readings.2"], 2: ["readings.3", "readings.2"]}


def rejects(store):
    return sorted((r.arrival_seq or -1, r.code, [d.path for d in r.details]) for r in store.read("rejects").collect())


def test_unusable_positions_are_rejects(spark, store, add_sites):
    add_sites(store, (1, "100"))
    t = "2026-08-09T12:00:0{}Z".format
    feed = arrivals(spark, (None, "a", [(None, "d", t(0), "1")]), (-1, "b", [(None, "d", t(1), "1")]),
                    (1 << 56, "c", [(None, "d", t(2), "1")]), (4, "d", [(None, "d", t(3), "5")]))
    ingest(store, feed, as_of=AS_OF)
    assert rejects(store) == [(-1, "VALIDATION_ERROR", ["arrival_seq"])] * 3
    assert figures(store) == (("5.0000", 1), 1) and findings(store).collect() == []


def test_one_position_for_two_arrivals(spark, store, add_sites):
    """One of them counts, the other is refused; nothing stops."""
    add_sites(store, (1, "100"))
    ingest(store, arrivals(
        spark,
        (1, "k1", [(None, "d", "2026-08-09T12:00:00Z", "1")]),
        (1, "k2", [(None, "d", "2026-08-09T13:00:00Z", "1")]),
        (2, "k3", [(None, "d", "2026-08-09T14:00:00Z", "1")]),
    ), as_of=AS_OF)
    assert rejects(store) == [(1, "VALIDATION_ERROR", ["arrival_seq"])]
    assert figures(store) == (("2.0000", 2), 2) and findings(store).collect() == []


def test_redelivery_in_one_epoch_is_a_replay(spark, store, add_sites):
    add_sites(store, (1, "100"))
    ingest(store, one(spark, 1).union(one(spark, 1)).union(one(spark, 1)).union(one(spark, 2)), as_of=AS_OF)
    got = sorted((r.arrival_seq, r.idempotent_replay) for r in store.read("ingest_results").collect())
    assert got == [(1, False), (1, True), (1, True), (2, False)]
    assert figures(store) == (("10.0000", 2), 2) and rejects(store) == []


def test_broken_lines_are_rejects(spark, store, add_sites, tmp_path):
    from gaugebook.sources.feeds import read_arrivals

    add_sites(store, (1, "100"))
    good = one(spark, 1).toJSON().first()
    (tmp_path / "feed.json").write_text(f'{good}\n{good[:40]}\nnot json\n[1]\n')
    ingest(store, read_arrivals(spark, str(tmp_path / "feed.json")), as_of=AS_OF)
    texts = [d.message for r in store.read("rejects").collect() for d in r.details]
    assert len(texts) == 3 and any(m.endswith("not json") for m in texts)
    assert figures(store) == (("5.0000", 1), 1)


def test_a_crashed_epoch_stays_unseen_after_other_commits(spark, store, add_sites):
    from gaugebook.plans.ingest import log_delivery_attempts
    from gaugebook.schemas import DELIVERY_ATTEMPTS

    add_sites(store, (1, "100"))
    ingest(store, one(spark, 1), as_of=AS_OF)
    head, before = store.head(), figures(store)
    for table in ("measurements", "batch_ledger", "site_summary"):  # lost before its commit
        store.write(store.read(table, head).drop("epoch"), table, head.epoch + 1)
    add_sites(store, (2, "100"))
    log_delivery_attempts(store, spark.createDataFrame([(2, AS_OF, True, None)], DELIVERY_ATTEMPTS), as_of=AS_OF)
    assert figures(store) == before and findings(store).collect() == []
    ingest(store, one(spark, 2), as_of=AS_OF)
    assert figures(store) == (("10.0000", 2), 2) and findings(store).collect() == []
    assert store.vacuum(older_than_seconds=-1) >= 3
    assert figures(store) == (("10.0000", 2), 2)


def test_two_writers(spark, store, add_sites, tmp_path):
    """Both commit: who comes second decides again on the new state."""
    from concurrent.futures import ThreadPoolExecutor

    add_sites(store, (1, "100"))
    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(ingest, store, one(spark, n), as_of=AS_OF) for n in (1, 2)]
        assert sorted(j.result() for j in jobs) == [2, 3]
    assert figures(store) == (("10.0000", 2), 2) and findings(store).collect() == []


def test_a_stale_writer_never_replaces_a_commit(spark, store, add_sites):
    from gaugebook.sources.store import CommitConflict

    add_sites(store, (1, "100"))
    stale = store.head()
    ingest(store, one(spark, 1), as_of=AS_OF)
    with pytest.raises(CommitConflict):
        store.commit(stale, [], AS_OF)
    assert figures(store) == (("5.0000", 1), 1)


def test_compaction_changes_no_row(spark, store, add_sites):
    add_sites(store, (1, "100"))
    for n in (1, 2, 3):
        ingest(store, one(spark, n), as_of=AS_OF)
    tables = sorted(store.head().tables)
    before = {t: sorted(map(str, store.read(t).collect())) for t in tables}
    store.compact(folders=1)
    assert {t: len(f) for t, f in store.head().folders.items()} == {t: 1 for t in tables}
    assert {t: sorted(map(str, store.read(t).collect())) for t in tables} == before
    assert store.vacuum(older_than_seconds=-1) > 0
    ingest(store, one(spark, 4), as_of=AS_OF)
    assert figures(store) == (("20.0000", 4), 4) and findings(store).collect() == []


def test_registration_loses_nothing(spark, store, add_sites):
    from gaugebook.plans.ingest import register_sites

    add_sites(store, (1, "100"), (2, "0"))
    feed = [(site_uuid(1), "again", "999", None), (site_uuid(3), "Y", "20", None), (site_uuid(3), "X", "10", None),
            (site_uuid(4), "Z", "12.3456", None), (None, "twin", "5", None), (None, "twin", "5", None)]
    register_sites(store, spark.createDataFrame(feed, SITE_FEED).repartition(3), as_of=AS_OF)
    sites = store.read("sites").collect()
    assert {s.id: s.emission_limit_kg for s in sites if s.name != "twin"} == {
        site_uuid(1): Decimal("100.000"), site_uuid(3): Decimal("10.000")}
    assert len({s.id for s in sites if s.name == "twin"}) == 2
    assert len(sites) + store.read("rejects").count() == len(feed) + 2


def test_broken_registrations_keep_their_text(spark, store, tmp_path):
    from gaugebook.plans.ingest import register_sites
    from gaugebook.sources.feeds import read_site_feed

    good = '{"id": "%s", "name": "A", "emissionLimitKg": "10", "metadata": "{}"}' % site_uuid(1)
    (tmp_path / "sites.json").write_text(f"{good}\n{good[:30]}\nnot json\nnot json\n")
    register_sites(store, read_site_feed(spark, str(tmp_path / "sites.json")), as_of=AS_OF)
    assert [s.id for s in store.read("sites").collect()] == [site_uuid(1)]
    texts = sorted(d.message for r in store.read("rejects").collect() for d in r.details)
    assert len(texts) == 3 and texts[0] == texts[1] == "unreadable record: not json" and good[:30] in texts[2]


def test_months_partition_and_odd_clocks(spark, store, add_sites):
    """A wrong clock never fails an epoch; its month is just another folder."""
    add_sites(store, (1, "100"))
    ingest(store, arrivals(
        spark,
        (1, "a", [(None, "d", "1971-01-01T00:00:00Z", "1")]),
        (2, "b", [(None, "d", "2999-12-31T23:59:59.999Z", "1")]),
    ), as_of=AS_OF)
    months = {r.month for r in store.read("measurements").select("month").collect()}
    assert months == {"1971-01", "2999-12"}
    old = store.read("measurements").filter(F.col("month") == "1971-01")
    files = [r[0] for r in old.select("_metadata.file_path").collect()]
    assert len(files) == 1 and "month=1971-01" in files[0]


def test_rejected_site_id_case_is_one_site(spark, store):
    from gaugebook.plans.ingest import register_sites

    upper = "ABCDEF00-0000-4000-8000-000000000001"
    register_sites(store, spark.createDataFrame([(upper, "A", "10", None)], SITE_FEED), as_of=AS_OF)
    rows = [(1, "2", "k", upper, [(None, "d", "2026-08-09T12:00:00Z", "1", None)])]
    ingest(store, spark.createDataFrame(rows, ARRIVALS), as_of=AS_OF)
    assert store.summary().first().site_id == upper.lower()
