"""The stream ends where the batch ends, also through restarts and crashes."""

import json
from pathlib import Path

import pytest
from support import site_uuid

from gaugebook.plans import ingest as plan
from gaugebook.plans.reconcile import findings
from gaugebook.sources.feeds import stream_arrivals, stream_legacy_arrivals
from gaugebook.sources.store import Store
from gaugebook.streaming.ingest_stream import start_ingest


def drop(folder: Path, name: str, *rows):
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps({"arrival_seq": s, "api_version": "2", "idempotency_key": k,
                    "site_id": site_uuid(1), "readings": rs})
        for s, k, rs in rows
    ]
    (folder / f"{name}.json").write_text("\n".join(lines))


def reading(minute, kg="5", **more):
    return {"deviceId": "d", "readingTs": f"2026-08-09T12:{minute:02d}:00Z", "ch4Kg": kg, **more}


def run(spark, store, tmp_path):
    query = start_ingest(
        store, stream_arrivals(spark, str(tmp_path / "in"), 1), str(tmp_path / "checkpoint"))
    query.awaitTermination()


def test_stream(spark, store, add_sites, tmp_path, monkeypatch):
    add_sites(store, (1, "12"))
    drop(tmp_path / "in", "a", (1, "k1", [reading(1)]), (2, "k2", [reading(2)]))
    run(spark, store, tmp_path)
    # A retry of k1 and an out-of-order backfill.
    drop(tmp_path / "in", "b", (3, "k1", [reading(1)]), (4, "k4", [reading(0)]))

    # Lost after some sinks, before the commit: the same micro-batch runs again.
    def lost(store_, head, tables, epoch, replaces):
        store_.write(tables["measurements"], "measurements", epoch)
        raise RuntimeError("executor gone")

    with monkeypatch.context() as m:
        m.setattr(plan, "_write_all", lost)
        with pytest.raises(Exception, match="executor gone"):
            run(spark, store, tmp_path)
    run(spark, store, tmp_path)

    # Lost after the commit, before the checkpoint knows: the batch is offered again.
    drop(tmp_path / "in", "c", (5, "k5", [reading(5, "1")]))
    real = Store.commit

    def commit_then_die(self, *args, **kwargs):
        real(self, *args, **kwargs)
        raise RuntimeError("driver gone")

    with monkeypatch.context() as m:
        m.setattr(Store, "commit", commit_then_die)
        with pytest.raises(Exception, match="driver gone"):
            run(spark, store, tmp_path)
    run(spark, store, tmp_path)

    row = store.summary().first()
    assert (str(row.total_kg), row.measurement_count, row.version) == ("16.0000", 4, 4)
    assert row.first_reading_at.minute == 0 and row.last_reading_at.minute == 5
    assert store.read("events_out").filter("event_type = 'site.limit_exceeded'").count() == 1
    assert store.read("ingest_results").filter("idempotent_replay").count() == 1
    assert findings(store).collect() == []

    # A lost checkpoint reads everything again: only replays.
    query = start_ingest(
        store, stream_arrivals(spark, str(tmp_path / "in")), str(tmp_path / "other"), name="fresh")
    query.awaitTermination()
    again = store.summary().first()
    assert (again.total_kg, again.measurement_count, again.version) == (
        row.total_kg, row.measurement_count, row.version)
    assert findings(store).collect() == []


def test_one_stream_of_both_formats(spark, store, add_sites, tmp_path):
    """Both formats share an epoch, its order and its identities."""
    add_sites(store, (1, "100"))
    drop(tmp_path / "in", "a", (1, "k1", [reading(1)]), (4, "k4", [reading(3, "2")]))
    (tmp_path / "old").mkdir()

    def legacy(name, *rows):
        lines = [json.dumps({"arrival_seq": s, "site_id": site_uuid(1), "batch_id": b, "readings": rs}) for s, b, rs in rows]
        (tmp_path / "old" / f"{name}.json").write_text("\n".join([*lines, "broken"]))

    # 12:01 again with the same mass, 12:03 ahead of the current batch, 12:04 alone.
    at = lambda minute, grams: {"device_id": "d", "ts": 1786276800 + 60 * minute, "ch4_g": grams}
    legacy("a", (2, "00000000-0000-4000-8000-0000000000b2", [at(1, 5000)]), (3, "00000000-0000-4000-8000-0000000000b3", [at(3, 3000), at(4, 1000)]))

    def run_both():
        start_ingest(store, stream_arrivals(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint"),
                     legacy=stream_legacy_arrivals(spark, str(tmp_path / "old"))).awaitTermination()

    run_both()
    assert store.head().epoch == 2
    row = store.summary().first()
    assert (str(row.total_kg), row.measurement_count, row.version) == ("9.0000", 3, 4)
    assert store.read("ingest_results").groupBy("api_version").count().count() == 2
    assert [r.code for r in store.read("rejects").collect()] == ["VALIDATION_ERROR"]
    drop(tmp_path / "in", "b", (9, "k9", [reading(9, "1")]))
    run_both()
    assert str(store.summary().first().total_kg) == "10.0000" and findings(store).collect() == []
