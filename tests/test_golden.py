"""The golden cases, once as one epoch and once spread over many."""

from collections import Counter
from decimal import Decimal

import pytest
from support import AS_OF, site_uuid
from golden import CASES
from pyspark.sql import functions as F

from gaugebook.plans.ingest import ingest
from gaugebook.plans.reconcile import findings
from gaugebook.plans.reports import conflicts_view, response_text, responses
from gaugebook.schemas import ARRIVALS, LEGACY_ARRIVALS
from gaugebook.sources.store import Store


def _arrivals(step=None):
    """(current rows, legacy rows, seq -> (case, index)); `step` picks positions."""
    current, legacy, where = [], [], {}
    for c, case in enumerate(CASES):
        for i, arrival in enumerate(case.arrivals):
            if step is not None and i not in step:
                continue
            seq = i * 1000 + c
            where[seq] = (c, i)
            key, readings, *kind = arrival
            if kind:
                rows = [(d, ts, Decimal(g)) for d, ts, g in readings]
                legacy.append((seq, site_uuid(c), key, rows))
            else:
                current.append((seq, "2", key, site_uuid(c), readings))
    return current, legacy, where


@pytest.fixture(scope="module", params=["one epoch", "four epochs"])
def done(request, spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("golden")))
    from gaugebook.plans.ingest import register_sites
    from gaugebook.schemas import SITE_FEED

    rows = [(site_uuid(c), f"{c:03d}", case.limit, None) for c, case in enumerate(CASES)]
    register_sites(store, spark.createDataFrame(rows, SITE_FEED), as_of=AS_OF)
    steps = [None] if request.param == "one epoch" else [{0}, {1}, {2, 3, 4}, set(range(5, 20))]
    where = {}
    for step in steps:
        current, legacy, seen = _arrivals(step)
        where.update(seen)
        ingest(
            store,
            spark.createDataFrame(current, ARRIVALS) if current else None,
            spark.createDataFrame(legacy, LEGACY_ARRIVALS) if legacy else None,
            as_of=AS_OF,
        )
    return store, where


def test_outcomes(done):
    store, where = done
    got = {}
    answers = responses(store.read("ingest_results"), store.read("batch_ledger")).collect()
    for row in answers:
        got[where[row.arrival_seq]] = (
            "replayed" if row.idempotent_replay else ("accepted", row.readings_accepted)
        )
    for row in store.read("rejects").collect():
        got[where[row.arrival_seq]] = row.code
        if row.code == "VALIDATION_ERROR":
            assert row.details
    expected = {
        (c, i): e for c, case in enumerate(CASES) for i, e in enumerate(case.expect)
    }
    wrong = {(CASES[c].name, i): (got.get((c, i)), e)
             for (c, i), e in expected.items() if got.get((c, i)) != e}
    assert not wrong


def test_totals_twice(done):
    """Stored summary and recomputed sum, both against the expected figures."""
    store, _ = done
    summary = {r.site_id: (r.total_kg, r.measurement_count) for r in store.summary().collect()}
    rows = {
        r.site_id: (r.kg, r.n)
        for r in store.read("measurements").groupBy("site_id")
        .agg(F.sum("ch4_kg").alias("kg"), F.count("*").alias("n")).collect()
    }
    for c, case in enumerate(CASES):
        want = (Decimal(case.total), case.count)
        assert summary.get(site_uuid(c), (Decimal(0), 0)) == want, case.name
        assert rows.get(site_uuid(c), (Decimal(0), 0)) == want, case.name


def test_conflicts(done):
    store, where = done
    got = {}
    for r in conflicts_view(store.read("batch_ledger")).orderBy("arrival_seq", "pos").collect():
        case = where[r.arrival_seq][0]
        got.setdefault(case, []).append((r.reason, str(r.submitted_kg), str(r.stored_kg)))
    for c, case in enumerate(CASES):
        assert got.get(c, []) == case.conflicts, case.name


def test_events(done):
    store, _ = done
    got = {}
    for e in store.read("events_out").orderBy("id").collect():
        got.setdefault(e.aggregate_id, []).append(e.event_type)
    for c, case in enumerate(CASES):
        if case.events is not None:
            assert got.get(site_uuid(c), []) == case.events, case.name


def test_versions_count_claimed_batches(done):
    store, _ = done
    versions = {r.site_id: r.version for r in store.summary().collect()}
    for c, case in enumerate(CASES):
        claimed = Counter(isinstance(e, tuple) for e in case.expect)[True]
        assert versions.get(site_uuid(c), 0) == claimed, case.name


def test_everything_reconciles(done):
    store, _ = done
    assert findings(store).collect() == []


def test_replay_is_the_original_but_for_the_flag(done):
    store, where = done
    texts = response_text(responses(store.read("ingest_results"), store.read("batch_ledger")))
    by_arrival = {where[r.arrival_seq]: r.response for r in texts.collect()}
    ten = next(i for i, c in enumerate(CASES) if c.name.startswith("G23"))
    first = by_arrival[(ten, 0)]
    assert '"acceptedCh4Kg":"200.0000"' in first and '"idempotentReplay":false' in first
    for i in range(1, 10):
        assert by_arrival[(ten, i)] == first.replace(
            '"idempotentReplay":false', '"idempotentReplay":true'
        )
    none = next(i for i, c in enumerate(CASES) if c.name.startswith("G18"))
    assert '"acceptedCh4Kg":"0"' in by_arrival[(none, 1)]
