"""Listings, windows, spans, calendar and delivery on small stores."""

from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from support import AS_OF, site_uuid
from pyspark.sql import functions as F

from gaugebook.operators.events import backlog, delivery_state, eligible, next_deliveries
from gaugebook.plans.ingest import ingest, log_delivery_attempts
from gaugebook.plans.reconcile import month_calendar, reconcile_sites
from gaugebook.plans.reports import months_between, one_site, site_metrics, site_page, site_view
from gaugebook.schemas import ARRIVALS, DELIVERY_ATTEMPTS, EVENTS_OUT


def send(spark, store, seq, *readings, site=1):
    rows = [(seq, "2", f"k{seq}", site_uuid(site), [(None, "d", ts, kg, None) for ts, kg in readings])]
    ingest(store, spark.createDataFrame(rows, ARRIVALS), as_of=AS_OF)


def test_pages_walk_every_site_once(spark, store, add_sites):
    add_sites(store, *[(n, "10") for n in range(7)])
    view = lambda: (store.read("sites"), store.summary())
    seen, after = [], None
    while True:
        page, after = site_page(*view(), after, 3)
        seen += [r.id for r in page]
        if len(seen) == 3:
            add_sites(store, (100, "10"))  # sorts behind "Site 1": not yet passed
        if after is None:
            break
    everything, nothing = site_page(*view(), None, 200)
    assert nothing is None and len(set(seen)) == len(seen)
    assert set(r.id for r in everything) >= set(seen) >= {site_uuid(n) for n in range(7)}
    for bad in (0, 201):
        with pytest.raises(ValueError):
            site_page(*view(), None, bad)


def test_metrics_window_is_closed(spark, store, add_sites):
    add_sites(store, (1, "100"), (2, "100"))
    send(spark, store, 1, ("2026-08-09T12:00:00Z", "1"), ("2026-08-09T11:59:59.999Z", "2"),
         ("2026-08-10T12:00:00Z", "4"), ("2026-08-10T12:00:00.001Z", "8"), ("2026-08-11T12:00:00Z", "42"))
    as_of = datetime(2026, 8, 10, 12, tzinfo=timezone.utc)
    rows = {r.id: r for r in site_metrics(
        store.read("sites"), store.summary(), store.read("measurements"), as_of).collect()}
    assert rows[site_uuid(1)].last_24h_kg == Decimal("5") and rows[site_uuid(1)].total_kg == Decimal("57")
    empty = rows[site_uuid(2)]
    assert (empty.last_24h_kg, empty.total_kg, empty.first_reading_at) == (0, 0, None)
    assert one_site(site_view(store.read("sites"), store.summary()), site_uuid(9)).count() == 0


def test_window_months():
    assert months_between(datetime(2025, 12, 31), datetime(2026, 1, 1)) == ["2025-12", "2026-01"]


def test_spans_widen_only(spark, store, add_sites):
    add_sites(store, (1, "1000"))
    def span():
        row = store.summary().first()
        return (f"{row.first_reading_at:%m-%d}", f"{row.last_reading_at:%m-%d}")

    send(spark, store, 1, ("2026-06-01T00:00:00Z", "1"), ("2026-06-15T00:00:00Z", "1"))
    assert span() == ("06-01", "06-15")
    send(spark, store, 2, ("2026-05-01T00:00:00Z", "1"))
    assert span() == ("05-01", "06-15")
    send(spark, store, 3, ("2026-05-01T00:00:00Z", "1"))
    assert span() == ("05-01", "06-15")
    assert store.summary().first().version == 3


def test_drift_is_named(spark, store, add_sites):
    add_sites(store, (1, "1000"), (2, "1000"))
    send(spark, store, 1, ("2026-06-01T00:00:00Z", "5"))
    off = store.summary().withColumn("total_kg", (F.col("total_kg") + 1).cast("decimal(18,4)"))
    ghost = spark.createDataFrame([(site_uuid(2), AS_OF)], "site_id string, first_reading_at timestamp")
    rows = {r.site_id: r for r in reconcile_sites(
        store.read("sites"), off.unionByName(ghost, allowMissingColumns=True),
        store.read("measurements")).collect()}
    assert rows[site_uuid(1)].total_verdict == "double counted"
    assert rows[site_uuid(2)].span_verdict == "span without readings"


def test_calendar(spark):
    months = [r.month for r in month_calendar(spark, date(2026, 8, 15)).orderBy("month").collect()]
    assert (months[0], months[-1], len(months)) == ("2026-02", "2027-02", 13)
    later = [r.month for r in month_calendar(spark, date(2026, 8, 15), date(2027, 1, 31)).collect()]
    assert max(later) == "2027-04" and len(later) == 15


def test_delivery(spark, store):
    """A full page of exhausted events must not hide the fresh one behind them."""
    events = spark.createDataFrame(
        [(i, "site", site_uuid(1), "test", "{}", AS_OF) for i in range(55)], EVENTS_OUT)
    log = [(i, AS_OF - timedelta(minutes=n), False, "no") for i in range(50) for n in range(1, 11)]
    log += [
        (50, AS_OF - timedelta(seconds=29), None, None),  # held by a live claim
        (51, AS_OF - timedelta(seconds=31), None, None),  # claim lapsed
        (52, AS_OF - timedelta(seconds=31), False, "first " + "x" * 600),
        (53, AS_OF - timedelta(minutes=2), False, "old"), (53, AS_OF - timedelta(minutes=1), True, None),
    ]
    log_delivery_attempts(store, spark.createDataFrame(log, DELIVERY_ATTEMPTS), as_of=AS_OF)
    state = delivery_state(events, store.read("delivery_attempts"))
    now = F.lit(AS_OF)
    assert [r.id for r in next_deliveries(state, now).collect()] == [51, 52, 54]
    assert next_deliveries(state, now, 2).count() == 2
    assert tuple(backlog(state).first()) == (4, 50)
    by_id = {r.id: r for r in state.collect()}
    assert len(by_id[52].last_error) == 500 and by_id[52].attempts == 1
    assert by_id[53].published_at and by_id[53].last_error == "old"
    assert by_id[54].claimed_at is None and eligible(state, now).count() == 3
