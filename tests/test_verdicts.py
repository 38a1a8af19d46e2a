"""Set-wide verdicts against the serial model, on random arrival logs."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from support import AS_OF, site_uuid
from pyspark.sql import functions as F
from serial_model import history, run

from gaugebook.functions.identity import arrival_of, position_of
from gaugebook.operators.dedup import resolve
from gaugebook.operators.linked import parts
from gaugebook.plans.ingest import ingest, register_sites
from gaugebook.plans.reconcile import findings
from gaugebook.schemas import ARRIVALS, LEGACY_ARRIVALS, SITE_FEED
from gaugebook.sources.store import Store

START = datetime(2026, 3, 1, tzinfo=timezone.utc)
READINGS = ("site_id string, device_id string, reading_id string, reading_ts timestamp, "
            "ch4_kg decimal(14,4), ord bigint")


def logs(seed, sites, batches=12):
    rng = random.Random(seed)
    out = []
    for s in range(sites):
        share = rng.choice([0.0, 0.3, 0.5, 0.8, 1.0])
        out += history(rng, f"s{s}", s * 1000, batches, share)
    return out


def frame(spark, batches):
    rows = [
        (site, device, rid, START + timedelta(hours=instant), Decimal(mass), (seq << 7) + pos)
        for seq, site, readings in batches
        for pos, (rid, device, instant, mass) in enumerate(readings)
    ]
    return spark.createDataFrame(rows, READINGS)


def verdicts(df):
    rows = df.select(
        arrival_of(F.col("ord")), position_of(F.col("ord")), "verdict", "stored_kg"
    ).collect()
    assert len({(r[0], r[1]) for r in rows}) == len(rows)
    return {(r[0], r[1]): (r[2], None if r[3] is None else int(r[3])) for r in rows}


@pytest.mark.parametrize("limit", [100_000, 0, 3])
def test_one_epoch(spark, limit):
    """With the ordered pass alone, with rounds alone, and with both."""
    batches = logs(7, 150)
    got = verdicts(resolve(frame(spark, batches), ordered_pass_rows=limit))
    want = run(batches)
    assert {v[0] for v in want.values()} == {
        "accept", "duplicate", "value_conflict", "mixed_identity"}
    assert {k: (got[k], w) for k, w in want.items() if got[k] != w} == {}


def test_one_scheme_needs_no_contested_path(spark):
    rng = random.Random(3)
    for share in (0.0, 1.0):
        batches = [b for s in range(40) for b in history(rng, f"s{s}", s * 1000, 10, share, 0.0)]
        assert verdicts(resolve(frame(spark, batches))) == run(batches)


def test_hot_reading_and_hot_id(spark):
    """A third of all rows repeat one reading, another third one id at many instants."""
    batches = []
    for i in range(300):
        batches.append((3 * i, "hot", [(None, "d", 0, 1 + i % 2)]))
        batches.append((3 * i + 1, "hot", [("r", "e", i % 90, 1)]))
        batches.append((3 * i + 2, "hot", [(None, "e", (i * 7) % 90, 1)]))
    for limit in (100_000, 0):
        assert verdicts(resolve(frame(spark, batches), ordered_pass_rows=limit)) == run(batches)


def _never(_):
    raise AssertionError("a round was taken")


def chain(length, device, seq):
    """Each id occurs at two instants and shares each with the next id; every instant has
    an anonymous reading too, so every verdict hangs on the one before."""
    out = []
    for i in range(length):
        for name, instant in ((f"r{i}", i), (None, i), (f"r{i}", i + 1)):
            out.append((seq + len(out), "s", [(name, device, instant, 1 + i % 2)]))
    return out


def test_a_chain_is_decided_in_one_pass(spark, monkeypatch):
    batches = chain(120, "d", 0)
    monkeypatch.setattr("gaugebook.operators.contested.one_round", _never)
    assert verdicts(resolve(frame(spark, batches))) == run(batches)


def test_parts_of_one_device_are_decided_apart(spark, monkeypatch):
    """One device with far more candidates than a task may walk, in parts that fit."""
    batches = []
    for i in range(60):
        batches += [(s, site, [(r and f"{i}-{r}", d, at + 50 * i, m) for r, d, at, m in rs])
                    for s, site, rs in chain(4, "d", len(batches))]
    monkeypatch.setattr("gaugebook.operators.contested.one_round", _never)
    assert verdicts(resolve(frame(spark, batches), ordered_pass_rows=16)) == run(batches)


def test_parts_of_a_graph(spark):
    rng = random.Random(4)
    for n, links in ((400, [(i, i + 1) for i in range(399)]), (300, [(0, i) for i in range(300)]),
                     (200, [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]), (5, [(1, 1)])):
        root = list(range(n))
        for u, v in links:
            low, high = sorted((root[u], root[v]))
            root = [low if r == high else r for r in root]
        found = parts(spark.createDataFrame(links, "u bigint, v bigint"))
        got = {r.node: r.part for r in found.collect()} if found is not None else {}
        assert set(got) == {x for u, v in links if u != v for x in (u, v)}
        assert len({(root[x], p) for x, p in got.items()}) == len({root[x] for x in got}) == len(set(got.values()))


@pytest.mark.parametrize("cuts", [[5], [2, 8]])
def test_any_split_into_epochs(spark, tmp_path, cuts):
    """The same log through the whole ingest, cut into epochs at any batch."""
    rng = random.Random(11)
    sites = 40
    batches = []
    for s in range(sites):
        batches += history(rng, s, s * 1000, 12, rng.choice([0.0, 0.4, 0.7, 1.0]), 0.3)
    want = run(batches)
    store = Store(spark, str(tmp_path / "store"))
    register_sites(
        store,
        spark.createDataFrame(
            [(site_uuid(s), f"Site {s}", "20.000", None) for s in range(sites)], SITE_FEED),
        as_of=AS_OF,
    )
    edges = [0, *cuts, 12]
    for low, high in zip(edges, edges[1:]):
        part = [b for b in batches if low <= b[0] % 1000 < high]
        # Batches of anonymous readings only may travel in the legacy format.
        old = [b for b in part if all(r[0] is None for r in b[2])]
        new = [b for b in part if b not in old]
        legacy = [
            (seq, site_uuid(site), site_uuid(seq),
             [(d, int((START + timedelta(hours=t)).timestamp()), Decimal(m * 1000))
              for _, d, t, m in rs])
            for seq, site, rs in old
        ]
        current = [
            (seq, "2", f"k{seq}", site_uuid(site),
             [(rid, d, (START + timedelta(hours=t)).isoformat(), str(m), None)
              for rid, d, t, m in rs])
            for seq, site, rs in new
        ]
        ingest(
            store,
            spark.createDataFrame(current, ARRIVALS) if current else None,
            spark.createDataFrame(legacy, LEGACY_ARRIVALS) if legacy else None,
            as_of=AS_OF,
        )
    accepted = {
        (r[0], r[1]): int(r[2])
        for r in store.read("measurements").select(
            arrival_of(F.col("arrival_ord")), position_of(F.col("arrival_ord")), "ch4_kg").collect()
    }
    mass = {(seq, pos): r[3] for seq, _, rs in batches for pos, r in enumerate(rs)}
    assert accepted == {k: mass[k] for k, v in want.items() if v[0] == "accept"}

    total, expected_after, crossed = {}, {}, {}
    for seq, site, rs in sorted(batches, key=lambda b: b[0]):
        before = total.get(site, 0)
        total[site] = before + sum(
            mass[seq, p] for p in range(len(rs)) if want[seq, p][0] == "accept")
        expected_after[seq] = total[site]
        if before <= 20 < total[site]:
            crossed[site_uuid(site)] = seq
    ledger = store.read("batch_ledger")
    after = {r[0]: int(r[1]) for r in ledger.select("arrival_seq", "response.total_kg").collect()}
    assert after == expected_after
    events = store.read("events_out").filter("event_type = 'site.limit_exceeded'")
    crossing = events.withColumn("batch", F.get_json_object("payload", "$.crossedByBatchId")).join(
        ledger.select(F.col("id").alias("batch"), "arrival_seq"), "batch")
    assert {r.aggregate_id: r.arrival_seq for r in crossing.collect()} == crossed
    conflicts = {
        (r.arrival_seq, r.reason): r.n
        for r in ledger.select("arrival_seq", F.explode("response.conflicts").alias("c"))
        .groupBy("arrival_seq", F.col("c.reason").alias("reason")).agg(F.count("*").alias("n"))
        .collect()
    }
    expected = {}
    for (seq, _), (verdict, _) in want.items():
        if verdict in ("value_conflict", "mixed_identity"):
            expected[seq, verdict] = expected.get((seq, verdict), 0) + 1
    assert conflicts == expected
    assert findings(store).collect() == []
