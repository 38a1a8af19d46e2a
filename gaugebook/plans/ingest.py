"""One epoch of ingest: a set of arrivals in, six tables out, one commit.

    arrivals -> validated -> claimed -> readings -> verdicts -> batches
                                |                       |          |
                             results                measurements  ledger, events,
                             rejects                identities    site summary

Order inside the epoch is arrival_seq; the outcome equals applying the batches
one after the other.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugebook.functions.compliance import compliance_status
from gaugebook.functions.identity import IDENTIFIED_KEY, INSTANT_KEY, arrival_ord
from gaugebook.functions.values import derived_uuid, month_of, packed_digest, unpacked_digest
from gaugebook.operators.claims import decide_claims, redelivered
from gaugebook.operators.dedup import ACCEPT, resolve, stored_scheme
from gaugebook.operators.events import advance_pending, event_rows, event_seeds, newly_pending, numbered
from gaugebook.operators.lookups import shared
from gaugebook.operators.totals import (
    advance_summary,
    batch_deltas,
    site_deltas,
    totals_after,
)
from gaugebook.operators.validate import check_current, check_legacy, check_sites
from gaugebook.plans.reconcile import recomputed
from gaugebook.schemas import ATTEMPT_LOG, VALIDATION_ERROR
from gaugebook.session import dropping_stages, release, stage
from gaugebook.sources.store import CommitConflict, Head, Keys, Store, Written


@dataclass
class Epoch:
    """What an epoch decided, before anything is written to the tables. All are staged;
    batches are told by their keys, and have digests as bytes: see `batch_id`."""

    claims: DataFrame
    verdicts: DataFrame
    batches: DataFrame


def batch_id() -> Column:
    return derived_uuid(F.col("site_id"), F.col("idempotency_key"))


def checked_arrivals(current: DataFrame | None, legacy: DataFrame | None) -> DataFrame:
    parts = []
    if current is not None:
        parts.append(check_current(current))
    if legacy is not None:
        parts.append(check_legacy(legacy))
    if not parts:
        raise ValueError("give current arrivals, legacy arrivals, or both")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def exploded_readings(claims: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The readings of claimed batches, keyed by their order of arrival. `batch`: the column
    that tells their batch."""
    return claims.filter("owns").select(
        "arrival_seq", "site_id", batch, F.posexplode("readings").alias("pos", "r")
    ).select(
        "site_id",
        "r.device_id",
        "r.reading_id",
        "r.reading_ts",
        "r.ch4_kg",
        "r.source",
        batch,
        arrival_ord(F.col("arrival_seq"), F.col("pos")).alias("ord"),
    )


def claim_epoch(
    checked: DataFrame,
    sites: DataFrame,
    ledger: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The claims of an epoch, see `claimed`."""
    return claimed(checked, sites, ledger)[0]


def claimed(
    checked: DataFrame,
    sites: DataFrame,
    ledger: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Claims of an epoch, staged: both the readings and the results read them. `ledger` may
    be a function that gives the part of the ledger that can hold the keys of the arrivals.

    The validated feed is staged too, numbered by row, because claiming reads it several
    times (for copies of an arrival, for the first arrival of each key) and parsing is the
    expensive part. The second frame is the stage behind the claims, to be released.
    """
    site_ids = sites.select(F.col("id").alias("site_id"))
    with dropping_stages(checked.sparkSession):
        numbered = redelivered(checked)
        if callable(ledger):
            ledger = ledger(numbered)
        claims = decide_claims(numbered, site_ids, ledger)
        # Batch ids are worked out by whoever reads them: they hardly compress.
        staged = stage(claims.drop("batch_id"), "claims", "zstd", outlives=True)
    return staged.withColumn("batch_id", F.when(F.col("code").isNull(), batch_id())).select(*claims.columns), staged


def decide_epoch(
    claims: DataFrame,
    sites: DataFrame,
    stored_instants: DataFrame | None = None,
    stored_ids: DataFrame | None = None,
    opening: DataFrame | None = None,
) -> Epoch:
    with dropping_stages(claims.sparkSession):
        readings = exploded_readings(claims, "idempotency_key")
        verdicts = stage(resolve(readings, stored_instants, stored_ids), "verdicts", "zstd", outlives=True)
    limits = sites.select(
        F.col("id").alias("site_id"), F.col("name").alias("site_name"), "emission_limit_kg"
    )
    with dropping_stages(claims.sparkSession):
        owned = claims.filter("owns")
        # Totals run over narrow rows; keys, digests and conflicts are joined to them once, at the end.
        deltas = stage(batch_deltas(verdicts), "deltas", "zstd")
        moved = owned.select("arrival_seq", "site_id").join(deltas.select("arrival_seq", "accepted_ch4_kg"), "arrival_seq")
        moved = stage(moved.join(limits, "site_id"), "moved", "zstd")
        totals = totals_after(moved, opening).drop("accepted_ch4_kg")
        figures = stage(deltas.join(totals, "arrival_seq"), "figures", "zstd")
        release(deltas, moved)
        digest = packed_digest(F.col("fingerprint")).alias("fingerprint")
        batches = owned.select("arrival_seq", "api_version", "idempotency_key", digest).join(figures, "arrival_seq")
        batches = stage(batches, "batches", "zstd", outlives=True)
    return Epoch(claims, verdicts, batches)


def _stored_state(
    store: Store, head: Head, claims: DataFrame
) -> tuple[DataFrame | None, DataFrame | None]:
    """What the tables already hold for the keys of this epoch."""
    readings = exploded_readings(claims)
    instants = ids = None
    if "measurements" in head.tables:
        # Catalyst does not derive a month predicate from reading_ts, so the months
        # of the epoch (a calendar-bounded list) prune the partitions up front.
        months = [r[0] for r in readings.select(month_of(F.col("reading_ts"))).distinct().collect()]
        slice_ = store.read("measurements", head).filter(F.col("month").isin(months))
        with dropping_stages(store.spark):
            held = shared(INSTANT_KEY, readings, slice_).only(slice_)
            instants = stage(stored_scheme(held), "stored-instants", "zstd", outlives=True)
    if "reading_identities" in head.tables:
        named = readings.filter("reading_id IS NOT NULL")
        keys = store.keys(named, "reading_identities", head)
        held = store.read("reading_identities", head, keys)
        with dropping_stages(store.spark):
            ids = shared(IDENTIFIED_KEY, named, held).only(held)
            ids = stage(ids.select(*IDENTIFIED_KEY, F.col("ch4_kg").alias("s_kg")), "stored-ids", "zstd", outlives=True)
    return instants, ids


def measurement_rows(verdicts: DataFrame, as_of: Column) -> DataFrame:
    """FLT-12 / SNK-1: accepted readings as table rows. Ids are made once the narrower rows
    are where they belong."""
    rows = verdicts.filter(F.col("verdict") == ACCEPT).select(
        "site_id", "idempotency_key", "reading_id", "device_id", "reading_ts", "ch4_kg", "source",
        F.col("ord").alias("arrival_ord"),
        month_of(F.col("reading_ts")).alias("month"),
    )
    # Whole months stay together and sorted by site, so files are few and their
    # row-group statistics prune; a hot month or site spreads over many ranges.
    order = ["month", "site_id", "reading_ts"]
    return (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("batch_id", batch_id())
        .withColumns(
            {"id": derived_uuid(F.col("batch_id"), F.col("arrival_ord")), "created_at": as_of}
        )
        .drop("idempotency_key")
    )


def ledger_rows(batches: DataFrame, as_of: Column) -> DataFrame:
    """SNK-2: the batch with the response that any retry gets back."""
    batches = batches.withColumn("batch_id", batch_id())
    response = F.struct(
        "batch_id",
        "site_id",
        "readings_submitted",
        "readings_accepted",
        "accepted_ch4_kg",
        "total_kg",
        compliance_status(F.col("total_kg"), F.col("emission_limit_kg")).alias("compliance_status"),
        "conflicts",
    )
    return batches.withColumns({
        "id": F.col("batch_id"),
        "request_hash": unpacked_digest(F.col("fingerprint")),
        "status": F.lit("completed"),
        "response": response,
        "created_at": as_of,
        "completed_at": as_of,
    })


def result_rows(claims: DataFrame) -> DataFrame:
    """Accepted and replayed arrivals; a replay points at the batch it repeats."""
    return claims.filter("code IS NULL").select(
        "arrival_seq", "api_version", "site_id", "idempotency_key", "batch_id",
        (~F.col("owns")).alias("idempotent_replay"),
    )


def reject_rows(claims: DataFrame) -> DataFrame:
    """SNK-5."""
    return claims.filter("code IS NOT NULL").select(
        "arrival_seq", "api_version", "site_id", "idempotency_key", "code", "details"
    )


def ingest(
    store: Store,
    current: DataFrame | None = None,
    legacy: DataFrame | None = None,
    *,
    as_of: datetime | None = None,
    stream: tuple[str, int] | None = None,
) -> int:
    """Apply one epoch and return its number.

    `stream` names the query and micro-batch an epoch comes from: a batch that was
    committed before is skipped, so a restart after the commit changes nothing.
    """
    def apply(head: Head) -> int:
        if stream and head.streams.get(stream[0], -1) >= stream[1]:
            return head.epoch
        with dropping_stages(store.spark):
            return _apply(store, head, current, legacy, as_of or datetime.now(timezone.utc), stream)

    return _from_newest_head(store, apply)


#: Times that a writer starts again because another one has committed.
CONFLICT_RETRIES = 20


def _from_newest_head(store: Store, apply: Callable[[Head], int]) -> int:
    """Writers may overlap: who loses the race for an epoch decides again on the new state,
    after a pause that grows, so that writers do not keep meeting."""
    for retry in range(CONFLICT_RETRIES):
        try:
            return apply(store.head())
        except CommitConflict:
            time.sleep(random.uniform(0, min(30.0, 0.1 * 2**retry)))
    return apply(store.head())


def _apply(
    store: Store,
    head: Head,
    current: DataFrame | None,
    legacy: DataFrame | None,
    as_of: datetime,
    stream: tuple[str, int] | None,
) -> int:
    now = F.lit(as_of)
    sites = store.read("sites", head)

    def ledger_of(arrivals: DataFrame) -> DataFrame:
        keys = store.keys(arrivals.filter(F.size("details") == 0), "batch_ledger", head)
        return store.read("batch_ledger", head, keys).select("site_id", "idempotency_key", "request_hash")

    claims, staged = claimed(
        checked_arrivals(current, legacy), sites, ledger_of if "batch_ledger" in head.tables else None)
    stored_instants, stored_ids = _stored_state(store, head, claims)
    # Sites of the epoch; the snapshot is read and written in their buckets only.
    touched = store.keys(claims.filter("owns"), "site_summary", head)
    opening = store.summary(head, touched)
    epoch = decide_epoch(claims, sites, stored_instants, stored_ids, opening)
    release(*(df for df in (stored_instants, stored_ids) if df is not None))

    number = head.following
    identities = epoch.verdicts.filter(
        (F.col("verdict") == ACCEPT) & F.col("reading_id").isNotNull()
    ).select(*IDENTIFIED_KEY, F.col("reading_ts").alias("first_ts"), "ch4_kg", "idempotency_key")

    def ledger() -> Late:
        release(staged, epoch.verdicts)
        return Late(
            epoch.batches.drop("first_ts", "last_ts", "total_before", "site_name", "readings_duplicate"),
            lambda rows: ledger_rows(rows, now))

    def events() -> Late:
        seeds = numbered(event_seeds(epoch.batches), number)
        release(epoch.batches)
        return Late(seeds, lambda rows: newly_pending(event_rows(rows, now)))

    # The snapshot's buckets are those it was read in, without the folders' ranges: a site of
    # the same bucket outside the range of the epoch's sites is carried over too.
    previous = store.summary(head, Keys(touched.buckets)).drop("epoch")
    # Functions are called once what stands before them is written: they remove what it was made of.
    tables = {
        "measurements": measurement_rows(epoch.verdicts, now),
        "reading_identities": Late(identities, lambda rows: rows.withColumn("batch_id", batch_id())),
        "site_summary": advance_summary(previous, site_deltas(epoch.batches), now),
        "ingest_results": result_rows(claims),
        "rejects": reject_rows(claims),
        "batch_ledger": ledger,
        "events_pending": events,
    }
    wrote = _write_all(store, head, tables, number, {"site_summary": touched.buckets})
    wrote += [w.also_for("events_out") for w in wrote if w.table == "events_pending"]
    return store.commit(head, wrote, as_of, stream)


def register_sites(
    store: Store, feed: DataFrame, *, as_of: datetime | None = None
) -> int:
    """SRC-3: append valid new sites; every other registration becomes a reject.

    A registered id stands. Of several registrations of one id in a feed the one that
    sorts first by name, limit and metadata is taken, so a rerun takes the same.
    """
    as_of = as_of or datetime.now(timezone.utc)

    def apply(head: Head) -> int:
        with dropping_stages(store.spark):
            checked = stage(check_sites(feed), "sites")
            order = Window.partitionBy("id").orderBy("name", "emission_limit_kg", "metadata")
            valid = checked.filter(F.size("details") == 0).withColumn("nth", F.row_number().over(order))
            known = store.read("sites", head).select("id").withColumn("known", F.lit(True))
            valid = stage(valid.join(known, "id", "left"), "registrations")
            fresh = valid.filter("nth = 1 AND known IS NULL")

            def reject(rows: DataFrame, details: Column) -> DataFrame:
                return rows.select(
                    F.lit(None).cast("bigint").alias("arrival_seq"),
                    F.lit(None).cast("string").alias("api_version"),
                    F.col("id").alias("site_id"),
                    F.lit(None).cast("string").alias("idempotency_key"),
                    F.lit(VALIDATION_ERROR).alias("code"),
                    details.alias("details"),
                )

            message = F.when(F.col("known"), "the id is registered").otherwise(
                "the feed registers the id more than once")
            taken = F.array(F.struct(F.lit("id").alias("path"), message.alias("message")))
            rejects = reject(checked.filter(F.size("details") > 0), F.col("details")).unionByName(
                reject(valid.filter("nth > 1 OR known"), taken))
            tables = {"sites": fresh.withColumn("created_at", F.lit(as_of)), "rejects": rejects}
            wrote = _write_all(store, head, tables, head.following)
            return store.commit(head, wrote, as_of)

    return _from_newest_head(store, apply)


def backfill_spans(store: Store, *, as_of: datetime | None = None) -> int:
    """JN-12: first and last reading of every site, from its own readings, as a new snapshot."""

    def apply(head: Head) -> int:
        snapshot = store.summary(head).drop("epoch")
        spans = recomputed(store.read("measurements", head)).select("site_id", "first_at", "last_at")
        filled = snapshot.join(spans, "site_id", "left").withColumns(
            {"first_reading_at": F.col("first_at"), "last_reading_at": F.col("last_at")})
        every = tuple(range(store.buckets(head)))
        wrote = _write_all(store, head, {"site_summary": filled}, head.following, {"site_summary": every})
        return store.commit(head, wrote, as_of or datetime.now(timezone.utc))

    return _from_newest_head(store, apply)


def log_delivery_attempts(
    store: Store, attempts: DataFrame, *, as_of: datetime | None = None
) -> int:
    """Append outcomes reported by whatever delivers the events, and advance the pending ones.

    Only the buckets of the events named are read and written.
    """
    log = attempts if "requeued" in attempts.columns else attempts.withColumn("requeued", F.lit(None).cast("boolean"))

    def apply(head: Head) -> int:
        with dropping_stages(store.spark):
            new = stage(log.select(*ATTEMPT_LOG.fieldNames()), "attempts")
            touched = store.keys(new.select(F.col("event_id").alias("id")), "events_pending", head)
            tables = {"delivery_attempts": new}
            if touched.buckets:
                pending = store.read("events_pending", head, touched).drop("epoch")
                tables["events_pending"] = advance_pending(pending, new)
            wrote = _write_all(store, head, tables, head.following, {"events_pending": touched.buckets})
            return store.commit(head, wrote, as_of or datetime.now(timezone.utc))

    return _from_newest_head(store, apply)


def requeue(store: Store, events: DataFrame, *, as_of: datetime | None = None) -> int:
    """Put events (`id`) back for delivery: their failures and claims so far no longer count.
    Delivered events stay delivered."""
    as_of = as_of or datetime.now(timezone.utc)
    entries = events.select(
        F.col("id").alias("event_id"), F.lit(as_of).alias("attempted_at"), F.lit(None).cast("boolean").alias("ok"),
        F.lit(None).cast("string").alias("error"), F.lit(True).alias("requeued"))
    return log_delivery_attempts(store, entries, as_of=as_of)


@dataclass
class Late:
    """Rows that `late` makes the table's rows of, once they are dealt to its buckets."""

    rows: DataFrame
    late: Callable[[DataFrame], DataFrame]


def _write_all(
    store: Store,
    head: Head,
    tables: dict[str, DataFrame | Late | Callable[[], DataFrame | Late]],
    epoch: int,
    replaces: dict[str, tuple[int, ...]] | None = None,
) -> list[Written]:
    """The tables do not depend on each other, so their jobs share the cluster. A function
    among them starts a turn of its own: it is called when all tables before it are written,
    so that their shuffles and stages are off the disks."""
    replaces = replaces or {}
    turns: list[dict] = [{}]
    for name, rows in tables.items():
        if callable(rows):
            turns.append({})
        turns[-1][name] = rows
    wrote: list[Written] = []

    def written(name: str, rows: DataFrame | Late) -> Written:
        df, late = (rows.rows, rows.late) if isinstance(rows, Late) else (rows, None)
        return store.write(df, name, epoch, head, replaces.get(name, ()), late)

    for turn in turns:
        ready = {name: rows() if callable(rows) else rows for name, rows in turn.items()}
        with ThreadPoolExecutor(max(len(ready), 1)) as pool:
            jobs = [
                pool.submit(inheritable_thread_target(store.spark)(written), name, rows) for name, rows in ready.items()
            ]
            wrote += [job.result() for job in jobs]
    return wrote
