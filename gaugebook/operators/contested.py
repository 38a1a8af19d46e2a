"""Instants that carry both identity schemes.

An anonymous reading is refused where an identified one was accepted, and that
acceptance depends on whether the same reading id was accepted at another
instant, and so on: verdicts form chains inside a (site, device). The task is the
greedy independent set in arrival order, "accept a candidate unless an earlier
accepted one excludes it":

* candidates of one reading id exclude each other;
* the anonymous candidate of an instant and the identified ones there exclude
  each other.

Candidates exclude each other only along the graph that links an instant to the ids
seen at it. Its connected parts are found first and each is decided on its own, by one
ordered pass over its rows: however many candidates a device has, a task holds one part.
A part that is itself too large for a task is thinned by a set-wide round (every
candidate that is first among all its rivals is accepted, its rivals are dropped), falls
apart, and goes through the same steps again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugebook.functions.identity import IDENTIFIED_KEY, INSTANT_KEY
from gaugebook.operators.linked import parts
from gaugebook.session import dropping_stages, release, stage

# Most rows of one connected part that are walked in one task.
ORDERED_PASS_ROWS = 100_000

CANDIDATE = ["site_id", "device_id", "reading_id", "reading_ts", "ord", "ch4_kg"]


def accepted_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks rows sorted by part and arrival; yields the accepted ones.

    A partition holds many parts, so rows stream through in Arrow batches and only the
    part at hand keeps state: its accepted ids and the instants it holds.
    """
    part = None
    ids: set = set()
    named_at: set = set()
    anonymous_at: set = set()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "site_id", "device_id", "reading_id")]
        instants = batch.column("reading_ts").cast(pa.int64()).to_pylist()
        keep = []
        for own_part, site, device, reading_id, instant in zip(*columns, instants):
            if own_part != part:
                part = own_part
                ids, named_at, anonymous_at = set(), set(), set()
            at, name = (site, device, instant), (site, device, reading_id)
            if reading_id is None:
                ok = at not in named_at and at not in anonymous_at
                if ok:
                    anonymous_at.add(at)
            else:
                ok = at not in anonymous_at and name not in ids
                if ok:
                    ids.add(name)
                    named_at.add(at)
            keep.append(ok)
        yield batch.filter(pa.array(keep, pa.bool_())).select(CANDIDATE)


def in_parts(candidates: DataFrame) -> DataFrame:
    """The candidates with `part`, the connected part of the id-instant graph they are in.

    An id links its instants to the least of them, so links are as many as rows of ids
    that occur at several instants; an instant without links is a part of its own.
    """
    at = candidates.withColumn("node", F.xxhash64(*INSTANT_KEY))
    named = at.filter("reading_id IS NOT NULL")
    hubs = named.groupBy(*IDENTIFIED_KEY).agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top")
    links = named.join(hubs, IDENTIFIED_KEY).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    linked = parts(links)
    if linked is None:
        return at.withColumnRenamed("node", "part")
    return at.join(linked, "node", "left").withColumn("part", F.coalesce("part", "node")).drop("node")


def one_round(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted now, still undecided) for a set of open candidates.

    Minima are combined before the shuffle and joined back, so a hot id or
    instant is split by AQE instead of landing in one task.
    """
    named = open_.filter("reading_id IS NOT NULL")
    anonymous = open_.filter("reading_id IS NULL")
    first_of_id = named.groupBy(*IDENTIFIED_KEY).agg(F.min("ord").alias("id_first"))
    first_named = named.groupBy(*INSTANT_KEY).agg(F.min("ord").alias("rival"))
    anonymous_at = anonymous.groupBy(*INSTANT_KEY).agg(F.min("ord").alias("rival"))

    won = F.col("rival").isNull() | (F.col("ord") < F.col("rival"))
    named_won = (
        named.join(first_of_id, IDENTIFIED_KEY)
        .filter(F.col("ord") == F.col("id_first"))
        .join(anonymous_at, INSTANT_KEY, "left")
        .filter(won)
        .select(*CANDIDATE)
    )
    anonymous_won = (
        anonymous.join(first_named, INSTANT_KEY, "left").filter(won).select(*CANDIDATE)
    )
    accepted = stage(named_won.unionByName(anonymous_won), "round-accepted")

    taken_named = accepted.filter("reading_id IS NOT NULL")
    taken_instants = accepted.filter("reading_id IS NULL").select(*INSTANT_KEY)
    rest_named = named.join(
        taken_named.select(*IDENTIFIED_KEY), IDENTIFIED_KEY, "left_anti"
    ).join(taken_instants, INSTANT_KEY, "left_anti")
    rest_anonymous = anonymous.join(
        taken_named.select(*INSTANT_KEY).unionByName(taken_instants).distinct(),
        INSTANT_KEY,
        "left_anti",
    )
    return accepted, stage(
        rest_named.select(*CANDIDATE).unionByName(rest_anonymous.select(*CANDIDATE)), "round-open"
    )


def settle(candidates: DataFrame, ordered_pass_rows: int = ORDERED_PASS_ROWS) -> DataFrame:
    """The accepted candidates; exact for any input.

    `candidates` has the CANDIDATE columns, at most one row per (id, instant) and one
    anonymous row per instant. A round decides at least the earliest open candidate of
    every part that is still too large, so the loop ends.
    """
    open_ = stage(candidates.select(*CANDIDATE), "candidates", "zstd")
    accepted: list[DataFrame] = []
    while True:
        with dropping_stages(open_.sparkSession):
            split = stage(in_parts(open_), "parts", "zstd", outlives=True)
        release(open_)
        large = stage(split.groupBy("part").count().filter(F.col("count") > ordered_pass_rows).select("part"), "large")
        done = large.isEmpty()
        small = split if done else split.join(large, "part", "left_anti")
        accepted.append(
            small.repartition("part")
            .sortWithinPartitions("part", "ord")
            .mapInArrow(accepted_in_order, candidates.select(*CANDIDATE).schema)
        )
        if done:
            break
        now, open_ = one_round(split.join(large, "part", "left_semi").select(*CANDIDATE))
        accepted.append(now)
    return reduce(DataFrame.unionByName, accepted)
