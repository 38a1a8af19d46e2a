"""What makes a reading, and a request, the same one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugebook.functions.values import canonical_decimal

# Keys of the two identity schemes.
INSTANT_KEY = ["site_id", "device_id", "reading_ts"]
IDENTIFIED_KEY = ["site_id", "device_id", "reading_id"]

# A position inside a batch is below 128, so (arrival_seq, position) packs into
# one bigint. A single primitive keeps min / min_by inside HashAggregate; a
# struct key would fall back to sorting.
POSITION_BITS = 7
MAX_ARRIVAL_SEQ = (1 << (63 - POSITION_BITS)) - 1


def arrival_ord(arrival_seq: Column, position: Column) -> Column:
    return F.shiftleft(arrival_seq, POSITION_BITS) + position


def arrival_of(ord_: Column) -> Column:
    return F.shiftright(ord_, POSITION_BITS)


def position_of(ord_: Column) -> Column:
    return ord_.bitwiseAND((1 << POSITION_BITS) - 1).cast("int")


def reading_identity(device_id: Column, reading_id: Column, reading_ts: Column) -> Column:
    """The reading id when there is one, otherwise the instant, per device."""
    return F.struct(
        F.when(reading_id.isNull(), "instant").otherwise("reading_id").alias("scheme"),
        device_id.alias("device_id"),
        F.coalesce(reading_id, F.unix_millis(reading_ts).cast("string")).alias("value"),
    )


def instant_text(r: str) -> str:
    """SQL text: device and instant of a reading struct as one string.

    Array functions hash strings but compare structs pair by pair; the leading
    length keeps the spelling unambiguous.
    """
    return f"concat(length({r}.device_id), ':', {r}.device_id, '@', unix_millis({r}.reading_ts))"


def identity_text(r: str) -> str:
    """SQL text: the identity of a reading struct as one string."""
    named = f"concat(length({r}.device_id), ':', {r}.device_id, '#', {r}.reading_id)"
    return f"CASE WHEN {r}.reading_id IS NULL THEN {instant_text(r)} ELSE {named} END"


def request_fingerprint(site_id: str, readings: str) -> str:
    """SQL text, equal for requests that carry the same readings, however spelled.

    `readings` is an array of structs (reading_id, device_id, reading_ts,
    mass_text, source). Order inside the batch, trailing zeros and the offset an
    instant was written with do not count.
    """
    canonical = (
        "named_struct('i', coalesce(r.reading_id, ''), 'd', r.device_id, "
        "'t', unix_millis(r.reading_ts), "
        f"'c', {canonical_decimal('r.mass_text')}, 's', r.source)"
    )
    return (
        f"sha2(to_json(named_struct('site', {site_id}, 'readings', "
        f"sort_array(transform({readings}, r -> {canonical})))), 256)"
    )
