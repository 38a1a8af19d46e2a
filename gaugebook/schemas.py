"""Record and table schemas, with the fixed values of the wire contract."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values of the contract ------------------------------------------
MAX_READINGS_PER_BATCH = 100
MAX_DEVICE_ID = 100
MAX_READING_ID = 128
MAX_SITE_NAME = 200
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 200
SOURCES = ("sensor", "satellite", "manual")
DEFAULT_SOURCE = "sensor"
LEDGER_STATES = ("in_progress", "completed", "failed")
WITHIN_LIMIT = "Within Limit"
LIMIT_EXCEEDED = "Limit Exceeded"
VALIDATION_ERROR = "VALIDATION_ERROR"
SITE_NOT_FOUND = "SITE_NOT_FOUND"
IDEMPOTENCY_KEY_REUSED = "IDEMPOTENCY_KEY_REUSED"
VALUE_CONFLICT = "value_conflict"
MIXED_IDENTITY = "mixed_identity"
INGESTED_EVENT = "measurements.ingested"
EXCEEDED_EVENT = "site.limit_exceeded"
DELIVERY_BATCH = 50
DELIVERY_MAX_ATTEMPTS = 10
DELIVERY_LEASE_SECONDS = 30
LAST_ERROR_CHARS = 500
MONTHS_BEHIND_AT_START = 6
MONTHS_AHEAD_AT_START = 6
MONTHS_AHEAD = 3

# An event's id is its epoch and its position there: 2^27 epochs of 2^36 events.
EVENT_POSITION_BITS = 36

# ---- decimals ----------------------------------------------------------------
MASS = T.DecimalType(14, 4)
TOTAL = T.DecimalType(18, 4)
LIMIT = T.DecimalType(14, 3)
GRAMS = T.DecimalType(28, 10)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# ---- feeds ---------------------------------------------------------------------
WIRE_READING = _struct(
    ("readingId", T.StringType()),
    ("deviceId", T.StringType()),
    ("readingTs", T.StringType()),
    ("ch4Kg", T.StringType()),
    ("source", T.StringType()),
)
ARRIVALS = _struct(
    ("arrival_seq", T.LongType()),
    ("api_version", T.StringType()),
    ("idempotency_key", T.StringType()),
    ("site_id", T.StringType()),
    ("readings", T.ArrayType(WIRE_READING)),
)
LEGACY_READING = _struct(
    ("device_id", T.StringType()),
    ("ts", T.LongType()),
    ("ch4_g", GRAMS),
)
LEGACY_ARRIVALS = _struct(
    ("arrival_seq", T.LongType()),
    ("site_id", T.StringType()),
    ("batch_id", T.StringType()),
    ("readings", T.ArrayType(LEGACY_READING)),
)
SITE_FEED = _struct(
    ("id", T.StringType()),
    ("name", T.StringType()),
    ("emissionLimitKg", T.StringType()),
    ("metadata", T.StringType()),
)

# ---- validated arrivals --------------------------------------------------------
READING = _struct(
    ("reading_id", T.StringType()),
    ("device_id", T.StringType()),
    ("reading_ts", T.TimestampType()),
    ("ch4_kg", MASS),
    ("source", T.StringType()),
)
#: Text of a feed line that is no readable record.
CORRUPT = "_corrupt_record"
DETAIL = _struct(("path", T.StringType()), ("message", T.StringType()))
CHECKED = _struct(
    ("arrival_seq", T.LongType()),
    ("api_version", T.StringType()),
    ("idempotency_key", T.StringType()),
    ("site_id", T.StringType()),
    ("readings", T.ArrayType(READING)),
    ("fingerprint", T.StringType()),
    ("details", T.ArrayType(DETAIL)),
)

# ---- tables ------------------------------------------------------------------------
CONFLICT = _struct(
    ("reason", T.StringType()),
    ("device_id", T.StringType()),
    ("reading_ts", T.TimestampType()),
    ("submitted_kg", MASS),
    ("stored_kg", MASS),
)
RESPONSE = _struct(
    ("batch_id", T.StringType()),
    ("site_id", T.StringType()),
    ("readings_submitted", T.IntegerType()),
    ("readings_accepted", T.IntegerType()),
    ("accepted_ch4_kg", TOTAL),
    ("total_kg", TOTAL),
    ("compliance_status", T.StringType()),
    ("conflicts", T.ArrayType(CONFLICT)),
)
SITES = _struct(
    ("id", T.StringType()),
    ("name", T.StringType()),
    ("emission_limit_kg", LIMIT),
    ("metadata", T.StringType()),
    ("created_at", T.TimestampType()),
)
MEASUREMENTS = _struct(
    ("id", T.StringType()),
    ("site_id", T.StringType()),
    ("batch_id", T.StringType()),
    ("reading_id", T.StringType()),
    ("device_id", T.StringType()),
    ("reading_ts", T.TimestampType()),
    ("ch4_kg", MASS),
    ("source", T.StringType()),
    ("created_at", T.TimestampType()),
    ("arrival_ord", T.LongType()),
    ("month", T.StringType()),
)
READING_IDENTITIES = _struct(
    ("site_id", T.StringType()),
    ("device_id", T.StringType()),
    ("reading_id", T.StringType()),
    ("first_ts", T.TimestampType()),
    ("ch4_kg", MASS),
    ("batch_id", T.StringType()),
)
BATCH_LEDGER = _struct(
    ("id", T.StringType()),
    ("site_id", T.StringType()),
    ("idempotency_key", T.StringType()),
    ("request_hash", T.StringType()),
    ("status", T.StringType()),
    ("readings_submitted", T.IntegerType()),
    ("readings_accepted", T.IntegerType()),
    ("accepted_ch4_kg", TOTAL),
    ("response", RESPONSE),
    ("created_at", T.TimestampType()),
    ("completed_at", T.TimestampType()),
    ("arrival_seq", T.LongType()),
    ("api_version", T.StringType()),
)
SITE_SUMMARY = _struct(
    ("site_id", T.StringType()),
    ("total_kg", TOTAL),
    ("measurement_count", T.LongType()),
    ("version", T.IntegerType()),
    ("first_reading_at", T.TimestampType()),
    ("last_reading_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
)
EVENTS_OUT = _struct(
    ("id", T.LongType()),
    ("aggregate_type", T.StringType()),
    ("aggregate_id", T.StringType()),
    ("event_type", T.StringType()),
    ("payload", T.StringType()),
    ("created_at", T.TimestampType()),
)
REJECTS = _struct(
    ("arrival_seq", T.LongType()),
    ("api_version", T.StringType()),
    ("site_id", T.StringType()),
    ("idempotency_key", T.StringType()),
    ("code", T.StringType()),
    ("details", T.ArrayType(DETAIL)),
)
INGEST_RESULTS = _struct(
    ("arrival_seq", T.LongType()),
    ("api_version", T.StringType()),
    ("site_id", T.StringType()),
    ("idempotency_key", T.StringType()),
    ("batch_id", T.StringType()),
    ("idempotent_replay", T.BooleanType()),
)
DELIVERY_ATTEMPTS = _struct(
    ("event_id", T.LongType()),
    ("attempted_at", T.TimestampType()),
    ("ok", T.BooleanType()),
    ("error", T.StringType()),
)
# The log keeps, next to reported outcomes, the events that were put back by hand.
ATTEMPT_LOG = T.StructType([*DELIVERY_ATTEMPTS.fields, T.StructField("requeued", T.BooleanType())])
EVENTS_PENDING = T.StructType([*EVENTS_OUT.fields, *_struct(
    ("claimed_at", T.TimestampType()),
    ("attempts", T.IntegerType()),
    ("last_error", T.StringType()),
).fields])
TABLES = {
    "sites": SITES,
    "measurements": MEASUREMENTS,
    "reading_identities": READING_IDENTITIES,
    "batch_ledger": BATCH_LEDGER,
    "site_summary": SITE_SUMMARY,
    "events_out": EVENTS_OUT,
    "rejects": REJECTS,
    "ingest_results": INGEST_RESULTS,
    "delivery_attempts": ATTEMPT_LOG,
    "events_pending": EVENTS_PENDING,
}
# Tables that are looked up by key lie in buckets of the hash of these columns.
BUCKETED_BY = {
    "batch_ledger": ["site_id", "idempotency_key"],
    "reading_identities": ["site_id", "device_id"],
    "site_summary": ["site_id"],
    "events_pending": ["id"],
}
# Directory levels below epoch=N.
PARTITIONED_BY = {"measurements": ["month"], **{table: ["bucket"] for table in BUCKETED_BY}}
