"""Whole-batch validation: each function adds `details`, empty when a row is valid.

All rules are array functions over the row's own readings (at most 100 of them
once the size rule has passed), so validation never shuffles. Stage the result
before filtering or exploding it: a pushed-down predicate would evaluate the rules
again inside the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugebook.functions.identity import (
    MAX_ARRIVAL_SEQ,
    identity_text,
    instant_text,
    request_fingerprint,
)
from gaugebook.functions.values import (
    LIMIT_TEXT,
    UUID_TEXT,
    derived_uuid,
    fits,
    parse_instant,
    parse_mass,
    stripped,
)
from gaugebook.schemas import (
    CORRUPT,
    DEFAULT_SOURCE,
    DETAIL,
    LIMIT,
    MASS,
    MAX_DEVICE_ID,
    MAX_READING_ID,
    MAX_READINGS_PER_BATCH,
    MAX_SITE_NAME,
    SOURCES,
)

_DETAILS = f"array<{DETAIL.simpleString()}>"
_NONE = f"CAST(array() AS {_DETAILS})"
_SIZED = f"coalesce(size(readings) BETWEEN 1 AND {MAX_READINGS_PER_BATCH}, false)"
_LAST_SECOND_OF_9999 = 253402300799


def _issue(bad: str, path: str, message: str) -> str:
    """A detail where `bad` holds, or cannot be decided because of a NULL."""
    return (
        f"CASE WHEN coalesce({bad}, true) "
        f"THEN named_struct('path', {path}, 'message', '{message}') END"
    )


def _issues(*found: str) -> str:
    return f"CAST(array_compact(array({', '.join(found)})) AS {_DETAILS})"


def _reading_issues(rules: list[tuple[str, str, str]]) -> str:
    """Issues of every reading in `normal`; a rule is (violated, field, message).

    One boolean pass settles the usual case; details are built for bad batches only.
    """
    fine = " AND ".join(f"NOT coalesce({bad}, true)" for bad, _, _ in rules)
    listed = _issues(
        *(_issue(bad, f"concat('readings.', i, '.{field}')", text) for bad, field, text in rules)
    )
    return (
        f"CASE WHEN normal IS NULL OR forall(normal, r -> {fine}) THEN {_NONE} "
        f"ELSE flatten(transform(normal, (r, i) -> {listed})) END"
    )


def _size_issue() -> str:
    return _issue(
        f"NOT {_SIZED}", "'readings'", f"a batch carries 1 to {MAX_READINGS_PER_BATCH} readings"
    )


def _uuid_issue(column: str, path: str) -> str:
    return _issue(f"NOT {column} RLIKE r'{UUID_TEXT}'", f"'{path}'", "expected a UUID")


def _sequenced(arrivals: DataFrame) -> DataFrame:
    """Every ordering starts from arrival_seq: one that is missing or out of range is
    taken out, and `seq_issues` says so. A line of the feed that is no JSON object of the
    expected shape comes with its text in CORRUPT."""
    seq = F.col("arrival_seq")
    usable = F.coalesce(seq.between(0, MAX_ARRIVAL_SEQ), F.lit(False))
    raw = F.col(CORRUPT) if CORRUPT in arrivals.columns else F.lit(None).cast("string")

    def issue(path: str, message: Column) -> Column:
        return F.array(F.struct(F.lit(path).alias("path"), message.alias("message")))

    issues = (
        F.when(raw.isNotNull(), issue("", F.concat(F.lit("unreadable record: "), raw)))
        .when(~usable, issue("arrival_seq", F.lit("expected a position within 0 .. 2^56-1")))
        .otherwise(F.expr(_NONE))
    )
    return arrivals.withColumn("seq_issues", issues).withColumn("arrival_seq", F.when(usable, seq))


# FLT-3: one reading per identity in a batch; the later index is reported. The
# pairwise search only runs for a batch that does repeat an identity.
_REPEATED = f"""
CASE WHEN size(array_distinct(keys)) < size(keys) THEN
  transform(
    filter(
      transform(keys, (k, i) -> named_struct('at', i, 'first', array_position(keys, k) - 1)),
      x -> x.first < x.at),
    x -> named_struct(
      'path', concat('readings.', x.at),
      'message', concat('same reading as index ', x.first,
                        '; give each its own readingId if they differ')))
ELSE {_NONE} END
"""

# FLT-4: one identity scheme per (device, instant); the larger index is reported.
# `tagged` is only set for batches that use both schemes.
_NAMED_AT = "transform(filter(tagged, t -> t LIKE 'n%'), t -> substring(t, 2))"
_ANONYMOUS_AT = "transform(filter(tagged, t -> t LIKE 'a%'), t -> substring(t, 2))"
_MIXED = f"""
CASE WHEN tagged IS NOT NULL THEN
  transform(
    array_intersect({_NAMED_AT}, {_ANONYMOUS_AT}),
    w -> named_struct(
      'path', concat('readings.', greatest(array_position(tagged, concat('n', w)),
                                           array_position(tagged, concat('a', w))) - 1),
      'message', 'readings with and without readingId share a device and instant'))
ELSE {_NONE} END
"""


def check_current(arrivals: DataFrame) -> DataFrame:
    """FLT-1..5 on the current format; returns the CHECKED columns."""
    normal = f"""
      CASE WHEN {_SIZED} THEN transform(readings, r -> named_struct(
        'reading_id', {stripped('r.readingId')},
        'device_id', {stripped('r.deviceId')},
        'reading_ts', {parse_instant('r.readingTs')},
        'ch4_kg', {parse_mass('r.ch4Kg')},
        'source', coalesce(r.source, '{DEFAULT_SOURCE}'),
        'mass_text', r.ch4Kg)) END"""
    sources = ", ".join(f"'{s}'" for s in SOURCES)
    rules = [
        (f"r.reading_id IS NOT NULL AND NOT {fits('r.reading_id', MAX_READING_ID)}",
         "readingId", f"expected 1 to {MAX_READING_ID} characters"),
        (f"NOT {fits('r.device_id', MAX_DEVICE_ID)}",
         "deviceId", f"expected 1 to {MAX_DEVICE_ID} characters"),
        ("r.reading_ts IS NULL", "readingTs", "expected an ISO-8601 instant with an offset"),
        ("r.ch4_kg IS NULL", "ch4Kg",
         "expected a decimal of up to 10 integer digits and 4 decimals"),
        (f"NOT r.source IN ({sources})", "source", "expected one of " + ", ".join(SOURCES)),
    ]
    envelope = _issues(_uuid_issue("site_id", "siteId"), _size_issue())
    key_issue = _issues(
        _issue("coalesce(idempotency_key, '') = ''", "'Idempotency-Key'", "a key is required")
    )
    both = (
        "exists(normal, r -> r.reading_id IS NULL) "
        "AND exists(normal, r -> r.reading_id IS NOT NULL)"
    )
    # Cross-reading rules need every field to be readable first; a missing key is
    # reported only for a body that is otherwise valid. The arrays behind a rule are
    # only built for batches the rule can apply to.
    judged = (
        _sequenced(arrivals)
        .withColumns(
            {"normal": F.expr(normal), "idempotency_key": F.expr(stripped("idempotency_key"))}
        )
        .withColumn("field_issues", F.expr(f"concat({envelope}, {_reading_issues(rules)})"))
        .withColumns(
            {
                "keys": F.expr(
                    f"CASE WHEN size(field_issues) = 0 AND size(normal) > 1 "
                    f"THEN transform(normal, r -> {identity_text('r')}) END"),
                "tagged": F.expr(
                    f"CASE WHEN size(field_issues) = 0 AND {both} THEN transform(normal, r -> "
                    f"concat(if(r.reading_id IS NULL, 'a', 'n'), {instant_text('r')})) END"),
            }
        )
        .withColumn(
            "body_issues",
            F.expr(f"CASE WHEN size(field_issues) > 0 THEN field_issues "
                   f"ELSE concat({_REPEATED}, {_MIXED}) END"),
        )
        .withColumn(
            "details",
            F.expr(f"CASE WHEN size(body_issues) > 0 THEN body_issues ELSE {key_issue} END"),
        )
    )
    return _checked(judged, F.coalesce(F.col("api_version"), F.lit("2")))


def check_legacy(arrivals: DataFrame) -> DataFrame:
    """FLT-6 and PRJ-1: legacy rules, then the current shape. No FLT-3 / FLT-4 here.

    Grams become kilograms by a decimal product, which is exact; the table holds
    four decimals of it.
    """
    mass = MASS.simpleString()
    normal = f"""
      CASE WHEN {_SIZED} THEN transform(readings, r -> named_struct(
        'reading_id', CAST(NULL AS string),
        'device_id', {stripped('r.device_id')},
        'reading_ts', CASE WHEN r.ts <= {_LAST_SECOND_OF_9999} THEN timestamp_seconds(r.ts) END,
        'ch4_kg', try_cast(round(r.ch4_g * 0.001BD, 4) AS {mass}),
        'source', '{DEFAULT_SOURCE}',
        'mass_text', CAST(r.ch4_g * 0.001BD AS string),
        'raw_ts', r.ts, 'raw_g', r.ch4_g)) END"""
    rules = [
        (f"NOT {fits('r.device_id', MAX_DEVICE_ID)}",
         "device_id", f"expected 1 to {MAX_DEVICE_ID} characters"),
        ("r.reading_ts IS NULL OR r.raw_ts <= 0", "ts", "expected epoch seconds above 0"),
        ("r.ch4_kg IS NULL OR r.ch4_kg < 0 OR r.raw_g < 0", "ch4_g",
         "expected grams of 0 or more that fit the table"),
    ]
    envelope = _issues(
        _uuid_issue("site_id", "site_id"), _uuid_issue("batch_id", "batch_id"), _size_issue()
    )
    judged = (
        _sequenced(arrivals)
        .withColumns({"normal": F.expr(normal), "idempotency_key": F.col("batch_id")})
        .withColumn("details", F.expr(f"concat({envelope}, {_reading_issues(rules)})"))
    )
    return _checked(judged, F.lit("1"))


def _checked(judged: DataFrame, version: Column) -> DataFrame:
    readings = (
        "transform(normal, r -> named_struct('reading_id', r.reading_id, 'device_id', r.device_id, "
        "'reading_ts', r.reading_ts, 'ch4_kg', r.ch4_kg, 'source', r.source))"
    )
    fingerprint = request_fingerprint("site_id", "normal")
    judged = judged.withColumn(
        "details", F.when(F.size("seq_issues") > 0, F.col("seq_issues")).otherwise(F.col("details"))
    )
    return judged.select(
        "arrival_seq",
        version.alias("api_version"),
        "idempotency_key",
        F.lower("site_id").alias("site_id"),
        F.expr(f"CASE WHEN size(details) = 0 THEN {readings} END").alias("readings"),
        F.expr(f"CASE WHEN size(details) = 0 THEN {fingerprint} END").alias("fingerprint"),
        "details",
    )


def check_sites(feed: DataFrame) -> DataFrame:
    """FLT-7 on a site registration feed: id, name, limit, metadata, details. A line that can't
    be read has its text in the details, and takes no part in the numbering below."""
    if CORRUPT in feed.columns:
        told = F.concat(F.lit("unreadable record: "), F.col(CORRUPT))
        bad = feed.filter(F.col(CORRUPT).isNotNull()).select(
            "id", "name", F.lit(None).cast(LIMIT).alias("emission_limit_kg"), "metadata",
            F.array(F.struct(F.lit("").alias("path"), told.alias("message"))).alias("details"))
        return check_sites(feed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)).unionByName(bad)
    metadata = F.coalesce(F.col("metadata"), F.lit("{}"))
    named = feed.select(
        F.col("id"),
        F.expr(stripped("name")).alias("name"),
        F.expr(f"CASE WHEN emissionLimitKg RLIKE r'{LIMIT_TEXT}' "
               f"THEN CAST(emissionLimitKg AS {LIMIT.simpleString()}) END").alias("emission_limit_kg"),
        metadata.alias("metadata"),
    )
    # Equal sites without an id are different sites: each copy in the feed has a number of its own.
    alike = Window.partitionBy("id", "name", "emission_limit_kg", "metadata").orderBy(F.lit(1))
    named = named.withColumn("copy", F.row_number().over(alike))
    parts = [F.col("name"), F.col("emission_limit_kg"), F.col("metadata")]
    derived = F.when(F.col("copy") > 1, derived_uuid(*parts, F.col("copy"))).otherwise(derived_uuid(*parts))
    return named.withColumn("id", F.coalesce(F.lower("id"), derived)).drop("copy").withColumn(
        "details",
        F.expr(_issues(
            _uuid_issue("id", "id"),
            _issue(f"NOT {fits('name', MAX_SITE_NAME)}", "'name'",
                   f"expected 1 to {MAX_SITE_NAME} characters"),
            _issue("emission_limit_kg IS NULL OR emission_limit_kg <= 0", "'emissionLimitKg'",
                   "expected a decimal above 0 of up to 11 integer digits and 3 decimals"),
            _issue("NOT startswith(schema_of_variant(try_parse_json(metadata)), 'OBJECT')",
                   "'metadata'", "expected a JSON object"),
        )),
    )
