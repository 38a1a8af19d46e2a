"""Projections and column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugebook.catalog.feeds import (
    AS_OF,
    event_readings,
    event_sites,
    events_legacy,
    events_store,
    lineitem_arrivals,
    mixed_arrivals,
    site_uuid,
    table,
)
from gaugebook.catalog.registry import (
    E_READINGS,
    E_SITES,
    L_ARRIVALS,
    PCT,
    SITE_E,
    STATUS,
    query,
)
from gaugebook.functions.compliance import (
    compliance_status,
    operator_name,
    total_verdict,
    utilization_band,
    utilization_pct,
)
from gaugebook.functions.identity import reading_identity
from gaugebook.functions.values import (
    canonical_decimal,
    grams_to_kilograms,
    month_of,
    parse_instant,
)
from gaugebook.operators.totals import advance_summary
from gaugebook.operators.validate import check_current, check_legacy
from gaugebook.plans.reports import site_view
from gaugebook.session import stage


@query("prj_1_legacy_normalised", f"""
WITH {E_READINGS}
SELECT {SITE_E} AS site_id, lpad(CAST(blk AS VARCHAR), 8, '0') || '-0000-4000-8000-'
         || lpad(CAST(user_id AS VARCHAR), 12, '0') AS idempotency_key,
       row_number() OVER (PARTITION BY user_id, blk ORDER BY event_id) - 1 AS pos,
       event_type AS device_id, epoch_ms(day) AS ms, kg AS ch4_kg, 'sensor' AS source
FROM e""")
def legacy_normalised(spark, sf_dir):
    return (
        stage(check_legacy(events_legacy(spark, sf_dir)), "checked")
        .select("site_id", "idempotency_key", F.posexplode("readings").alias("pos", "r"))
        .select(
            "site_id", "idempotency_key", F.col("pos").cast("bigint").alias("pos"),
            "r.device_id", F.unix_millis("r.reading_ts").alias("ms"), "r.ch4_kg", "r.source",
        )
    )


@query("prj_2_grams_to_kilograms", """
SELECT event_id, CAST(CAST(value AS DECIMAL(28,10)) * 0.001 AS DECIMAL(28,10)) AS kg
FROM events""")
def grams(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        grams_to_kilograms(F.col("value").cast("decimal(28,10)")).cast("decimal(28,10)").alias("kg"),
    )


@query("prj_3_instant_millis", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def instants(spark, sf_dir):
    """Written with an offset and microseconds, read back as UTC milliseconds."""
    local = F.col("ts") - F.expr("INTERVAL 5 HOURS")
    text = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("-05:00"))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", text.alias("written"))
        .select("event_id", F.unix_millis(F.expr(parse_instant("written"))).alias("ms"))
    )


@query("prj_4_canonical_decimal", r"""
SELECT CASE WHEN t LIKE '%.%' THEN rtrim(rtrim(t, '0'), '.') ELSE t END AS canonical,
       count(*) AS n
FROM (SELECT CAST(CAST(l_extendedprice AS DECIMAL(14,4)) AS VARCHAR) AS t FROM lineitem
      UNION ALL SELECT CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM lineitem)
GROUP BY 1""")
def canonical(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    texts = lines.select(
        F.explode(F.array(
            F.col("l_extendedprice").cast("decimal(14,4)").cast("string"),
            F.col("l_quantity").cast("int").cast("string"),
        )).alias("t")
    )
    return texts.groupBy(F.expr(canonical_decimal("t")).alias("canonical")).agg(
        F.count("*").alias("n")
    )


@query("prj_5_reading_identity", f"""
WITH {E_READINGS}
SELECT {SITE_E} AS site_id, CASE WHEN k % 2 = 0 THEN 'reading_id' ELSE 'instant' END AS scheme,
       count(DISTINCT event_type || '|' || CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR)
             ELSE CAST(epoch_ms(day) AS VARCHAR) END) AS identities
FROM e GROUP BY user_id, 2""")
def identities(spark, sf_dir):
    rid = F.when(F.col("k") % 2 == 0, F.col("k").cast("string"))
    keyed = event_readings(spark, sf_dir).select(
        site_uuid(F.col("user_id")).alias("site_id"),
        reading_identity(F.col("event_type"), rid, F.col("day")).alias("identity"),
    )
    return keyed.distinct().groupBy("site_id", F.col("identity.scheme").alias("scheme")).agg(
        F.count("*").alias("identities")
    )


@query("prj_6_fingerprint_classes", f"""
WITH {L_ARRIVALS}
SELECT key AS idempotency_key, count(*) AS arrivals,
       count(DISTINCT (l_shipdate, kg)) AS fingerprints
FROM l GROUP BY cust, key""")
def fingerprints(spark, sf_dir):
    """Hash values are this library's own; which requests are equal is not."""
    return (
        check_current(lineitem_arrivals(spark, sf_dir))
        .groupBy("site_id", "idempotency_key", "fingerprint").agg(F.count("*").alias("n"))
        .groupBy("site_id", "idempotency_key")
        .agg(F.sum("n").alias("arrivals"), F.count("*").alias("fingerprints"))
        .select("idempotency_key", "arrivals", "fingerprints")
    )


def _sites(spark, sf_dir):
    store = events_store(spark, sf_dir)
    head = store.head()
    return site_view(store.read("sites", head), store.summary(head))


@query("prj_7_compliance_status", f"""
WITH {E_SITES} SELECT {SITE_E} AS id, {STATUS} AS compliance_status FROM s""")
def status(spark, sf_dir):
    return _sites(spark, sf_dir).select(
        "id", compliance_status(F.col("total_kg"), F.col("emission_limit_kg")).alias("compliance_status")
    )


@query("prj_8_utilization", f"WITH {E_SITES} SELECT {SITE_E} AS id, {PCT} AS utilization_pct FROM s")
def utilization(spark, sf_dir):
    return _sites(spark, sf_dir).select(
        "id", utilization_pct(F.col("total_kg"), F.col("emission_limit_kg")).alias("utilization_pct")
    )


@query("prj_9_utilization_band", f"""
WITH {E_SITES}
SELECT {SITE_E} AS id, CASE WHEN total > lim THEN 'over' WHEN total * 100 >= 80 * lim THEN 'warn'
       ELSE 'ok' END AS band
FROM s""")
def band(spark, sf_dir):
    return _sites(spark, sf_dir).select(
        "id", utilization_band(F.col("total_kg"), F.col("emission_limit_kg")).alias("band")
    )


@query("prj_10_site_view", f"""
WITH {E_SITES}
SELECT {SITE_E} AS id, 'Site ' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS name,
       lim AS emission_limit_kg, total AS total_kg, n AS measurement_count,
       {STATUS} AS compliance_status
FROM s""")
def view(spark, sf_dir):
    return _sites(spark, sf_dir).select(
        "id", "name", "emission_limit_kg", "total_kg", "measurement_count", "compliance_status"
    )


@query("prj_11_operator_name", f"""
SELECT DISTINCT {SITE_E} AS id,
       CASE WHEN user_id % 3 = 0 THEN 'op-' || (user_id % 7) END AS operator
FROM events""")
def operator(spark, sf_dir):
    """Only a JSON string counts: a number, or no metadata, gives NULL."""
    return event_sites(spark, sf_dir).select(
        "id", operator_name(F.coalesce("metadata", F.lit("{}"))).alias("operator")
    )


@query("prj_12_month_bucket", """
SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n,
       count(*) FILTER (WHERE l_shipdate >= date_trunc('month', l_shipdate)
         AND l_shipdate < date_trunc('month', l_shipdate) + INTERVAL 1 MONTH) AS inside
FROM lineitem GROUP BY 1""")
def month_bucket(spark, sf_dir):
    ts = F.col("l_shipdate")
    start = F.date_trunc("month", ts)
    inside = (ts >= start) & (ts < start + F.expr("INTERVAL 1 MONTH"))
    return table(spark, sf_dir, "lineitem").groupBy(month_of(ts).alias("month")).agg(
        F.count("*").alias("n"), F.count_if(inside).alias("inside")
    )


@query("prj_13_defaults", f"""
WITH {E_READINGS}
SELECT {SITE_E} AS site_id, CASE WHEN k % 3 = 0 THEN 'satellite' ELSE 'sensor' END AS source,
       count(*) AS n
FROM e GROUP BY user_id, 2""")
def defaults(spark, sf_dir):
    """A reading without a source is a sensor's."""
    arrivals = mixed_arrivals(spark, sf_dir).join(
        event_readings(spark, sf_dir).select(F.col("event_id").alias("arrival_seq"), "k"),
        "arrival_seq",
    )
    unsourced = arrivals.withColumn(
        "readings",
        F.expr("transform(readings, r -> named_struct('readingId', r.readingId, 'deviceId', "
               "r.deviceId, 'readingTs', r.readingTs, 'ch4Kg', r.ch4Kg, "
               "'source', if(k % 3 = 0, 'satellite', null)))"),
    )
    return (
        stage(check_current(unsourced), "checked").select("site_id", F.explode("readings").alias("r"))
        .groupBy("site_id", F.col("r.source").alias("source")).agg(F.count("*").alias("n"))
    )


@query("prj_14_span_widening", f"""
WITH {E_READINGS}
SELECT {SITE_E} AS site_id, epoch_ms(min(day)) AS first_ms, epoch_ms(max(day)) AS last_ms
FROM e GROUP BY user_id""")
def span(spark, sf_dir):
    """The later half first, then the earlier one: the start must move back."""
    readings = event_readings(spark, sf_dir).withColumn("site_id", site_uuid(F.col("user_id")))
    mid = F.lit(readings.agg(F.percentile_approx("event_id", 0.5)).first()[0])

    def deltas(part):
        return part.groupBy("site_id").agg(
            F.sum("kg").alias("moved_kg"), F.count("*").alias("moved_count"),
            F.lit(1).alias("moved_version"),
            F.min("day").alias("moved_first"), F.max("day").alias("moved_last"),
        )

    none = readings.limit(0).select(
        "site_id", F.lit(0).alias("total_kg"), F.lit(0).alias("measurement_count"),
        F.lit(0).alias("version"), F.col("day").alias("first_reading_at"),
        F.col("day").alias("last_reading_at"), F.col("day").alias("updated_at"),
    )
    now = F.lit(AS_OF)
    once = advance_summary(none, deltas(readings.filter(F.col("event_id") >= mid)), now)
    twice = advance_summary(once, deltas(readings.filter(F.col("event_id") < mid)), now)
    return twice.select(
        "site_id",
        F.unix_millis("first_reading_at").alias("first_ms"),
        F.unix_millis("last_reading_at").alias("last_ms"),
    )


@query("prj_15_drift_diagnosis", f"""
WITH {E_SITES}
SELECT {SITE_E} AS id, CASE user_id % 5 WHEN 0 THEN 'double counted' WHEN 1 THEN 'update lost'
       ELSE 'ok' END AS verdict
FROM s""")
def drift(spark, sf_dir):
    number = F.substring("id", -12, 12).cast("bigint")
    stored = F.col("total_kg") + F.when(number % 5 == 0, 1).when(number % 5 == 1, -1).otherwise(0)
    return _sites(spark, sf_dir).select(
        "id", total_verdict(stored, F.col("total_kg")).alias("verdict")
    )
