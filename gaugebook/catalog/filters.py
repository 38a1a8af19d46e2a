"""Filters and validation."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gaugebook.catalog.feeds import (
    AS_OF,
    event_readings,
    event_sites,
    events_current,
    events_store,
    new_events_store,
    once,
    lineitem_arrivals,
    site_uuid,
    table,
    text_instant,
    wire_reading,
)
from gaugebook.catalog.registry import (
    E_EVENTS,
    E_READINGS,
    E_SITES,
    L_VERDICTS,
    LAST_DAY,
    SITE_E,
    query,
    uuid_sql,
)
from gaugebook.functions.identity import arrival_ord
from gaugebook.operators.dedup import resolve
from gaugebook.operators.events import delivery_state, eligible
from gaugebook.operators.validate import check_current, check_legacy, check_sites
from gaugebook.plans.ingest import log_delivery_attempts, requeue
from gaugebook.plans.reconcile import quality_report
from gaugebook.plans.reports import page_rows, recent_mass, site_view
from gaugebook.session import stage

def paths():
    return F.expr("array_join(transform(details, d -> d.path), ',')").alias("paths")


def text_list(*pairs: tuple[str, str]) -> str:
    """SQL: the names whose condition holds, comma-separated, in order."""
    parts = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs)
    return f"concat_ws(',', {parts})"


@query("flt_1_reading_rules", "SELECT event_id AS arrival_seq, " + text_list(
    ("readings.0.readingId", "event_id % 19 = 0"),
    ("readings.0.deviceId", "event_id % 7 = 1"),
    ("readings.0.readingTs", "event_id % 13 = 0"),
    ("readings.0.ch4Kg", "event_id % 11 < 2"),
    ("readings.0.source", "event_id % 17 = 0"),
) + " AS paths FROM events")
def reading_rules(spark, sf_dir):
    """Every event as a one-reading batch, misspelled in ways its number decides."""
    n, kg = F.col("event_id"), F.col("kg").cast("string")
    reading = wire_reading(
        F.when(n % 19 == 0, " ").when(n % 19 == 1, "  x "),
        F.when(n % 7 == 0, F.concat(F.lit(" "), "event_type", F.lit("\t")))
        .when(n % 7 == 1, "   ").otherwise(F.col("event_type")),
        F.when(n % 13 == 0, F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(n % 13 == 1, F.concat(F.date_format("day", "yyyy-MM-dd'T'HH:mm"), F.lit("+02:00")))
        .otherwise(text_instant(F.col("day"))),
        F.when(n % 11 == 0, F.concat(F.lit("-"), kg)).when(n % 11 == 1, F.concat(kg, F.lit("0")))
        .otherwise(kg),
        F.when(n % 17 == 0, "drone").when(n % 17 == 1, F.lit(None)).otherwise("manual"),
    )
    arrivals = event_readings(spark, sf_dir).select(
        n.alias("arrival_seq"), F.lit("2").alias("api_version"),
        n.cast("string").alias("idempotency_key"), site_uuid(F.col("user_id")).alias("site_id"),
        F.array(reading).alias("readings"),
    )
    return check_current(arrivals).select("arrival_seq", paths())


@query("flt_2_batch_size", """
SELECT (event_id // 300) * 3 + user_id % 3 AS arrival_seq, count(*) AS readings,
       CASE WHEN count(*) > 100 THEN 'readings' ELSE '' END AS paths
FROM events GROUP BY event_id // 300, user_id % 3""")
def batch_size(spark, sf_dir):
    """Batches of about 100 readings: the larger half is refused as a whole."""
    batches = (
        event_readings(spark, sf_dir)
        .groupBy(
            (F.floor(F.col("event_id") / 300) * 3 + F.col("user_id") % 3).alias("arrival_seq"),
            (F.col("user_id") % 3).alias("u"),
        )
        .agg(
            F.collect_list(
                F.struct(
                    F.col("event_type").alias("device_id"),
                    F.unix_seconds("day").alias("ts"),
                    (F.col("kg") * 1000).cast("decimal(28,10)").alias("ch4_g"),
                )
            ).alias("readings")
        )
        .select(
            "arrival_seq", site_uuid(F.col("u")).alias("site_id"),
            site_uuid(F.col("arrival_seq")).alias("batch_id"), "readings",
            F.size("readings").cast("bigint").alias("n"),
        )
    )
    checked = check_legacy(batches).join(batches.select("arrival_seq", "n"), "arrival_seq")
    return checked.select("arrival_seq", F.col("n").alias("readings"), paths())


@query("flt_3_repeated_identity", f"""
WITH {E_READINGS},
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, blk ORDER BY event_id) - 1 AS pos FROM e),
f AS (SELECT *, min(pos) OVER (PARTITION BY user_id, blk, event_type, day) AS first_pos FROM p)
SELECT seq AS arrival_seq,
       coalesce(string_agg('readings.' || pos, ',' ORDER BY pos) FILTER (WHERE first_pos < pos), '')
         AS paths
FROM f GROUP BY seq""")
def repeated_identity(spark, sf_dir):
    return check_current(events_current(spark, sf_dir)).select("arrival_seq", paths())


@query("flt_4_mixed_schemes", f"""
WITH {E_READINGS},
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, blk ORDER BY event_id) - 1 AS pos FROM e),
g AS (SELECT seq, event_type, day, min(pos) FILTER (WHERE k % 2 = 0) AS named,
             min(pos) FILTER (WHERE k % 2 = 1) AS anonymous
      FROM p GROUP BY ALL)
SELECT seq AS arrival_seq,
       string_agg('readings.' || greatest(named, anonymous), ',' ORDER BY named) AS paths
FROM g WHERE named IS NOT NULL AND anonymous IS NOT NULL GROUP BY seq""")
def mixed_schemes(spark, sf_dir):
    rid = F.when(F.col("k") % 2 == 0, F.col("event_id"))
    mixed = F.expr(
        "array_join(transform(filter(details, d -> d.message LIKE 'readings with and without%'), "
        "d -> d.path), ',')"
    )
    return (
        stage(check_current(events_current(spark, sf_dir, rid)), "checked")
        .select("arrival_seq", mixed.alias("paths")).filter("paths <> ''")
    )


@query("flt_5_key_present", """
SELECT event_id AS arrival_seq,
       CASE WHEN event_id % 5 < 2 THEN 'Idempotency-Key' ELSE '' END AS paths,
       CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 > 1 THEN 'k' || event_id END
         AS idempotency_key
FROM events""")
def key_present(spark, sf_dir):
    n = F.col("event_id")
    key = F.when(n % 5 == 0, "  \t").when(n % 5 > 1, F.concat(F.lit(" k"), n, F.lit(" ")))
    arrivals = event_readings(spark, sf_dir).select(
        n.alias("arrival_seq"), F.lit("2").alias("api_version"), key.alias("idempotency_key"),
        site_uuid(F.col("user_id")).alias("site_id"),
        F.array(wire_reading(F.lit(None), F.col("event_type"), text_instant(F.col("day")),
                             F.col("kg"))).alias("readings"),
    )
    return check_current(arrivals).select("arrival_seq", paths(), "idempotency_key")


@query("flt_6_legacy_rules", "SELECT event_id AS arrival_seq, " + text_list(
    ("batch_id", "event_id % 23 = 0"),
    ("readings.0.device_id", "event_id % 7 = 1"),
    ("readings.0.ts", "event_id % 13 = 0"),
    ("readings.0.ch4_g", "event_id % 11 < 2"),
) + " AS paths FROM events")
def legacy_rules(spark, sf_dir):
    n = F.col("event_id")
    grams = (F.col("kg") * 1000 + 1).cast("decimal(28,10)")
    reading = F.struct(
        F.when(n % 7 == 1, " ").otherwise(F.col("event_type")).alias("device_id"),
        F.when(n % 13 == 0, 0).otherwise(F.unix_seconds("day")).alias("ts"),
        F.when(n % 11 == 0, -grams).when(n % 11 == 1, F.lit("99999999999999.5").cast("decimal(28,10)"))
        .otherwise(grams).cast("decimal(28,10)").alias("ch4_g"),
    )
    arrivals = event_readings(spark, sf_dir).select(
        n.alias("arrival_seq"), site_uuid(F.col("user_id")).alias("site_id"),
        F.when(n % 23 == 0, "not-a-uuid").otherwise(site_uuid(n)).alias("batch_id"),
        F.array(reading).alias("readings"),
    )
    return check_legacy(arrivals).select("arrival_seq", paths())


@query("flt_7_site_rules", f"""
SELECT {uuid_sql('c_custkey')} AS id, """ + text_list(
    ("name", "c_custkey % 5 = 0"),
    ("emissionLimitKg", "CAST(c_acctbal AS DECIMAL(14,2)) <= 0 OR c_custkey % 7 = 0"),
    ("metadata", "c_custkey % 11 = 0"),
) + " AS paths FROM customer")
def site_rules(spark, sf_dir):
    n = F.col("c_custkey")
    limit = F.col("c_acctbal").cast("decimal(14,2)").cast("string")
    feed = table(spark, sf_dir, "customer").select(
        site_uuid(n).alias("id"),
        F.when(n % 5 == 0, "  ").otherwise(F.col("c_name")).alias("name"),
        F.when(n % 7 == 0, F.concat(limit, F.lit("00"))).otherwise(limit).alias("emissionLimitKg"),
        F.when(n % 11 == 0, "[1]").when(n % 11 == 1, '{"a":1}').alias("metadata"),
    )
    return check_sites(feed).select("id", paths())


@query("flt_8_recent_window", f"""
WITH {E_READINGS},
d AS (SELECT DISTINCT ON (user_id, event_type, day) * FROM e ORDER BY user_id, event_type, day, event_id)
SELECT {SITE_E} AS site_id, CAST(sum(kg) AS DECIMAL(18,4)) AS last_24h_kg
FROM d WHERE day BETWEEN {LAST_DAY} - INTERVAL 36 HOURS AND {LAST_DAY} - INTERVAL 12 HOURS
GROUP BY user_id""")
def recent_window(spark, sf_dir):
    """Closed at both ends: the newest day lies after the window and must not count."""
    stored = events_store(spark, sf_dir).read("measurements")
    newest = table(spark, sf_dir, "events").agg(F.max(F.date_trunc("day", "ts"))).first()[0]
    return recent_mass(stored, newest - timedelta(hours=12))


@query("flt_9_site_lookup", f"""
SELECT {uuid_sql('c_custkey')} AS id,
       CASE WHEN c_custkey NOT IN (SELECT user_id FROM events) THEN 'SITE_NOT_FOUND' END AS code
FROM customer""")
def site_lookup(spark, sf_dir):
    """Point lookup as a report: each requested id, found or not."""
    sites = events_store(spark, sf_dir).read("sites").select("id", F.lit(True).alias("found"))
    wanted = table(spark, sf_dir, "customer").select(site_uuid(F.col("c_custkey")).alias("id"))
    return wanted.join(sites, "id", "left").select(
        "id", F.when(F.col("found").isNull(), "SITE_NOT_FOUND").alias("code")
    )


@query("flt_10_keyset_page", f"""
WITH {E_SITES}, n AS (SELECT {SITE_E} AS id, 'Site ' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS name
                      FROM s)
SELECT id, name FROM n
WHERE (name, id) > ('Site 00000005', '00000000-0000-4000-8000-000000000005')
ORDER BY name, id LIMIT 51""")
def keyset_page(spark, sf_dir):
    """A page (the limit is the feature) plus the row that tells whether more follow."""
    store = events_store(spark, sf_dir)
    view = site_view(store.read("sites"), store.summary())
    after = ("Site 00000005", "00000000-0000-4000-8000-000000000005")
    return page_rows(view, after).select("id", "name")


# Attempts derived from each event's number: id % 12 failures, one a minute before
# the reference instant, a success after them where id % 3 = 0, and a claim that has
# not reported yet, ten seconds old, where id % 5 = 0.
def attempts_of(events):
    at = lambda minutes: F.lit(AS_OF) - F.make_dt_interval(mins=minutes)
    n = (F.col("id") % 12).cast("int")
    failures = events.filter(n > 0).select(
        F.col("id").alias("event_id"), F.explode(F.sequence(F.lit(1), n)).alias("i"), n.alias("n")
    ).select(
        "event_id", at(60 - F.col("i")).alias("attempted_at"), F.lit(False).alias("ok"),
        F.concat(F.col("i").cast("string"), F.lit(" "), F.repeat(F.lit("x"), 600)).alias("error"),
    )
    none = F.lit(None).cast("string").alias("error")
    successes = events.filter(F.col("id") % 3 == 0).select(
        F.col("id").alias("event_id"), at(F.lit(30)).alias("attempted_at"), F.lit(True).alias("ok"), none
    )
    claims = events.filter(F.col("id") % 5 == 0).select(
        F.col("id").alias("event_id"),
        (F.lit(AS_OF) - F.expr("INTERVAL 10 SECONDS")).alias("attempted_at"),
        F.lit(None).cast("boolean").alias("ok"), none,
    )
    return failures.unionByName(successes).unionByName(claims)


# A requeue puts back what failed ten times and more; a claim it finds no longer holds.
EVENT_IDS = E_EVENTS + """,
i AS (SELECT id, CASE WHEN o = 0 THEN 'measurements.ingested' ELSE 'site.limit_exceeded' END AS event_type FROM ev),
st AS (SELECT id, event_type, id % 12 AS failures, id % 3 = 0 AS published,
         CASE WHEN id % 12 >= 10 AND id % 7 = 0 THEN 0 ELSE id % 12 END AS attempts,
         id % 5 = 0 AND NOT (id % 12 >= 10 AND id % 7 = 0) AS held FROM i)"""


def delivery_store(spark, sf_dir):
    """Feed E with reported deliveries in two commits, and a requeue after them."""

    def build():
        store = new_events_store(spark, sf_dir)
        log = attempts_of(store.read("events_out"))
        log_delivery_attempts(store, log.filter("ok IS NOT NULL"), as_of=AS_OF)
        log_delivery_attempts(store, log.filter("ok IS NULL"), as_of=AS_OF)
        requeue(store, store.read("events_out").filter("id % 12 >= 10 AND id % 7 = 0"), as_of=AS_OF)
        return store

    return once(spark, sf_dir, "delivery_store", build)


def events_state(spark, sf_dir):
    """Every event ever, from the whole log."""
    store = delivery_store(spark, sf_dir)
    return delivery_state(store.read("events_out").drop("epoch"), store.read("delivery_attempts"))


def pending_events(spark, sf_dir):
    """Undelivered events, from the table that commits keep of them."""
    return delivery_store(spark, sf_dir).pending()


@query("flt_11_eligible_events", f"""
WITH {EVENT_IDS}
SELECT id, event_type, attempts FROM st WHERE NOT published AND attempts < 10 AND NOT held""")
def eligible_events(spark, sf_dir):
    return eligible(pending_events(spark, sf_dir), F.lit(AS_OF)).select(
        "id", "event_type", F.col("attempts").cast("bigint").alias("attempts")
    )


def line_verdicts(spark, sf_dir):
    """Reading verdicts of feed L in one epoch, without tables."""
    from gaugebook.catalog.joins import line_claims  # the claims are shared

    readings = line_claims(spark, sf_dir).filter("owns").select(
        "site_id", F.posexplode("readings").alias("pos", "r"), "arrival_seq"
    ).select("site_id", "r.device_id", "r.reading_id", "r.reading_ts", "r.ch4_kg",
             arrival_ord(F.col("arrival_seq"), F.col("pos")).alias("ord"))
    return resolve(readings)


@query("flt_12_withheld", f"""
WITH {L_VERDICTS}
SELECT verdict, count(*) AS n, CAST(sum(kg) AS DECIMAL(18,4)) AS kg FROM v GROUP BY verdict""")
def withheld(spark, sf_dir):
    return line_verdicts(spark, sf_dir).groupBy("verdict").agg(
        F.count("*").alias("n"), F.sum("ch4_kg").cast("decimal(18,4)").alias("kg")
    )


@query("flt_13_table_rules", f"""
WITH {E_SITES}
SELECT 'negative_mass' AS rule, count(*) FILTER (WHERE verdict = 'accept' AND kg < 0) AS rows FROM v
UNION ALL SELECT 'unknown_source', count(*) FILTER (WHERE 'sensor' NOT IN ('sensor', 'satellite', 'manual')) FROM v
UNION ALL SELECT 'negative_total', count(*) FILTER (WHERE total < 0) FROM s
UNION ALL SELECT 'limit_not_positive', count(*) FILTER (WHERE lim <= 0) FROM s
UNION ALL SELECT 'unknown_status', count(*) FILTER (WHERE 'completed' NOT IN ('in_progress', 'completed', 'failed')) FROM b""")
def table_rules(spark, sf_dir):
    store = events_store(spark, sf_dir)
    return quality_report(store.read("sites"), store.summary(), store.read("measurements"), store.read("batch_ledger"))


@query("flt_13b_broken_rules", f"""
WITH {E_SITES}
SELECT 'negative_mass' AS rule, count(*) FILTER (WHERE verdict = 'accept' AND
  CASE WHEN user_id % 5 = 0 THEN kg > 0 ELSE kg < 0 END) AS rows FROM v
UNION ALL SELECT 'unknown_source', count(*) FILTER (WHERE verdict = 'accept' AND user_id % 7 IN (3, 4)) FROM v
UNION ALL SELECT 'negative_total', count(*) FILTER (WHERE user_id % 4 = 1 AND total > 0) FROM s
UNION ALL SELECT 'limit_not_positive', count(*) FILTER (WHERE user_id % 6 = 2) FROM s
UNION ALL SELECT 'unknown_status', count(*) FILTER (WHERE user_id % 3 = 1) FROM b""")
def broken_rules(spark, sf_dir):
    """The same tables with rows that break each rule, whoever wrote them."""
    store = events_store(spark, sf_dir)
    user = lambda column: F.substring(column, -12, 12).cast("bigint")
    site = user("site_id")
    measurements = store.read("measurements").withColumns({
        "ch4_kg": F.when(site % 5 == 0, -F.col("ch4_kg")).otherwise(F.col("ch4_kg")),
        "source": F.when(site % 7 == 3, "probe").when(site % 7 != 4, F.col("source")),
    })
    return quality_report(
        store.read("sites").withColumn(
            "emission_limit_kg", F.when(user("id") % 6 != 2, F.col("emission_limit_kg")).otherwise(0)),
        store.summary().withColumn(
            "total_kg", F.when(site % 4 == 1, -F.col("total_kg")).otherwise(F.col("total_kg"))),
        measurements,
        store.read("batch_ledger").withColumn("status", F.when(site % 3 == 1, "lost").otherwise(F.col("status"))),
    )
