"""Windows, ordering, top-k and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gaugebook.catalog.feeds import (
    AS_OF,
    event_readings,
    event_sites,
    events_legacy,
    events_store,
    lineitem_arrivals,
    lineitem_store,
    once,
    site_uuid,
    table,
)
from gaugebook.catalog.filters import EVENT_IDS, pending_events
from gaugebook.catalog.registry import (
    E_BATCHES,
    E_READINGS,
    E_SITES,
    E_VERDICTS,
    L_ARRIVALS,
    L_OUTCOMES,
    L_TOTALS,
    L_VERDICTS,
    SITE_E,
    SITE_L,
    query,
)
from gaugebook.functions.identity import INSTANT_KEY
from gaugebook.operators.claims import first_claims
from gaugebook.operators.dedup import instant_profile, resolve
from gaugebook.operators.events import next_deliveries
from gaugebook.operators.totals import crossings
from gaugebook.operators.validate import check_legacy, check_sites
from gaugebook.plans.ingest import claim_epoch, decide_epoch, exploded_readings
from gaugebook.plans.reports import conflicts_view, latest_batches, page_rows, site_view


def event_sites_table(spark, sf_dir):
    return check_sites(event_sites(spark, sf_dir)).select("id", "name", "emission_limit_kg")


def event_claims(spark, sf_dir):
    return once(spark, sf_dir, "event_claims", lambda: claim_epoch(
        check_legacy(events_legacy(spark, sf_dir)), event_sites_table(spark, sf_dir)
    ))


@query("limit_crossings", f"""
WITH {E_BATCHES}
SELECT {SITE_E} AS site_id, 'Site ' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS site_name,
       lpad(CAST(blk AS VARCHAR), 8, '0') || '-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0')
         AS idempotency_key,
       lim AS emission_limit_kg, total AS total_kg, CAST(total - lim AS DECIMAL(18,4)) AS over_kg
FROM t WHERE total > lim AND total - kg <= lim""")
def limit_crossings(spark, sf_dir):
    """The flagship: which sites exceeded their limit, by how much, in which batch.

    Straight from the arrivals, in one epoch and without tables.
    """
    claims = claim_epoch(
        check_legacy(events_legacy(spark, sf_dir)), event_sites_table(spark, sf_dir)
    )
    epoch = decide_epoch(claims, event_sites_table(spark, sf_dir))
    over = (F.col("total_kg") - F.col("emission_limit_kg")).cast("decimal(18,4)")
    return crossings(epoch.batches).select(
        "site_id", "site_name", "idempotency_key", "emission_limit_kg", "total_kg",
        over.alias("over_kg"),
    )


@query("wn_1_first_claim", f"""
WITH {L_OUTCOMES}
SELECT {SITE_L} AS site_id, key AS idempotency_key, epoch_ms(l_shipdate) AS owner_ms, kg AS owner_kg
FROM o WHERE outcome = 'accepted'""")
def first_claim(spark, sf_dir):
    arrivals = lineitem_arrivals(spark, sf_dir).select(
        "arrival_seq", "site_id", "idempotency_key", "readings",
        F.lit("-").alias("fingerprint"),
    )
    owners = first_claims(arrivals).select(F.col("owner_seq").alias("arrival_seq"))
    first = F.col("readings")[0]
    return arrivals.join(owners, "arrival_seq").select(
        "site_id", "idempotency_key",
        F.unix_millis(first["readingTs"].cast("timestamp")).alias("owner_ms"),
        first["ch4Kg"].cast("decimal(14,4)").alias("owner_kg"),
    )


@query("wn_2_first_reading", f"""
WITH {E_VERDICTS}
SELECT {SITE_E} AS site_id, event_type AS device_id, epoch_ms(day) AS ms, kg, event_id
FROM v WHERE verdict = 'accept'""")
def first_reading(spark, sf_dir):
    readings = event_readings(spark, sf_dir).select(
        site_uuid(F.col("user_id")).alias("site_id"), F.col("event_type").alias("device_id"),
        F.lit(None).cast("string").alias("reading_id"), F.col("day").alias("reading_ts"),
        F.col("kg").alias("ch4_kg"), F.col("event_id").alias("ord"),
    )
    return instant_profile(readings).select(
        "site_id", "device_id", F.unix_millis("reading_ts").alias("ms"),
        F.col("a_kg").alias("kg"), F.col("a_ord").alias("event_id"),
    )


@query("wn_3_running_total", f"""
WITH {E_BATCHES} SELECT seq AS arrival_seq, {SITE_E} AS site_id, kg AS delta_kg, total AS total_kg FROM t""")
def running(spark, sf_dir):
    return events_store(spark, sf_dir).read("batch_ledger").select(
        "arrival_seq", "site_id", F.col("accepted_ch4_kg").alias("delta_kg"),
        F.col("response.total_kg").alias("total_kg"),
    )


@query("wn_4_crossings", f"""
WITH {L_TOTALS}
SELECT {SITE_L} AS site_id, c_name AS site_name, CAST(lim AS VARCHAR) AS limit_kg,
       CAST(total AS VARCHAR) AS total_kg
FROM t WHERE total > lim AND total - delta <= lim""")
def crossing_events(spark, sf_dir):
    payload = lambda name: F.get_json_object("payload", f"$.{name}")
    return lineitem_store(spark, sf_dir).read("events_out").filter(
        "event_type = 'site.limit_exceeded'"
    ).select(
        F.col("aggregate_id").alias("site_id"), payload("siteName").alias("site_name"),
        payload("emissionLimitKg").alias("limit_kg"),
        payload("totalEmissionsToDateKg").alias("total_kg"),
    )


@query("wn_5_earliest_by_id", f"""
WITH {L_ARRIVALS}
SELECT {SITE_L} AS site_id, CAST(l_orderkey AS VARCHAR) AS device_id,
       CAST(l_linenumber AS VARCHAR) AS reading_id, arg_min(kg, (l_shipdate, seq)) AS kg,
       epoch_ms(min(l_shipdate)) AS first_ms
FROM l GROUP BY cust, l_orderkey, l_linenumber""")
def earliest_by_id(spark, sf_dir):
    """Rows that repeat an id at several instants: the earliest instant stands."""
    r = F.col("readings")[0]
    rows = lineitem_arrivals(spark, sf_dir).select(
        "site_id", r["deviceId"].alias("device_id"), r["readingId"].alias("reading_id"),
        r["readingTs"].cast("timestamp").alias("ts"), r["ch4Kg"].cast("decimal(14,4)").alias("kg"),
        "arrival_seq",
    )
    return rows.groupBy("site_id", "device_id", "reading_id").agg(
        F.min_by("kg", F.struct("ts", "arrival_seq")).alias("kg"),
        F.unix_millis(F.min("ts")).alias("first_ms"),
    )


@query("wn_6_first_index", f"""
WITH {E_VERDICTS}
SELECT seq AS arrival_seq, event_type AS device_id, epoch_ms(day) AS ms, min(pos) AS first_pos,
       count(*) AS n
FROM v GROUP BY seq, event_type, day""")
def first_index(spark, sf_dir):
    return (
        events_legacy(spark, sf_dir)
        .select("arrival_seq", F.posexplode("readings").alias("pos", "r"))
        .groupBy("arrival_seq", F.col("r.device_id").alias("device_id"),
                 (F.col("r.ts") * 1000).alias("ms"))
        .agg(F.min("pos").cast("bigint").alias("first_pos"), F.count("*").alias("n"))
    )


def _view(spark, sf_dir):
    store = events_store(spark, sf_dir)
    return site_view(store.read("sites"), store.summary())


@query("ord_1_site_order", f"""
WITH {E_SITES}, n AS (SELECT {SITE_E} AS id, 'Site ' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS name
                      FROM s)
SELECT name, id FROM n ORDER BY name, id""")
def site_order(spark, sf_dir):
    return _view(spark, sf_dir).select("name", "id").orderBy("name", "id")


@query("ord_2_first_page", f"""
WITH {E_SITES}, n AS (SELECT {SITE_E} AS id, 'Site ' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS name
                      FROM s)
SELECT name, id FROM n ORDER BY name, id LIMIT 11""")
def first_page(spark, sf_dir):
    return page_rows(_view(spark, sf_dir).select("name", "id"), None, 10)


@query("ord_3_next_deliveries", f"""
WITH {EVENT_IDS}
SELECT id, event_type FROM st WHERE NOT published AND attempts < 10 AND NOT held
ORDER BY id LIMIT 50""")
def deliveries(spark, sf_dir):
    return next_deliveries(pending_events(spark, sf_dir), F.lit(AS_OF)).select("id", "event_type")


@query("ord_4_latest_batches", f"""
WITH {E_BATCHES}
SELECT seq AS arrival_seq, submitted AS readings_submitted, accepted AS readings_accepted,
       kg AS accepted_ch4_kg
FROM t ORDER BY seq DESC LIMIT 5""")
def latest(spark, sf_dir):
    wide = lambda c: F.col(c).cast("bigint").alias(c)
    return latest_batches(events_store(spark, sf_dir).read("batch_ledger")).select(
        "arrival_seq", wide("readings_submitted"), wide("readings_accepted"), "accepted_ch4_kg"
    )


@query("ord_5_sorted_inside_batch", f"""
WITH {E_READINGS}
SELECT seq AS arrival_seq,
       string_agg(event_type || ' ' || epoch_ms(day) // 1000 || ' ' || kg, ',' ORDER BY event_type, day, kg)
         AS readings
FROM e GROUP BY seq""")
def sorted_inside(spark, sf_dir):
    listed = F.expr(
        "array_join(transform(sort_array(readings), r -> concat(r.device_id, ' ', r.ts, ' ', "
        "CAST(r.ch4_g * 0.001BD AS decimal(14,4)))), ',')"
    )
    return events_legacy(spark, sf_dir).select("arrival_seq", listed.alias("readings"))


@query("set_1_all_conflicts", f"""
SELECT feed, reason, count(*) AS n FROM (
  SELECT * FROM (WITH {E_VERDICTS} SELECT 'E' AS feed, verdict AS reason FROM v WHERE verdict = 'value_conflict')
  UNION ALL
  SELECT * FROM (WITH {L_VERDICTS} SELECT 'L', verdict FROM v WHERE verdict = 'value_conflict'))
GROUP BY feed, reason""")
def all_conflicts(spark, sf_dir):
    parts = [
        conflicts_view(store.read("batch_ledger")).select(F.lit(feed).alias("feed"), "reason")
        for feed, store in (("E", events_store(spark, sf_dir)), ("L", lineitem_store(spark, sf_dir)))
    ]
    return parts[0].unionByName(parts[1]).groupBy("feed", "reason").agg(F.count("*").alias("n"))


@query("set_2_touched_instants", f"""
WITH {E_READINGS}
SELECT {SITE_E} AS site_id, count(*) AS instants
FROM (SELECT DISTINCT user_id, event_type, day FROM e) GROUP BY user_id""")
def touched(spark, sf_dir):
    return exploded_readings(event_claims(spark, sf_dir)).select(*INSTANT_KEY).distinct().groupBy(
        "site_id"
    ).agg(F.count("*").alias("instants"))


@query("set_3_not_inserted", f"""
WITH {E_VERDICTS}
SELECT {SITE_E} AS site_id, event_type AS device_id, count(*) AS n
FROM v WHERE verdict <> 'accept' GROUP BY user_id, event_type""")
def not_inserted(spark, sf_dir):
    return resolve(exploded_readings(event_claims(spark, sf_dir))).filter(
        "verdict <> 'accept'"
    ).groupBy("site_id", "device_id").agg(F.count("*").alias("n"))


@query("set_4_month_series", """
SELECT strftime(m, '%Y-%m') AS month, count(l_shipdate) AS lines
FROM (SELECT unnest(generate_series(date_trunc('month', (SELECT min(l_shipdate) FROM lineitem))::TIMESTAMP,
        (SELECT max(l_shipdate) FROM lineitem), INTERVAL 1 MONTH)) AS m)
LEFT JOIN lineitem ON date_trunc('month', l_shipdate) = m
GROUP BY 1""")
def month_series(spark, sf_dir):
    """Every month of the span, also an empty one."""
    lines = table(spark, sf_dir, "lineitem")
    span = lines.agg(
        F.date_trunc("month", F.min("l_shipdate")).alias("a"), F.max("l_shipdate").alias("b")
    )
    months = span.select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m")
    ).select(F.date_format("m", "yyyy-MM").alias("month"))
    counts = lines.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("lines")
    )
    return months.join(counts, "month", "left").select(
        "month", F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines")
    )
