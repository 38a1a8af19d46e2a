"""Name -> Spark query and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ---- shared SQL ---------------------------------------------------------------


def uuid_sql(number: str) -> str:
    return f"'00000000-0000-4000-8000-' || lpad(CAST({number} AS VARCHAR), 12, '0')"


SITE_E = uuid_sql("user_id")
SITE_L = uuid_sql("cust")

# Feed E: readings, verdicts, batches, running totals.
E_READINGS = """
e AS (
  SELECT event_id, user_id, event_type, date_trunc('day', ts) AS day,
         CAST(value AS DECIMAL(14,4)) AS kg, event_id // 1000 AS blk,
         (event_id // 1000) * 16777216 + user_id AS seq,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""
E_VERDICTS = E_READINGS + """,
r AS (
  SELECT *, row_number() OVER w AS rn, first_value(kg) OVER w AS first_kg,
         first_value(seq) OVER w AS first_seq,
         row_number() OVER (PARTITION BY user_id, blk ORDER BY event_id) - 1 AS pos
  FROM e WINDOW w AS (PARTITION BY user_id, event_type, day ORDER BY event_id)),
v AS (
  SELECT *, CASE WHEN rn = 1 THEN 'accept'
                 WHEN kg = first_kg OR seq = first_seq THEN 'duplicate'
                 ELSE 'value_conflict' END AS verdict
  FROM r)"""
E_BATCHES = E_VERDICTS + """,
b AS (
  SELECT user_id, blk, seq, count(*) AS submitted,
         count(*) FILTER (WHERE verdict = 'accept') AS accepted,
         count(*) FILTER (WHERE verdict = 'duplicate') AS duplicates,
         count(*) FILTER (WHERE verdict = 'value_conflict') AS conflicts,
         CAST(coalesce(sum(kg) FILTER (WHERE verdict = 'accept'), 0) AS DECIMAL(18,4)) AS kg,
         min(day) FILTER (WHERE verdict = 'accept') AS first_day,
         max(day) FILTER (WHERE verdict = 'accept') AS last_day
  FROM v GROUP BY user_id, blk, seq),
t AS (
  SELECT *, CAST(sum(kg) OVER (PARTITION BY user_id ORDER BY seq) AS DECIMAL(18,4)) AS total,
         CAST(2000 + 100 * (user_id % 10) AS DECIMAL(14,3)) AS lim
  FROM b)"""
E_SITES = E_BATCHES + """,
s AS (
  SELECT user_id, CAST(sum(kg) AS DECIMAL(18,4)) AS total, CAST(sum(accepted) AS BIGINT) AS n,
         count(*) AS version, min(first_day) AS first_day, max(last_day) AS last_day,
         max(lim) AS lim
  FROM t GROUP BY user_id)"""
# Events of feed E: the two halves of the feed are epochs 2 and 3; ids are epoch and position.
E_EVENTS = E_BATCHES + """,
hv AS (SELECT (min(seq) + max(seq) + 1) // 2 // 16777216 AS half FROM e),
ev AS (
  SELECT *, CASE WHEN blk >= half THEN 3 ELSE 2 END * 68719476736
           + row_number() OVER (PARTITION BY blk >= half ORDER BY seq * 2 + o) - 1 AS id
  FROM (SELECT t.*, 0 AS o FROM t UNION ALL SELECT t.*, 1 FROM t WHERE total > lim AND total - kg <= lim), hv)"""
LAST_DAY = "(SELECT max(date_trunc('day', ts)) FROM events)"
STATUS = "CASE WHEN total > lim THEN 'Limit Exceeded' ELSE 'Within Limit' END"
# Round half up in integers: total / limit in percent, two decimals.
PCT = (
    "CAST(((2 * CAST(total * 10000 AS HUGEINT) + CAST(lim AS HUGEINT)) // "
    "(2 * CAST(lim AS HUGEINT))) * 0.01 AS DECIMAL(18,2))"
)

# Feed L: arrivals in order, outcome per arrival, verdict per claimed reading.
L_ARRIVALS = """
l AS (
  SELECT o_custkey AS cust, l_orderkey, l_linenumber, l_suppkey, l_shipdate,
         CAST(l_quantity AS DECIMAL(14,4)) AS kg,
         l_suppkey || '-' || l_orderkey || '-' || l_linenumber AS key,
         row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate,
           l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
L_OUTCOMES = L_ARRIVALS + """,
c AS (
  SELECT *, row_number() OVER w AS crn, first_value(l_shipdate) OVER w AS first_ts,
         first_value(kg) OVER w AS claim_kg
  FROM l WINDOW w AS (PARTITION BY cust, key ORDER BY seq)),
o AS (
  SELECT *, CASE WHEN crn = 1 THEN 'accepted'
                 WHEN l_shipdate = first_ts AND kg = claim_kg THEN 'replayed'
                 ELSE 'IDEMPOTENCY_KEY_REUSED' END AS outcome
  FROM c)"""
L_VERDICTS = L_OUTCOMES + """,
v AS (
  SELECT *, CASE WHEN rn = 1 THEN 'accept' WHEN kg = first_kg THEN 'duplicate'
                 ELSE 'value_conflict' END AS verdict
  FROM (SELECT *, row_number() OVER w AS rn, first_value(kg) OVER w AS first_kg
        FROM o WHERE outcome = 'accepted'
        WINDOW w AS (PARTITION BY cust, l_orderkey, l_linenumber ORDER BY seq)))"""
L_TOTALS = L_VERDICTS + """,
t AS (
  SELECT v.*, CASE WHEN verdict = 'accept' THEN 1 ELSE 0 END AS accepted,
         CAST(CASE WHEN verdict = 'accept' THEN kg ELSE 0 END AS DECIMAL(18,4)) AS delta,
         CAST(sum(CASE WHEN verdict = 'accept' THEN kg ELSE 0 END)
              OVER (PARTITION BY cust ORDER BY seq) AS DECIMAL(18,4)) AS total,
         CAST(500 + 100 * c_nationkey AS DECIMAL(14,3)) AS lim, c_name
  FROM v JOIN customer ON c_custkey = cust)"""
