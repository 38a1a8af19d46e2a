"""Column expressions on literal rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gaugebook.functions.compliance import (
    compliance_status,
    operator_name,
    utilization_band,
    utilization_pct,
)
from gaugebook.functions.identity import (
    MAX_ARRIVAL_SEQ,
    arrival_of,
    arrival_ord,
    position_of,
    request_fingerprint,
)
from gaugebook.functions.values import (
    canonical_decimal,
    derived_uuid,
    fits,
    grams_to_kilograms,
    mass_text,
    parse_instant,
    parse_mass,
    stripped,
)


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.withColumn("x", expr).orderBy("i").select("x").collect()]


def test_canonical_decimal(spark):
    pairs = {"5.50": "5.5", "5.000": "5", "0.10": "0.1", "5": "5", "0": "0", "10.0000": "10",
             "007.0": "007", "100": "100"}
    assert column(spark, list(pairs), "string", F.expr(canonical_decimal("v"))) == list(pairs.values())


def test_grams(spark):
    grams = ["1000", "1", "0", "500", "12345", "1234.5", "8.2", "20.3", "1.005"]
    want = ["1", "0.001", "0", "0.5", "12.345", "1.2345", "0.0082", "0.0203", "0.001005"]
    got = column(spark, [Decimal(g) for g in grams], "decimal(28,10)", grams_to_kilograms(F.col("v")))
    assert [g.normalize() for g in got] == [Decimal(w).normalize() for w in want]


def test_instants(spark):
    texts = {
        "2026-08-09T12:00:00.000Z": 1786276800000,
        "2026-08-09T12:00Z": 1786276800000,
        "2026-08-09T07:00:00-05:00": 1786276800000,
        "2026-08-09T12:00:00.1239999Z": 1786276800123,
        "1969-12-31T23:59:59.9999Z": -1,
        "2026-08-09T12:00:00": None,
        "2026-02-30T12:00:00Z": None,
        "2026-08-09T24:00:00Z": None,
        "2026-08-09 12:00:00Z": None,
        "2026-08-09T12:00:00+0500": None,
        "2026-08-09T12:00:00Z\n": None,
        "": None,
    }
    got = column(spark, list(texts), "string", F.unix_millis(F.expr(parse_instant("v"))))
    assert got == list(texts.values())


def test_masses(spark):
    texts = ["0", "10.0000", "9999999999.9999", "10000000000", "1.00001", "-1", "1e3", ".5", "5.", "1\n"]
    got = column(spark, texts, "string", F.expr(parse_mass("v")))
    assert got == [Decimal(t) for t in texts[:3]] + [None] * 7


def test_strip_and_length(spark):
    assert column(spark, ["  a\tb ﻿\n"], "string", F.expr(stripped("v"))) == ["a\tb"]
    # A supplementary character counts as two units.
    texts = ["", "ab", "abc", "é" * 2, "é" * 3, "😀", "😀a"]
    assert column(spark, texts, "string", F.expr(fits("v", 2))) == [
        False, True, False, True, False, True, False]


@pytest.mark.parametrize(
    "total, limit, status, pct, band",
    [
        ("100.0000", "100.000", "Within Limit", "100.00", "warn"),
        ("100.0001", "100.000", "Limit Exceeded", "100.00", "over"),
        ("0", "1.000", "Within Limit", "0.00", "ok"),
        ("79.9999", "100.000", "Within Limit", "80.00", "ok"),
        ("80", "100.000", "Within Limit", "80.00", "warn"),
        ("130", "100.000", "Limit Exceeded", "130.00", "over"),
        ("1000000000.0002", "1000000000.000", "Limit Exceeded", "100.00", "over"),
    ],
)
def test_compliance(spark, total, limit, status, pct, band):
    row = spark.range(1).select(
        F.lit(Decimal(total)).cast("decimal(18,4)").alias("t"),
        F.lit(Decimal(limit)).cast("decimal(14,3)").alias("l"),
    ).select(
        compliance_status(F.col("t"), F.col("l")),
        utilization_pct(F.col("t"), F.col("l")),
        utilization_band(F.col("t"), F.col("l")),
    ).first()
    assert tuple(row) == (status, Decimal(pct), band)


def test_operator_only_from_a_json_string(spark):
    texts = ['{"operator":"Acme"}', '{"operator":5}', "{}", "not json", '{"operator":null}', None]
    assert column(spark, texts, "string", operator_name(F.col("v"))) == ["Acme"] + [None] * 5


def test_accepted_amount_text(spark):
    got = column(spark, [Decimal("0.0000"), Decimal("15.0000")], "decimal(18,4)", mass_text(F.col("v")))
    assert got == ["0", "15.0000"]


def test_order_key_round_trip(spark):
    seqs = [0, 1, MAX_ARRIVAL_SEQ]
    ord_ = arrival_ord(F.col("v"), F.lit(99))
    assert column(spark, seqs, "bigint", arrival_of(ord_)) == seqs
    assert column(spark, seqs, "bigint", position_of(ord_)) == [99] * 3


def test_derived_ids_are_stable_uuids(spark):
    ids = column(spark, ["a", "b", "a"], "string", derived_uuid(F.col("v"), F.lit("k")))
    assert ids[0] == ids[2] != ids[1]
    import uuid

    assert all(uuid.UUID(i).version == 8 for i in ids)


READINGS = "array<struct<reading_id:string,device_id:string,reading_ts:timestamp,mass_text:string,source:string>>"


def fingerprint(spark, readings, site="s"):
    from datetime import datetime

    rows = [(rid, d, datetime.fromisoformat(ts), m, s) for rid, d, ts, m, s in readings]
    df = spark.createDataFrame([(site, rows)], f"site string, rs {READINGS}")
    return df.select(F.expr(request_fingerprint("site", "rs"))).first()[0]


def test_fingerprint_classes(spark):
    a = (None, "A", "2026-08-09T01:00:00+00:00", "1.0000", "sensor")
    b = (None, "B", "2026-08-09T02:00:00+00:00", "2.0000", "sensor")
    base = fingerprint(spark, [a, b])
    same = [
        [b, a],
        [a[:3] + ("1", "sensor"), b],
        [(None, "A", "2026-08-08T20:00:00-05:00", "1.0", "sensor"), b],
    ]
    other = [
        [a[:3] + ("1.0001", "sensor"), b],
        [a, b, (None, "C", "2026-08-09T03:00:00+00:00", "3", "sensor")],
        [("x",) + a[1:], b],
        [a[:4] + ("manual",), b],
        [a[:3] + ("01.0000", "sensor"), b],
    ]
    assert all(fingerprint(spark, rs) == base for rs in same)
    assert all(fingerprint(spark, rs) != base for rs in other)
    assert fingerprint(spark, [a, b], "t") != base
