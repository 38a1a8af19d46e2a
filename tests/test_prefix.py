"""Chunked running totals against plain accumulation."""

import random

import pytest
from pyspark.sql import functions as F

from gaugebook.operators.prefix import running_total


@pytest.mark.parametrize("bits", [(), (2,), (3, 2), (20, 20)])
@pytest.mark.parametrize("spread", [1, 1000, 1 << 40])
def test_running_total(spark, bits, spread):
    rng = random.Random(5)
    rows, seqs = [], set()
    for _ in range(300):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 3)}"
        seq = rng.randint(0, 400) * spread
        if (key, seq) not in seqs:
            seqs.add((key, seq))
            rows.append((key, seq, rng.randint(0, 9)))
    df = spark.createDataFrame(rows, "k string, s bigint, v int").withColumn(
        "v", F.col("v").cast("decimal(18,4)"))
    got = {(r.k, r.s): int(r.t) for r in running_total(df, "k", "s", "v", "t", bits).collect()}
    want, sums = {}, {}
    for key, seq, v in sorted(rows, key=lambda r: r[1]):
        sums[key] = sums.get(key, 0) + v
        want[key, seq] = sums[key]
    assert got == want


def test_every_input_is_chunked(spark):
    """No plain window over a whole key, not even for a small one."""
    df = spark.range(10).selectExpr("'a' AS k", "id AS s", "CAST(id AS decimal(18,4)) AS v")
    plan = running_total(df, "k", "s", "v", "t")._jdf.queryExecution().toString()
    assert "_chunk" in plan
