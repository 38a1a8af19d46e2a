"""Which stages stay on disk, and how long."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from gaugebook.operators.dedup import resolve
from gaugebook.schemas import MASS
from gaugebook.session import checkpoint_root, dropping_stages, release, stage


def staged(spark) -> set[str]:
    folder = Path(checkpoint_root(spark).removeprefix("file:")) / "gaugebook"
    return {p.name for p in folder.glob("*/*")}


def labels(names: set[str]) -> list[str]:
    return sorted(name.rpartition("-")[0] for name in names)


def test_stages_outlive_one_block(spark):
    before = staged(spark)
    with dropping_stages(spark):
        with dropping_stages(spark):
            stage(spark.range(3), "inner")
            kept = stage(spark.range(3), "kept", outlives=True)
        assert labels(staged(spark) - before) == ["kept"] and kept.count() == 3
        early = stage(spark.range(3), "early")
        release(early)
        assert labels(staged(spark) - before) == ["kept"]
    assert staged(spark) == before


def test_contested_verdicts_leave_what_they_read(spark):
    """links, rounds, candidates and parts stayed until the session ended."""
    rows = [(i, f"r{i // 2}" if i % 3 else None, i // 3) for i in range(60)]
    readings = spark.createDataFrame(rows, "ord long, reading_id string, at long").select(
        F.lit("s").alias("site_id"), F.lit("d").alias("device_id"), "reading_id",
        F.timestamp_seconds("at").alias("reading_ts"), F.lit(1).cast(MASS).alias("ch4_kg"), F.col("ord") * 128)
    readings = readings.withColumnRenamed(readings.columns[-1], "ord")
    for limit in (100_000, 4):  # in one pass, and by rounds
        before = staged(spark)
        got = resolve(readings, ordered_pass_rows=limit)
        assert labels(staged(spark) - before) == ["contested", "ids", "instants"]
        assert got.count() == 60 and got.filter("verdict = 'accept'").count() > 0
