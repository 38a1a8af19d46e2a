"""Keys that meet others, found by their hashes.

Most keys of an epoch come once and are not stored: nothing has to be looked up for them.
Which ones do meet others is told by 64-bit hashes, which are all that is shuffled. Hashes
of different keys may be equal: what is found is looked up by the keys themselves, so that
this costs a lookup and changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugebook.session import stage


@dataclass
class Met:
    """`hashes` of the keys that meet others."""

    keys: list[str]
    hashes: DataFrame

    def only(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys do, and perhaps a few more."""
        return rows.withColumn("_h", F.xxhash64(*self.keys)).join(self.hashes, "_h", "left_semi").drop("_h")


def met(
    keys: list[str],
    rows: DataFrame,
    stored: DataFrame | None = None,
    matters: Column | None = None,
    stored_matters: Column | None = None,
) -> Met:
    """Keys of more than one row of `rows`, or of one and of `stored`; with `matters`, only
    those with a row where it holds. `rows` and `stored` are read here and looked up later."""
    h = F.xxhash64(*keys).alias("_h")

    def told(df: DataFrame, came: int, counts: Column | None) -> DataFrame:
        return df.select(
            h, F.lit(came).alias("came"), (F.lit(True) if counts is None else counts).cast("int").alias("matter"))

    all_ = told(rows, 1, matters)
    if stored is not None:
        all_ = all_.unionByName(told(stored, 0, stored_matters))
    counted = all_.groupBy("_h").agg(
        F.count("*").alias("n"), F.max("came").alias("came"), F.max("matter").alias("matter"))
    return Met(keys, stage(counted.filter("n > 1 AND came = 1 AND matter = 1").select("_h"), "met"))


def shared(keys: list[str], rows: DataFrame, stored: DataFrame) -> Met:
    """Keys of both `rows` and `stored`."""
    h = F.xxhash64(*keys).alias("_h")
    sides = rows.select(h, F.lit(1).alias("side")).unionByName(stored.select(h, F.lit(2).alias("side")))
    counted = sides.groupBy("_h").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    return Met(keys, stage(counted.filter("low < high").select("_h"), "shared"))
