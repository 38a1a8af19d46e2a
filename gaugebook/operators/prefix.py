"""Running totals that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = (20, 20)


def running_total(
    rows: DataFrame,
    key: str,
    seq: str,
    amount: str,
    total: str,
    chunk_bits: tuple[int, ...] = CHUNK_BITS,
) -> DataFrame:
    """Add `total`: the sum of `amount` over the key's rows up to this `seq`.

    A plain window would sort all rows of a hot key in one task. Here `seq` (a bigint,
    unique per key, 0 .. 2^56-1) is cut into chunks of 2^20 values; the window runs inside
    (key, chunk), and the sums of earlier chunks are added from a second, equally chunked
    level, whose chunks (at most 2^16 a key) are the third. No window partition exceeds
    2^20 rows, however hot the key or sparse the sequence, and every input takes this way.
    """
    if not chunk_bits:
        whole = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(total, F.sum(amount).over(whole))

    chunked = rows.withColumn("_chunk", F.shiftright(seq, chunk_bits[0]))
    inside = (
        Window.partitionBy(key, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    )
    sums = chunked.groupBy(key, "_chunk").agg(F.sum(amount).alias("_sum"))
    upto = running_total(
        sums.withColumnRenamed("_chunk", "_seq"), key, "_seq", "_sum", "_upto", chunk_bits[1:]
    )
    before = upto.select(
        key, F.col("_seq").alias("_chunk"), (F.col("_upto") - F.col("_sum")).alias("_before")
    )
    return (
        chunked.withColumn(total, F.sum(amount).over(inside))
        .join(before, [key, "_chunk"])
        .withColumn(total, F.col(total) + F.col("_before"))
        .drop("_chunk", "_before")
    )
