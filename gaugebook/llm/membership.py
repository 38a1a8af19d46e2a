"""A Bloom filter of ids with a fixed size: it thins a scan before the exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24  # 2 MB, whatever the number of ids: more ids only let more rows through
HASHES = 4
_BLOCK = 16


class Membership:
    def __init__(self, ids: DataFrame, column: str):
        """Each block of bits is put together by one aggregation; 2^BITS bits come to the driver."""
        spots = F.array(*[F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(k)), 64 - BITS) for k in range(HASHES)])
        bits = ids.where(F.col(column).isNotNull()).select(F.explode(spots).alias("bit")).distinct()
        # A word of 64 bits per row: at most 2^18 rows.
        words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
        self.words = np.zeros(1 << (BITS - 6), np.int64)
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy()

    def spots(self, column: str):
        """The bits of a row, to be computed where the rows are: columns for `may_hold`."""
        return [F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(k)), 64 - BITS).alias(f"_bit{k}") for k in range(HASHES)]

    def may_hold(self, batch) -> np.ndarray:
        out = np.ones(batch.num_rows, bool)
        for k in range(HASHES):
            bit = batch.column(f"_bit{k}").to_numpy()
            out &= (self.words[bit >> 6] >> (bit & 63)) & 1 == 1
        return out


def thinned(rows: DataFrame, column: str, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose `column` may be among `ids`.`key`: all that are, and few others."""
    member = Membership(ids, key)
    names = rows.columns
    schema = rows.schema

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            kept = batch.filter(pa.array(member.may_hold(batch)))
            yield kept.select(names)

    return rows.select("*", *member.spots(column)).mapInArrow(keep, schema)
