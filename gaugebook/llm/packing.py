"""Best-fit packing of documents into token sequences, by linear grouping.

`pieces`: each document becomes its token ids and a closing id 0. A document longer than
the sequence is cut into full pieces; its remainder, if any, comes first. `pack` places
pieces. The plan of a packing is made from the histogram of lengths alone (at most one
count per length), so the driver holds nothing that grows with the corpus; documents take
their places by their rank within a length, which is counted in salted groups.

Defined results: null and empty texts are one piece of length 1 (the closing id); repeated
rows are packed as often as they occur; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugebook.llm.linear_grouping import Runs, pack_histogram
from gaugebook.llm.text import arrow_map, ids_and_text, shuffle_partitions, slices
from gaugebook.llm.tokens import Encoder
from gaugebook.session import stage

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker: its words stay known from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with the crc32 of their ids as little-endian 32-bit numbers."""
    path = vocabulary or default_vocabulary()

    def cut(batches):
        for rows, _, _ in slices(batches):
            out: list[tuple] = []
            ids_of = encoder(path).encode(rows.column("text"))
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), ids_of):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                edges = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                        for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(ids_and_text(docs), cut, PIECES)


def _places(runs: Runs) -> dict[str, np.ndarray]:
    """For each length, by rank: first rank of a run, its first sequence, offset in it."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, bins in runs:
        offset = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + bins
            offset += length
        sequence += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1],
            "sequence": table[:, 2], "offset": table[:, 3]}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1..capacity.

    `cut` is written once and read for the histogram, the ranks and the placement.
    """
    cut = stage(cut, "pieces")
    salts = max(1, shuffle_partitions(cut))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    places = _places(pack_histogram(counts, capacity))
    before = by_salt.select("length", "salt", (
        F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(before, ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("before") + F.col("nth") - 1).alias("rank"))

    def put(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(places["key"], (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns - 1)]
                + [pa.array(places["sequence"][at] + rank - places["rank"][at]), pa.array(places["offset"][at])],
                names=batch.schema.names[:-1] + ["sequence_id", "offset"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(put, f"{kept}, sequence_id long, offset long")
