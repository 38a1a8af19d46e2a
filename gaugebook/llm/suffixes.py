"""Removal of repeated byte strings by bucket-pointer refinement on a sparse suffix array.

A byte goes if it is covered by a string of LENGTH bytes that also starts anywhere else.

Bucket identifiers are built as in bucket-pointer refinement: the 8-grams of a text are the
first buckets, and a longer string is named by the identifiers at its start and at a later
offset, which the last round has left. Names depend on the bytes alone, so that they agree
across tasks. Only some starts are sorted: of the strings of g bytes inside a window of
LENGTH, the one with the smallest name is the window's anchor, and equal windows have equal
anchors. Starts with one anchor are a unit; its core is the name of the anchor, its context
the bytes from its first start to the end of its last string.

Buckets are refined level by level, g = 100, 185, 200:

* a unit whose core occurs once holds no repeat and leaves;
* units of one core and one context are repeats from end to end;
* what is left of a bucket, and one unit of each context in it, is refined at the next g.

At the last level a unit is one start and its core and context are two hashes of the same
string, 128 bits together. Every step is an aggregation and a join on a core, so large
groups of copies fold before the shuffle.

Defined results: null counts as empty; texts shorter than LENGTH lose nothing; repeated
rows are separate documents, so their strings repeat; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugebook.llm.membership import thinned
from gaugebook.llm.text import arrow_map, flat, hash_spans
from gaugebook.session import stage

LENGTH = 200
GRAMS = (100, 185, 200)
#: Starts that are looked at together; positions of anchors are kept in as many bits.
BLOCK_BITS = 20
ID = ["doc_id", "mark"]

_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)


def names(data: np.ndarray, reach: int) -> dict[int, np.ndarray]:
    """Bucket identifiers of the strings of 8, 16, .. and `reach` bytes at every position.

    The first buckets are the 8-grams themselves. A bucket of twice the length is named by
    the identifiers at the position and at the later offset, which the last round has left;
    `reach` need not be a power of two, as the two halves may overlap.
    """
    n = len(data)
    if n < reach:
        return {reach: np.empty(0, np.uint64)}
    wide = np.zeros(n - 7, np.uint64)
    for k in range(8):
        np.left_shift(wide, np.uint64(8), out=wide)
        np.bitwise_or(wide, data[k:n - 7 + k], out=wide)
    out, size = {8: wide}, 8
    with np.errstate(over="ignore"):
        while size < reach:
            step = min(size, reach - size)
            here = out[size]
            count = n - (size + step) + 1
            x = here[:count] * _A
            x ^= here[step:step + count]
            x *= _B
            x ^= x >> np.uint64(31)
            x *= _A
            x ^= x >> np.uint64(29)
            size += step
            out[size] = x
    return out


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of each window."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x = np.minimum(x[:len(x) - step], x[step:])
        size += step
    return x


def units(data: np.ndarray, gram: int, length: int = LENGTH):
    """First start, number of starts, core and context of the units of a text, in order."""
    starts, counts, cores, contexts = [], [], [], []
    width = length - gram + 1
    block = (1 << BLOCK_BITS) - 2 * length
    for base in range(0, max(len(data) - length + 1, 0), block):
        part = data[base:base + block + length - 1]
        if len(part) < length:
            break
        name = names(part, gram)[gram]
        # Equal names keep the order of their positions, so the leftmost one wins.
        low = np.uint64((1 << BLOCK_BITS) - 1)
        packed = (name & ~low) | np.arange(len(name), dtype=np.uint64)
        anchor = window_minimum(packed, width)
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(edge[1:], len(anchor)) - 1
        starts.append(base + edge)
        counts.append(last - edge + 1)
        cores.append(name[(anchor[edge] & low).astype(np.int64)])
        contexts.append(hash_spans(part, edge, last + length))
    if not starts:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in (starts, counts, cores, contexts))


UNITS = "doc_id long, mark long, start long, count int, core long, context long"


def _batch(doc_id, mark, columns) -> pa.RecordBatch:
    start, count, core, context = columns
    return pa.RecordBatch.from_arrays(
        [doc_id, mark, pa.array(start), pa.array(count.astype(np.int32)), pa.array(core.view(np.int64)),
         pa.array(context.view(np.int64))], names=["doc_id", "mark", "start", "count", "core", "context"])


def _all_units(docs: DataFrame, gram: int, length: int) -> DataFrame:
    def emit(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            found, row = [], []
            for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                if b - a >= length:
                    found.append(units(data[a:b], gram, length))
                    row.append(np.full(len(found[-1][0]), i))
            if found:
                at = pa.array(np.concatenate(row))
                yield _batch(batch.column("doc_id").take(at), batch.column("mark").take(at),
                             [np.concatenate(c) for c in zip(*found)])

    return arrow_map(docs, emit, UNITS)


def _merged(ranges) -> list[tuple[int, int]]:
    """Disjoint half-open ranges, in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def _finer_units(docs: DataFrame, open_: DataFrame, gram: int, length: int) -> DataFrame:
    """Units of the starts that `open_` (doc_id, mark, start, count) leaves to decide."""
    wanted = open_.groupBy(*ID).agg(F.collect_set(F.struct("start", "count")).alias("ranges"))
    rows = thinned(docs, "mark", wanted, "mark").join(wanted, ID)

    def emit(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            found, row = [], []
            for i, ranges in enumerate(batch.column("ranges").to_pylist()):
                text = data[offsets[i]:offsets[i + 1]]
                for a, b in _merged((r["start"], r["start"] + r["count"]) for r in ranges):
                    start, *rest = units(text[a:b + length - 1], gram, length)
                    found.append((start + a, *rest))
                    row.append(np.full(len(start), i))
            if found:
                at = pa.array(np.concatenate(row))
                yield _batch(batch.column("doc_id").take(at), batch.column("mark").take(at),
                             [np.concatenate(c) for c in zip(*found)])

    return arrow_map(rows, emit, UNITS)


def _refined(level: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(repeated, open) units of a level, as doc_id, mark, start, count."""
    buckets = level.groupBy("core").agg(
        F.count("*").alias("n"), (F.min("context") == F.max("context")).alias("alike")).where("n > 1").drop("n")
    shared = stage(level.join(buckets, "core"), label)
    kept = [*ID, "start", "count"]
    mixed = shared.where(~F.col("alike")).withColumn("pick", F.xxhash64(*ID, "start"))
    contexts = mixed.groupBy("core", "context").agg(F.count("*").alias("n"), F.min("pick").alias("least"))
    told = mixed.join(contexts, ["core", "context"])
    repeated = shared.where("alike").select(*kept).unionByName(told.where("n > 1").select(*kept))
    return repeated, told.where((F.col("n") == 1) | (F.col("pick") == F.col("least"))).select(*kept)


def _release(df: DataFrame) -> None:
    """Shuffle files of a finished level go once the driver's JVM has collected their handles."""
    df.sparkSession.sparkContext._jvm.System.gc()


def repeats(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """doc_id, mark and ranges of starts (start, count) whose strings also start elsewhere."""
    if grams[-1] != length:
        raise ValueError("the last level names whole strings")
    repeated, open_ = _refined(_all_units(docs, grams[0], length), "units")
    found = [repeated]
    for gram in grams[1:]:
        open_ = stage(open_, "open")
        _release(docs)
        # Written once: buckets and members both read them, and they are few.
        finer = stage(_finer_units(docs, open_, gram, length), "finer")
        repeated, open_ = _refined(finer, "units")
        found.append(repeated)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stage(out.groupBy(*ID).agg(F.collect_set(F.struct("start", "count")).alias("ranges")), "repeats")


def without_repeats(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """doc_id, n_bytes, the removed byte ranges as spans (start, end), and the bytes that stay, per document."""
    text = docs["text"].cast("string")
    keyed = docs.select(docs["doc_id"].cast("long").alias("real_id"), F.coalesce(
        docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("doc_id"), text.alias("text"),
        F.xxhash64(docs["doc_id"].cast("long"), text).alias("mark"))
    found = repeats(keyed.drop("real_id"), length, grams)
    _release(docs)
    rows = keyed.join(found, ID, "left").select("real_id", "text", "ranges")

    def cut(batches):
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                raw = (text or "").encode()
                gone = _merged((r["start"], r["start"] + r["count"] - 1 + length) for r in ranges or ())
                at, parts = 0, []
                for a, b in gone:
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join(parts) + raw[at:])
                spans.append([{"start": a, "end": b} for a, b in gone])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column("real_id"), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return arrow_map(rows, cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
