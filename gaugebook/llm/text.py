"""Texts as flat byte arrays: what the vectorised operators share.

An Arrow batch of texts is cut into slices of about SLICE_BYTES; each slice is one
uint8 array plus row offsets. A longer text is a slice of its own, never cut. Null
texts count as empty.
"""

from __future__ import annotations

import ctypes
import sys

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
BATCH_ROWS = 512
#: Fixed seeds: hashes must agree between executors and runs.
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15 | 3)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keep_memory() -> None:
    """Let this process reuse freed array memory instead of handing it back to the system.

    Array code frees and takes a few MB at every step; with glibc's defaults each of them
    is mapped and cleared anew, which costs several times what the arithmetic does.
    """
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 64 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


_busy_with: str | None = None


def release_memory(work: str) -> None:
    """Hand back to the system what earlier tasks of other work left free in this process.

    Workers live through all queries of an application and pass from one operator to the
    next; what each of them keeps would add up on the executor. Tasks of the same work reuse it.
    """
    global _busy_with
    if _busy_with not in (None, work):
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)
    _busy_with = work


def arrow_map(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """`mapInArrow` in small batches: BATCH_ROWS long texts must fit next to a task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    work = f"{fn.__module__}.{fn.__qualname__}"

    def run(batches):
        keep_memory()
        release_memory(work)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def ids_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads, by position, so that clashing extra columns do no harm."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"),
                       *(docs[c] for c in more))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, longer by underscores if a column is called so (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the n + 1 offsets of the rows in them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield (batch.slice(start, stop - start), data[offsets[start]:offsets[stop]],
                   offsets[start:stop + 1] - offsets[start])
            start = stop


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that do not cross rows: starts, ends, row of each."""
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before[heads] = False
    after[tails] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
        if size > 8 * SLICE_BYTES:
            return _powers.pop(key)
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class SpanHashes:
    """64-bit hashes of byte ranges of one array: differences of one weighted running sum."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * _power(_MULT, len(data))[:len(data)], out=self.total[1:])
        self.inverse = _power(_INV, len(data))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[ends] - self.total[starts]) * self.inverse[starts]
                       + (ends - starts).astype(np.uint64))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHashes(data)(starts, ends)


def combine(parts: Iterable[np.ndarray]) -> np.ndarray:
    """An order-dependent hash of several hash columns."""
    with np.errstate(over="ignore"):
        out = None
        for part in parts:
            out = part if out is None else mix(out * np.uint64(0xA0761D6478BD642F) + np.asarray(part).astype(np.uint64))
    return out


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text, modulo: the split that the labels are learned by."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == F.lit(remainder)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges, one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    if not total:
        return out
    heads = np.cumsum(lengths) - lengths
    out[0] = starts[0]
    out[heads[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)
