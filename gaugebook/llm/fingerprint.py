"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Three triplets, spread over a window of 32 bytes, are taken at every byte and hashed into
BUCKETS counters; spread triplets tell texts of one language apart better than adjacent
bytes, whose counts the language decides.
The digest holds, for each counter, the quartile of the document's counters that it falls
in (two bits), and the length on a logarithmic scale. The difference of two digests is the
sum of quartile steps (opposite ends count double) plus the length steps, capped at its
bound; likeness is 1 - difference / bound.

Defined results: null counts as the empty text; texts under three bytes have all counters
in the lowest quartile; equal texts have equal digests; repeated rows give repeated
results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugebook.llm.text import SLICE_BYTES, arrow_map, ids_and_text, shuffle_partitions, slices

BUCKETS = 1024
# Byte offsets of the triplets.
TRIPLETS = [(0, 7, 16), (0, 9, 20), (0, 13, 31)]
# Odd multipliers of the triplet hash, by triplet and byte of it.
_ODD = (np.random.default_rng(7).integers(0, 1 << 32, (len(TRIPLETS), 3), dtype=np.uint32)) | np.uint32(1)
#: Difference of two quartile codes.
_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int64)
LENGTH_BASE = 1.1
LENGTH_STEPS = 20


def digests(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Hex digest of each row's bytes: two digits of length, then two bits per counter."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    counts = np.zeros(rows * BUCKETS + 1, np.int64)
    if len(data):
        wide = data.astype(np.uint32)
        base = np.repeat(np.arange(rows, dtype=np.int64) * BUCKETS, size)
        shift = np.uint32(33 - BUCKETS.bit_length())
        for (a, b, c), (x, y, z) in zip(TRIPLETS, _ODD):
            n = len(data) - c
            if n <= 0:
                continue
            at = base[:n] + ((wide[a:a + n] * x ^ wide[b:b + n] * y) * np.uint32(0x85EBCA6B) + wide[c:c + n] * z >> shift)
            for back in range(1, c + 1):  # triplets that would reach into the next row are not counted
                last = offsets[1:] - back
                at[last[(size >= back) & (last < n)]] = rows * BUCKETS
            counts += np.bincount(at, minlength=len(counts))
    counts = counts[:-1].reshape(rows, BUCKETS)
    order = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
    low, mid, high = (order[:, [q * BUCKETS // 4 - 1]] for q in (1, 2, 3))
    code = (counts > low).astype(np.uint8) + (counts > mid) + (counts > high)
    packed = code[:, 0::4] << 6 | code[:, 1::4] << 4 | code[:, 2::4] << 2 | code[:, 3::4]
    length = np.minimum(255, np.log(np.maximum(1, size)) / np.log(LENGTH_BASE)).astype(int)
    return [f"{n:02x}{row.tobytes().hex()}" for n, row in zip(length, packed.astype(np.uint8))]


def digest(text: str) -> str:
    data = np.frombuffer(text.encode(), np.uint8)
    return digests(data, np.array([0, len(data)]))[0]


def _codes(fingerprint: str) -> tuple[int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return int(fingerprint[:2], 16), np.stack([packed >> s & 3 for s in (6, 4, 2, 0)], 1).ravel()


#: A difference of BOUND or more is no likeness at all: unrelated digests differ by about 1.25 a counter.
BOUND = int(1.25 * BUCKETS)


def likeness(one: str, other: str) -> float:
    """1 for equal digests, 0 at the bound of the difference score."""
    (n, a), (m, b) = _codes(one), _codes(other)
    difference = int(_STEP[a, b].sum()) + max(0, min(LENGTH_STEPS, abs(n - m)) - 1)
    return 1.0 - min(difference, BOUND) / BOUND


def digests_of(texts: list[str]) -> list[str]:
    """Digests of many texts, about SLICE_BYTES at a time."""
    out: list[str] = []
    raw = [t.encode() for t in texts]
    start = size = 0
    for i in range(len(raw) + 1):
        if i == len(raw) or (size and size + len(raw[i]) > SLICE_BYTES // 4):
            part = raw[start:i]
            if part:
                at = np.cumsum([0] + [len(r) for r in part])
                out += digests(np.frombuffer(b"".join(part), np.uint8), at)
            start, size = i, 0
        if i < len(raw):
            size += len(raw[i])
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and digest of each document."""
    def compute(batches):
        for rows, data, at in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(digests(data, at), pa.string())],
                                             names=["doc_id", "fingerprint"])

    return arrow_map(ids_and_text(docs), compute, "doc_id long, fingerprint string")


def _ranges(docs: DataFrame, count: int) -> DataFrame:
    """Documents dealt into ranges of ascending ids; the first of each also ends the range before.

    Only range bounds (one id per range) come to the driver.
    """
    bounds = docs.stat.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.1 / count) if count > 1 else []
    bounds = sorted({int(b) for b in bounds})
    part = F.lit(0)
    if bounds:
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id")))
    firsts = sorted((r["part"], r["first"]) for r in docs.select("doc_id", part.alias("part")).groupBy("part").agg(
        F.min("doc_id").alias("first")).toLocalIterator())
    extra = {firsts[i][1]: firsts[i - 1][0] for i in range(len(firsts))}  # the very first follows the last
    copies = F.array(F.struct(part.alias("part"), F.lit(False).alias("extra")))
    if extra:
        target = F.create_map(*[F.lit(x) for pair in extra.items() for x in pair])
        where = F.try_element_at(target, F.col("doc_id"))
        copies = F.when(F.col("doc_id").isin(list(extra)), F.concat(
            copies, F.array(F.struct(where.alias("part"), F.lit(True).alias("extra"))))).otherwise(copies)
    return docs.withColumn("_at", F.explode(copies)).select("doc_id", "text", "_at.part", "_at.extra")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document, of its edited text, and their likenesses.

    The edited text ends in the first floor(n/4) code points of the next document by id
    instead of its own last ones. Texts are shuffled once, by ranges of ids; rows of one id
    follow each other in an order fixed by their text. Null ids are left out.
    """
    docs = ids_and_text(docs).where(F.col("doc_id").isNotNull())
    count = max(1, shuffle_partitions(docs))
    dealt = _ranges(docs, count)
    dealt = dealt.repartition(count, "part").sortWithinPartitions("part", "extra", "doc_id", "text")

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(batches):
        held, held_part, closed = None, None, None  # the row that waits for its next one
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pairs = []
            for row, print_ in zip(zip(batch.column("doc_id").to_pylist(), texts, batch.column("part").to_pylist(),
                                       batch.column("extra").to_pylist()), digests_of(texts)):
                doc_id, text, part, extra = row
                if extra and closed == part:
                    continue  # more rows of the id that opens the next range
                if held is not None and held_part == part:
                    take = len(held[1]) // 4
                    pairs.append((*held, held[1][:len(held[1]) - take] + text[:take], print_))
                closed = part if extra else None
                held, held_part = (None, part) if extra else ((doc_id, text, print_), part)
            prints = digests_of([p[3] for p in pairs])
            out = [(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, edited_print,
                    likeness(own, edited_print), likeness(own, following))
                   for (doc_id, text, own, edited, following), edited_print in zip(pairs, prints)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return arrow_map(dealt, compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                     "edited_fingerprint string, near_edited double, near_next double")
