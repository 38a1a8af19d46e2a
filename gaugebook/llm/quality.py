"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Tokens are runs of word bytes or of punctuation. Features are hashed token n-grams (one
and two tokens), n-grams of token shapes (one to three), and marks for a token that
repeats one of its last four; a feature's value is the square root of its share of the
document's features, so that rows have unit norm and length does not matter. The model is
fitted on a bounded sample of the labelled rows (`SAMPLE`, those with the smallest hash of
doc_id, and of a repeated id ROWS_AN_ID rows); scoring reads every whole text.

Defined results: null and empty texts score the model's bias alone; rows with equal doc_id
are scored each; a doc_id with contradicting labels and a null label teach nothing; without
any usable label every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugebook.llm.text import arrow_map, combine, hash_spans, held_out, ids_and_text, mix, slices

BITS = 18
#: Labelled rows a model is fitted on, at most.
SAMPLE = 8000
#: Rows that one id brings to the sample, at most.
ROWS_AN_ID = 4
EPOCHS = 3

_KIND = np.full(256, 2, np.uint8)
_KIND[:33] = 0
_KIND[127] = 0
_KIND[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and rows of runs of one kind that do not cross rows."""
    kind = _KIND[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, index and value of the non-zero features."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    if not len(data):
        return none
    starts, ends, row = _tokens(data, offsets)
    if not len(starts):
        return none
    word = hash_spans(data, starts, ends)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int32)])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int32)])
    size = ends - starts
    capitals = upper[ends] - upper[starts]
    shape = (np.minimum(size, 12) * 16 + _UPPER[data[starts]] * 8 + (capitals == size) * 4
             + (digit[ends] > digit[starts]) * 2).astype(np.uint64)
    shape = np.where(_KIND[data[starts]] == 2, word, mix(shape + np.uint64(1 << 20)))
    parts, rows = [combine([word, 1]), combine([shape, 2])], [row, row]
    for lag in (1, 2, 3, 4):
        same = row[lag:] == row[:-lag]
        if lag == 1:
            parts += [combine([word[:-1], word[1:], 3])[same], combine([shape[:-1], shape[1:], 4])[same]]
            rows += [row[1:][same]] * 2
        elif lag == 2:
            parts.append(combine([shape[:-2], shape[1:-1], shape[2:], 5])[same])
            rows.append(row[2:][same])
        again = same & (word[lag:] == word[:-lag])
        parts.append(np.full(int(again.sum()), combine([np.uint64(lag), 6])))
        rows.append(row[lag:][again])
    index = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique((np.concatenate(rows) << BITS) | index, return_counts=True)
    row = key >> BITS
    total = np.bincount(row, weights=count, minlength=len(offsets) - 1)
    return row, key & ((1 << BITS) - 1), np.sqrt(count / total[row]).astype(np.float32)


def fit_ftrl(rows: Sample | list[tuple[int, np.ndarray, np.ndarray]], alpha: float = 0.3, beta: float = 1.0,
             l1: float = 1e-4, l2: float = 1e-3, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic model; rows are (label, index, value)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            label, index, value = rows[i]
            index = np.append(index, size - 1)
            value = np.append(value, 1.0)
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] = ni + g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, size: int) -> DataFrame:
    """doc_id, text and label of at most `size` labelled ids, the smallest by hash. `learn` is on doc_id."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[column].cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    known = known.where(F.col("label") == F.col("most")).drop("most")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # At most `size` rows of two numbers: a proven bound for the broadcast.
    return ids_and_text(docs).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, column: str, learn: Column, size: int = SAMPLE) -> np.ndarray:
    def extract(batches):
        for rows, data, offsets in slices(batches):
            row, index, value = features(data, offsets)
            cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
            pack = [(index[a:b].astype("<i4").tobytes(), value[a:b].astype("<f4").tobytes())
                    for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("label"), pa.array([p[0] for p in pack], pa.binary()),
                 pa.array([p[1] for p in pack], pa.binary())], names=["doc_id", "label", "index", "value"])

    sample = labelled_sample(docs, labels, column, learn, size)
    # An id that is repeated brings a few of its rows, the first by hash; so the sample is bounded in rows.
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    sample = sample.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= ROWS_AN_ID).drop("nth")
    return fit_ftrl(Sample(arrow_map(sample, extract, "doc_id long, label int, index binary, value binary").toArrow()))


class Sample:
    """Feature rows of a sample in a fixed order, decoded one at a time: only their bytes are held."""

    def __init__(self, table: pa.Table):
        doc_id, self.label = (table.column(c).to_numpy() for c in ("doc_id", "label"))
        self.index, self.value = (self._bytes(table.column(c)) for c in ("index", "value"))
        told = [zlib.crc32(self._row(self.index, i)) for i in range(len(doc_id))]
        self.order = np.lexsort((told, self.label, doc_id))

    @staticmethod
    def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.concatenate([[0], pc.binary_length(column).to_numpy()]).astype(np.int64)
        parts = []
        for chunk in column.chunks:
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
            if len(chunk):
                parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if chunk.buffers()[2] else np.empty(0, np.uint8))
        return np.cumsum(sizes), np.concatenate(parts) if parts else np.empty(0, np.uint8)

    @staticmethod
    def _row(column: tuple[np.ndarray, np.ndarray], i: int) -> np.ndarray:
        return column[1][column[0][i]:column[0][i + 1]]

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, nth: int) -> tuple[int, np.ndarray, np.ndarray]:
        i = self.order[nth]
        index, value = (np.frombuffer(self._row(c, i).tobytes(), t) for c, t in ((self.index, "<i4"), (self.value, "<f4")))
        return int(self.label[i]), index.astype(np.int64), value.astype(float)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score, the probability of label 1, of every document."""
    weights = weights.astype(np.float32)

    def apply(batches):
        for rows, data, offsets in slices(batches, limit=1 << 18):
            row, index, value = features(data, offsets)
            total = np.bincount(row, weights=weights[index] * value, minlength=rows.num_rows) + float(weights[-1])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))],
                                             names=["doc_id", "score"])

    return arrow_map(ids_and_text(docs), apply, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 5, remainder: int = 0,
             threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of the held-out split are never read."""
    weights = train(docs, labels, column, ~held_out(F.col("doc_id"), modulus, remainder))
    return score(docs, weights).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id"), modulus, remainder), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
