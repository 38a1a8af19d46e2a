"""Language identification: a byte convolutional network in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a window of
fixed length, and classified by a softmax. The network is trained on windows of a bounded
sample of documents (`SAMPLE`, those with the smallest hash of doc_id among the rows to
learn from). A document is cut into consecutive windows, the last one padded, so its whole
text is read; its probabilities are the mean of its windows', weighted by their length.

Defined results: null texts and texts without a letter get `und` and score 0; rows with
equal doc_id are predicted each; documents without lang teach nothing; with no row to
learn from everything is `und`; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugebook.llm.text import arrow_map, held_out, ids_and_text, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: Documents the network is trained on, at most, and windows taken from each.
SAMPLE, WINDOWS_EACH = 4000, 4
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows of consecutive bytes, the row and the length of each."""
    size = np.diff(offsets)
    each = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[:-1][row] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[1:][row] - start)
    at = start[:, None] + np.arange(WINDOW)[None, :]
    out = data[np.minimum(at, max(len(data) - 1, 0))] if len(row) else np.empty((0, WINDOW), np.uint8)
    out[np.arange(WINDOW)[None, :] >= length[:, None]] = 0
    return out, row, length


class Network:
    def __init__(self, classes: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes = classes
        reach = max(WIDTHS)
        self.mask = np.concatenate([np.repeat(np.arange(reach)[:, None] < w, FILTERS, 1) for w in WIDTHS], 1)
        self.mask = np.repeat(self.mask, EMBED, 0).astype(np.float32)  # narrower filters end in zeros
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filter": (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32),
            "shift": np.zeros(self.mask.shape[1], np.float32),
            "out": rng.normal(0, 0.1, (self.mask.shape[1], len(classes))).astype(np.float32),
            "bias": np.zeros(len(classes), np.float32),
        }
        self.p["embed"][0] = 0

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))]
        return np.concatenate([e[:, j:j + WINDOW] for j in range(max(WIDTHS))], 2)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = self._columns(x)
        z = (columns.reshape(-1, columns.shape[2]) @ self.p["filter"]).reshape(len(x), WINDOW, -1)
        return columns, z, np.maximum(z.max(1) + self.p["shift"], 0)

    def probabilities(self, x: np.ndarray, chunk: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)))
        for i in range(0, len(x), chunk):
            h = self.pooled(x[i:i + chunk])[2]
            s = h @ self.p["out"] + self.p["bias"]
            s = np.exp(s - s.max(1, keepdims=True))
            out[i:i + chunk] = s / s.sum(1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01) -> None:
        rng = np.random.default_rng(2)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i:i + batch]
                columns, z, h = self.pooled(x[at])
                s = h @ self.p["out"] + self.p["bias"]
                s = np.exp(s - s.max(1, keepdims=True))
                d = s / s.sum(1, keepdims=True)
                d[np.arange(len(at)), y[at]] -= 1
                d /= len(at)
                dh = (d @ self.p["out"].T) * (h > 0)
                best = z.argmax(1)  # the position that each filter's maximum came from
                picked = columns[np.arange(len(at))[:, None], best]  # window, filter, column
                dfilter = np.einsum("nf,nfc->cf", dh, picked) * self.mask
                dcolumn = dh[:, :, None] * self.p["filter"].T[None]
                dembed = np.zeros_like(self.p["embed"])
                padded = np.pad(x[at], ((0, 0), (0, max(WIDTHS) - 1)))
                for j in range(max(WIDTHS)):
                    code = padded[np.arange(len(at))[:, None], best + j]
                    np.add.at(dembed, code.ravel(), dcolumn[:, :, j * EMBED:(j + 1) * EMBED].reshape(-1, EMBED))
                dembed[0] = 0
                grads = {"embed": dembed, "filter": dfilter, "shift": dh.sum(0), "out": h.T @ d, "bias": d.sum(0)}
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9 ** step))
                                  / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def train(docs: DataFrame, learn: Column, size: int = SAMPLE) -> Network | None:
    """A network for the languages of the sample; `learn` is a condition on doc_id."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"),
                       docs["lang"].cast("string").alias("lang"))
    ids = rows.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    sample = rows.where(F.col("lang").isNotNull()).join(F.broadcast(chosen), "doc_id")

    def extract(batches):
        for part, data, offsets in slices(batches):
            x, row, length = windows(data, offsets)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            packed = []
            for a, b in zip(cut, cut[1:]):  # spread over the whole text
                at = np.unique(np.linspace(a, b - 1, WINDOWS_EACH).astype(int)) if b > a else np.empty(0, int)
                packed.append(x[at[length[at] >= 16]].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(packed, pa.binary())],
                                             names=["doc_id", "lang", "windows"])

    table = arrow_map(sample, extract, "doc_id long, lang string, windows binary").toArrow()
    found = sorted(zip(*(table.column(i).to_pylist() for i in range(3))))
    if not found:
        return None
    classes = sorted({lang for _, lang, _ in found})
    x = np.frombuffer(b"".join(w for _, _, w in found), np.uint8).reshape(-1, WINDOW)
    y = np.repeat([classes.index(lang) for _, lang, _ in found], [len(w) // WINDOW for _, _, w in found])
    network = Network(classes)
    network.fit(x, y, epochs=max(4, min(40, 60000 // max(1, len(x)))))
    return network


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    def apply(batches):
        for rows, data, offsets in slices(batches, limit=1 << 18):
            texts = rows.column("text").to_pylist()
            known = np.array([network is not None and t is not None and bool(_LETTER.search(t)) for t in texts])
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known.any():
                x, row, length = windows(data, offsets)
                p = network.probabilities(x) * length[:, None]
                mean = np.stack([np.bincount(row, weights=p[:, k], minlength=len(texts)) for k in range(p.shape[1])], 1)
                mean /= np.maximum(mean.sum(1, keepdims=True), 1e-12)
                best = mean.argmax(1)
                score = np.where(known, mean.max(1), 0.0)
                lang = [network.classes[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0))],
                names=["doc_id", "lang_pred", "score"])

    return arrow_map(ids_and_text(docs), apply, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score. The held-out split teaches nothing."""
    network = train(docs, ~held_out(F.col("doc_id"), modulus, remainder))
    return predict(docs, network).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id"), modulus, remainder), F.lit(False)).alias("held_out"),
        "lang_pred", "score")
