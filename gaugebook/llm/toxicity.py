"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding turns text into lower-case base letters, homoglyphs and the usual digit and sign
substitutions included, and everything else into single positions of white space. Lexicon
entries are whole words or word beginnings. They are learned from a bounded sample of
labelled rows: beginnings and words that toxic documents hold far more often than clean
ones, weighted by log odds. A beginning gives way to the longest word or beginning under it
as long as what else it covers is no evidence of its own. Exception phrases (words that continue an entry but occur in
clean documents only, and any the caller names) cancel the hits inside them. A document's
features are the sum of hit weights, plain and divided by the square root of its number of
words; a logistic model on them gives the score.

Defined results: null and empty texts have no hits; rows with equal doc_id are scored
each; ids with contradicting labels teach nothing; without labels, or without an entry
that separates them, the score is the share of label 1 (0 where there is none); extra
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugebook.llm.quality import labelled_sample
from gaugebook.llm.text import arrow_map, held_out, ids_and_text, slices

#: Labelled rows the lexicon and the model are learned from, at most, of either label.
SAMPLE = 4000
#: Entries, at most; those with the most evidence stay.
ENTRIES = 5000
#: Lengths of word beginnings that may become entries.
BEGINNINGS = range(4, 9)
#: An entry occurs in so many toxic documents at least, and so many times as often as in clean ones
#: (half a document added to both: of many rare words, some miss the clean part of a sample by chance).
LEAST, ODDS = 5, 50.0
#: What a beginning covers besides a longer entry is evidence if it occurs so many times as often in toxic documents.
REST_ODDS = 2.0

# Characters that are read as another letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v",
    "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "b", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "œ": "o", "æ": "a",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "€": "e", "£": "l", "¡": "i",
}


#: Code points up to here are folded by a table, the few above one by one.
TABLE = 1 << 16


@cache
def _folded(code: int) -> int:
    if 0xD800 <= code < 0xE000:
        return 32
    c = unicodedata.normalize("NFKD", chr(code))[:1].lower()[:1] or " "
    c = LOOKALIKES.get(c, c)
    if c.isalpha():
        return ord(c)
    return 0 if unicodedata.category(chr(code)) in ("Mn", "Cf") else 32  # combining marks and invisible characters vanish


def _fold_table() -> np.ndarray:
    return np.array([_folded.__wrapped__(code) for code in range(TABLE)], np.uint32)


_FOLD: list[np.ndarray] = []


def fold(text: str) -> str:
    """Lower-case base letters, everything else a space; one leading and one closing space."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    folded = _FOLD[0][np.minimum(code, TABLE - 1)]
    high = np.flatnonzero(code >= TABLE)
    if len(high):
        distinct, at = np.unique(code[high], return_inverse=True)
        folded[high] = np.array([_folded(c) for c in distinct.tolist()], np.uint32)[at]
    return f" {folded[folded > 0].astype('<u4').tobytes().decode('utf-32-le')} "


def terms(folded: str) -> set[str]:
    """Candidate entries of a text: ' word ' and ' beginning'."""
    out = set()
    for word in set(folded.split()):
        if len(word) >= 3:
            out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in BEGINNINGS if len(word) >= n)
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    #: bias, weight of the plain sum, weight of the sum by length
    model: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            # An entry that is an exception too never hits.
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    @staticmethod
    def sums(automaton, folded: str) -> tuple[float, int]:
        """Sum of the weights of hits outside exceptions, and the number of words."""
        words = len(folded.split())
        if not len(automaton):
            return 0.0, words
        hits, spared = [], []
        for end, (size, weight) in automaton.iter(folded):
            (spared if weight is None else hits).append((end - size + 1, end, weight))
        if spared:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)]
        return sum(h[2] for h in hits), words

    def score(self, total: float, words: int) -> float:
        bias, plain, dense = self.model
        total = max(0.0, total)  # entries of negative weight, which only a caller can give, are no evidence
        x = bias + plain * np.log1p(total) + dense * np.log1p(total / np.sqrt(max(1, words)))
        return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def learn_entries(counted: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[dict[str, float], list[str]]:
    """Entries with weights, and exceptions, from (term, toxic documents, clean documents)."""
    by_term = {t: (a, b) for t, a, b in counted}

    def odds(a: int, b: int) -> float:
        return ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))

    # Of a few documents no term has higher odds than one that all toxic ones hold, and no clean one.
    least_odds = min(ODDS, odds(toxic, 0))
    kept: dict[str, float] = {}
    for term in sorted(by_term, key=lambda t: (len(t.rstrip()), t)):
        a, b = by_term[term]
        if a >= LEAST and odds(a, b) >= least_odds:
            bare = term.rstrip()
            if not any(bare[:n] in kept for n in range(min(BEGINNINGS) + 1, len(bare) + 1)):
                kept[term] = float(np.log(odds(a, b)))
    ordered = sorted(by_term)

    def longest(term: str) -> str:
        """The longest entry under this beginning, if what else stands under it is no evidence:
        a beginning is then only the start of one word, and of harmless ones."""
        a, b = by_term[term]
        bare, best = term.rstrip(), term
        for other in ordered[bisect_left(ordered, bare):]:
            if not other.startswith(bare):
                break
            own, others = by_term[other]
            lost = (a - own) * (clean + 1) > REST_ODDS * (b - others) * (toxic + 1)
            # What takes a beginning's place is an entry by itself: it may be harmless otherwise.
            if not lost and own >= LEAST and odds(own, others) >= least_odds and (len(other), other) > (len(best), best):
                best = other
        return best

    kept = {t: float(np.log(odds(*by_term[t]))) for t in map(longest, kept)}
    kept = dict(sorted(kept.items(), key=lambda x: (-x[1] * by_term[x[0]][0], x[0]))[:ENTRIES])
    exceptions = [t for t, (a, b) in by_term.items() if t[-1] == " " and a == 0 and b >= 2
                  and any(t[:n] in kept for n in range(5, len(t)))]
    return kept, sorted(exceptions)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (weight * (p - y)) + 0.05 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w - np.linalg.solve(h, g)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, column: str, learn: Column, size: int = SAMPLE,
          exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from at most `size` labelled documents of either label."""
    # Ids with both labels teach nothing, whichever label a sample is drawn for.
    labels = labels.groupBy("doc_id").agg(F.min(column).alias(column), F.max(column).alias("_most")).where(
        F.col(column) == F.col("_most")).drop("_most")
    counts = {r["label"]: r["n"] for r in labels.where(learn).groupBy(
        F.col(column).cast("int").alias("label")).agg(F.count("*").alias("n")).collect() if r["label"] is not None}
    if not counts.get(1) or not counts.get(0):
        return Lexicon({}, model=(35.0 if counts.get(1) else -35.0, 0.0, 0.0) if counts else (-35.0, 0.0, 0.0))
    # All ids with one label only, then the two bounded samples.
    sample = labelled_sample(docs, labels.where(F.col(column) == 1), column, learn, size).unionByName(
        labelled_sample(docs, labels.where(F.col(column) == 0), column, learn, size))

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        number = Counter()
        for rows, _, _ in slices(batches):
            for text, label in zip(rows.column("text").to_pylist(), rows.column("label").to_pylist()):
                seen[int(label == 1)].update(terms(fold(text or "")))
                number[int(label == 1)] += 1
        found = [("", number[1], number[0]), *((t, seen[1][t], seen[0][t]) for t in seen[0].keys() | seen[1].keys())]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in
                                          enumerate((pa.string(), pa.int64(), pa.int64()))], names=["term", "a", "b"])

    counted = arrow_map(sample, count, "term string, a long, b long").groupBy("term").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    # What is collected comes from the bounded sample: entries need LEAST toxic documents, exceptions two clean ones.
    likely = counted.where((F.col("term") == "") | (F.col("a") >= LEAST) & (F.col("a") * 4 >= F.col("b"))
                           | (F.col("a") == 0) & (F.col("b") >= 2) & F.col("term").endswith(" "))
    found = [tuple(r) for r in likely.toLocalIterator()]
    toxic, clean = next(((a, b) for t, a, b in found if t == ""), (0, 0))
    if not toxic or not clean:
        return Lexicon({}, model=(float(np.log((counts[1] + .5) / (counts[0] + .5))), 0.0, 0.0))
    weights, spared = learn_entries([f for f in found if f[0]], toxic, clean)
    lexicon = Lexicon(weights, spared + [re.sub(r"\s+", " ", fold(e)) for e in exceptions])

    def measure(batches):
        automaton = lexicon.automaton()
        for rows, _, _ in slices(batches):
            sums = [lexicon.sums(automaton, fold(t or "")) for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("label"), pa.array([s[0] for s in sums], pa.float64()),
                 pa.array([s[1] for s in sums], pa.int64())], names=["label", "total", "words"])

    table = arrow_map(sample, measure, "label int, total double, words long").toArrow()
    y = (table.column("label").to_numpy() == 1).astype(float)
    total, words = table.column("total").to_numpy(), table.column("words").to_numpy()
    x = np.column_stack([np.log1p(total), np.log1p(total / np.sqrt(np.maximum(1, words)))])
    share = np.where(y == 1, counts[1] / toxic, counts[0] / clean)  # back to the labels' own mixture
    order = np.lexsort((words, total, y))
    lexicon.model = _fit(x[order], y[order], (share * len(y) / share.sum())[order])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score, the probability of label 1, of every document."""
    def apply(batches):
        automaton = lexicon.automaton()
        for rows, _, _ in slices(batches):
            found = [lexicon.score(*lexicon.sums(automaton, fold(t or ""))) for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found, pa.float64())],
                                             names=["doc_id", "score"])

    return arrow_map(ids_and_text(docs), apply, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 3, remainder: int = 1,
             threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of the held-out split are never read."""
    labels = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[column])
    lexicon = train(docs, labels, column, ~held_out(F.col("doc_id"), modulus, remainder))
    return score(docs, lexicon).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id"), modulus, remainder), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
