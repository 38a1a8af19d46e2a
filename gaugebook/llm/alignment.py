"""Alignment of two tokenizers over the same texts, by divide and conquer at shared cuts.

Tokenizer A is a byte-level BPE, B a piece BPE that puts a space ahead; both see the text
with that space. Where a token of A and one of B end at the same byte, the text is cut;
between two cuts lies a group. Within an interval a common end is looked for from the
middle outwards, each end of A by bisection among the ends of B; the interval is divided
there and both halves are treated alike. An interval without an inner cut is a leaf group.

Neither tokenizer joins a word to the white space behind it (but for what a piece of B
itself joins), so both end a token ahead of a run of white space, and behind a lone line feed. Texts are divided at these known cuts
first, into units (a word and the space ahead of it, mostly); a unit is encoded and aligned once and
remembered by the worker.

A pair of ids is linked where a token of each shares a group. `aligned` goes through each text
once and lists its pairs, `pair_counts` counts the documents that hold a pair linked, and
`align` adds up these counts. Counts of the FREQUENT
commonest pairs go to every task (a fixed size); links of all other pairs are looked up by
a join.

Defined results: texts that are null, empty, or that do not come out of both tokenizers as
they went in (with U+2581, which B writes for a space) have no tokens: zeros and an empty digest; rows with
equal or null doc_id are told apart by row; repeated rows count as documents of their
own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugebook.llm.text import arrow_map, gather, ids_and_text, slices
from gaugebook.session import stage

#: Pairs whose counts every task holds: 16 bytes each.
FREQUENT = 1 << 20
#: Units a worker remembers before it starts afresh.
CACHE_UNITS = 800_000
#: Units of at most SHORT characters are divided JOINED at a time.
SHORT, JOINED = 64, 4096
#: Ids of B are below 2^B_BITS: a pair is one number.
B_BITS = 24
#: A pair has at most so many bits: ids of A are below 2^(PAIR_BITS - B_BITS), and a slice holds fewer than 2^(63 - PAIR_BITS) documents.
PAIR_BITS = 48
#: Code points that A's splitting pattern takes as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SPACE_SIGN = "▁"


def cuts(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Groups of two tokenizations as (tokens of A, tokens of B) ahead of each shared end, in order.

    `a` and `b` are the ends of the tokens, ascending, with equal last elements.
    """
    found = []
    # An interval of tokens, and the tokens of A in it that are known to end at no cut.
    todo = [(0, len(a), 0, len(b), 0, 0)]
    while todo:
        i, j, k, n, low, high = todo.pop()
        at = None
        if j - i > 1 and n - k > 1:
            middle = (i + j - 1) // 2
            if not low <= middle < high:
                low = high = middle
            left, right = low - 1, high
            while left >= i or right < j - 1:
                near_left = left >= i and (right >= j - 1 or middle - left < right - middle)
                token = left if near_left else right
                place = bisect_left(b, a[token], k, n - 1)
                if place < n - 1 and b[place] == a[token]:
                    at = token
                    break
                if near_left:
                    left -= 1
                else:
                    right += 1
        if at is None:
            found.append((j, n))
            continue
        # The stretch searched so far, up to the cut, need not be searched again.
        todo.append((at + 1, j, place + 1, n, max(left + 1, at + 1), max(min(right, j - 1), at + 1)))
        todo.append((i, at + 1, k, place + 1, min(left + 1, at), min(right, at)))
    return found


def all_cuts(a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`cuts` of many texts at once: `a` and `b` are the ends of all tokens in one byte count,
    `upto_a` and `upto_b` the number of tokens up to the end of each text.

    All intervals of one depth are searched together, at one more step from their middles a
    round, and those without a cut are closed.
    """
    i, j = np.concatenate([[0], upto_a[:-1]]), upto_a
    k, n = np.concatenate([[0], upto_b[:-1]]), upto_b
    leaves = []
    while len(i):
        middle = (i + j - 1) // 2
        at = np.full(len(i), -1)
        place = np.full(len(i), -1)
        open_ = np.flatnonzero((j - i > 1) & (n - k > 1))
        step = 0
        while len(open_):
            for side in (middle[open_] - step, middle[open_] + step) if step else (middle[open_],):
                inside = (side >= i[open_]) & (side < j[open_] - 1) & (at[open_] < 0)
                probe = open_[inside]
                end = a[side[inside]]
                spot = np.searchsorted(b, end)
                hit = (spot < n[probe] - 1) & (b[spot] == end)
                at[probe[hit]] = side[inside][hit]
                place[probe[hit]] = spot[hit]
            step += 1
            open_ = open_[(at[open_] < 0) & ((middle[open_] - step >= i[open_]) | (middle[open_] + step < j[open_] - 1))]
        leaf = at < 0
        leaves.append(np.stack([j[leaf], n[leaf]]))
        at, place = at[~leaf] + 1, place[~leaf] + 1
        i, j = np.concatenate([i[~leaf], at]), np.concatenate([at, j[~leaf]])
        k, n = np.concatenate([k[~leaf], place]), np.concatenate([place, n[~leaf]])
    ends = np.concatenate(leaves, axis=1)
    return tuple(ends[:, np.argsort(ends[0])])


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Units of texts with their tokens, groups and links. One per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: i for i, c in _byte_letters().items()}
        # Entries outside the byte alphabet (a special token) are never produced; their bytes are their text.
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode()
                        for i, p in enumerate(pieces)]
        text_pieces = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i)]
        # White space that some piece of B joins to the character ahead of it (a carriage return, say)
        # divides nothing. Texts stay whole if that were so for spaces, or if a piece held a line feed.
        glued = {m[1] for p in text_pieces for m in re.finditer(f"(?<=[^{WHITE}{SPACE_SIGN}])([{WHITE}{SPACE_SIGN}])", p)}
        self.divisible = not glued & {" ", SPACE_SIGN} and not any("\n" in p for p in text_pieces)
        more = f"(?:[{''.join(sorted(glued))}][{WHITE}]*[^{WHITE}]*)*" if glued else ""
        self.unit = re.compile(f"\n(?![{WHITE}])|[{WHITE}]*[^{WHITE}]+{more}|[{WHITE}]+")
        self._forget()

        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.flat_a, self.flat_b = _Pieces(self.bytes_a), _Pieces(self.bytes_b)
        # Decimal ids with what may follow them in the digest.
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.shown = _Pieces([b"%d%c" % (i, sign) for sign in b",|;" for i in range(most)])
        self.most = most
        self.plain = re.compile(f" [^{WHITE}]+")
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[bytes] = []  # a1,a2|b1;...
        self.sizes = np.empty((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.good = np.empty(0, bool)
        self.pair_start = np.zeros(1, np.int64)
        self.pair = np.empty(0, np.int64)  # numbers of the distinct pairs of each unit
        self.times = np.empty(0, np.int64)
        self.pair_number: dict[int, int] = {}
        self.pairs = np.empty(0, np.int64)  # (a << B_BITS) + b of each number
        self.generation = getattr(self, "generation", -1) + 1

    def units(self, text: str) -> list[str]:
        return self.unit.findall(" " + text) if self.divisible else [" " + text]

    def _add(self, units, text, sizes, good, counts, pairs, times) -> None:
        self.number.update(zip(units, range(len(self.text), len(self.text) + len(units))))
        self.text.extend(text)
        distinct, back = np.unique(np.asarray(pairs, np.int64), return_inverse=True)
        fresh = [p for p in distinct.tolist() if p not in self.pair_number]
        self.pair_number.update(zip(fresh, range(len(self.pairs), len(self.pairs) + len(fresh))))
        self.pairs = np.concatenate([self.pairs, np.array(fresh, np.int64)])
        numbers = np.array([self.pair_number[p] for p in distinct.tolist()], np.int64)
        self.pair = np.concatenate([self.pair, numbers[back] if len(distinct) else back])
        self.sizes = np.concatenate([self.sizes, np.asarray(sizes, np.int64).reshape(-1, 4)])
        self.good = np.concatenate([self.good, np.asarray(good, bool)])
        self.pair_start = np.concatenate([self.pair_start, self.pair_start[-1] + np.cumsum(counts, dtype=np.int64)])
        self.times = np.concatenate([self.times, np.asarray(times, np.int64)])

    def _learn(self, new: list[str]) -> None:
        whole = [u for u in new if self.divisible and len(u) <= SHORT and self.plain.fullmatch(u)]
        others = set(new).difference(whole)
        for start in range(0, len(whole), JOINED):
            part = whole[start:start + JOINED]
            if not self._learn_joined(part):
                others.update(part)
        if others:
            self._learn_each([u for u in new if u in others])

    def _learn_joined(self, units: list[str]) -> bool:
        """Short words with a space ahead, encoded as one text and divided by arrays, all units at once."""
        text = "".join(units)
        ia = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ib = np.array(self.b.encode(text[1:]), np.int64)
        raw = text.encode()
        if self.flat_a.joined(ia) != raw or self.flat_b.joined(ib) != raw:
            return False
        ends = np.cumsum([len(u.encode()) for u in units])
        ea, eb = np.cumsum(self.length_a[ia]), np.cumsum(self.length_b[ib])
        upto_a, upto_b = (np.searchsorted(e, ends, side="right") for e in (ea, eb))
        if (ea[upto_a - 1] != ends).any() or (eb[upto_b - 1] != ends).any():
            return False
        unit_a, unit_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        to_a, to_b = all_cuts(ea, eb, upto_a, upto_b)
        group_a, group_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        unit_of = np.searchsorted(upto_a, to_a)  # of each group
        n_groups = np.bincount(unit_of, minlength=len(units))
        n_links = np.bincount(unit_of, group_a * group_b, len(units)).astype(np.int64)
        # The tokens in the order of the digest: those of A, then those of B, group by group.
        place_a = np.arange(len(ia)) + np.repeat(to_b - group_b, group_a)
        place_b = np.arange(len(ib)) + np.repeat(to_a, group_b)
        order = np.empty(len(ia) + len(ib), np.int64)
        order[place_a], order[place_b] = ia, ib
        order[place_a[to_a - 1]] += self.most
        order[place_b[to_b - 1]] += 2 * self.most
        shown = self.shown.joined(order)
        at = np.cumsum(self.shown.length[order])[place_b[upto_b - 1]].tolist()
        text_of = [shown[x:y - 1] for x, y in zip([0, *at], at)]
        # Links: each token of A with all of B's in its group.
        span = np.repeat(group_b, group_a)
        left = np.repeat(ia, span)
        right = ib[gather(np.repeat(to_b - group_b, group_a), span)]
        unit = np.repeat(np.repeat(np.arange(len(units)), unit_a), span)
        link = (left << B_BITS) + right
        links = np.lexsort((link, unit))
        link, unit = link[links], unit[links]
        first = np.flatnonzero(np.concatenate([[True], (link[1:] != link[:-1]) | (unit[1:] != unit[:-1])]))
        times = np.diff(np.append(first, len(link)))
        self._add(units, text_of, np.stack([unit_a, unit_b, n_groups, n_links], 1), np.ones(len(units), bool),
                  np.bincount(unit[first], minlength=len(units)), link[first], times)
        return True

    def _learn_each(self, new: list[str]) -> None:
        ids_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        # B puts a space ahead of what it gets, if that is anything; behind a line feed, which is a token by itself, nothing is put.
        led = [u[0] == " " and len(u) > 1 for u in new]
        ids_b = self.b.encode([u[1:] if s else "\n" + u for u, s in zip(new, led)], num_threads=1)
        text, sizes, good, pairs, times, counts = [], [], [], [], [], []
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        for unit, ia, ib, s in zip(new, ids_a, ids_b, led):
            if not s:
                ib = ib[2:]
            parts_a, parts_b = [bytes_a[i] for i in ia], [bytes_b[i] for i in ib]
            raw = unit.encode()
            if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
                good.append(False)
                text.append(b"")
                sizes.append((0, 0, 0, 0))
                counts.append(0)
                continue
            good.append(True)
            held: dict[int, int] = {}
            shown, i, k, links = [], 0, 0, 0
            groups = cuts(_ends(parts_a), _ends(parts_b))
            for j, n in groups:
                ga, gb = ia[i:j], ib[k:n]
                i, k = j, n
                shown.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                links += len(ga) * len(gb)
                ga, gb = Counter(ga), Counter(gb)  # long groups repeat ids
                for x, p in ga.items():
                    for y, q in gb.items():
                        held[(x << B_BITS) + y] = held.get((x << B_BITS) + y, 0) + p * q
            text.append(";".join(shown).encode())
            sizes.append((len(ia), len(ib), len(groups), links))
            pairs.extend(held)
            times.extend(held.values())
            counts.append(len(held))
        self._add(new, text, sizes, good, counts, pairs, times)

    def rows(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each text the numbers of its units in order (none where it has no tokens), and which have any."""
        split = [self.units(t) if t and SPACE_SIGN not in t else [] for t in texts]
        number = self.number
        fresh = list(dict.fromkeys(u for u in chain.from_iterable(split) if u not in number))
        if fresh:
            if len(self.text) + len(fresh) > CACHE_UNITS and self.text:
                self._forget()
                fresh = list(dict.fromkeys(chain.from_iterable(split)))
            self._learn(fresh)
            number = self.number
        out = [np.array([number[u] for u in us], np.int64) for us in split]
        out = [o if self.good[o].all() else o[:0] for o in out]
        return out, np.array([len(o) > 0 for o in out])


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _ends(parts: list[bytes]) -> list[int]:
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


class _Pieces:
    """Byte strings by number, joined by index arithmetic."""

    def __init__(self, pieces: list[bytes]):
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        return self.data[gather(self.start[numbers], self.length[numbers])].tobytes()


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _document_units(out: list[np.ndarray], units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, unit) of a slice, with the number of occurrences."""
    row = np.repeat(np.arange(len(out)), [len(o) for o in out])
    key, times = np.unique(row * units + (np.concatenate(out) if out else row), return_counts=True)
    return key // units, key % units, times


def _document_pairs(known: Aligner, out: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct linked pairs of each document of a slice, ascending, how often each is linked, and
    the n + 1 offsets of the documents."""
    doc, unit, n = _document_units(out, max(len(known.text), 1))
    lengths = known.pair_start[unit + 1] - known.pair_start[unit]
    at = gather(known.pair_start[unit], lengths)
    key = np.repeat(doc << PAIR_BITS, lengths) + known.pairs[known.pair[at]]
    times = np.repeat(n, lengths) * known.times[at]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    times = np.add.reduceat(times[order], first) if len(key) else times
    key = key[first]
    ends = np.searchsorted(key, np.arange(len(out) + 1) << PAIR_BITS)
    return key & ((1 << PAIR_BITS) - 1), times, ends


TOKENS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]


def aligned(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Per document: tokens, groups and links, the groups as a digest, a number of its row, its
    linked pairs ((a << B_BITS) + b), each once, and how often each is linked."""

    def digest(batches) -> Iterator[pa.RecordBatch]:
        known, n = aligner(*paths), 0
        for rows, _, _ in slices(batches):
            out, full = known.rows(rows.column("text").to_pylist())
            totals = np.zeros((len(out), len(TOKENS)), np.int64)
            if full.any():
                starts = np.cumsum([0, *[len(o) for o in out]])[:-1][full]
                totals[full] = np.add.reduceat(known.sizes[np.concatenate(out)], starts)
            shown = known.text
            shas = [hashlib.sha256(b";".join([shown[u] for u in o.tolist()])).hexdigest() if len(o) else "" for o in out]
            pairs, times, ends = _document_pairs(known, out)
            row = (TaskContext.get().partitionId() << 33) + n + np.arange(len(out))
            n += len(out)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *[pa.array(totals[:, k]) for k in range(len(TOKENS))], pa.array(shas, pa.string()),
                 pa.array(row), *[pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(x)) for x in (pairs, times)]],
                names=["doc_id", *[f for f, _ in TOKENS], "groups_sha256", "row", "pairs", "times"])

    numbers = ", ".join(f"{f} long" for f, _ in TOKENS)
    return arrow_map(ids_and_text(docs), digest,
                     f"doc_id long, {numbers}, groups_sha256 string, row long, pairs array<long>, times array<long>")


def pair_counts(told: DataFrame) -> DataFrame:
    """pair and n, the number of documents that hold it linked."""
    return told.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def ranked(counts: DataFrame) -> DataFrame:
    """pair, n and whether n is the highest of its id of A. One row at most per id of A is joined."""
    a = F.shiftright("pair", B_BITS)
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Per document: tokens, groups, links, links whose count is the best of their id of A, sum of
    the links' counts, and the groups as a digest.

    Texts are aligned once; their pairs are written out with them, counted, and given their counts.
    """
    told = stage(aligned(docs, paths or default_vocabularies()), "aligned", "zstd")
    counts = stage(ranked(stage(pair_counts(told), "pair-counts")), "pairs")
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    known = top.column("pair").to_numpy()[order]
    # The sign tells a best count.
    counts_of = (top.column("n").to_numpy() * np.where(top.column("best").to_numpy() == 1, -1, 1))[order]
    kept = ["doc_id", *[f for f, _ in TOKENS], "groups_sha256", "row"]

    def add(batches) -> Iterator[pa.RecordBatch]:
        """Sums over the frequent pairs; the others (`rest`) are left for a join."""
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("pairs")).to_numpy())]).astype(np.int64)
            place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            count = np.where(known[place] == pairs, counts_of[place], 0) if len(known) else np.zeros(len(pairs), np.int64)
            sums = []
            for amount in (times * (count < 0), times * np.abs(count)):
                upto = np.concatenate([[0], np.cumsum(amount)])
                sums.append(pa.array((upto[ends[1:]] - upto[ends[:-1]]).astype(np.int64)))
            left = count == 0
            rest_ends = np.concatenate([[0], np.cumsum(left)])[ends].astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(pairs[left], pa.int64()), pa.array(times[left], pa.int64())], ["pair", "times"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *sums, pa.ListArray.from_arrays(rest_ends, rest)],
                                             names=[*kept, "n_best", "count_sum", "rest"])

    numbers = ", ".join(f"{f} long" for f, _ in TOKENS)
    summed = stage(arrow_map(told, add, f"doc_id long, {numbers}, groups_sha256 string, row long, n_best long, count_sum long, "
                             "rest array<struct<pair: long, times: long>>"), "summed", "zstd")
    links = summed.select("row", F.inline("rest"))
    found = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_count"))
    zero = F.lit(0).cast("long")
    return summed.drop("rest").join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_count", zero)).alias("count_sum"), "groups_sha256")
