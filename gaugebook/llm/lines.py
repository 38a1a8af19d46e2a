"""Line dedup by a segment-partition edit join.

Every non-empty line takes part. It is removed if an equal line, or one within the edits
(insert, delete, replace of a code point) that the shorter of the two allows, stands before
it; the order is by doc_id (null first), then by a hash of id and text, then by line number.
A line allows EDITS edits from MIN_CHARS code points on and proportionally fewer below:
one from half of that, none under half. A caller can set a floor; shorter lines then stay.

1. Equal lines fold to their first occurrence.
2. A line of n code points that allows e edits is cut into e + 1 segments; a line within e edits holds
   one of them unchanged, near its place. Segments are index entries under (n, number of the
   segment, text); for lengths n, n - 1, .. each line probes the substrings that the
   multi-match windows leave.
3. Lines that meet under a key are candidates. Where more than CROWD meet, the shared
   segment is cut out and what remains is partitioned again under the old key and the new,
   up to level LEVELS; what still meets in crowds then is joined, for pairs whose counts of
   characters (16 classes, modulo 16) are close enough for EDITS edits.
4. Candidates are verified by a banded bit-parallel edit distance.

Defined results: a null text stays null and has no lines; an empty text is one empty line;
rows of equal doc_id and equal text are one document in the order, so that they never remove
each other's lines at equal line numbers; rows of one doc_id, or without one, that differ in
text are documents of their own; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugebook.llm.membership import thinned
from gaugebook.llm.text import (
    SpanHashes,
    arrow_map,
    combine,
    flat,
    free_name,
    gather,
    hash_spans,
    shuffle_partitions,
    slices,
)
from gaugebook.session import stage

EDITS = 2
MIN_CHARS = 32
CROWD = 48
LEVELS = 2
CLASSES = 16
#: Marks a row that is an index entry and a probe; above all edits.
BOTH = 64
FIRST = -(1 << 63)  # stands for a null doc_id
#: A document: its id, and a hash of id and text that tells apart texts of one id.
ID = ["doc_id", "mark"]


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """Row, number, start and end byte of every line of every non-empty row, and starts and ends in code points."""
    edge = np.zeros(len(data) + 1, bool)
    full = offsets[:-1] < offsets[1:]
    edge[offsets[:-1][full]] = True
    feeds = np.flatnonzero(data == 10)
    row_of = np.searchsorted(offsets, feeds, side="right") - 1
    starts = np.concatenate([offsets[:-1][full], feeds + 1])
    rows = np.concatenate([np.flatnonzero(full), row_of])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[last] = offsets[1:][rows[last]]
    head = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=head[1:])
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:] != rows[:-1]
    heads = np.flatnonzero(new)
    number = np.arange(len(rows)) - np.repeat(heads, np.diff(np.append(heads, len(rows))))
    return rows, number, starts, ends, head


def segments(n: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the i-th of `parts` even segments of lines of n code points; longer ones last."""
    short = n // parts
    longer_from = parts - n % parts
    return i * short + np.maximum(0, i - longer_from), short + (i >= longer_from)


def allowed(n):
    """Edits that a line of n code points allows."""
    return np.minimum(EDITS, n * EDITS // MIN_CHARS)


def keys(data: np.ndarray, begin: np.ndarray, n: np.ndarray, least: int = 1, given: np.ndarray | None = None, own: bool = True):
    """(line, role, key, start, length) arrays. `begin`: first code point of each line, `n`: their number.

    role 0 is an index entry, 1 + d a probe among lines that are d code points shorter. Lines under
    `least` code points have no keys. The length joined decides the edits, unless each line is `given` its own.
    Each index entry has a probe of its own key and place, which is left out without `own`.
    """
    first_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    hashed = SpanHashes(data)
    out = []
    for edits, shorter in ((e, d) for e in range(1, EDITS + 1) for d in range(-1, e + 1)):
        probe = shorter >= 0
        role = 1 + shorter if probe else 0
        size = n - max(shorter, 0)
        usable = np.flatnonzero((size >= max(least, edits + 1)) & ((allowed(size) if given is None else given) == edits))
        if not len(usable):
            continue
        for i in range(edits + 1):
            at, length = segments(size[usable], i, edits + 1)
            low, high = (max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))) if probe else (0, 0)
            for move in range(low, high + 1):
                if not own and shorter == 0 and move == 0:
                    continue
                start = at + move
                ok = (start >= 0) & (start + length <= n[usable])
                line, s, k = usable[ok], start[ok], length[ok]
                a, b = first_byte[begin[line] + s], first_byte[begin[line] + s + k]
                key = combine([hashed(a, b), size[line] * 8 + i])
                out.append((line, np.full(len(line), role), key, s, k))
    if not out:
        return [np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint64)] + [np.empty(0, np.int64)] * 2
    return [np.concatenate(c) for c in zip(*out)]


def within(x: str, y: str, edits: int) -> bool:
    """Whether the edit distance is `edits` at most: a band of 2 * edits + 1 bits, column by column."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > edits:
        return False
    if x == y:
        return True
    a = 0
    while a < len(x) and x[a] == y[a]:
        a += 1
    b = 0
    while b < len(x) - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a:len(x) - b], y[a:len(y) - b]
    m, n = len(x), len(y)
    if m <= edits:  # no room for a whole band
        row = list(range(m + 1))
        for j, c in enumerate(y, 1):
            row, old = [j], row
            for i in range(1, m + 1):
                row.append(min(old[i] + 1, row[i - 1] + 1, old[i - 1] + (x[i - 1] != c)))
        return row[m] <= edits
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    width = 2 * edits + 1
    full = (1 << width) - 1
    # Bit r of a vector in column j belongs to row j - edits + r; `up`, `down`: vertical steps of +1, -1.
    up, down, score = full & ~((1 << edits) - 1), 0, edits
    for j in range(1, n + 1):
        shift = j - edits - 1
        mask = masks.get(y[j - 1], 0)
        equal = (mask >> shift if shift >= 0 else mask << -shift) & full
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right, left = (down | ~(diagonal | up)) & full, diagonal & up
        if j + edits <= m:
            score += not diagonal >> (width - 1) & 1
            if score > 2 * edits + n - m:
                return False
        else:
            bit = m - j + edits
            score += (right >> bit & 1) - (left >> bit & 1)
        up, down = (left | ~(diagonal >> 1 | right)) & full, diagonal >> 1 & right
    return score <= edits


def sketches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of first bytes of code points by class, modulo 16, packed. An edit moves their sum of
    differences by two at most."""
    size = ends - starts
    at = gather(starts, size)
    head = (data[at] & 0xC0) != 0x80
    line = np.repeat(np.arange(len(starts)), size)[head]
    count = np.bincount(line * CLASSES + data[at[head]] % CLASSES, minlength=len(starts) * CLASSES)
    packed = (count.reshape(-1, CLASSES).astype(np.uint64) & np.uint64(15)) << np.arange(0, 4 * CLASSES, 4, dtype=np.uint64)
    return np.bitwise_or.reduce(packed, axis=1) if len(starts) else np.empty(0, np.uint64)


def _alike(a: str, b: str):
    """Whether two sketches allow EDITS edits."""
    steps = [F.abs(F.shiftright(a, 4 * k).bitwiseAND(15) - F.shiftright(b, 4 * k).bitwiseAND(15)) for k in range(CLASSES)]
    total = F.lit(0)
    for step in steps:
        total = total + F.least(step, 16 - step)
    return total <= 2 * EDITS


def _occurrences(docs: DataFrame, least: int) -> DataFrame:
    """Lines that take part: two hashes, where they stand, and their number of code points."""
    def emit(batches):
        for part, data, offsets in slices(batches):
            rows, number, starts, ends, head = line_spans(data, offsets)
            n = head[ends] - head[starts]
            take = n >= max(least, 1)
            rows, number, starts, ends = rows[take], number[take], starts[take], ends[take]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hash_spans(data, starts, ends).view(np.int64)),
                 pa.array(hash_spans(data ^ 0xA5, starts, ends).view(np.int64)),
                 *(part.column(c).take(pa.array(rows)) for c in ID), pa.array(number.astype(np.int32))],
                names=["line", "check", *ID, "number"])

    return arrow_map(docs, emit, "line long, check long, doc_id long, mark long, number int")


def _key_rows(docs: DataFrame, least: int) -> DataFrame:
    """key and line of all index entries and probes; the lowest bit of `entry` marks a probe, the next ones are the edits.

    An index entry and the probe of its own key are one row, marked BOTH.
    """
    def emit(batches):
        known: set[int] = set()
        for _, data, offsets in slices(batches, limit=1 << 19):
            rows, _, starts, ends, head = line_spans(data, offsets)
            n = head[ends] - head[starts]
            take = (n >= least) & (allowed(n) > 0)
            starts, ends = starts[take], ends[take]
            if not len(starts):
                continue
            line, at = np.unique(hash_spans(data, starts, ends).view(np.int64), return_index=True)
            new = np.array([i for i, h in enumerate(line.tolist()) if h not in known], np.int64)
            known.update(line[new].tolist())
            if len(known) > 200_000:
                known.clear()
            at, line = at[new], line[new]
            n = head[ends[at]] - head[starts[at]]
            which, role, key, _, _ = keys(data, head[starts[at]], n, least, own=False)
            entry = allowed(n[which] - np.maximum(role - 1, 0)) * 2 + np.where(role > 0, 1, BOTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(line[which]), pa.array(entry.astype(np.int8))],
                names=["key", "line", "entry"])

    return arrow_map(docs, emit, "key long, line long, entry byte")


def _meet(rows: DataFrame, rest: bool) -> DataFrame:
    """Candidate pairs (u, v) of a key; members of a crowd come back as (key, u) with v null."""
    columns = ["key", "line", "entry"] + (["rest"] if rest else [])
    ordered = rows.select(*columns).repartition(shuffle_partitions(rows), "key").sortWithinPartitions("key")
    # Spark sorts by one number in linear time; the members of a key are few and need no order.
    ordered.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")

    def pairs(members):
        index = sorted({m[0] for m in members if not m[1] & 1})
        probes = sorted({m[0] for m in members if m[1] & 1})
        return [(min(a, b), max(a, b)) for a in index for b in probes if a != b]

    def close(key, members, crowd, out):
        if not crowd and len(members) > 1:
            out += [(key, a, b, None, None) for a, b in pairs(members.values())]

    def scan(batches):
        held: dict = {}
        current, crowd = None, False
        for batch in batches:
            key, line = batch.column("key").to_numpy(), batch.column("line").to_numpy()
            # Rows that are alone under their key, as most are, never reach Python objects.
            alone = np.zeros(len(key), bool)
            alone[1:-1] = (key[1:-1] != key[:-2]) & (key[1:-1] != key[2:])
            at = np.flatnonzero(~alone)
            entry = batch.column("entry").to_numpy()
            text = batch.column("rest") if rest else None
            out: list = []
            for i, k, u, marked in zip(at.tolist(), key[at].tolist(), line[at].tolist(), entry[at].tolist()):
                if k != current:
                    close(current, held, crowd, out)
                    current, held, crowd = k, {}, False
                for p in (marked - BOTH, marked - BOTH + 1) if marked & BOTH else (marked,):
                    member = (u, p, text[i].as_py() if rest else None)
                    if crowd:
                        out.append((k, u, None, p, member[2]))
                        continue
                    held.setdefault((u, p), member)
                    if len(held) > CROWD:
                        crowd = True
                        out += [(k, m[0], None, m[1], m[2]) for m in held.values()]
                        held = {}
            yield _batch(out)
        out = []
        close(current, held, crowd, out)
        yield _batch(out)

    def _batch(out):
        c = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()),
             pa.array(c[3], pa.int8()), pa.array(c[4], pa.string())], names=["key", "u", "v", "entry", "rest"])

    return ordered.mapInArrow(scan, "key long, u long, v long, entry byte, rest string")


def _again(rows: DataFrame, first: bool) -> DataFrame:
    """Crowd members (key, line, entry, text, rest) under their old key and the keys of what remains.

    At the first level the text is the whole line, and the key shows which substring was
    shared; later the rest has lost that substring already.
    """
    def emit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            old, line, entry, text = (batch.column(c).to_pylist() for c in ("key", "line", "entry", "text"))
            data, _ = flat(pa.array(text, pa.string()))
            n = np.array([len(t) for t in text])
            of = np.array(entry)
            which, role, key, start, length = keys(data, np.cumsum(n) - n, n, given=None if first else of >> 1)
            before = np.array(old, np.int64)[which]
            fits = (role > 0) == (of[which] & 1 > 0)
            if first:
                fits &= key.view(np.int64) == before
            else:
                key = combine([before.view(np.uint64), key])
            c = list(zip(*[(t, line[w], entry[w], text[w][:s] + text[w][s + k:]) for w, t, s, k in zip(
                which[fits].tolist(), key[fits].view(np.int64).tolist(), start[fits].tolist(), length[fits].tolist())])) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int8()), pa.array(c[3], pa.string())],
                names=["key", "line", "entry", "rest"])

    return arrow_map(rows, emit, "key long, line long, entry byte, rest string")


def _texts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """line, check, text and sketch of the given lines (line, check, doc_id, mark, number)."""
    wanted = lines.groupBy(*ID).agg(F.sort_array(F.collect_set("number")).alias("numbers"))
    rows = thinned(docs, "mark", wanted, "mark").join(wanted.hint("merge"), ID)

    def cut(batches):
        for batch in batches:
            line, check, text = [], [], []
            for body, numbers in zip(batch.column("text").to_pylist(), batch.column("numbers").to_pylist()):
                parts = (body or "").split("\n")
                text += [parts[i] for i in numbers if i < len(parts)]
            data, at = flat(pa.array(text, pa.string()))
            line, check = hash_spans(data, at[:-1], at[1:]), hash_spans(data ^ 0xA5, at[:-1], at[1:])
            yield pa.RecordBatch.from_arrays([pa.array(line.view(np.int64)), pa.array(check.view(np.int64)),
                                              pa.array(text, pa.string()), pa.array(sketches(data, at[:-1], at[1:]).view(np.int64))],
                                             names=["line", "check", "text", "sketch"])

    found = arrow_map(rows, cut, "line long, check long, text string, sketch long")
    return found.join(lines.select("line", "check"), ["line", "check"], "left_semi").dropDuplicates(["line", "check"])


def near_lines(docs: DataFrame, least: int = 1, occurrences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (line, check, first: doc_id, mark and number), and the pairs of them within the allowed edits.

    `docs`: doc_id (no nulls), mark and text. `occurrences`: their lines, if the caller has staged them.
    """
    if occurrences is None:
        occurrences = _occurrences(docs, least)
    lines = stage(occurrences.groupBy("line", "check").agg(F.min(F.struct(*ID, "number")).alias("first")).select(
        "line", "check", "first.doc_id", "first.mark", "first.number"), "lines")
    met = stage(_meet(_key_rows(docs, least), False), "candidates")
    found, first = [met], True
    for level in range(LEVELS):
        crowd = met.where("v IS NULL").select("key", F.col("u").alias("line"), "entry", "rest")
        if crowd.isEmpty():
            break
        if first:
            texts = stage(_texts(docs, lines.join(crowd.select("line").distinct(), "line", "left_semi")), "crowd-texts")
            whole = crowd.drop("rest").join(texts.select("line", "text"), "line")
            crowd = _again(whole, True)  # what remains beside the shared substring
            first = False
        if level == LEVELS - 1:
            placed = crowd.select("key", "line", "entry").distinct().join(texts.select("line", "sketch"), "line")
            x = placed.where("entry & 1 = 0").select("key", F.col("line").alias("x"), F.col("sketch").alias("x_sketch"))
            y = placed.where("entry & 1 = 1").select("key", F.col("line").alias("y"), F.col("sketch").alias("y_sketch"))
            both = x.join(y, "key").where((F.col("x") != F.col("y")) & _alike("x_sketch", "y_sketch"))
            found.append(both.select("key", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))
            break
        met = stage(_meet(_again(crowd.withColumnRenamed("rest", "text"), False), True), "candidates")
        found.append(met)
    pairs = found[0].where("v IS NOT NULL").select("u", "v")
    for more in found[1:]:
        pairs = pairs.unionByName(more.where("v IS NOT NULL").select("u", "v"))
    pairs = stage(pairs.distinct(), "pairs")
    named = pairs.select(F.col("u").alias("line")).unionByName(pairs.select(F.col("v").alias("line"))).distinct()
    texts = stage(_texts(docs, lines.join(named, "line", "left_semi")), "texts")
    side = [texts.select(F.col("line").alias(c), F.col("check").alias(f"{c}_check"), F.col("text").alias(f"{c}_text")) for c in "uv"]
    both = pairs.join(side[0], "u").join(side[1], "v")

    def verify(batches):
        for batch in batches:
            ok = [within(a, b, int(allowed(min(len(a), len(b))))) for a, b in zip(batch.column("u_text").to_pylist(), batch.column("v_text").to_pylist())]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["u", "u_check", "v", "v_check"])

    near = arrow_map(both, verify, "u long, u_check long, v long, v_check long")
    return lines, near


def _removals(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, mark and the numbers of the lines that go, for documents that lose any."""
    occurrences = stage(_occurrences(docs, least), "occurrences")  # read twice, and finding them costs most of a scan
    lines, near = near_lines(docs, least, occurrences)
    spot = F.struct(*ID, "number")
    at_u = lines.select(F.col("line").alias("u"), F.col("check").alias("u_check"), spot.alias("u_at"))
    at_v = lines.select(F.col("line").alias("v"), F.col("check").alias("v_check"), spot.alias("v_at"))
    placed = near.join(at_u, ["u", "u_check"]).join(at_v, ["v", "v_check"])
    later = placed.select(F.when(F.col("u_at") > F.col("v_at"), F.struct(F.col("u").alias("line"), F.col("u_check").alias("check")))
                          .when(F.col("v_at") > F.col("u_at"), F.struct(F.col("v").alias("line"), F.col("v_check").alias("check"))).alias("x"))
    gone = later.where("x IS NOT NULL").select("x.*").distinct().withColumn("gone", F.lit(True))
    state = lines.withColumnsRenamed({c: f"first_{c}" for c in (*ID, "number")}).join(gone, ["line", "check"], "left")
    all_lines = occurrences.join(state, ["line", "check"])
    drop = F.col("gone").isNotNull()
    for c in (*ID, "number"):
        drop = drop | (F.col(c) != F.col(f"first_{c}"))
    return all_lines.where(drop).groupBy(*ID).agg(F.sort_array(F.collect_set("number")).alias("numbers"))


def dedup(docs: DataFrame, n_lines: str = "n_lines", n_removed: str = "n_removed", least: int = 1) -> DataFrame:
    """The documents with `text` cut, and two counts beside their columns (in place of columns of those names).

    Lines under `least` code points stay.
    """
    names = [c for c in docs.columns if c not in (n_lines, n_removed)]
    id_, text = F.coalesce(docs["doc_id"].cast("long"), F.lit(FIRST)), docs["text"].cast("string")
    mark = F.xxhash64(docs["doc_id"].cast("long"), text)
    gone = stage(_removals(docs.select(id_.alias("doc_id"), mark.alias("mark"), text.alias("text")), least), "removals")
    at, which, away = (free_name(docs, c) for c in ("_at", "_mark", "_numbers"))
    rows = docs.select(*(docs[c] for c in names), id_.alias(at), mark.alias(which)).join(
        gone.select(F.col("doc_id").alias(at), F.col("mark").alias(which), F.col("numbers").alias(away)).hint("merge"),
        [at, which], "left").drop(at, which)
    # A merge join at every size: the list of removals grows with the corpus, so it is no side to broadcast.
    schema = rows.drop(away).withColumn("text", F.col("text").cast("string")).withColumns(
        {n_lines: F.lit(0).cast("long"), n_removed: F.lit(0).cast("long")}).schema

    def cut(batches):
        for batch in batches:
            texts, gone_of = batch.column("text").cast(pa.string()).to_pylist(), batch.column(away).to_pylist()
            counts = [0 if t is None else t.count("\n") + 1 for t in texts]
            for i, gone_lines in enumerate(gone_of):
                if gone_lines and texts[i] is not None:
                    drop = set(gone_lines)
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in drop)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(counts, pa.int64()), pa.array([len(g or ()) for g in gone_of], pa.int64())],
                names=names + [n_lines, n_removed])

    return arrow_map(rows, cut, schema)
