"""N-gram Jaccard join by a prefix tree of globally ordered word-shingle sets.

1. `profiles`: the shingle set of every document, its size, and a hash of the whole set;
   documents of one hash are one class, and only classes are joined.
2. The global order puts rare shingles first: shingles that recur within windows of the
   corpus are frequent ones and go last, by their count; the rest are ordered by hash.
   The order decides cost only, never the result.
3. Two sets with similarity 3/4 share a shingle among the first n - ceil(3n/4) + 1 of
   either. Those prefixes are the first levels of the tree; classes that meet at one of
   their nodes are candidates if lengths and remaining lengths allow the overlap.
4. Candidates of a class hang in a tree by their ordered sets; it is traversed with the
   class's own set, so shared beginnings are counted once, and a branch is left as soon
   as what remains can't reach the overlap.
5. Common shingles up to the smaller of two prefixes' last keys lie in both prefixes, so a
   pair that meets c times overlaps in c plus what one set holds after its prefix, at most;
   pairs that this bound rules out are never compared.
6. Links make components. Each class is first held against the neighbour it meets most
   often, then against neighbours in other components, and at last against every class of
   another component that it meets often enough: pairs inside a component need no test, so
   groups of near copies cost links in proportion to their size. Only the last step decides
   what is complete; the first two make it small. There, shingles that the very same classes
   meet at are one node, and in a node of many classes only sets probe that can begin to
   overlap there with a larger one, by bands of size (`_across`).

Defined results: words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered; a text of
fewer words than a shingle is one shingle; null texts and texts without words have size 0
and are linked with nothing; repeated rows are linked to each other; rows without doc_id take
part like any other, but name a component (by null) only where no row of it has an id; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugebook.llm.components import components, merged
from gaugebook.llm.membership import thinned
from gaugebook.llm.text import arrow_map, combine, flat, hash_spans, ids_and_text, mix, shuffle_partitions, slices, spans
from gaugebook.session import stage

WORDS = 5
#: Shingles counted together when frequent ones are looked for.
COUNT_WINDOW = 1_500_000
#: Frequent shingles that are ordered by count, at most (8 MB); the others keep the order of their hash.
FREQUENT = 1_000_000
#: Times that a shingle recurs in windows before it counts as frequent.
RECURS = 16
#: Classes that meet one by one at a node, at most; a larger node is probed by the sets that can begin to overlap there.
HOT = 32

_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (63 bits) of all rows, ascending within a row, and the n + 1 offsets of the rows."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    starts, ends, row = spans(_WORD[data], offsets)
    word = hash_spans(_LOWER[data], starts, ends)
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    n = len(word) - words + 1
    parts, at = [], []
    if n > 0:
        same = row[words - 1:] == row[:n]
        parts.append(combine([word[k:k + n] for k in range(words)])[same])
        at.append(row[:n][same])
    for size in range(1, words):  # whole sequences of the short ones
        short = np.flatnonzero(count == size)
        if len(short):
            parts.append(combine([np.uint64(size)] + [word[first[short] + k] for k in range(size)]))
            at.append(short)
    shingle, at = np.concatenate(parts) >> np.uint64(1), np.concatenate(at)
    order = np.lexsort((shingle, at))
    shingle, at = shingle[order], at[order]
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (at[1:] != at[:-1])
    size = np.bincount(at[fresh], minlength=rows)
    return shingle[fresh], np.concatenate([[0], np.cumsum(size)])


def set_hashes(shingles: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash of each row's set."""
    sizes = np.diff(cuts)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles + np.uint64(0x51ED)), dtype=np.uint64)])
        return mix(total[cuts[1:]] - total[cuts[:-1]] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def row_mark(docs: DataFrame):
    """A hash of doc_id and text: the key of a row, never null; only copies share it."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def _marked(docs: DataFrame) -> DataFrame:
    rows = ids_and_text(docs)
    return rows.select("*", row_mark(rows).alias("mark"))


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """kind 0: doc_id, n, cls, mark of a document. kind 1: a recurring shingle (cls) and its count (n) in a window."""
    def profile(batches):
        held, known, size = [], set(), 0

        def recurring():
            token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64),) * 2
            token, count = token[count > 1], count[count > 1]
            zero = np.zeros(len(token), np.int64)
            return _batch([zero, count.astype(np.int64), token.view(np.int64), zero, zero + 1])

        for part, data, offsets in slices(batches):
            shingles, cuts = shingle_sets(data, offsets, words)
            cls = set_hashes(shingles, cuts)
            for i, c in enumerate(cls.tolist()):
                if c not in known:  # copies in a window count once
                    known.add(c)
                    held.append(shingles[cuts[i]:cuts[i + 1]])
            size += len(shingles)
            yield _batch([part.column("doc_id"), np.diff(cuts), cls, part.column("mark"), np.zeros(len(cls), np.int64)])
            if size > COUNT_WINDOW:
                yield recurring()
                held, known, size = [], set(), 0
        yield recurring()

    def _batch(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:4]]
                                          + [pa.array(columns[4], pa.int64()).cast(pa.int32())],
                                          names=["doc_id", "n", "cls", "mark", "kind"])

    return arrow_map(_marked(docs), profile, "doc_id long, n long, cls long, mark long, kind int")


class Order:
    """The global order: a shingle's key is its hash, or a number above all hashes if it is frequent."""

    def __init__(self, frequent: list[int]):
        """`frequent`: shingles by ascending count."""
        token = np.array(frequent, np.int64).view(np.uint64)
        by_token = np.argsort(token)
        self.token, self.rank = token[by_token], by_token.astype(np.uint64)

    def keys(self, shingles: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Keys, ascending within each row."""
        if not len(self.token) or not len(shingles):
            return shingles
        at = np.minimum(np.searchsorted(self.token, shingles), len(self.token) - 1)
        hot = self.token[at] == shingles
        keys = np.where(hot, self.rank[at] + np.uint64(1 << 63), shingles)
        row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        return keys[np.lexsort((keys, row))]


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - -(-3 * n // 4) + 1, 0)


def needed(n: int, m: int) -> int:
    """The least overlap of sets of these sizes with 100 * overlap >= 75 * union."""
    return -(-3 * (n + m) // 7)


def prefixes(docs: DataFrame, order: Order, words: int = WORDS) -> DataFrame:
    """token, cls, size and position for the prefix of every class."""
    def emit(batches):
        known: set[int] = set()
        for _, data, offsets in slices(batches):
            shingles, cuts = shingle_sets(data, offsets, words)
            cls = set_hashes(shingles, cuts)
            keys = order.keys(shingles, cuts)
            new = np.zeros(len(cls), bool)
            for i, c in enumerate(cls.tolist()):
                if c not in known:
                    known.add(c)
                    new[i] = True
            if len(known) > 200_000:
                known.clear()
            n = np.diff(cuts)
            take = np.where(new, prefix_length(n), 0)
            row = np.repeat(np.arange(len(n)), take)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[cuts[:-1][row] + nth].view(np.int64)), pa.array(cls[row]),
                 pa.array(n[row].astype(np.int32)), pa.array(nth.astype(np.int32))],
                names=["token", "cls", "size", "pos"])

    return arrow_map(ids_and_text(docs), emit, "token long, cls long, size int, pos int")


def meetings(rows: DataFrame) -> DataFrame:
    """Prefix rows whose token another class has too, and the class before it in order of size."""
    ordered = rows.repartition(shuffle_partitions(rows), "token").sortWithinPartitions("token", "size", "cls")
    ordered.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")

    def shared(batches):
        held = None  # the last row, which the next batch may continue
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held[:4], columns)]
            token, cls = columns[0], columns[1]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            columns = [c[fresh] for c in columns]
            out, held = _shared(columns, held[4] if held is not None else None)
            yield out
        if held is not None and held[4] is not None:
            yield _rows(held[:4], np.array([held[4][0]]), np.array([held[4][1]], np.int32), np.array([True]))

    def _rows(columns, before, before_size, has):
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns] + [pa.array(before, pa.int64(), mask=~has),
                                              pa.array(before_size, pa.int32(), mask=~has)],
            names=["token", "cls", "size", "pos", "before", "before_size"])

    def _shared(columns, first_before):
        """All but the last row; `first_before` is the class before the first row, if it has its token."""
        token, cls, size, _ = columns
        same = np.zeros(len(token), bool)
        same[1:] = token[1:] == token[:-1]
        before, before_size = np.concatenate([[0], cls[:-1]]), np.concatenate([size[:1], size[:-1]])
        if first_before is not None:
            same[0], (before[0], before_size[0]) = True, first_before
        after = np.zeros(len(token), bool)
        after[:-1] = token[1:] == token[:-1]
        keep = same | after
        keep[-1] = False
        last = [c[-1:] for c in columns] + [(int(before[-1]), int(before_size[-1])) if same[-1] else None]
        return _rows([c[keep] for c in columns], before[keep], before_size[keep], same[keep]), last

    return ordered.mapInArrow(shared, "token long, cls long, size int, pos int, before long, before_size int")


def tree_links(own: np.ndarray, others: list[tuple[int, np.ndarray]], step: int = 128) -> list[int]:
    """Ids of `others` (sorted key arrays) that reach the threshold with `own`, by one traversal of their tree."""
    out = []
    path, counts = np.empty(0, np.uint64), np.zeros(1, np.int64)  # the branch taken last, overlap at each depth
    for number, keys in sorted(others, key=lambda o: o[1].astype(">u8").tobytes()):
        least = needed(len(own), len(keys))
        if min(len(own), len(keys)) < least:
            continue
        n = min(len(path), len(keys))
        differ = np.flatnonzero(path[:n] != keys[:n])
        depth = int(differ[0]) if len(differ) else n
        depth = min(depth, len(counts) - 1)
        counts = counts[:depth + 1]
        reached = True
        while depth < len(keys):
            # What is left of either set bounds the overlap that this branch can reach.
            at = int(np.searchsorted(own, keys[depth]))
            if counts[-1] + min(len(keys) - depth, len(own) - at) < least:
                reached = False
                break
            part = keys[depth:depth + step]
            place = np.minimum(np.searchsorted(own, part), len(own) - 1)
            counts = np.concatenate([counts, counts[-1] + np.cumsum(own[place] == part)])
            depth += len(part)
        path = keys[:depth]
        if reached and counts[-1] >= least:
            out.append(number)
    return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes that are links. `sets`: cls, keys (binary, ordered)."""
    right = sets.select(F.col("cls").alias("v"), F.col("keys").alias("v_keys")).join(pairs.hint("merge"), "v")
    both = right.join(sets.select(F.col("cls").alias("u"), F.col("keys").alias("u_keys")).hint("merge"), "u")
    both = both.select("u", "v", "u_keys", "v_keys")
    both.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")

    def check(batches):
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            groups: dict[int, list] = {}
            own: dict[int, np.ndarray] = {}
            for i, (a, b) in enumerate(zip(u, v)):
                if a not in own:
                    own[a] = np.frombuffer(batch.column("u_keys")[i].as_py(), "<u8")
                groups.setdefault(a, []).append((b, np.frombuffer(batch.column("v_keys")[i].as_py(), "<u8")))
            found = [(a, b) for a, others in groups.items() for b in tree_links(own[a], others)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()),
                                              pa.array([f[1] for f in found], pa.int64())], names=["u", "v"])

    return both.mapInArrow(check, "u long, v long")


def _sets(docs: DataFrame, chosen: DataFrame, order: Order, words: int) -> DataFrame:
    """cls and ordered keys of the chosen documents (mark, cls); repeated rows give repeated sets."""
    # A merge join at every size: the chosen documents grow with the corpus, and the Python steps
    # before and after it run in stages of their own.
    rows = thinned(_marked(docs), "mark", chosen, "mark").join(chosen.hint("merge"), "mark")

    def build(batches):
        for part, data, offsets in slices(batches):
            shingles, cuts = shingle_sets(data, offsets, words)
            cls = set_hashes(shingles, cuts)
            keys = order.keys(shingles, cuts).astype("<u8")
            mine = np.flatnonzero(cls == part.column("cls").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[mine]), pa.array([keys[cuts[i]:cuts[i + 1]].tobytes() for i in mine], pa.binary())],
                names=["cls", "keys"])

    return arrow_map(rows, build, "cls long, keys binary")


def _close(a: str, b: str):
    """Sizes that allow the threshold."""
    return (F.col(a) * 4 >= F.col(b) * 3) & (F.col(b) * 4 >= F.col(a) * 3)


def _often_enough(times, a: str, b: str):
    """Whether sets of sizes a and b that meet so often in their prefixes can reach the overlap."""
    after = F.greatest(F.ceil(F.col(a) * 3 / 4), F.ceil(F.col(b) * 3 / 4)) - 1
    return 7 * (times + after) >= 3 * (F.col(a) + F.col(b))


def _nodes(here: DataFrame) -> DataFrame:
    """Members of the nodes that can link two components: node, cls, size, pos, comp, weight, hot.

    A node is all the tokens that the very same classes meet at, such as those of a passage;
    `weight` is their number and `pos` the place of the first.
    """
    held = here.groupBy("token").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("cls")).alias("node"), F.min("cls").alias("low"),
        F.max("cls").alias("high"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    held = held.where(F.col("least") != F.col("most")).select(
        "token", F.xxhash64("node", "low", "high", "members").alias("node"), (F.col("members") > HOT).alias("hot"))
    return stage(here.join(held, "token").groupBy("node", "cls", "size", "comp", "hot").agg(
        F.min("pos").alias("pos"), F.count("*").alias("weight")), "nodes")


def _across(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes of different components that their meetings don't rule out.

    Members of a node of up to HOT classes meet one by one, and what they share is counted. In
    a larger node only pairs meet that can have their first common shingle there: what either
    set holds from there on must reach the overlap, so the other set has (4 size - 7 pos) / 3
    shingles at most (`reach`). The smaller set of such a pair reaches its own size at least;
    only those sets probe, by bands of size. What a set has in larger nodes bounds what
    pairs share there, and what either has in the nodes from there on bounds how often they meet.
    """
    reach = F.floor((4 * F.col("size") - 7 * F.col("pos")) / 3)
    band = F.floor(F.log(F.col("size") + F.lit(0.5)) / math.log(4 / 3))
    of_class = Window.partitionBy("cls")
    hot_weight, cold_weight = F.when(F.col("hot"), F.col("weight")).otherwise(0), F.when(F.col("hot"), 0).otherwise(F.col("weight"))
    rows = nodes.select(
        "node", "cls", "size", "pos", "comp", "hot", "weight", reach.alias("reach"), band.alias("band"),
        F.sum(hot_weight).over(of_class).alias("hot_weight"),
        *(F.sum(w).over(of_class.orderBy(F.desc("pos"))).alias(f"{name}_left") for name, w in (("hot", hot_weight), ("cold", cold_weight))))

    def side(of: DataFrame, name: str) -> DataFrame:
        return of.select("node", "band", *(F.col(c).alias(f"{name}_{c}") for c in (
            "cls", "size", "pos", "comp", "weight", "reach", "hot_weight", "hot_left", "cold_left")))

    cold = rows.where("NOT hot")
    bound = F.least("a_pos", "b_pos") + F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
    met = side(cold, "a").drop("band").join(side(cold, "b").drop("band"), "node").where(
        (F.col("a_cls") < F.col("b_cls")) & (F.col("a_comp") != F.col("b_comp")) & _close("a_size", "b_size")
        & (7 * bound >= 3 * (F.col("a_size") + F.col("b_size")))).withColumn("n", F.col("a_weight"))

    hot = rows.where("hot")
    # A partner holds 4/3 of the smaller set at most: its band is the same, the next, or by rounding the one after.
    bands = F.explode(F.array(*(F.col("band") + k for k in range(3))))
    probes = side(hot.where("reach >= size").withColumn("band", bands), "a")
    left = F.least("a_hot_left", "b_hot_left") + F.least("a_cold_left", "b_cold_left")
    first = probes.join(side(hot, "b"), ["node", "band"]).where(
        (F.col("a_size") <= F.col("b_size")) & (F.col("b_size") <= F.col("a_reach")) & (F.col("a_size") <= F.col("b_reach"))
        & ((F.col("a_size") < F.col("b_size")) | (F.col("a_cls") < F.col("b_cls")))
        & (F.col("a_comp") != F.col("b_comp")) & _often_enough(left, "a_size", "b_size")).withColumn("n", F.lit(0).cast("long"))

    def ends(pairs: DataFrame) -> DataFrame:
        """One order of the two classes, for either kind of meeting."""
        flip = F.col("a_cls") > F.col("b_cls")
        return pairs.select(
            F.least("a_cls", "b_cls").alias("u"), F.greatest("a_cls", "b_cls").alias("v"),
            F.when(flip, F.col("b_size")).otherwise(F.col("a_size")).alias("u_size"),
            F.when(flip, F.col("a_size")).otherwise(F.col("b_size")).alias("v_size"),
            F.least("a_hot_weight", "b_hot_weight").alias("hot"), "n")

    counted = ends(met).unionByName(ends(first)).groupBy("u", "v", "u_size", "v_size", "hot").agg(F.sum("n").alias("n"))
    return counted.withColumn("n", F.col("n") + F.col("hot")).where(_often_enough(F.col("n"), "u_size", "v_size")).select("u", "v")


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    full, empty = _members(docs, words)
    heads = full.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = full.join(heads, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(empty.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def heads(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and mark of one row of each component, by the smallest doc_id (null last), then mark; rows without words all."""
    full, empty = _members(docs, words)
    first = full.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("first"))
    return first.select("first.doc_id", "first.mark").unionByName(empty.select("doc_id", "mark").distinct())


def _members(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their component (comp), and documents that have no words."""
    profile = stage(profiles(docs, words), "profiles")
    recurring = profile.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= RECURS)
    top = recurring.orderBy(F.desc("n"), "cls").limit(FREQUENT).select("cls", "n").toArrow()
    by_count = np.lexsort((top.column("cls").to_numpy(), top.column("n").to_numpy()))
    order = Order(top.column("cls").to_numpy()[by_count])
    per_doc = profile.where("kind = 0").drop("kind")
    met = stage(meetings(prefixes(docs, order, words)), "meetings")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs of classes that are links."""
        pairs = stage(pairs, "pairs")
        named = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
        chosen = stage(per_doc.join(named, "cls").groupBy("cls").agg(F.min("mark").alias("mark")), "chosen")
        return stage(verified(pairs, stage(_sets(docs, chosen, order, words), "sets")), "links")

    def placed(comp: DataFrame) -> DataFrame:
        return met.drop("before", "before_size").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
            "comp", F.coalesce("comp", "cls"))

    def promising(neighbours: DataFrame) -> DataFrame:
        """Pairs (cls, v) that meet often enough as neighbours, one for each cls: the one met most often."""
        counted = neighbours.where(_close("size", "v_size")).groupBy("cls", "v", "size", "v_size").agg(
            F.count("*").alias("n")).where(_often_enough(F.col("n"), "size", "v_size"))
        return counted.groupBy(F.col("cls").alias("u")).agg(F.max(F.struct("n", "v")).alias("best")).select(
            "u", F.col("best.v").alias("v"))

    comp = components(linked(promising(met.where("before IS NOT NULL").withColumnsRenamed({"before": "v", "before_size": "v_size"}))))

    along = Window.partitionBy("token").orderBy("size", "cls")
    now = placed(comp).withColumns({f"v_{c}" if c != "cls" else "v": F.lag(c).over(along) for c in ("cls", "comp", "size")})
    comp = merged(comp, linked(promising(now.where(F.col("comp") != F.col("v_comp")))))
    comp = merged(comp, linked(_across(_nodes(placed(comp)))))

    full = per_doc.where("n > 0").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "comp", F.coalesce("comp", "cls"))
    return full, per_doc.where("n = 0")
