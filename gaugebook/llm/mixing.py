"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The token mass of the cells is
raked until its margins equal the targets; the ratio of raked to actual mass is the weight
of a cell. Probabilities are raked too, under the bound that no cell gives more than it
has: they are min(1, a product of one factor for each margin), so that the expected sample
is the wanted share of all tokens and has the target margins itself. A category that has
less than its target is kept whole, and what it lacks is dealt to the others of its margin
by their targets. Where targets of several margins exclude each other under the bound, the
raking ends after ROUNDS; `reached` shows the margins of the sample in any case. A hash of
doc_id and a seed decides, so a rerun keeps the same documents.

Every source and every language is a category of its own; topics are TOPICS hashed word
classes. Up to DRIVER_CELLS cells are raked on the driver; more by rounds of Spark
aggregations over the table of cells, to the same margins and tolerance.

Tokens are words (runs of bytes that are no white space). The topic of a document is the
class that most of its longer words hash to, the smaller one in a tie.

Defined results: null source and lang are the category `(none)`; null and empty texts have
no tokens, belong to topic 0 and get weight and probability of their cell, or weight 1 and
probability `share` where the cell has no mass (1 where no document has a token); documents of one doc_id share one fate; a null doc_id counts as one more id; an
empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugebook.llm.jaccard import _LOWER, _WORD
from gaugebook.llm.text import arrow_map, free_name, hash_spans, slices, spans
from gaugebook.session import stage

TOPICS = 8
#: Bytes of a word that votes for a topic, at least.
TOPIC_WORD = 6
#: Cells that the driver rakes and broadcasts, at most.
DRIVER_CELLS = 50_000
NONE = "(none)"
#: Targets temper the actual shares: share^TEMPER, made to sum to 1.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.9}
SHARE = 0.8
SEED = 17
ROUNDS = 200
TOLERANCE = 1e-9


def tokens_and_topic(docs: DataFrame, prefix: str = "mix_") -> DataFrame:
    """The documents with mix_tokens and mix_topic beside their columns."""
    added = [f"{prefix}tokens", f"{prefix}topic"]
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*(docs[c] for c in names))
    schema = docs.withColumns({added[0]: F.lit(0).cast("long"), added[1]: F.lit(0)}).schema

    def measure(batches):
        for part, data, offsets in slices(batches):
            starts, ends, row = spans(_WORD[data], offsets) if len(data) else (np.empty(0, np.int64),) * 3
            n = np.bincount(row, minlength=part.num_rows)
            long = ends - starts >= TOPIC_WORD
            vote = hash_spans(_LOWER[data], starts[long], ends[long]) % np.uint64(TOPICS)
            votes = np.bincount(row[long] * TOPICS + vote.astype(np.int64), minlength=part.num_rows * TOPICS)
            topic = votes.reshape(part.num_rows, TOPICS).argmax(1)
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in names] + [pa.array(n.astype(np.int64)), pa.array(topic.astype(np.int32))],
                names=names + added)

    return arrow_map(docs, measure, schema)


def rake(mass: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS,
         tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell masses whose margins meet the targets. margins: (category of each cell, target mass of each category)."""
    out = mass.astype(float).copy()
    for _ in range(rounds):
        worst = 0.0
        for category, target in margins:
            now = np.bincount(category, weights=out, minlength=len(target))
            factor = np.where(now > 0, target / np.where(now > 0, now, 1), 1.0)
            worst = max(worst, float(np.abs(factor - 1).max()))
            out *= factor[category]
        if worst < tolerance:
            break
    return out


def calibrate(mass: np.ndarray, weight: np.ndarray, wanted: float) -> float:
    """The scale for which min(1, scale * weight) keeps `wanted` of the mass."""
    order = np.argsort(-weight)
    mass, weight = mass[order], weight[order]
    full = np.concatenate([[0.0], np.cumsum(mass)])  # mass of cells that are kept whole
    rest = np.concatenate([np.cumsum((mass * weight)[::-1])[::-1], [0.0]])
    for k in range(len(mass)):
        if rest[k] <= 0:
            break
        scale = (wanted - full[k]) / rest[k]
        if scale * weight[k] <= 1 + 1e-12:
            return max(scale, 0.0)
    return np.inf


#: A factor is remembered up to here, so that cells kept whole can come back.
MOST = 1e6


def rake_bounded(mass: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], start: float,
                 rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Probabilities whose expected margins meet the targets. Expected mass is concave in a factor,
    so a Newton step ends at or below the factor sought, as does the ratio without the bound."""
    a = np.full(len(mass), start, float)
    for _ in range(rounds):
        worst = 0.0
        for category, target in margins:
            of = lambda w: np.bincount(category, weights=w, minlength=len(target))
            now, free, all_ = of(mass * np.minimum(a, 1)), of(np.where(a < 1, mass * a, 0)), of(mass * a)
            off = np.abs(now - target) > 1e-13 * target
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(free > 0, 1 + (target - now) / free, 0.0)
                factor = np.where(off, np.fmax(step, np.where(all_ > 0, target / all_, 0.0)), 1.0)
                worst = max(worst, float(np.where(target > 0, np.abs(now / target - 1), 0.0).max()))
            a = np.minimum(a * factor[category], MOST)
        if worst < tolerance:
            break
    return np.where(a > 1 - 1e-12, 1.0, a)


def _tempered(mass: np.ndarray, temper: float) -> np.ndarray:
    share = np.where(mass > 0, (mass / mass.sum()) ** temper, 0.0)
    return share / share.sum() * mass.sum()


CELL = ["source", "lang", "topic"]


def _raked_here(cells: DataFrame, targets: dict[str, dict[str, float]], share: float) -> DataFrame:
    """CELL, weight and chance of every cell, computed on the driver."""
    rows = cells.orderBy(*CELL).collect()
    mass = np.array([c["mass"] for c in rows], float)
    margins = []
    for margin in CELL:
        names, category = np.unique([c[margin] for c in rows], return_inverse=True)
        if margin in targets:
            wanted = np.array([float(targets[margin].get(n, 0.0)) for n in names])
            if wanted.sum() <= 0:
                raise ValueError(f"no target of {margin} is a category of the corpus")
            wanted = wanted / wanted.sum() * mass.sum()
        else:
            wanted = _tempered(np.bincount(category, weights=mass), TEMPER[margin])
        margins.append((category, wanted))
    ratio = rake(mass, margins) / mass
    held = [np.bincount(category, weights=mass) for category, _ in margins]
    sample = min([share * mass.sum()] + [h[w > 0].sum() for h, (_, w) in zip(held, margins)])
    bounded = []
    for h, (category, wanted) in zip(held, margins):  # min(what there is, the target times one scale)
        scale = calibrate(h, wanted / h, sample)
        bounded.append((category, np.where(wanted > 0, np.minimum(h, scale * np.where(wanted > 0, wanted, 1)), 0.0)))
    chance = rake_bounded(mass, bounded, share)
    table = cells.sparkSession.createDataFrame(
        [(*(c[m] for m in CELL), float(w), float(p)) for c, w, p in zip(rows, ratio, chance)],
        "source string, lang string, topic string, weight double, chance double")
    return F.broadcast(table)  # DRIVER_CELLS rows at most


def _wanted(cells: DataFrame, margin: str, targets: dict[str, dict[str, float]], total: float) -> DataFrame:
    """The target mass of every category of a margin, beside the mass it has."""
    now = cells.groupBy(margin).agg(F.sum("mass").alias("mass"))
    if margin in targets:
        given = cells.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in targets[margin].items()], f"{margin} string, wanted double")
        now = now.join(given, margin, "left").select(margin, "mass", F.coalesce("wanted", F.lit(0.0)).alias("wanted"))
    else:
        now = now.select(margin, "mass", F.pow(F.col("mass") / total, F.lit(TEMPER[margin])).alias("wanted"))
    now = stage(now, "wanted")
    whole = now.agg(F.sum("wanted")).first()[0]
    if whole <= 0:
        raise ValueError(f"no target of {margin} is a category of the corpus")
    return now.withColumn("wanted", F.col("wanted") / whole * total)


def _scale(table: DataFrame, wanted: float) -> float:
    """`calibrate` for a table of mass and weight, by aggregations: cells kept whole only
    become more, so the scale rises to the wanted one."""
    scale, whole = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(scale) >= 1
        count, kept, rest = table.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("mass"))), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(~full, F.col("mass") * F.col("weight"))), F.lit(0.0))).first()
        if count == whole:
            return scale
        if rest <= 0:
            return np.inf
        whole, scale = count, max(scale, (wanted - kept) / rest)


def _bounded_factor() -> Column:
    """The factor of `rake_bounded` from now, free, all and wanted of a category."""
    now, free, all_, wanted = (F.col(c) for c in ("now", "free", "all", "wanted"))
    step = F.when(free > 0, 1 + (wanted - now) / F.when(free > 0, free))
    ratio = F.when(all_ > 0, wanted / F.when(all_ > 0, all_))
    return F.when(F.abs(now - wanted) > 1e-13 * wanted, F.greatest(step, ratio, F.lit(0.0))).otherwise(1.0)


def _raked_wide(cells: DataFrame, targets: dict[str, dict[str, float]], share: float, total: float) -> DataFrame:
    """What `_raked_here` returns, by aggregations: a round is one sum and one join for each margin."""
    wanted = {m: stage(_wanted(cells, m, targets, total), "targets") for m in CELL}
    raked = cells.withColumn("raked", F.col("mass").cast("double"))
    for _ in range(ROUNDS):
        worst = 0.0
        for margin in CELL:
            factors = stage(raked.groupBy(margin).agg(F.sum("raked").alias("now")).join(wanted[margin], margin).select(
                margin, F.when(F.col("now") > 0, F.col("wanted") / F.col("now")).otherwise(1.0).alias("factor")), "factors")
            worst = max(worst, factors.agg(F.max(F.abs(F.col("factor") - 1))).first()[0])
            raked = stage(raked.join(factors, margin).select(
                *CELL, "mass", (F.col("raked") * F.col("factor")).alias("raked")), "raked")
        if worst < TOLERANCE:
            break
    weight = (F.col("raked") / F.col("mass")).alias("weight")
    held = [float(wanted[m].where("wanted > 0").agg(F.sum("mass")).first()[0]) for m in CELL]
    sample, bounded = min([share * total, *held]), {}
    for margin in CELL:
        scale = _scale(wanted[margin].withColumn("weight", F.col("wanted") / F.col("mass")), sample)
        bounded[margin] = wanted[margin].select(margin, F.when(F.col("wanted") > 0, F.least(
            F.col("mass").cast("double"), F.col("wanted") * F.lit(float(min(scale, 1e300))))).otherwise(0.0).alias("wanted"))
    kept = raked.select(*CELL, "mass", weight, F.lit(float(share)).alias("chance"))
    give, p = F.col("mass") * F.col("chance"), F.col("chance")
    for _ in range(ROUNDS):
        worst = 0.0
        for margin in CELL:
            sums = kept.groupBy(margin).agg(
                F.sum(F.least(give, F.col("mass").cast("double"))).alias("now"),
                F.sum(F.when(p < 1, give).otherwise(0.0)).alias("free"), F.sum(give).alias("all"))
            miss = F.when(F.col("wanted") > 0, F.abs(F.col("now") / F.when(F.col("wanted") > 0, F.col("wanted")) - 1)).otherwise(0.0)
            factors = stage(sums.join(bounded[margin], margin).select(
                margin, _bounded_factor().alias("factor"), miss.alias("miss")), "factors")
            worst = max(worst, factors.agg(F.max("miss")).first()[0])
            kept = stage(kept.join(factors, margin).select(
                *CELL, "mass", "weight", F.least(p * F.col("factor"), F.lit(MOST)).alias("chance")), "chances")
        if worst < TOLERANCE:
            break
    return kept.select(*CELL, "weight", F.when(p > 1 - 1e-12, 1.0).otherwise(p).alias("chance"))


def reached(mixed: DataFrame, prefix: str = "mix_") -> DataFrame:
    """What `mix` gives in the mean: margin, category, its tokens, those expected in the sample
    (`kept_tokens`) and its share of the sample; one row a category."""
    tokens, chance = F.col(f"{prefix}tokens"), F.col(f"{prefix}probability")
    names = {"source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
             "lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)), "topic": F.col(f"{prefix}topic").cast("string")}
    cells = stage(mixed.select(*(names[c].alias(c) for c in CELL), tokens.alias("tokens"), (tokens * chance).alias("kept")).groupBy(
        *CELL).agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept")), "reached")
    rows = cells.select(F.inline(F.array(*(F.struct(
        F.lit(m).alias("margin"), F.col(m).alias("category"), F.col("tokens"), F.col("kept")) for m in CELL))))
    sums = rows.groupBy("margin", "category").agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept_tokens"))
    total = cells.agg(F.sum("kept")).first()[0] or 0.0
    return sums.withColumn("share", F.col("kept_tokens") / F.lit(float(total)) if total else F.lit(0.0))


def mix(docs: DataFrame, share: float = SHARE, targets: dict[str, dict[str, float]] | None = None,
        seed: int = SEED, prefix: str = "mix_") -> DataFrame:
    """The documents with tokens, topic, cell, weight, probability and kept beside their columns, each
    under `prefix` and in place of a column of that name.

    `targets`: for `source`, `lang` or `topic` the wanted shares by category, made to sum to
    1 over the categories that occur, of any size; a category left out gets none. A margin
    without targets is tempered by TEMPER.
    """
    rows = tokens_and_topic(docs.drop(*(prefix + c for c in ("cell", "weight", "probability", "kept"))), prefix)
    names = {"source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
             "lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)), "topic": F.col(f"{prefix}topic").cast("string")}
    # One row per source, language and topic leaves the scan.
    cells = stage(rows.select(*(names[c].alias(c) for c in CELL), F.col(f"{prefix}tokens").alias("mass")).groupBy(*CELL).agg(
        F.sum("mass").alias("mass")).where("mass > 0"), "mass")
    count, total = cells.agg(F.count("*"), F.sum("mass")).first()
    name, held, chance, kept = (prefix + c for c in ("cell", "weight", "probability", "kept"))
    out = rows.withColumn(name, F.concat_ws("|", *names.values()))
    if count:
        table = _raked_here(cells, targets or {}, share) if count <= DRIVER_CELLS else _raked_wide(
            cells, targets or {}, share, float(total))
        at = {c: free_name(rows, f"_{c}_at") for c in CELL}
        weight, p = free_name(out, "_weight_of"), free_name(out, "_chance_of")
        table = table.withColumnsRenamed({**at, "weight": weight, "chance": p})
        out = out.withColumns({at[c]: names[c] for c in CELL}).join(table, list(at.values()), "left").withColumns(
            {held: F.col(weight), chance: F.col(p)})
    else:
        out = out.withColumns({held: F.lit(1.0), chance: F.lit(1.0)})
    id_ = F.col("doc_id").cast("long")
    uniform = F.shiftrightunsigned(F.xxhash64(id_, id_.isNull(), F.lit(seed)), 11) / F.lit(float(1 << 53))
    out = out.select(*rows.columns, name, held, chance)
    return out.withColumns({held: F.coalesce(held, F.lit(1.0)), chance: F.coalesce(chance, F.lit(float(min(share, 1.0))))}).withColumn(
        kept, uniform < F.col(chance))
