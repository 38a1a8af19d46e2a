import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugebook.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = []
    for i, q in good:
        if i % 10:
            continue
        near = sorted((float(np.sqrt(((q - c) ** 2).sum())), j) for j, c in good if j != i and len(c) == len(q))[:k]
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("tile, query_tile", [(4096, 512), (16, 3)])
def test_matches_brute_force(spark, tile, query_tile):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 8)).astype(np.float32)
    base[20:40] = base[0]  # ties
    base[40] *= 1e4
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(200, None), (210, [0.0] * 8), (220, [1.0] * 7 + [None]), (230, [float("nan")] + [1.0] * 7),
             (240, [float("inf")] + [1.0] * 7), (250, [1.0, 2.0, 3.0]), (260, [1.0, 2.0, 4.0]), (270, [5.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).withColumn("tile", F.lit("x")).withColumn("dim", F.lit("x"))
    got = neighbours.nearest(df, F.pmod("vec_id", F.lit(10)) == 0, 5, tile, query_tile)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got, expected = sorted(map(tuple, got.collect())), brute(rows, 5)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert np.allclose([g[3] for g in got], [e[3] for e in expected], rtol=1e-12, atol=0)


def test_empty(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") >= 0).count() == 0
