import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugebook.llm import mixing
from tests.llm import brute


def test_raking_meets_margins():
    rng = np.random.default_rng(2)
    mass = rng.random(24)
    margins = [(np.arange(24) // 6, rng.random(4)), (np.arange(24) % 6, rng.random(6))]
    margins = [(c, t / t.sum()) for c, t in margins]
    out = mixing.rake(mass, margins)
    for category, target in margins:
        assert np.allclose(np.bincount(category, weights=out), target)
    # The odds between cells stay what they were.
    ratio = (out / mass).reshape(4, 6)
    assert np.allclose(ratio[0, 0] * ratio[1, 1], ratio[0, 1] * ratio[1, 0])


def test_scale_keeps_the_wanted_mass():
    rng = np.random.default_rng(3)
    mass, weight = rng.random(50), rng.random(50) * 5
    for wanted in (0.1, 0.5, 0.99):
        scale = mixing.calibrate(mass, weight, wanted * mass.sum())
        assert np.isclose((mass * np.minimum(1, scale * weight)).sum(), wanted * mass.sum())


def test_weights_follow_targets(make_docs):
    rows = [(i, f"word{i} " * 20, "en" if i % 3 else "fr", "a" if i % 4 else "b") for i in range(400)]
    got = mixing.mix(make_docs(rows), share=0.5, targets={"source": {"a": 0.4, "b": 0.6}, "lang": {"en": 0.5, "fr": 0.5}}).collect()
    expected = [{"source": r["source"], "lang": r["lang"], "w": r["mix_tokens"] * r["mix_weight"]} for r in got]
    assert brute.shares(expected, "source", "w") == pytest.approx({"a": 0.4, "b": 0.6}, abs=1e-6)
    assert brute.shares(expected, "lang", "w") == pytest.approx({"en": 0.5, "fr": 0.5}, abs=1e-6)
    assert sum(r["mix_tokens"] * r["mix_probability"] for r in got) == pytest.approx(0.5 * sum(r["mix_tokens"] for r in got))


def test_bounded_raking_meets_margins():
    """Where the scaled weights of some cells pass 1, the margins of the sample still hold."""
    rng = np.random.default_rng(9)
    mass = rng.random(24) + 0.1
    margins = [np.arange(24) // 6, np.arange(24) % 6]
    p = np.minimum(1, (rng.random(4) + 0.3)[margins[0]] * (rng.random(6) + 0.4)[margins[1]])  # the one solution of this form
    bounded = [(c, np.bincount(c, weights=mass * p)) for c in margins]
    got = mixing.rake_bounded(mass, bounded, 0.8)
    assert (p == 1).sum() > 2 and np.allclose(got, p, rtol=1e-6)
    for category, target in bounded:
        assert np.allclose(np.bincount(category, weights=mass * got), target, rtol=1e-7)


@pytest.mark.parametrize("cells", [50_000, 0])
def test_the_sample_meets_its_targets(make_docs, monkeypatch, cells):
    """Probabilities, not only weights: `b` has less than its target and is kept whole, `a` and `c` share the rest."""
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    monkeypatch.setattr(mixing, "TEMPER", {"source": 1.0, "lang": 1.0, "topic": 1.0})
    monkeypatch.setattr(mixing, "TOPICS", 1)
    rows = [(i, f"word{i} " * 20, "en", "abc"[min(i % 10, 2) if i % 10 < 2 else 2 * (i % 2)]) for i in range(400)]
    got = mixing.mix(make_docs(rows), share=0.8, targets={"source": {"a": 0.3, "b": 0.5, "c": 0.2}})
    held = brute.shares([{"source": r[3], "w": 1} for r in rows], "source", "w")
    rest = 0.8 - held["b"]
    want = {"a": rest * 0.6, "b": held["b"], "c": rest * 0.4}
    assert max(want[k] / held[k] for k in "ac") < 1 and held["b"] < 0.4
    found = {r["category"]: r for r in mixing.reached(got).where("margin = 'source'").collect()}
    assert {k: r["share"] * 0.8 for k, r in found.items()} == pytest.approx(want, rel=1e-6)
    assert all(r["mix_probability"] == 1 for r in got.where("source = 'b'").collect())


def test_a_null_id_is_no_other_id(make_docs):
    rows = [(None, f"word{i} " * 5, "en", "a") for i in range(5)] + [(-1, "word " * 5, "en", "a")]
    fates = set()
    for seed in range(12):
        got = mixing.mix(make_docs(rows), share=0.5, seed=seed).collect()
        assert len({r["mix_kept"] for r in got if r["doc_id"] is None}) == 1
        fates |= {(r["doc_id"], r["mix_kept"], seed) for r in got}
    assert any((None, k, s) in fates and (-1, not k, s) in fates for k in (True, False) for s in range(12))


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    got = mixing.mix(docs, prefix="_m_")
    assert got.columns[:len(docs.columns)] == docs.columns
    rows = got.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["_m_probability"] <= 1 for r in rows)
    assert mixing.mix(make_docs([])).count() == 0
    assert all(r["mix_kept"] for r in mixing.mix(make_docs(odd_rows), share=1.0).collect())


def test_stages_one_by_one(spark, make_docs, odd_rows, random_rows, tmp_path):
    """Each stage against its own input; the folder holds labels for some documents."""
    rows = [(1000 + d, t) for d, t in random_rows] + [r for r in odd_rows if r[0] not in (7, 13)]
    docs = make_docs(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + i, int(i % 7 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]
    for name in ("quality", "line_dedup", "near_duplicates", "mixing"):
        assert stages[name](spark, docs, str(tmp_path)).columns == docs.columns
    first = {d: c for d, _, c in brute.jaccard_groups([r[:2] for r in rows])}
    kept = {r[0] for r in stages["near_duplicates"](spark, docs, "").select("doc_id").collect()}
    assert kept == {d for d, c in first.items() if d == c}
    lines = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, docs, "").collect()}
    expected = brute.kept_lines([r[:2] for r in rows])
    texts = dict(r[:2] for r in rows)
    assert lines == {d: t for d, t in expected.items() if t != "" or not texts[d]}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.countDistinct("doc_id")).first()[0] > 0
    empty = make_docs([])
    assert all(stages[n](spark, empty, str(tmp_path)).count() == 0 for n in stages)


@pytest.mark.parametrize("cells", [50_000, 0])
def test_rare_sources_have_margins_of_their_own(make_docs, monkeypatch, cells):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)  # 0: raked by aggregations
    rows = [(i, "hot words in here " * 300, "en", "hot") for i in range(20)]
    rows += [(100 + i, "some tail words " * (i % 3 + 2), "en", f"tail{i % 5}") for i in range(15)]
    docs = make_docs(rows)

    def weighed(got):
        return brute.shares([{"source": r["source"], "w": r["mix_tokens"] * r["mix_weight"]} for r in got], "source", "w")

    got = mixing.mix(docs).collect()
    actual = brute.shares([{"source": r["source"], "w": r["mix_tokens"]} for r in got], "source", "w")
    assert max(v for k, v in actual.items() if k != "hot") < 0.005
    tempered = {k: v ** mixing.TEMPER["source"] for k, v in actual.items()}
    assert weighed(got) == pytest.approx({k: v / sum(tempered.values()) for k, v in tempered.items()}, rel=1e-6)
    assert sum(r["mix_tokens"] * r["mix_probability"] for r in got) == pytest.approx(0.8 * sum(r["mix_tokens"] for r in got))
    given = {"hot": 0.5, **{f"tail{k}": 0.1 for k in range(5)}}
    got = mixing.mix(docs, targets={"source": given}).collect()
    assert weighed(got) == pytest.approx(given, rel=1e-6) and all(r["mix_probability"] > 0 for r in got)
