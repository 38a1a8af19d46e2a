import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import brute
from gaugebook.llm import components, jaccard
from gaugebook.llm.text import flat


def found(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, df.collect()))


def test_sets_match_words():
    texts = ["A b\tC d e f g", "a B c D e F G", "x", "", None, "a b c d e a b c d e", "é b  c"]
    data, offsets = flat(pa.array(texts))
    keys, cuts = jaccard.shingle_sets(data, offsets)
    assert np.diff(cuts).tolist() == [len(brute.shingles(t)) for t in texts]
    assert keys[cuts[0]:cuts[1]].tolist() == keys[cuts[1]:cuts[2]].tolist()


def test_groups_match_all_pairs(make_docs, random_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "RECURS", 1)  # every recurring shingle is ordered by count
    assert found(jaccard.groups(make_docs(random_rows))) == brute.jaccard_groups(random_rows)


@pytest.mark.parametrize("hot, recurs", [(0, 1000), (3, 2)])
def test_shared_passages(make_docs, monkeypatch, hot, recurs):
    """Passages fill a little more or less of texts than links need; few or many texts meet at their shingles."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "RECURS", recurs)
    rng = random.Random(hot)
    passages = [[f"p{k}x{i}" for i in range(70)] for k in range(4)]
    rows = []
    for i in range(160):
        own = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([0, 3, 8, 10, 12, 15, 20, 30, 60]))]
        passage = passages[min(rng.randrange(6), 3)][:rng.choice([40, 60, 65, 70])]
        cut = rng.randrange(len(own) + 1)
        rows.append((i, " ".join(own[:cut] + passage + own[cut:])))
    expected = brute.jaccard_groups(rows)
    assert 5 < len({r[2] for r in expected}) < 150
    assert found(jaccard.groups(make_docs(rows))) == expected


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_no_link_between_components_is_ruled_out(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = np.random.default_rng(7)
    sets, rows = {}, []
    for cls in range(300):
        shared = np.arange(1000, 1000 + rng.integers(20, 90)) + 1000 * rng.integers(0, 3)
        own = rng.integers(0, 900, rng.choice([0, 2, 5, 9, 14, 20, 40]))
        sets[cls] = np.unique(np.concatenate([own, shared]))
        take = int(jaccard.prefix_length(np.array([len(sets[cls])]))[0])
        rows += [(int(t), cls, len(sets[cls]), k, cls % 7 if cls < 50 else cls) for k, t in enumerate(sets[cls][:take])]
    here = spark.createDataFrame(rows, "token long, cls long, size int, pos int, comp long")
    met = {tuple(r) for r in jaccard._across(jaccard._nodes(here)).collect()}
    comp = {r[1]: r[4] for r in rows}
    links = {(a, b) for a in sets for b in range(a + 1, 300) if comp[a] != comp[b] and 100 * len(
        np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert len(links) > 500 and links <= met
    assert len(met) < 20_000 and all(a < b and comp[a] != comp[b] for a, b in met)


def test_odd_rows(make_docs, odd_rows):
    expected = brute.jaccard_groups([r[:2] for r in odd_rows])
    assert found(jaccard.groups(make_docs(odd_rows, clash=True))) == expected


def test_empty(make_docs):
    assert found(jaccard.groups(make_docs([]))) == []


def test_tree_links():
    rng = np.random.default_rng(5)
    own = np.unique(rng.integers(0, 400, 150).astype(np.uint64))
    others = []
    for k in range(200):
        keep = own[rng.random(len(own)) < rng.choice([0.7, 0.85, 0.95, 1])]
        others.append((k, np.unique(np.concatenate([keep, rng.integers(0, 400, rng.integers(0, 40)).astype(np.uint64)]))))
    expected = [k for k, o in others if 100 * len(np.intersect1d(own, o)) >= 75 * len(np.union1d(own, o))]
    assert 0 < len(expected) < 200
    for step in (1, 7, 128):
        assert sorted(jaccard.tree_links(own, others, step)) == expected


def test_components(spark):
    links = [(i, i + 1) for i in range(12)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(13)} | {(i, 100) for i in (100, 101, 102)}


def test_components_merged_with_more_links(spark, monkeypatch):
    """Links between components join them; links inside one, and links gone through before, start no rounds."""
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    first, more = links[:150], links[150:] + [(500, 501), (501, 3)]
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long")
    before = components.components(frame(first))
    assert {tuple(r) for r in components.merged(before, frame(more)).collect()} == {
        tuple(r) for r in components.components(frame(first + more)).collect()}
    seen = []
    mark = components._mark
    monkeypatch.setattr(components, "_mark", lambda edges: seen.append(mark(edges)) or seen[-1])
    inside = [r for r in first if r[0] != r[1]]
    assert {tuple(r) for r in components.merged(before, frame(inside)).collect()} == {tuple(r) for r in before.collect()}
    assert [n for n, _ in seen] == [0]


def test_rows_without_id_are_linked(spark, make_docs):
    base = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(None, base), (None, base + " tail"), (None, other), (5, other + " end"), (None, "quite alone in here"), (6, "so is this one")]
    got = jaccard.groups(make_docs(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [
        (0, 1, 0), (0, 56, 0), (0, 56, 5), (0, 57, 0), (5, 57, 5), (6, 1, 6)]
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, make_docs(rows), "").collect()]
    assert (5, other + " end") in kept and (None, other) not in kept
    assert sum(t.startswith(base) for _, t in kept) == 1 and len(kept) == 4
