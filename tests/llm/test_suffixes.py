import random

import numpy as np
import pytest

from gaugebook.llm import suffixes
from tests.llm import brute


def found(df):
    return sorted((r["doc_id"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in df.collect())


def test_units_cover_every_start_once():
    rng = np.random.default_rng(1)
    for text in (rng.integers(97, 99, 700), np.full(900, 97), np.tile(rng.integers(97, 123, 9), 80)):
        data = text.astype(np.uint8)
        for gram in (20, 37, 40):
            start, count, core, _ = suffixes.units(data, gram, 40)
            assert start[0] == 0 and (start[1:] == start[:-1] + count[:-1]).all() and start[-1] + count[-1] == len(data) - 39
            # Equal strings are in buckets of one name.
            name = np.repeat(core, count)
            strings = {}
            for p in range(len(name)):
                assert strings.setdefault(data[p:p + 40].tobytes(), name[p]) == name[p]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_counting_every_string(make_docs, seed):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcd é") for _ in range(rng.randint(20, 160))) for _ in range(6)]
    rows = [(i, "".join(rng.choice([rng.choice(stock), "".join(rng.choice("xyz") for _ in range(rng.randint(1, 90))), "ab" * rng.randint(1, 60)])
                        for _ in range(rng.randint(0, 4)))) for i in range(40)]
    got = found(suffixes.without_repeats(make_docs(rows), length=40, grams=(20, 37, 40)))
    assert got == sorted(brute.byte_spans(rows, 40))


def test_odd_rows_at_full_length(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] != 10] + [(21, "z" * 700), (22, "y" * 200), (22, "y" * 200), (23, "w" * 199), (24, "w" * 199)]
    got = found(suffixes.without_repeats(make_docs(rows, clash=True)))
    assert got == sorted(brute.byte_spans([r[:2] for r in rows], 200))


def test_empty(make_docs):
    assert found(suffixes.without_repeats(make_docs([]))) == []
