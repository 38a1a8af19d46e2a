import random

import numpy as np
import pytest

from tests.llm import brute
from gaugebook.llm import lines


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_band_matches_full_table():
    rng = random.Random(1)
    for _ in range(4000):
        x = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(y))
            y[k:k + rng.randint(0, 1)] = rng.choice(["", "c", "a"])
        y = "".join(y)
        for edits in (1, 2, 3):
            assert lines.within(x, y, edits) == (brute.distance(x, y) <= edits)


def test_near_strings_share_a_key():
    rng = random.Random(2)
    for _ in range(300):
        x = "".join(rng.choice("abcé") for _ in range(rng.randint(34, 60)))
        y = list(x)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(y))
            y[k:k + rng.randint(0, 1)] = rng.choice(["", "z"])
        y = "".join(y)
        short, long = sorted((x, y), key=len)
        got = []
        for text, probe in ((short, False), (long, True)):
            raw = np.frombuffer(text.encode(), np.uint8)
            _, role, key, _, _ = lines.keys(raw, np.zeros(1, np.int64), np.array([len(text)]))
            got.append(set(key[(role > 0) == probe].tolist()))
        assert got[0] & got[1]


def test_sketches_of_near_strings_are_close():
    rng = random.Random(5)
    for _ in range(200):
        x = "".join(rng.choice("abcdé日") for _ in range(60))
        y = list(x)
        for _ in range(2):
            k = rng.randrange(len(y))
            y[k:k + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
        pair = []
        for text in (x, "".join(y)):
            raw = np.frombuffer(text.encode(), np.uint8)
            pair.append(int(lines.sketches(raw, np.array([0]), np.array([len(raw)]))[0]))
        steps = [abs((pair[0] >> 4 * k & 15) - (pair[1] >> 4 * k & 15)) for k in range(16)]
        assert sum(min(s, 16 - s) for s in steps) <= 4


@pytest.mark.parametrize("crowd, levels", [(48, 2), (2, 2), (1, 3)])
def test_dedup_matches_all_pairs(make_docs, monkeypatch, crowd, levels):
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines, "LEVELS", levels)
    rng = random.Random(4)
    stock = ["".join(rng.choice("abcdef é") for _ in range(rng.randint(30, 70))) for _ in range(8)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(stock))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(line))
                line[k:k + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            text.append("".join(line))
        rows.append((i, "\n".join(text)))
    assert texts_of(lines.dedup(make_docs(rows))) == brute.kept_lines(rows)


def test_odd_rows(make_docs, odd_rows):
    unique = [r for r in odd_rows if r[0] not in (7, 13)]
    got = lines.dedup(make_docs(unique, clash=True))
    assert {"line", "key", "n_lines", "n_removed"} <= set(got.columns)
    assert texts_of(got) == brute.kept_lines([r[:2] for r in unique])
    counts = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in got.collect()}
    assert counts[3] == (0, 0) and counts[4] == (1, 0) and counts[2] == (1, 1)


def test_rows_of_one_id_do_not_remove_each_other(make_docs):
    line = "this line is long enough to take part"
    assert [r["text"] for r in lines.dedup(make_docs([(1, line), (1, line), (2, line)])).orderBy("doc_id").collect()] == [line, line, ""]


def test_empty_and_null_id(make_docs):
    line = "this line is long enough to take part"
    assert lines.dedup(make_docs([])).count() == 0
    assert texts_of(lines.dedup(make_docs([(1, line), (None, line)]))) == {None: line, 1: ""}


def test_texts_of_one_id_or_none_lose_only_their_own_lines(make_docs):
    common = "this line stands in many of the documents here"
    own = ["the first of all the lines that stand alone", "quite another one 0123456789 abcdefghijk", "short", "ZYXWVUTSRQPONMLKJIHGFEDCBA 9876543210"]
    rows = [(1, common), (2, f"{common}\n{own[0]}"), (2, f"{own[1]}\n{common}"), (2, f"{own[2]}\n{own[3]}")]
    got = [(r["text"], r["n_removed"]) for r in lines.dedup(make_docs(rows)).collect()]
    assert sorted(got) == sorted([(common, 0), (own[0], 1), (own[1], 1), (f"{own[2]}\n{own[3]}", 0)])
    # Without an id, too; the common line stays once.
    got = [(r["text"], r["n_removed"]) for r in lines.dedup(make_docs([(None, t) for _, t in rows[1:]])).collect()]
    assert sorted(n for _, n in got) == [0, 0, 1]
    assert sorted(x for t, _ in got for x in t.split("\n")) == sorted([common, *own])


def test_short_lines(make_docs):
    """Equal ones go at any length; near ones by the edits that the shorter one allows."""
    rng = random.Random(6)
    stock = ["".join(rng.choice("abcdef é") for _ in range(n)) for n in (1, 2, 5, 15, 16, 17, 20, 24, 31, 32, 33)]
    rows = []
    for i in range(70):
        text = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(stock))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(line) + 1)
                line[k:k + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            text.append("".join(line))
        rows.append((i, "\n".join(text)))
    spots = [(d, i, x) for d, t in rows for i, x in enumerate(t.split("\n")) if x]
    first = {}
    for d, i, x in spots:
        first.setdefault(x, (d, i))
    names = list(first)
    gone = {max(x, y, key=first.get) for k, x in enumerate(names) for y in names[:k]
            if brute.distance(x, y) <= min(2, min(len(x), len(y)) // 16)}
    assert any(16 <= len(x) < 32 for x in gone)
    expected = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if not x or first[x] == (d, i) and x not in gone)
                for d, t in rows}
    for crowd in (48, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(lines, "CROWD", crowd)
            assert texts_of(lines.dedup(make_docs(rows))) == expected
    assert texts_of(lines.dedup(make_docs(rows), least=32)) == brute.kept_lines(rows, least=32)


def test_lines_are_found_once_and_only_crowds_have_sketches(make_docs, monkeypatch):
    found = []
    occurrences = lines._occurrences
    monkeypatch.setattr(lines, "_occurrences", lambda *a: found.append(occurrences(*a)) or found[-1])
    monkeypatch.setattr(lines, "CROWD", 1)
    rows = [(i, f"this line is long enough to take part {i % 7}") for i in range(30)]
    assert texts_of(lines.dedup(make_docs(rows))) == brute.kept_lines(rows)
    assert [f.columns for f in found] == [["line", "check", "doc_id", "mark", "number"]]


def test_members_of_a_key_need_no_order(spark):
    rows = [(1, 7, 5), (1, 9, 4), (1, 7, 5), (1, 9, 4), (2, 7, 5), (3, 9, 4)]
    met = lines._meet(spark.createDataFrame(rows, "key long, line long, entry byte"), False)
    assert [tuple(r)[:3] for r in met.collect()] == [(1, 7, 9)]
    sort = next(x for x in met._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Sort [" in x)
    assert "key#" in sort and "line#" not in sort and "entry#" not in sort


def test_an_index_entry_and_its_own_probe_are_one_row(make_docs):
    """A line that meets no other has its keys to itself."""
    text = "".join(chr(0x4e00 + i) for i in range(40))
    rows = lines._key_rows(make_docs([(1, text)]).selectExpr("doc_id", "doc_id AS mark", "text"), 1).collect()
    assert len({r["key"] for r in rows}) == len(rows) > 3
    assert sum(r["entry"] & lines.BOTH > 0 for r in rows) == lines.EDITS + 1
