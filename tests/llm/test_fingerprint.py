import hashlib

import pytest

from gaugebook.llm import fingerprint


def test_likeness_bounds(random_rows):
    texts = [t for _, t in random_rows] + ["", "a", "ab"]
    prints = fingerprint.digests_of(texts)
    assert prints == [fingerprint.digest(t) for t in texts]  # slices do not run into each other
    for a, b in zip(prints, prints[1:]):
        assert 0 <= fingerprint.likeness(a, b) <= 1 and fingerprint.likeness(a, a) == 1
        assert fingerprint.likeness(a, b) == fingerprint.likeness(b, a)


@pytest.mark.parametrize("partitions", [1, 5])
def test_edited_pairs(make_docs, odd_rows, partitions):
    rows = [r for r in odd_rows if r[0] not in (7, 13)] + [(-5, "first")]
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(make_docs(rows, clash=True, partitions=partitions)).collect()}
    ordered = sorted((r[0], r[1] or "") for r in rows)
    assert sorted(got) == [d for d, _ in ordered]
    for (d, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        take = len(text) // 4
        edited = text[:len(text) - take] + following[:take]
        assert got[d]["n_chars"] == len(text)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["fingerprint"] == fingerprint.digest(text)
        assert got[d]["near_edited"] == fingerprint.likeness(fingerprint.digest(text), fingerprint.digest(edited))
        assert got[d]["near_next"] == fingerprint.likeness(fingerprint.digest(text), fingerprint.digest(following))


def test_edits_are_nearer_than_other_texts(make_docs, random_rows):
    long = [(d, t) for d, t in random_rows if len(t) > 200]
    rows = fingerprint.edited_pairs(make_docs(long)).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.95 * len(rows)


def test_repeated_ids_null_ids_and_empty(make_docs):
    assert fingerprint.edited_pairs(make_docs([])).count() == 0
    got = fingerprint.edited_pairs(make_docs([(1, "aaaa"), (1, "aaaa"), (1, "bbbb"), (2, "cccc"), (None, "x")])).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 1, 2]
    alone = fingerprint.edited_pairs(make_docs([(4, "abcdefgh")])).collect()
    assert [r["edited_sha256"] for r in alone] == [hashlib.sha256(b"abcdefab").hexdigest()]
