import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugebook.llm import alignment
from gaugebook.llm.alignment import SPACE_SIGN, WHITE

TRICKY = ["a", " ", "  ", "\n", "\n\n", "a\nb", "a\n\nb", "a \n", "\na", "a\n b", "a\t\tb\n", "x\x1cy !\x1cz", "a\x00b", "don't 't 's", "é²3 ³x", "日本 語　x",
          " x y   z", "<s> hello</s> <|endoftext|> x<|endoftext|>", "<unk>", "a" * 300, "🙂🙂 \U0001d400", "a b", "\r\nx\r\n", "v" + SPACE_SIGN, "<0x41>",
          "  lead", "trail  ", " a  b   c    d", "́x", "ﬁ ＡＢ"]


@pytest.fixture(scope="module")
def known():
    return alignment.Aligner(*alignment.default_vocabularies())


def whole(known, text):
    """Tokens and groups of a text that is encoded as a whole: (ids a, ids b) of each group, or None."""
    if not text:
        return None
    raw = (" " + text).encode()
    ia, ib = known.a.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text)
    if b"".join(known.bytes_a[i] for i in ia) != raw or b"".join(known.bytes_b[i] for i in ib) != raw:
        return None
    ea, eb = alignment._ends([known.bytes_a[i] for i in ia]), alignment._ends([known.bytes_b[i] for i in ib])
    shared, out = set(ea) & set(eb), []
    sides = [[[]], [[]]]
    for side, ids, ends in ((0, ia, ea), (1, ib, eb)):
        for token, end in zip(ids, ends):
            sides[side][-1].append(token)
            if end in shared:
                sides[side].append([])
    return list(zip(sides[0][:-1], sides[1][:-1]))


def brute(known, rows):
    aligned = [whole(known, text) for _, text, *_ in rows]
    count = Counter()
    for groups in aligned:
        count.update({(a, b) for ga, gb in groups or [] for a in ga for b in gb})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, *_), groups in zip(rows, aligned):
        links = [(a, b) for ga, gb in groups or [] for a in ga for b in gb]
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups or [])
        out.append((doc_id, sum(len(ga) for ga, _ in groups or []), sum(len(gb) for _, gb in groups or []), len(groups or []), len(links),
                    sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_cuts_are_the_shared_ends():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 60)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(0, n - 1)), n}) for _ in range(2))
        shared = sorted(set(a) & set(b))
        assert alignment.cuts(a, b) == [(a.index(c) + 1, b.index(c) + 1) for c in shared]


def test_all_cuts_are_the_cuts_of_each():
    rng = np.random.default_rng(3)
    a, b, upto_a, upto_b, expected, start = [], [], [], [], [], 0
    for _ in range(300):
        n = int(rng.integers(1, 25))
        ends = [sorted({*rng.integers(1, n + 1, rng.integers(0, n + 1)).tolist(), n}) for _ in range(2)]
        expected += [(len(a) + x, len(b) + y) for x, y in alignment.cuts(*ends)]
        a += [start + e for e in ends[0]]
        b += [start + e for e in ends[1]]
        start += n
        upto_a.append(len(a))
        upto_b.append(len(b))
    got = alignment.all_cuts(*(np.array(x) for x in (a, b, upto_a, upto_b)))
    assert list(zip(*(g.tolist() for g in got))) == expected


def test_units_are_encoded_as_in_the_text(known, random_rows):
    """Tokens of units, joined, are the tokens of the text, whatever its white space."""
    rng = random.Random(2)
    alphabet = "ab'é!1 \n\t\r 　日\x1c🙂" + SPACE_SIGN
    texts = TRICKY + [t for _, t in random_rows[:30]] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    assert known.divisible
    for text in texts:
        groups = whole(known, text)
        (units,), _ = known.rows([text])
        got = b";".join(known.text[u] for u in units).decode()
        assert got == ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups or []), repr(text)


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_matches_brute_force(make_docs, odd_rows, random_rows, known, frequent):
    rows = odd_rows + random_rows + [(1000 + i, t) for i, t in enumerate(TRICKY)] + [(None, "a b"), (None, "a c"), (None, None)]
    got = alignment.align(make_docs(rows, clash=True), frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(known, rows)


def test_small_stores(make_docs, random_rows, known, monkeypatch):
    """Workers that forget units and hand on counts early give the same."""
    rows = random_rows[:40]
    known.rows([t for _, t in rows])
    monkeypatch.setattr(alignment, "CACHE_UNITS", 50)
    small = alignment.Aligner(*alignment.default_vocabularies())
    for _, text in rows:
        (units,), _ = small.rows([text])
        (others,), _ = known.rows([text])
        assert [small.text[u] for u in units] == [known.text[u] for u in others]


def test_white_space_of_the_pattern(known):
    """The fixed list of white space is what A's pattern splits at."""
    import re

    listed = re.compile(f"[{WHITE}]")
    for code in [*range(0x250), *range(0x1680, 0x1681), *range(0x2000, 0x2070), 0x3000, 0xfeff]:
        words = known.a.pre_tokenizer.pre_tokenize_str("!" + chr(code) + "!")
        assert (len(words) > 1) == bool(listed.match(chr(code))) or chr(code).isalnum() or len(words) == 3 or words[0][1] == (0, 1), hex(code)


def test_empty(make_docs):
    assert alignment.align(make_docs([])).count() == 0
    row = alignment.align(make_docs([(1, None), (2, "")])).collect()
    assert sorted(map(tuple, row)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_texts_are_aligned_once(spark, make_docs):
    """What a text is cut into is kept, not found again once the pairs are counted."""
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    rows = [(i, f"word{i} and others") for i in range(30)]
    got = alignment.align(make_docs(rows).withColumn("text", told.asNondeterministic()("text")))
    assert got.count() == 30 and read.value == 30
