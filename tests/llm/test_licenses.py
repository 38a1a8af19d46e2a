import random
import re

import pytest
from pyspark.sql import functions as F

from gaugebook.llm import licenses
from gaugebook.llm.licenses import CELL, TEMPLATES, Template


def brute(text, templates=TEMPLATES):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts, base, labels, score = [], set(), set(), 0.0
    for t in templates:
        if t.phrase:
            at = [p for p in range(len(ws)) if ws[p:p + len(t.words)] == t.words]
            starts += at
            if at:
                base.add(t.label)
                labels.add(t.label)
                score = 1.0
        else:
            cells = -(-len(ws) // CELL)
            for b in range(max(cells - 1, 1)):
                shared = len(set(ws[b * CELL:(b + 2) * CELL]) & set(t.words))
                if shared >= t.need:
                    labels.add(t.label)
                    score = max(score, shared / len(set(t.words)))
    return (len(ws), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


def texts():
    rng = random.Random(5)
    common = "the license under of by this and permission software version work".split()
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 12)):
            kind = rng.random()
            if kind < 0.5:
                parts.append(" ".join(rng.choice(common + ["zeta%d" % rng.randint(0, 30)]) for _ in range(rng.randint(1, 90))))
            else:
                words = rng.choice(TEMPLATES).text.split()
                if rng.random() < 0.5:
                    for _ in range(rng.randint(1, 3)):
                        words[rng.randrange(len(words))] = rng.choice(["", "other", words[0].upper()])
                parts.append(rng.choice([" ", "\n", ", "]).join(words))
        out.append(rng.choice(["\n", " ", "... "]).join(parts))
    return out


EDGES = ["MIT License", "mit\nlicense mit license", "mit licenses", "the-mit-license!", "MİT License", "the apache licenKse apache", "released under K worK is", "ccby cc by",
         "GNU general PUBLIC\tlicense", " ".join(["w"] * (CELL - 1)) + " mit license", " ".join(["w"] * (2 * CELL - 1)) + " mit license",
         " ".join(["w"] * (3 * CELL)) + " apache license", "cc by " * 200, "É" + "x" * 50 + " cc by É"]


def test_matches_brute_force(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts() + EDGES)] + [(None, "mit license"), (None, "cc by"), (None, None)]
    got = licenses.scan(make_docs(rows, clash=True))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    expected = sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == expected


def test_pruned_pairs_are_whole(spark, make_docs):
    """Every pair over the threshold is found, at several thresholds, by its exact overlap."""
    templates = tuple(Template(str(k), t.text, s) for k, (t, s) in enumerate(
        (t, s) for t in licenses.NOTICES for s in (0.3, 0.55, 0.9)))
    docs = make_docs([(i, t) for i, t in enumerate(texts())])
    order = licenses.global_order(docs, templates)
    found = licenses.candidates(docs, templates, order)
    got = {(r.doc_id, r.block, r.template, r.shared) for r in licenses.matches(found, templates, order).join(
        found.select("row", "doc_id"), "row").collect()}
    expected = set()
    for i, text in enumerate(texts()):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        for b in range(max(-(-len(ws) // CELL) - 1, 1)):
            for k, t in enumerate(templates):
                shared = len(set(ws[b * CELL:(b + 2) * CELL]) & set(t.words))
                if shared >= t.need:
                    expected.add((i, b, k, shared))
    assert got == expected and len(got) > 100


def test_templates_are_checked(make_docs):
    with pytest.raises(ValueError):
        licenses.scan(make_docs([]), (Template("x", "w " * (CELL + 1)),))
    with pytest.raises(ValueError):
        licenses.scan(make_docs([]), (Template("x", "a b", 0.5, True),))


def test_empty(make_docs):
    assert licenses.scan(make_docs([])).count() == 0
    assert licenses.scan(make_docs([(1, "mit license")]).withColumn("text", F.lit(None).cast("string"))).first().n_words == 0
