import random
import zlib

import pytest

from gaugebook.llm import language, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"
BAD, FAIR = ["idiotic", "moronish", "scumbag"], ["scumbaggery"]


@pytest.fixture(scope="module")
def corpus(spark, make_docs):
    """Texts in two alphabets; noise marks low quality, insults mark toxicity."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        lang = rng.choice(["aa", "bb"])
        letters = "abcdefg" if lang == "aa" else "nopqrstu"
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(30, 90))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        elif rng.random() < 0.3:
            words.insert(3, rng.choice(FAIR))
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), lang))
        labels.append((i, good, toxic))
    return make_docs(rows, clash=True), spark.createDataFrame(labels, LABELS)


def accuracy(got, truth, held_out):
    rows = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] == held_out]
    return sum(a == b for a, b in rows) / len(rows)


def split(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


@pytest.mark.parametrize("operator, column, modulus, remainder", [(quality, 1, 5, 0), (toxicity, 2, 3, 1)])
def test_held_out_accuracy(corpus, operator, column, modulus, remainder):
    docs, labels = corpus
    got = operator.classify(docs, labels).collect()
    truth = {r[0]: r[column] for r in labels.collect()}
    assert len(got) == 400 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == split(r["doc_id"], modulus, remainder) for r in got)
    assert accuracy(got, truth, True) > 0.95


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_held_out_labels_are_not_read(spark, corpus, operator):
    docs, labels = corpus
    modulus, remainder, column = (5, 0, "quality") if operator is quality else (3, 1, "toxic")
    flipped = spark.createDataFrame(
        [(i, *(1 - x if split(i, modulus, remainder) else x for x in rest)) for i, *rest in labels.collect()], LABELS)
    scores = [{r["doc_id"]: r["score"] for r in operator.classify(docs, x).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1], column


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_rows_and_labels(spark, make_docs, odd_rows, operator):
    docs = make_docs(odd_rows, clash=True)
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, None, None), (2, 1, 1), (2, 0, 0), (None, 1, 1), (999, 1, 0), (6, 1, 0), (8, 0, 1)], LABELS)
    for labels in (none, odd):
        got = operator.classify(docs, labels).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in odd_rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert operator.classify(make_docs([]), odd).count() == 0


def test_folding():
    folded = toxicity.fold("Ìd1οT, ꮪ​ sсum№")
    assert folded.startswith(" idiot ") and " scum" in folded


def test_exceptions_cancel_hits():
    lexicon = toxicity.Lexicon({" scum": 2.0, " moron ": 1.0}, [" scumbag fair "])
    automaton = lexicon.automaton()
    assert lexicon.sums(automaton, " a scumbag fair moron ") == (1.0, 4)
    assert lexicon.sums(automaton, " scumbags moronic ") == (2.0, 2)


def test_languages(corpus):
    docs, _ = corpus
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert held == [i for i in got if split(i, 4, 2)]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) > 0.95 * len(held)


def test_languages_of_odd_rows(make_docs, odd_rows):
    got = language.identify(make_docs(odd_rows, clash=True)).collect()
    texts = dict(r[:2] for r in odd_rows)
    for r in got:
        silent = not any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == silent and 0 <= r["score"] <= 1
    nothing = language.identify(make_docs([(1, "some text", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    assert language.identify(make_docs([])).count() == 0


def test_letters_of_higher_planes_are_folded():
    bold, script, double, square = (lambda w, at=at: "".join(chr(at + ord(c) - 97) for c in w) for at in (0x1D41A, 0x1D4EA, 0x1D552, 0x1F130))
    assert [toxicity.fold(f(w)) for f, w in ((bold, "rotten"), (script, "rotten"), (double, "rotten"), (square, "rotten"))] == [" rotten "] * 4
    assert toxicity.fold("a\U0001f600b\U000e0061c \U00020000") == " a bc \U00020000 "
    lexicon = toxicity.Lexicon({" rotten ": 2.0})
    assert lexicon.sums(lexicon.automaton(), toxicity.fold(f"so {bold('Rotten'.lower())} it is"))[0] == 2.0


def test_entries_are_words_not_their_beginnings():
    """" path" starts a toxic word and harmless ones; " moro" starts only toxic ones."""
    counted = [(" path", 41, 9), (" pathe", 40, 0), (" pathetic ", 40, 0), (" pathway ", 1, 6),
               (" moro", 30, 0), (" moron ", 18, 0), (" morons ", 12, 0)]
    weights, _ = toxicity.learn_entries(counted, 200, 2000)
    assert set(weights) == {" pathetic ", " moro"}


def test_a_beginning_gives_way_to_entries_only():
    """" bori" owes its odds to many words; of those, " boringly " is a harmless one, and the
    longest. As an entry it had a negative weight, and sums below -1 had no score."""
    counted = [(" bori", 500, 9), (" boring ", 60, 0), (" boringly ", 5, 8), (" bloc", 150, 2),
               (" block ", 20, 0), (" blocker ", 5, 0), (" ererst ", 6, 0)]
    weights, _ = toxicity.learn_entries(counted, 1000, 1000)
    assert set(weights) == {" bori", " bloc"} and min(weights.values()) > 0
    assert 0 <= toxicity.Lexicon({" ill ": -2.0}, model=(0.0, 1.0, 1.0)).score(-4.0, 1) <= 1


def test_contradicting_labels_teach_nothing(spark, make_docs):
    rows = [(i, "rotten scum here " * 3 if i < 30 else "fair words here " * 3, "en", "a") for i in range(60)]
    said = [(i, 1, int(i < 30)) for i in range(60)]
    both = said + [(i, 1, 1 - t) for i, _, t in said]
    labels = spark.createDataFrame(both, LABELS)
    assert all(r["score"] < 0.7 for r in toxicity.classify(make_docs(rows), labels).collect())
    taught = toxicity.classify(make_docs(rows), spark.createDataFrame(said, LABELS)).collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] < 30) for r in taught)
