import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside, next to those of `documents`.
CLASH = ["line", "key", "cls", "n", "token", "mark", "length", "label", "start", "score", "piece", "rank", "comp",
         "cell", "weight", "kept", "v", "u", "salt", "number", "check", "part", "extra", "_id"]


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def words(rng, n, alphabet="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents of (doc_id, text[, lang[, source]]) rows, with clashing extra columns if asked."""
    def make(rows, clash=False, partitions=3):
        df = spark.createDataFrame([row(*r) for r in rows], SCHEMA).repartition(partitions)
        return df.selectExpr("*", *(f"'x' AS {c}" for c in CLASH)) if clash else df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null columns, repeated rows and ids, ties, a long text."""
    rng = random.Random(3)
    base = words(rng, 60)
    rows = [(1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (7, "one two"),
            (8, base + " tail"), (9, "\n".join([base, base, "short"])), (10, words(rng, 30000)), (11, "x"),
            (12, "naïve café 日本 \U0001f600 " * 20), (13, base, None, None), (13, words(rng, 40), "fr", "s1"), (14, "ab " * 300)]
    return rows


@pytest.fixture(scope="session")
def random_rows():
    """Texts that share passages, lines and near copies in many ways."""
    rng = random.Random(11)
    lines = [words(rng, rng.randint(4, 14)) for _ in range(12)]
    rows, texts = [], []
    for i in range(120):
        kind = rng.random()
        if kind < 0.35 and texts:
            parts = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(parts))
                parts[k] = rng.choice([words(rng, 1), parts[k][:-1], parts[k] + "q", ""])
            text = " ".join(parts)
        else:
            text = "\n".join(rng.choice([words(rng, rng.randint(3, 40)), rng.choice(lines)]) for _ in range(rng.randint(1, 5)))
        texts.append(text)
        rows.append((i, text))
    return rows
