import random

import pytest

CLASHING = "doc_id long, text string, _id long, _text string, keep_id long, n int, _h1 string, set_id string, bucket string, score string"


def corpus(seed: int = 1, n: int = 60):
    """Texts with exact and near copies, shared passages, and the odd cases."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        if i % 4 == 0:
            t[len(t) // 2 : len(t) // 2] = passage.split()
        if i % 5 == 0 and texts:
            t = rng.choice(texts).split() or ["x"]
            if i % 10 == 0:
                t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += ["", " \t\n", None, "one two", "One  two", "one two three four five", "Ünïcode ΣΑΣ İ <|endoftext|> x", "a" * 5000, ("long " + passage + " ") * 60, texts[0], texts[0].upper()]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "y", 2, 3, "z", "w", "b", "s") for i, t in rows], CLASHING)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and repeated rows."""
    return spark.createDataFrame([(None, "same text"), (5, "same text"), (5, "same text"), (2, None), (None, None), (7, "")], "doc_id long, text string")
