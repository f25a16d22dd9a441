import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use too."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = some(70), some(5000)
    texts = [None, "", " ", "\n\n", "a", "one two three", passage, passage, passage + " " + some(5), some(30) + " " + passage, some(80) + "\n" + passage + "\n" + some(10), long, long, "é ü 漢字 😀 " + some(60), "ab " * 300, "x" * 700, some(13), "<|endoftext|> " + some(8), "A B c D", "a b C d"]
    texts += [some(rng.randrange(0, 90)) for _ in range(40)]
    base = some(60).split()
    for _ in range(25):
        w = list(base)
        w[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(w))
    rows = [(None if i == 4 else i, t, "en", ["s1", "s1", None, "s2"][i % 4], len(t or ""), "k", 0.5) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (3, "another text of the same id", "en", "s3", 5, "k", 0.1), (None, "null id", "en", None, 3, "k", 0.2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
