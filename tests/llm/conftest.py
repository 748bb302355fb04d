import random

import pytest

ROW = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
WORDS = "the of and river stone light winter garden paper window morning silver letter market yellow bridge".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) * (rng.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """A small table with copies, near copies, shared passages, nulls, blanks, repeated ids and clashing extra columns."""
    rng = random.Random(5)
    shared, base = prose(rng, 60), prose(rng, 80)
    texts = [prose(rng, rng.randint(0, 120)) for _ in range(40)]
    texts += [f"{prose(rng, 30)}\n{shared}\n{prose(rng, 20)}" for _ in range(6)]
    texts += [base] * 4
    for _ in range(8):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, None, "", " \n\t ", "one two", "One TWO", "a b c d e", "a b c d e f", "x" * 500, "y " * 3000, "Caffè 🙂 " * 40, "🙂" * 90]
    rows = [(i, t, rng.choice(["en", "fr", None]), f"src{i % 3}" if i % 11 else None, len(t or ""), 0.1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ROW)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ROW)
