import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, text_hash string, node string, keys string"


def rows(seed=3):
    """Documents with nulls, blanks, ties, copies, near copies, shared passages and one very long text; clashing extra columns."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkléß") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(60), text(120)
    near = base.split()
    near[60] = "CHANGED"
    texts = [None, "", "  \n\t ", "one", text(4), base, base, base, " ".join(near), f"{text(30)} {passage} {text(20)}", f"{text(5)}\n{passage}", passage + " " + passage, text(3000), "a " * 400, text(34), text(35), "Ünï ’s don't “x” 12,5 don't 'start  y"]
    out = [(i, t, "en", f"src{i % 3}" if i % 7 else None, 0, "w", "h", "n", "k") for i, t in enumerate(texts)]
    return [*out, out[9], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
