import re

import pytest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, extra string, key long"


def words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW) if lower else text)


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, repeats inside a text, ties, null, empty, one word, one very long text."""
    import random

    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéßX ") for _ in range(rng.randint(1, 7))).strip() or "z" for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, out = text(150), []
    base = text(120).split(" ")
    for i in range(24):
        near = base[:]
        near[rng.randrange(len(near))] = f"edit{i}"
        out.append(" ".join(near))
    out += [text(60) + " " + passage + " " + text(rng.randint(1, 50)) for _ in range(12)]
    out += [text(200) for _ in range(10)]
    out += [out[0], out[30], None, "", "one", "one", "ONE", "two words", passage + "\n" + passage, text(9000), "a" * 1000, "\t \n", "same same same same same same"]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
