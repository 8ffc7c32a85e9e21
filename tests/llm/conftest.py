import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    """A small table with nulls, empty and long texts, copies, shared passages and lines, one frequent line, and near copies."""
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abdeghilmnorstu") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    make = lambda n: " ".join(rnd.choice(vocabulary) if rnd.random() < 0.6 else rnd.choice(("the", "of", "and", "to")) for _ in range(n))
    passage, line, long = make(70), "A Line Of many Documents", make(5000)
    texts = [make(rnd.randint(1, 150)) for _ in range(60)]
    texts += [f"{make(20)} {passage} {make(30)}" for _ in range(6)] + [passage, f"{passage}\n{passage}"]
    texts += [f"{make(10)}\n  {line.upper() if i % 2 else line}\t\n{make(10)}\nshort" for i in range(25)]
    texts += [texts[3]] * 8 + [long, long, f"{long} end", "", None, " \n\t ", "word", "é日本 <|endoftext|> \U0001f600 x", "a " * 400, "x\ny\nx\ny", "%%% ### " * 40]
    near = make(120).split()
    texts += [" ".join([*near[:i], "changed", *near[i + 1 :]]) for i in range(0, 120, 6)]
    return [(i * 3, t, ("en", "fr", None)[i % 3], ("b", "a", None, "é")[min(i % 7, 3)], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(shuffled, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows, and columns named like results."""
    rows = [(None, None, None, None, None), (None, "same words here", "en", "a", 1), (5, "one two three", "en", "a", 1), (5, "one two three", "en", "a", 1), (5, "other text", None, None, 2), (7, "same words here", "xx1", "", 0)]
    names = "size long, taken long, slot long, shard int, n_tokens long, kept boolean, fp long, tree binary, n_words long, n_lines long, n_removed long"
    return spark.createDataFrame([(*r, *[None] * 11) for r in rows], f"{SCHEMA}, {names}")
