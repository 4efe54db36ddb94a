import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, first string, h string"


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, nulls, empty and very long texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßz") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, line = text(40), text(12)
    out = [text(r.randint(1, 120)) for _ in range(n // 3)]
    for _ in range(n // 3):
        base = r.choice(out)
        words = base.split(" ")
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append(r.choice([base, " ".join(words), base + "\n" + line, passage + "\n" + text(20), text(10) + " " + passage]))
    out += [None, "", " \n\t", "x", "A b C", "...", text(4000), line, line.upper() + "!", (text(9) + "\n") * 3, "  a  b\r\n\x0bc ", passage, passage]
    return [(k * 7 % 101 + 1000 * (k // 101), t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", None]), len(t or ""), "own", "own") for k, t in enumerate(out)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
