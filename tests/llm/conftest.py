import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep long, key long, n int, size string, at int"


def words(rng, n):
    common = ["the", "of", "and", "to", "in"]
    return [rng.choice(common) if rng.random() < 0.4 else "w%d" % rng.randint(0, 3000) for _ in range(n)]


def make_rows():
    """Texts with copies, near copies, shared passages, nulls, empties, white space only, one very long; ids with a null; extra columns with clashing names."""
    rng = random.Random(7)
    texts = [" ".join(words(rng, rng.randint(1, 200))) for _ in range(60)]
    base = words(rng, 150)
    for k in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = "x%d" % rng.randint(0, 10**6)
        texts.append(" ".join(w))
    texts += [texts[0]] * 6 + [texts[3].upper(), " " + texts[5].replace(" ", "\n"), texts[7] + " end"]
    passage = " ".join(words(rng, 40))
    texts += [" ".join(words(rng, 20)) + " " + passage + " " + " ".join(words(rng, 20)) for _ in range(8)] + [passage + " " + passage]
    texts += ["", "", None, None, " \t\n", "one", "one", "é ünï 漢字 😀 text", "a b", " ".join(words(rng, 6000)), "Released under the MIT License."]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[4], rows[4], (rows[9][0], "another text of the same id"), (None, texts[1]), (None, None)]
    return [(i, t, rng.choice(("en", None)), rng.choice(("a", "a", "a", "b", "é", "Z", None)), None if t is None else len(t), "x", 1, 2, 3, "y", 4) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
