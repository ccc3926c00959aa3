import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "sel", "mon", "dra", "vi") for b in ("n", "ter", "lo", "sky", "ped", "quam", "ish", "o")]
#: Columns of the caller whose names the operators use inside or for their output.
CLASHES = "row string, key string, q_w string, kept string, n_words string, bands string, spans string, h string, group string"


def prose(seed, lines=6, words=12):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(words)) + "." for _ in range(lines))


def documents(spark, rows, clashes=False):
    """A documents table of (doc_id, text, source) rows, perhaps with clashing columns."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + (", " + CLASHES if clashes else "")
    more = ("x",) * 9 if clashes else ()
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *more) for i, t, s in rows], schema)


MESSY = [(1, prose(1), "a"), (2, None, "a"), (3, "", None), (None, prose(2), "b"), (4, prose(1), "a"), (4, prose(1), "a"), (5, " \n\t\n ", "c"), (6, "é" * 5000 + " " + "x" * 30000, "c"),
         (7, "\n".join([prose(3, 1)] * 40), "a"), (8, "word", None), (9, "!!! ### $$$", "d"), (8, "other text under a used id", None), (10, prose(4, 800, 20), "a")]


@pytest.fixture(scope="session")
def messy(spark):
    return documents(spark, MESSY, clashes=True)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [], clashes=True)
