import random

import pytest

WORDS = ["ara", "bel", "cor", "dun", "eri", "fal", "gos", "hin", "ilu", "jat", "kem", "lop", "mur", "nes", "oti", "pra", "qui", "rus", "sem", "tov"]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(WORDS) for _ in range(draw.randint(1, 3))) for _ in range(n))


def swap(text: str, at: int) -> str:
    words = text.split(" ")
    words[at] = "changed"
    return " ".join(words)


#: doc_id, text: nulls, blanks, ties, repeats, near copies, a long text
ROWS = (
    [(i, prose(i, 40 + i)) for i in range(12)]
    + [(20, prose(3, 43)), (21, prose(3, 43).replace(" ", "  ", 5)), (22, swap(prose(4, 44), 7)), (23, swap(swap(prose(4, 44), 7), 40))]
    + [(30, None), (31, ""), (32, " \n\t"), (None, prose(99, 30)), (None, None), (33, "one two"), (34, "One  two"), (35, "ümläut 😀 x")]
    + [(40, prose(7, 47)), (40, prose(7, 47)), (41, prose(8, 48) + " " + prose(500, 120)), (42, prose(500, 120) + " " + prose(9, 49)), (43, prose(77, 6000))]
)


@pytest.fixture(scope="session")
def docs(spark):
    """With columns whose names the operators use inside."""
    rows = [(i, t, "en", f"src{k % 3}", len(t or ""), k, "x", k % 2, 0.5) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, key string, row int, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
