import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, n long, node long, fp string, score double, kept boolean, region long, gone boolean, label int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]), with other columns whose names clash with those inside operators."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "k", 2, 3, 4, "f", 0.5, True, 5, False, 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


WORDS = "the of and river stone morning engine paper window garden silver ocean market letter bridge winter copper signal harvest lantern".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


#: Null, empty, blank, tied, repeated and very long texts; null ids; rows that occur twice.
EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (6, "One two"), (7, prose(1, 80)), (8, prose(1, 80)), (8, prose(1, 80)), (9, prose(1, 80) + " tail"), (None, "no id here"), (None, None), (10, "ß é 日本 \u0085 ​ 🙂"), (11, "word " * 40_000), (12, "x" * 300_000)]
