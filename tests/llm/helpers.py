"""Small tables with everything that can go wrong in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, digest int, id int, key string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(spark, with_null_id=True, extra=()):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(5)
    base = words(rng, 80)
    texts = [None, "", " \n\t", base, base, base + " end", words(rng, 3), words(rng, 30_000), "A" * 200_000, "1 " * 5000, "é\u00a0ü \u2003x\r\n\x0b", "\n\n\n", *extra]
    rows = [(i, t, "en", None, len(t or ""), None, None, i, "k") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (100, base, None, "s", None, "c", 1, None, None)]
    if with_null_id:
        rows += [(None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
