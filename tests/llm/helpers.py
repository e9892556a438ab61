"""Small tables with every awkward row."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, failed_bits long, runs string, rank int, size int"


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def awkward(spark, extra=()):
    """Nulls in every column, empty and long texts, repeated rows, names that clash."""
    rng = random.Random(3)
    base = prose(rng, 90)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", None), (4, None, "en", "a"), (5, "", None, "b"), (None, "one two three", "en", "b"), (6, "word", "de", "b"), (7, "word", "de", None),
        (8, prose(rng, 9000), "en", "c"), (9, "\n \t\n", "en", "c"), (10, "é ü ß 漢字 é ü ß 漢字", "de", "c"), (11, "123 456 ###", "de", "c"), (12, prose(rng, 60), "en", "a"), (12, prose(rng, 60), "en", "a"),
        (13, base, "en", "a"), (13, base, "en", "a"), (None, None, None, None), (14, "xy " * 200, "en", "d"), *extra,
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", 1, 2) for r in rows], SCHEMA)
