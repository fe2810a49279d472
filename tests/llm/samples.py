"""Rows that the tests of this folder share."""

#: Columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone int, n int, rep int, row int, key string, pack int, words string, hi long, n_lines string, n_removed int, registers binary"


def make(spark, rows):
    """documents from (doc_id, text[, lang]) with columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 1, None, 2, 3, "k", 4, None, 5, "x", 6, b"") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))
