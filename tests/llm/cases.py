"""Rows that every document operator has to take."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = "the quick brown fox jumps over the lazy dog and then runs back to the quiet old barn again"

AWKWARD = [
    (1, PROSE, "en", "a", 1),
    (2, PROSE, "en", "a", 1),
    (2, PROSE, "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 4),
    (6, "one", "en", None, 3),
    (7, "12345 ... 678", None, "a", 13),
    (None, "a row without an identifier but with some words in it", "en", "b", 1),
    (8, "der die das und ist ein kleiner satz auf deutsch", "de", "b", 1),
    (9, "word " * 60_000, "en", "c", 300_000),
    (10, "x" * 200_000, "en", "c", 200_000),
    (11, PROSE.replace(" ", "\n\t "), "en", "a", 1),
]


def documents(spark, rows=AWKWARD, clashing=False):
    df = spark.createDataFrame(rows, DOCUMENTS)
    if clashing:
        for name in ("row", "row_id", "digest", "locator", "size", "copies", "key", "score", "lang_pred", "spans", "shard", "set_id", "token", "owner", "t", "kept", "doc"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df
