"""Odd tables that every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "The quick brown fox jumps over the lazy dog near the river bank. " * 40


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names operators use inside."""
    rows = [
        (1, LONG), (2, ""), (3, None), (4, "a"), (4, "a"), (5, LONG), (None, "null id text with several words in it"), (7, " \t\n "),
        (8, "Ünïcödé 漢字 😀   text"), (5, "other text under the same id"), (9, "x" * 5000), (10, "\\ </s> [INST] <|endoftext|>"),
    ]
    schema = "doc_id long, text string, chunk int, owner int, fingerprint string, n int, _key long, bucket int"
    return spark.createDataFrame([(i, t, 1, 2, "z", 3, 4, 5) for i, t in rows], schema)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
