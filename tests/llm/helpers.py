"""Small tables with everything that can be odd about them."""

LONG = "lorem " * 40_000


def docs(spark, rows, extra=True):
    """documents from (doc_id, text, source) rows, with columns that clash with internal names."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 1, 2.0) for i, t, s in rows]
    df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, position int, tokens double")
    return df if extra else df.drop("shard", "position", "tokens")


def odd_rows():
    """Nulls in any column, empty and very long texts, repeated rows."""
    return [(1, None, "a"), (2, "", "b"), (3, "   \n ", "a"), (None, "some words here", "a"), (4, "same words here", None), (5, LONG, "b"), (6, "twice the same row", "a"), (6, "twice the same row", "a"), (7, "!!! ???", "c")]


def collect(df):
    return [tuple(r) for r in df.collect()]
