"""Small tables with the odd rows that every operator must stand: nulls, empty and long texts, repeated rows, clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, count long, n long"


def docs(spark, texts, extra=True):
    """(doc_id, text) pairs as documents; with columns whose names operators use themselves."""
    rows = [(i, t, "en", "src0", None if t is None else len(t), 0.5, 1, 2) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df if extra else df.select("doc_id", "text")


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "a b c d e f"), (5, "x " * 50_000), (6, "a b c d e f"), (7, "Ünïcödé 漢字   \x1c end"), (8, "tail\n")]
