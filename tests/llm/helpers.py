"""Small tables with the hard cases: nulls, empties, long texts, ties, repeated rows, clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text, source); with a column whose name clashes with the operators' own."""
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).selectExpr("*", "'x' AS size", "'y' AS key", "'z' AS host")


def edge_rows():
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    return [(5, None, "a"), (3, "", "a"), (None, "no id here, just words that go on", "b"), (7, "same text twice over", None), (7, "same text twice over", None), (1, long, "a"), (9, "   \n\t ", "c"), (2, "Ünïcode — “quotes” 日本語 ́x", "b")]
