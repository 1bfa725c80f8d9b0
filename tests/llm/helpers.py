"""Small tables with every odd case, for the tests of this folder."""

ODD_TEXTS = [
    None, "", " \t\n", "a", "One two", "the cat sat on the mat", "The cat SAT on the mat",
    "the cat sat on the mat", "Füße öffnen! 123 ... x", "x" * 5000, "\u4f60\u597d \u4e16\u754c",
    "tail <|endoftext|> end", "a  b\n\n c\x1c d\u00a0e", "it's they'll 12345 &&&*** !!!",
]


def docs(spark, texts=None):
    """(doc_id, text, ...): a NULL id, a repeated row, and columns named like results."""
    rows = [(i, t, "s", i) for i, t in enumerate(ODD_TEXTS if texts is None else texts)]
    if texts is None:
        rows += [(None, "no id here", "s", 0), (4, "One two", "s", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens long")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, n_tokens long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
