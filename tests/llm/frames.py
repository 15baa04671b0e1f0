"""Small documents with what may go wrong in them."""

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PROSE = " ".join(f"word{i}" for i in range(80))

ROWS = [
    (0, PROSE, "en", "a"),
    (1, PROSE, "en", "a"),  # a copy
    (2, PROSE.replace("word40", "other"), "en", None),
    (3, None, None, "b"),
    (4, "", "en", "b"),
    (5, " \t\n ", "en", "b"),
    (6, LONG, "de", "c"),
    (7, "one two", "fr", "c"),
    (8, 'Ünïcode  wörds here\npassword = "abcdef0123456789"\n\n\nx', "fr", "c"),
    (None, "no id at all", "en", "a"),
    (9, "no id at all", "en", "a"),
    (9, "no id at all", "en", "a"),  # a repeated row
    (10, "same same same same " * 30, "en", "zz"),
]


def documents(spark, rows=ROWS):
    """With extra columns whose names operators might use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, n long"
    return spark.createDataFrame(
        [(i, t, lang, s, None if t is None else len(t), "x", "y", 1) for i, t, lang, s in rows], schema
    )
