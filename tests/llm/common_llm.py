"""Frames for the edge cases that every operator must take: nulls, empty and very long texts,
ties and repeated rows, clashing column names, an empty table."""

SF = "/root/testdata/sf0.001"
CLASH = ["id", "t", "th", "h1", "h2", "n", "rep", "_t", "_c0", "shard", "slot", "lang_pred", "n_lines", "n_removed", "cluster"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
LONG = "\n".join(f"the long line number {i % 50} of a very long text" for i in range(4000))
BASE = "\n".join(f"line {i} tells of the river and the hill and the old mill" for i in range(12))

ROWS = [
    (1, BASE, "en"),
    (2, BASE, "en"),  # exact copy
    (3, BASE + "\nand one more line at the end", "en"),
    (3, BASE + "\nand one more line at the end", "en"),  # a row given twice
    (4, None, "en"),
    (5, "", None),
    (6, "one two", "en"),
    (7, "one two", None),
    (8, LONG, "de"),
    (9, "&&& $$$ 123", "de"),
    (None, BASE, "en"),
    (None, None, None),
    (10, "a" * 3000 + " " + "9" * 3000 + "\n\n\n\n" + "@" * 50, "de"),
    (11, "Ünïcödé ἀρχή 漢字 \U0001f600 é ½   x", "de"),
]


def edge_docs(spark):
    rows = [(i, t, lang, "s", None, *["x"] * len(CLASH)) for i, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
