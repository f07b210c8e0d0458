"""Small tables that hold every awkward row at once."""

from pathlib import Path

SMALL = Path("/root/testdata/sf0.001")
MEDIUM = Path("/root/testdata/sf0.01")
LARGE = Path("/root/testdata/sf0.1")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, score string, labels string, copies int"
LONG = "Lorem ipsum dolor sit amet, consetetur sadipscing elitr. " * 1500 + "x" * 3000


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named like outputs."""
    clash = (True, "s", "c", "l", 7)
    return [
        (1, "The same words in the same order, again and again.", "en", "a", 50, *clash),
        (2, "the SAME words in the same order, again and again.", "en", "a", 50, *clash),
        (2, "the SAME words in the same order, again and again.", "en", "a", 50, *clash),
        (3, "", "en", "b", 0, *clash),
        (4, None, None, None, None, None, None, None, None, None),
        (None, "No id here but words enough to be a text of its own.", None, "b", 1, *clash),
        (None, None, None, None, None, None, None, None, None, None),
        (5, " \n\t ", "de", None, 4, *clash),
        (6, LONG, "en", "a", len(LONG), *clash),
        (7, LONG, "en", "c", len(LONG), *clash),
        (8, "1234 5678 !!!", "de", "c", 13, *clash),
        (9, "Ünïcödé ÀÉÎ words 😀 and K kelvin", "de", "a", 30, *clash),
    ]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def read(spark, name, folder=SMALL):
    return spark.read.parquet(f"{folder}/{name}.parquet")
