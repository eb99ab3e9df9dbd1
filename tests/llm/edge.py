"""A table with the cases that every operator must take."""

import random

from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("the of and river stone éclair light über house 漢字 paper wind".split()) + rng.choice(["", "", "s", "ing"]) for _ in range(n)]


def documents(spark, extra=()):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing columns."""
    para = " ".join(words(1, 80))
    line = "this very line of text is found in many of the documents here"
    data = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, " \n\t\x0b ", "en", "a", 5),
        (3, para, "en", "b", len(para)),
        (4, para, "en", "b", len(para)),
        (5, para + " end", "fr", "b", 1),
        (6, "\n".join(" ".join(words(k, 12)) for k in range(20_000)), "de", "c", 1),
        (7, f"one\n  {line.upper()} \nlast", "en", "c", 1),
        (8, f"{line}\n{line}", "en", None, 1),
        (9, line, "en", "c", 1),
        (10, f"\n{line}\n", "en", "c", 1),
        (11, f"x\n{line}", "en", "c", 1),
        (12, "repeat " * 100, "en", "a", 1),
        (12, "repeat " * 100, "en", "a", 1),
        (None, f"no id\n{line}", "en", "a", 1),
        *extra,
    ]
    df = spark.createDataFrame(data, COLUMNS)
    clash = "row fp word kept drops batch size p slice h doc body ids c n unit digest v id c0 y score h1 quality n_copies pattern stays".split()
    return df.withColumns({c: F.lit("clash") for c in clash})


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


LABELS = "doc_id long, quality int, toxic int"
