import os
import random
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, n_lines string, text_key string, id int"


def nasty_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids."""
    rng = random.Random(5)
    words = ["the", "of", "and", "house", "Straße", "l'été", "que", "año", "12", "x1", "Ωmega", "中文", "end."]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(60)
    near = base.split(" ")
    near[30] = "changed"
    texts = [None, "", " \n\t ", "!!! 123 ...", "one two", "one two three\n", base, base, " ".join(near), base.upper(),
             say(30_000), "a" * 50_000, "\n".join(["All rights reserved here."] * 5), "All rights reserved here.\nown line of the text",
             "error 17 at host a7 port 80 ok\nplain words stand here", "error 18 at host b9 port 81 ok\nother words stand there", " 　 é́ \U0001f600", "<|endoftext|> x"]
    rows = [(i, t, None if i % 3 == 0 else ("en", "fr")[i % 2], None if i % 4 == 0 else "s", None if t is None else len(t), "clash", 7, "clash", "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, "en", "s", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (5, "a different text under the same id that is long enough", "en", "s", 1, "x", 1, "x", "x", 1)]
    return rows


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(nasty_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], T.StructType.fromDDL(DOCUMENTS))
