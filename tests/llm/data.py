"""Documents with every odd case, and extra columns whose names clash with the operators' own."""

import random

from pyspark.sql import functions as F

WORDS = "river stone cloud amber field north light paper glass winter garden silver morning distant quiet market window bridge summer letter".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", ",", "."]) + str(r.randint(0, 99)) * (r.random() < 0.3) for _ in range(n))


def rows():
    base, passage = prose(120, 1), prose(60, 2)
    words = base.split(" ")
    near = " ".join(words[:50] + ["changed"] + words[51:])
    out = [
        (0, base), (1, base), (2, near), (3, near.upper()), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  TWO"), (9, "the same line\n" * 200),
        (10, prose(40, 3) + "\n" + passage + "\n" + prose(30, 4)), (11, prose(20, 5) + " " + passage + " " + prose(20, 6)), (12, prose(9000, 7)), (13, "é ü ß 中文 😀 " * 30),
        (14, "<|endoftext|> <s> </s> [INST] x"), (15, "a" * 5000), (2, near), (20, prose(80, 8)), (21, passage), (22, "\x00\x1c\x85  odd white space"),
    ]
    return out + [(30 + k, prose(100, 30 + k)) for k in range(10)]


def documents(spark, extra=()):
    df = spark.createDataFrame(rows() + list(extra), "doc_id long, text string")
    names = ("part", "key", "start", "ids", "n", "place", "length", "ahead", "range", "toxic", "begin", "label")
    return df.select("doc_id", "text", *(F.lit(7).alias(n) for n in names), F.lit("x").alias("Doc_ID2"))

def clash(df):
    """The same with columns that differ from the operators' by case only."""
    return df.select("*", F.lit("no").alias("TEXT"), F.lit(1).alias("DOC_ID"))
