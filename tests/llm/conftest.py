"""A small table with every awkward case: nulls, empties, ties, repeated rows, long texts, clashing names."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("score", StringType()), StructField("spans", StringType()), StructField("kept", StringType())])


def invented(seed: int, words: int) -> str:
    r = random.Random(seed)
    syllables = ["tha", "en", "or", "ré", "lo", "mi", "ka", "und", "ßa", "pe"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(words))


def texts() -> list[tuple[int | None, str | None]]:
    base = invented(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = invented(2, 70)
    out = [
        (1, base), (2, base), (3, near), (4, base.upper()), (5, invented(3, 90)), (6, invented(4, 10) + " " + passage + " " + invented(5, 20)),
        (7, passage + "\n" + invented(6, 30)), (8, None), (9, ""), (10, "  \n\t "), (11, "one two three"), (12, "one two three"), (13, "One two"),
        (14, "a" * 450), (15, invented(7, 4000)), (16, invented(7, 4000) + " end"), (17, "\U0001f600 é́ <|endoftext|> \x00\x1c mixed İ"),
        (18, base), (18, base), (19, "x" * 30000), (None, base), (None, None),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([Row(doc_id=i, text=t, score="s", spans="p", kept="k") for i, t in texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
