import json

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.answers import label_from_keys, parse_answer
from gradeloom.operators import ingest
from gradeloom.sources import sinks

# Free-text answers and what is read out of them.
CASES = [
    ('{"score":"A1", "level":"B2"} extra text here', {"score": "A1", "level": "B2"}, "A1"),
    ('{"score":"B2"} and some more data', {"score": "B2"}, "B2"),
    ('text before {"score":"C1", "level":"A2"} text after', {"score": "C1", "level": "A2"}, "C1"),
    ('random text {"level":"B1"}', {"level": "B1"}, "B1"),
    ('Here is a score {"score":"C1"} with some random text.', {"score": "C1"}, "C1"),
    ('Here is the JSON file:\n\n{"score": "B1"', {"score": "B1"}, "B1"),
    ('{"score": "B1"', {"score": "B1"}, "B1"),
    ('{"score": "B1"°}', {"score": "B1"}, "B1"),
    ('{"score": "B1" ', {"score": "B1"}, "B1"),
    ('The level is {"level": "C2"', {"level": "C2"}, "C2"),
    ('{"score": "A2"°', {"score": "A2"}, "A2"),
    ('Result: {"cefr": "B2"°}', {"cefr": "B2"}, "B2"),
    ("no json here at all", None, None),
    ('{"invalid": "X9"}', {"invalid": "X9"}, None),
    ("{'score': 'c1'}", {"score": "c1"}, "C1"),
    ("I would say B2, maybe C1", {"score": "B2"}, "B2"),
    ('{"score": "Z9", "level": "B1"}', {"score": "Z9", "level": "B1"}, None),
    ('{"a": "B1", "b": "B2"}', {"a": "B1", "b": "B2"}, None),
    ('{"grade": " b2 "', {"grade": "B2"}, "B2"),
    (None, None, None),
    ("", None, None),
    ('{"score": "A1", "score": "B2"}', {"score": "B2"}, "B2"),
    ('{"level": "\u00a0b1\u3000"}', {"level": "\u00a0b1\u3000"}, "B1"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, answer string")
    m = parse_answer(F.col("answer"))
    return {r["i"]: r for r in df.select("i", F.to_json(m).alias("m"), label_from_keys(m).alias("label")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_answer(parsed, i):
    row = parsed[i]
    assert (json.loads(row["m"]) if row["m"] else None) == CASES[i][1]
    assert row["label"] == CASES[i][2]


def test_other_scale(spark):
    levels = ("LOW", "MID", "HIGH")
    df = spark.createDataFrame([('{"score": "mid"',), ("surely HIGH",), ('{"score": "B1"',)], "a string")
    got = df.select(label_from_keys(parse_answer(F.col("a"), levels), levels).alias("l")).collect()
    assert [r.l for r in got] == ["MID", "HIGH", None]


def test_answer_folder(spark, tmp_path):
    for name, answer in (("s1", '{"score": "A1"}'), ("s2", "nothing"), ("s3", '{"invalid": "X9"}')):
        (tmp_path / f"{name}.txt").write_text(answer)
    found = ingest.answers_from_folder(spark, str(tmp_path))
    assert {r.name: (r.parsed, r.label) for r in found.collect()} == {"s1": (True, "A1"), "s2": (False, None), "s3": (True, None)}
    assert ingest.parse_totals(found).first().asDict() == {"n_total": 3, "n_parsed": 2, "n_labelled": 1, "n_failed": 1}


def test_answer_files(spark, tmp_path):
    """One file an answer in few folders: a missing id and a missing answer are kept, rows of one id in one task share a file."""
    rows = [(i, f'{{"score": "B{i % 2 + 1}"}}') for i in range(40)] + [(None, '{"score": "C1"}'), (50, None), (-7, "no"), (60, '{"score": "A1"}'), (60, '{"score": "A1"}')]
    answers = spark.createDataFrame(rows, "id bigint, answer string").coalesce(2)
    n = sinks.write_text_files(answers.coalesce(1), str(tmp_path / "one"), "id", "answer")
    assert n == 44 and len(list((tmp_path / "one").glob("*"))) == 1 and len(list((tmp_path / "one").rglob("*.txt"))) == 44
    assert not list((tmp_path / "one").rglob(".*"))
    found = ingest.answers_from_folder(spark, str(tmp_path / "one")).collect()
    want = [(str(i), f"B{i % 2 + 1}", True) for i in range(40)] + [("null", "C1", True), ("50", None, False), ("-7", None, False), ("60", "A1", True)]
    assert sorted((r["name"], r["label"], r["parsed"]) for r in found) == sorted(want, key=lambda w: w[0])
    assert {r["name"]: r["answer"] for r in found}["60"] == '{"score": "A1"}\n{"score": "A1"}\n'
    assert sinks.write_text_files(answers.limit(0), str(tmp_path / "none"), "id", "answer") == 0
    assert ingest.answers_from_folder(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no file name"):
        sinks.write_text_files(spark.createDataFrame([("a/b", "x")], "id string, answer string"), str(tmp_path / "bad"), "id", "answer")
