"""Large files read by byte ranges against readers of whole files."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.sources import ranges as R, readers as RD

ODD = ['say ""hi""', "line\nbreak", "a\r\nb", "", "plain", 'x"', ",", "é\n\n" * 5, '"', "long " * 300 + '\n"q"\n' * 40]


@pytest.fixture
def small_ranges(spark):
    """Files are cut every 600 bytes, so most borders fall inside quoted fields."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "600"), spark.conf.set(names[1], "1")
    yield
    for n, v in kept.items():
        spark.conf.set(n, v)


def csv_text(rows, end):
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    return end.join(["sample_id,grp,label,text", *(f"{i},g,A1,{quoted(t)}" for i, t in rows)]) + end


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_equals_the_multi_line_reader(spark, tmp_path, small_ranges, end):
    rng = random.Random(5)
    for f in range(3):
        rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 5)))) for i in range(60 * f)]
        (tmp_path / f"part-{f}.csv").write_bytes(csv_text(rows, end).encode())
    (tmp_path / "none.csv").write_bytes(b"")
    path = str(tmp_path)
    tasks = R._pieces(spark, path, "\n", R.odd_quotes).select("file", "range_start").distinct().count()
    key = lambda df: sorted(tuple(r) for r in df.select(F.col("sample_id").cast("string"), "grp", "label", F.coalesce("text", F.lit(""))).collect())
    got = key(R.read_csv(spark, path, RD.CORPUS_SCHEMA))
    want = [tuple(r) for f in range(3) for r in list(csv.reader(open(tmp_path / f"part-{f}.csv", newline="")))[1:]]
    assert tasks > 20 and got == sorted(want) and len(got) == 180
    if end == "\n":  # with the other one, Spark's reader changes the line breaks inside fields
        assert got == key(spark.read.schema(RD.CORPUS_SCHEMA).options(**RD.CSV_OPTIONS).csv(path))


def test_one_record_over_many_ranges_and_no_final_break(spark, tmp_path, small_ranges):
    long = 'a "b"\n' * 2000
    (tmp_path / "f.csv").write_text(csv_text([(1, "x"), (2, long), (3, "")], "\n")[:-1])
    got = {r.sample_id: r.text for r in RD.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {1: "x", 2: long, 3: ""}


def test_torn_file_is_refused(spark, tmp_path):
    (tmp_path / "f.csv").write_text('sample_id,grp,label,text\n1,g,A1,"open\n')
    with pytest.raises(ValueError, match="inside a quoted string"):
        R.read_csv(spark, str(tmp_path), RD.CORPUS_SCHEMA)


@pytest.mark.parametrize("indent", [None, 2])
def test_json_object_equals_the_whole_parser(spark, tmp_path, small_ranges, indent):
    rng = random.Random(7)
    odd = ["}", "{", '"', "\\", "\\\"}", ",", "é", "\n", "a b"]
    big = {f"{i}" + "".join(rng.choice(odd) for _ in range(rng.randint(0, 6))): {l: rng.random() for l in rng.sample(["A1", "B2", "}x"], rng.randint(0, 3))} for i in range(400)}
    (tmp_path / "big.json").write_text(json.dumps(big, indent=indent))
    (tmp_path / "empty.json").write_text("{}")
    found = R.read_json_entries(spark, str(tmp_path), "map<string,double>").collect()
    assert {r.id: r.value for r in found} == big and len(found) == len(big)
    assert R._pieces(spark, f"{tmp_path}/big.json", "}", R.odd_json_quotes).select("range_start").distinct().count() > 20


def test_more_ranges_than_the_list_may_have_are_refused(spark, tmp_path, small_ranges, monkeypatch):
    (tmp_path / "f.csv").write_text(csv_text([(k, "x" * 50) for k in range(60)], "\n"))
    monkeypatch.setattr(R, "MAX_RANGES", 3)
    with pytest.raises(ValueError, match="maxPartitionBytes"):
        RD.read_corpus(spark, str(tmp_path)).count()
