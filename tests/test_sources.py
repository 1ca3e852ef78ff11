from gradeloom.session import fresh_path
from gradeloom.sources import catalog as C, readers as RD


def test_csv_with_quotes_and_breaks(spark):
    rows = [(1, "g", "A1", 'said "hi",\nthen left'), (2, "g", "B2", None), (3, "h", "C1", " tail\\ ")]
    path = fresh_path(spark, "t-csv")
    spark.createDataFrame(rows, RD.CORPUS_SCHEMA).write.options(**RD.CSV_OPTIONS, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    got = {r["sample_id"]: r["text"] for r in RD.read_corpus(spark, path).collect()}
    assert got == {1: 'said "hi",\nthen left', 2: "", 3: " tail\\ "}


def test_label_file_precedence(spark):
    names = ["set", "norm-set", "SET", "norm-two", "TWO", "xx-THREE-labels", "aa-three"]
    files = spark.createDataFrame([(n,) for n in names], "label_file string")
    got = {r["dataset"]: (r["match_class"], r["label_file"]) for r in C.match_label_files(spark.createDataFrame([("set",), ("two",), ("three",), ("none",)], "dataset string"), files).collect()}
    assert got == {"set": (0, "set"), "two": (1, "norm-two"), "three": (4, "aa-three"), "none": (None, None)}


def test_last_label_wins(spark):
    df = spark.createDataFrame([(1, "A1", 1), (1, "B1", 2), (2, "C1", 1)], "id int, l string, o int")
    assert sorted(map(tuple, RD.ground_truth(df, "id", "l", "o").collect())) == [("1", "B1"), ("2", "C1")]
