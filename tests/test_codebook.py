"""Stata extracts and codebook wording."""

import pandas as pd

from popspark.sources import codebook

BOOK = """Variable: ROADS  Type: numeric
Label: (Are we spending too much
   or too little on...) roads and bridges?
Notes: none
Variable: ROADSY Type: numeric
Label:
   Highways
Text: x
Variable: HAPPY Type: numeric
Label: General happiness
PCT 1 2
Variable: HAPPY Type: numeric
Label: another label
"""


def test_wording_and_questions(spark, tmp_path):
    (tmp_path / "book.txt").write_text(BOOK)
    labels = codebook.wording(spark, str(tmp_path / "book.txt"))
    assert {r["variable"]: r["label"] for r in labels.collect()} == {
        "roads": "(Are we spending too much or too little on...) roads and bridges?", "roadsy": "Highways", "happy": "General happiness",
    }
    got = codebook.questions(labels.union(spark.createDataFrame([("bare", None)], "variable string, label string")), {"roads": "roads"})
    assert {r["variable"]: r["text"] for r in got.collect()} == {
        "roads": "Are we spending too much or too little on roads and bridges?", "roadsy": "Are we spending too much or too little on Highways?",
        "happy": "General happiness", "bare": "bare",
    }
    assert {r["text"] for r in codebook.questions(labels.where("variable = 'roadsy'")).collect()} == {"Highways"}


def test_stata_columns_codes_and_labels(spark, tmp_path):
    path = str(tmp_path / "survey.dta")
    pd.DataFrame({"age": [30.0, None, 50.0], "code": [1, 2, 1], "name": ["a", "b", ""], "other": [0, 0, 0]}).to_stata(path, write_index=False, variable_labels={"age": "Age in years", "code": "Roads: Version Y"})
    rows = codebook.stata(spark, [path], ["code", "age", "name"], strings=["name"])
    assert sorted(tuple(r) for r in rows.where("age is not null").collect()) == [(1.0, 30.0, "a"), (1.0, 50.0, "")]
    assert rows.count() == 3 and rows.where("age is null").count() == 1
    assert codebook.stata_labels(path)["code"] == "Roads" and codebook.stata_labels(path)["age"] == "Age in years"
