"""Two kinds of survey records brought to one taxonomy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .taxonomy import Taxonomy, band, crosswalk

# fixed values: levels in order, and the codes of the two sources
LEVELS = {
    "age_band": ("18-24", "25-34", "35-44", "45-54", "55-64", "65+"),
    "sex": ("male", "female"),
    "education": ("less_than_hs", "high_school", "some_college", "bachelors", "graduate"),
    "race": ("white", "black", "other"),
    "marital": ("married", "widowed", "divorced", "separated", "never_married"),
}
AGES = (18, 25, 35, 45, 55, 65)
SEX = {1: "male", 2: "female"}
MARITAL = {1: "married", 2: "widowed", 3: "divorced", 4: "separated", 5: "never_married"}
CENSUS_RACE = {1: "white", 2: "black"}
CENSUS_SCHOOLING = ((1, 15), (16, 17), (18, 20), (21, 21), (22, 24))
SURVEY_RACE = {1: "white", 2: "black", 3: "other"}
SURVEY_DEGREE = {0: "less_than_hs", 1: "high_school", 2: "some_college", 3: "bachelors", 4: "graduate"}
SURVEY_OLDEST = 89
CENSUS_COLUMNS = ("AGEP", "SEX", "SCHL", "RAC1P", "MAR", "PWGTP")
SURVEY_COLUMNS = ("age", "sex", "degree", "race", "marital")

TAXONOMY = Taxonomy(LEVELS)


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def _require(records: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in records.columns]
    if missing:
        raise ValueError(f"the records lack {', '.join(missing)}")


def schooling(value: Column) -> Column:
    """Inclusive ranges of codes to levels of education; null for any other code."""
    return F.coalesce(*[F.when(value.between(low, high), F.lit(level)) for (low, high), level in zip(CENSUS_SCHOOLING, LEVELS["education"], strict=True)])


def census(records: DataFrame) -> DataFrame:
    """Adults with every attribute and a positive weight (AGEP, SEX, SCHL, RAC1P, MAR, PWGTP)."""
    _require(records, CENSUS_COLUMNS)
    rows = records.select(
        band(_number("AGEP"), AGES, LEVELS["age_band"]).alias("age_band"),
        crosswalk(_number("SEX"), SEX).alias("sex"),
        schooling(_number("SCHL")).alias("education"),
        crosswalk(_number("RAC1P"), CENSUS_RACE, "other").alias("race"),
        crosswalk(_number("MAR"), MARITAL).alias("marital"),
        _number("PWGTP").alias("weight"),
    )
    return rows.dropna().where("weight > 0")


def survey(records: DataFrame, weight: str) -> DataFrame:
    """All records with a positive weight, items kept; attributes out of range are null (age, sex, degree, race, marital)."""
    _require(records, (*SURVEY_COLUMNS, weight))
    age = _number("age")
    coded = {
        "age_band": band(F.when(age <= SURVEY_OLDEST, age), AGES, LEVELS["age_band"]),
        "education": crosswalk(_number("degree"), SURVEY_DEGREE),
        "sex": crosswalk(_number("sex"), SEX),
        "race": crosswalk(_number("race"), SURVEY_RACE),
        "marital": crosswalk(_number("marital"), MARITAL),
        "weight": _number(weight),
    }
    return records.withColumns(coded).where("weight > 0")
