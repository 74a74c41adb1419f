"""Survey extracts in Stata's format, and question wording from a codebook's text."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The fields that a codebook's lines begin with, and how a label's version suffix begins.
FIELDS = ("Variable:", "Label:", "Notes:", "Text:", "LABEL ", "PCT")
VERSIONS = ("Version", "Ver")

CHUNK_ROWS = 100_000


def stata(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], strings: Sequence[str] = ()) -> DataFrame:
    """The columns of Stata files as raw codes: doubles, or strings where named; missing codes are null.

    A task a file, in chunks of CHUNK_ROWS; paths must be readable where the tasks run.
    """
    columns, schema = list(columns), ", ".join(f"`{c}` {'string' if c in strings else 'double'}" for c in columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with pd.read_stata(path, columns=columns, convert_categoricals=False, chunksize=CHUNK_ROWS) as chunks:
                    for chunk in chunks:
                        yield chunk[columns].astype({c: "float64" for c in columns if c not in strings})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInPandas(read, schema)


def _unversioned(label: str) -> str:
    """Without a last part that is a word for version and one capital."""
    head, colon, tail = label.rpartition(":")
    words = tail.split()
    versioned = colon and len(words) == 2 and words[0] in VERSIONS and len(words[1]) == 1 and words[1].isupper()
    return (head if versioned else label).strip()


def stata_labels(path: str) -> dict[str, str]:
    """Labels of a file's variables by lower-case name, without a version suffix (header only)."""
    with pd.read_stata(path, iterator=True) as reader:
        return {name.lower(): _unversioned(str(label)) for name, label in reader.variable_labels().items()}


def wording(spark: SparkSession, path: str) -> DataFrame:
    """variable, label: the first label that is not blank of each variable in a codebook's text.

    A line belongs to the field that it or the last line before begins with; a variable's fields reach to the next
    variable's line, which also names its type. A label may go on over several lines.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    line = F.ltrim(F.regexp_replace("line", "\r", ""))
    begins = F.coalesce(*[F.when(line.startswith(f) & (F.lit(f != "Variable:") | line.contains("Type:")), F.lit(f)) for f in FIELDS])
    so_far = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one codebook: a document for people
    marked = lines.select("at", line.alias("line"), begins.alias("begins"))
    marked = marked.withColumn("field", F.last("begins", True).over(so_far)).withColumn("block", F.count_if(F.col("begins") == "Variable:").over(so_far))
    content = F.when(F.col("begins").isNotNull(), F.expr("substr(line, length(begins) + 1)")).otherwise(F.col("line"))
    name = F.max(F.when(F.col("begins") == "Variable:", F.split(F.ltrim(content), r"\s+")[0]))
    parts = F.array_sort(F.collect_list(F.when(F.col("field") == "Label:", F.struct("at", F.trim(content).alias("part")))))
    blocks = marked.where("block > 0").groupBy("block").agg(F.lower(name).alias("variable"), F.array_join(F.filter(parts["part"], lambda x: x != ""), " ").alias("label"))
    clean = blocks.withColumn("label", F.trim(F.regexp_replace("label", r"\s+", " ")))
    return clean.where("label <> ''").groupBy("variable").agg(F.min_by("label", "block").alias("label"))


def questions(labels: DataFrame, families: Mapping[str, str] | None = None) -> DataFrame:
    """variable, text: labels (variable, label) as the questions that were asked.

    What stands in a label's first brackets is the stem of its question and what follows them the item; together they make
    one sentence that ends with a question mark. A label without a stem takes that of its family: families maps a prefix
    of variables to the one whose label carries the stem. Without either the label stands; without a label, the name.
    """
    spark = labels.sparkSession
    opens, closes = F.locate("(", F.col("label")), F.expr("locate(')', label, greatest(locate('(', label), 1))")
    bracketed = (opens > 0) & (closes > opens)
    split = labels.withColumns({
        "stem": F.when(bracketed, F.trim(F.substring("label", opens + 1, closes - opens - 1))),
        "item": F.when(bracketed, F.trim(F.substring("label", closes + 1, F.length("label")))).otherwise(F.col("label")),
    })
    prefixes = spark.createDataFrame(list((families or {}).items()), "prefix string, carrier string")
    carried = split.where("stem <> ''").select(F.col("variable").alias("carrier"), F.col("stem").alias("shared"))
    rows = split.join(F.broadcast(prefixes.join(carried, "carrier").drop("carrier")), F.col("variable").startswith(F.col("prefix")), "left")  # a row a family
    stem = F.btrim(F.replace(F.coalesce("stem", "shared"), F.lit("..."), F.lit("")), F.lit(" ."))
    sentence = F.concat_ws(" ", F.concat(F.upper(F.left(stem, F.lit(1))), F.substring(stem, F.lit(2), F.length(stem))), F.concat(F.rtrim(F.col("item"), F.lit("?")), F.lit("?")))
    text = F.when(F.coalesce("label", F.lit("")) == "", F.col("variable")).when(stem.isNull(), F.col("label")).otherwise(sentence)
    return rows.select("variable", text.alias("text"))
