"""Raw extracts: zipped CSV in chunks, and what is published from them."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling, weighted

#: Rows read at once; largest sample of microdata and its share of the rows.
CHUNK_ROWS, SEED_ROWS, SEED_SHARE = 500_000, 40_000, 0.02


def zipped_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns, as doubles, of all CSV members of zip archives; an error names an archive without any.

    A task a member: a zip can't be split, but its members can be read apart. Paths must be readable where the tasks run.
    """
    columns = list(columns)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with zipfile.ZipFile(path) as archive:
                    found = sorted(n for n in archive.namelist() if n.endswith(".csv"))
                if not found:
                    raise ValueError(f"no CSV in {path}")
                yield pd.DataFrame({"path": path, "member": found})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, member in zip(batch["path"], batch["member"], strict=True):
                with zipfile.ZipFile(path) as archive, archive.open(member) as file:
                    for chunk in pd.read_csv(file, usecols=columns, dtype="float64", chunksize=CHUNK_ROWS):
                        yield chunk[columns]

    listed = spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(members, "path string, member string").collect()  # a row a member
    each = spark.createDataFrame(listed, "path string, member string").repartition(max(1, len(listed)), "path", "member")
    return each.mapInPandas(read, ", ".join(f"`{c}` double" for c in columns))


def write_marginals(records: DataFrame, levels: Mapping[str, Sequence[str]], path: str, source: Mapping[str, str], universe: str, weight: str = "weight") -> dict:
    """The weighted share of every level of every attribute, and the totals, as the JSON file that Targets.load reads; also returned."""
    shares = {a: dict.fromkeys(names, 0.0) for a, names in levels.items()}
    for r in weighted.all_marginals(records, list(levels), weight).collect():  # a row a level
        shares[r["attribute"]][r["level"]] = r["share"]
    totals = records.agg(F.count("*").alias("records"), F.sum(weight).alias("total")).first()
    made = {"source": dict(source), "universe": universe, "population_total": totals["total"] or 0.0, "records": totals["records"], "marginals": shares}
    records.sparkSession.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return made


def write_microdata(records: DataFrame, path: str, key: str, seed: int = 0, share: float = SEED_SHARE, most: int = SEED_ROWS) -> None:
    """A sample of the records, at most so many rows, as one gzipped CSV with a header."""
    picked = sampling.bernoulli(records, share, seed, key, most)
    picked.drop(key).coalesce(1).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)  # at most `most` rows
