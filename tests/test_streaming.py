"""Marginals of a stream: closed windows come out once, rows behind the watermark are left out."""

import json
import os

from pyspark.sql import functions as F

from popspark.streaming.marginals import windowed_marginals

SCHEMA = "at timestamp, level string, weight double"


def test_stream_closes_windows_and_drops_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [
        [("2024-01-01 05:00:00", "a", 1.0), ("2024-01-01 06:00:00", "a", 2.5), ("2024-01-01 07:00:00", "b", 4.0), ("2024-01-01 08:00:00", None, 9.0)],
        [("2024-01-02 00:30:00", "a", 1.0), ("2024-01-01 23:45:00", "b", 1.0)],  # within the hour that is waited
        [("2024-01-03 12:00:00", "b", 3.0)],
        [("2024-01-03 13:00:00", "b", 0.5)],  # a batch later rows are held against the watermark that closed the windows
        [("2024-01-01 10:00:00", "a", 100.0)],
        [("2024-01-05 12:00:00", "a", 1.0)],
    ]
    for i, rows in enumerate(batches):
        path = folder / f"{i}.json"
        path.write_text("\n".join(json.dumps(dict(zip(("at", "level", "weight"), r))) for r in rows))
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    found = windowed_marginals(stream, "at", "level", "weight")
    asked = found.writeStream.format("memory").queryName("marginals_out").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert asked.awaitTermination(120)
    out = spark.table("marginals_out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "level", "weight", "records")
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("2024-01-01", "a", 3.5, 2), ("2024-01-01", "b", 5.0, 2), ("2024-01-02", "a", 1.0, 1), ("2024-01-03", "b", 3.5, 2)]
    spark.catalog.dropTempView("marginals_out")


def test_a_table_gives_every_window(spark):
    rows = spark.createDataFrame([("2024-01-01 05:00:00", "a", 1.0), ("2024-01-03 05:00:00", "a", 2.0), ("2024-01-03 06:00:00", None, 2.0)], "at string, level string, weight double").withColumn("at", F.to_timestamp("at"))
    assert sorted((r["level"], r["weight"], r["records"]) for r in windowed_marginals(rows, "at", "level", "weight").collect()) == [("a", 1.0, 1), ("a", 2.0, 1)]
