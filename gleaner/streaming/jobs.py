"""Submitted jobs as a stream: JSON lines from a folder, validated as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import jobs as J

BODY = f"op string, trace_id string, timeout_ms long, args struct<{', '.join(p.replace(' ', ': ', 1) for p in J.ARGS.split(', '))}>"


def parsed(lines: DataFrame) -> DataFrame:
    """Jobs of a column ``value`` of JSON: op, trace_id, args, timeout_ms and problem, null for a good one."""
    body = F.from_json("value", BODY)
    rows = lines.select(body.alias("b")).select("b.*")
    args = F.coalesce("args", F.from_json(F.lit("{}"), J.ARGS))
    told = rows.withColumn("args", args).withColumn("problem", F.when(F.col("op").isNull(), "body is no job").otherwise(J.problem(F.col("op"), F.col("args"))))
    return told.withColumn("timeout_ms", J.timeout_ms(F.col("op"), F.coalesce("timeout_ms", F.lit(0))))


def submitted(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """The stream of a folder that job files are put into; a file is one micro-batch's at most."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_a_trigger).load(path)
    return parsed(lines)
