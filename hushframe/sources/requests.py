"""Sources and sinks: request bodies, text tables, masked output, audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_requests(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """JSON lines as ``body`` (as written) and ``session`` (a top-level field, if named)."""
    lines = spark.read.text(path).withColumnRenamed("value", "body")
    return lines.withColumn("session", F.get_json_object("body", f"$.{session}")) if session else lines


def split_valid(requests: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Bodies that are JSON objects, and the rejected rest with a reason."""
    kind = F.schema_of_variant(F.try_parse_json(F.col(body)))
    good = F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
    return requests.filter(good), requests.filter(~good).withColumn("error", F.lit("Invalid JSON body"))


def read_texts(spark: SparkSession, path: str, source: str = "parquet", **options) -> DataFrame:
    return spark.read.format(source).options(**options).load(path)


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """Files of JSON lines as they arrive."""
    return spark.readStream.text(path).withColumnRenamed("value", "body")


def write_masked(df: DataFrame, path: str, source: str = "json", mode: str = "append") -> None:
    df.write.format(source).mode(mode).save(path)


def write_audit(events: DataFrame, path: str, batch: int | None = None) -> None:
    """Audit events as JSON lines: appended, or as the batch of that number, which replaces what an earlier try of it left."""
    lines = events.select(F.to_json(F.struct("timestamp", "category", "placeholder", "confidence", "position", "mode", "reviewRequired")).alias("value")).write
    if batch is None:
        lines.mode("append").text(path)
    else:
        lines.mode("overwrite").text(f"{path}/batch={batch}")


def audit_stream(events: DataFrame, path: str, checkpoint: str):
    """The same for a stream. Each micro-batch has a folder of its own, so one that Spark repeats after a failure is there once."""
    return events.writeStream.foreachBatch(lambda rows, batch: write_audit(rows, path, batch)).option("checkpointLocation", checkpoint)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Events written by ``write_audit``."""
    kinds = "timestamp string, category string, placeholder string, confidence double, position struct<start: int, end: int>, mode string, reviewRequired boolean"
    return spark.read.schema(kinds).json(path)


def valid_analyze_input(body: Column) -> Column:
    """True where a body's ``text`` is a string."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.text", "variant")) == "STRING", F.lit(False))
