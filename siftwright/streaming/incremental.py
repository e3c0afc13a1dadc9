"""The same stages over documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def arriving(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    """A stream of Parquet files of documents."""
    return spark.readStream.schema(schema).parquet(path)


def squashed_fields(docs: DataFrame) -> DataFrame:
    """Stateless: works on a stream as on a table."""
    return docs.select("rel", X.squash(F.col("body")).alias("field"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """events(ts, event_type, value) -> counts and sums by window; events later than `late` are dropped."""
    t = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return t.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
