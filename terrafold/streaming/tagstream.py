"""Tag queries and boxes on streams of features. They are stateless, so they run on a stream as they do on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.box import Box
from ..operators.tagquery import compile_query
from ..sources.library import FEATURES


def read_features(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the features that are added below a folder of Parquet files."""
    return spark.readStream.schema(FEATURES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def matching(stream: DataFrame, query: str, box: Box | None = None) -> DataFrame:
    found = stream.where(compile_query(query))
    return found if box is None else found.where(box.touches())
