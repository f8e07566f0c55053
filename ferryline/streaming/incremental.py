"""Mapping and validation on a stream: both are stateless, so the batch operators run unchanged."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.mapping import Template, apply_mapping
from ..operators.validation import validate


def validate_stream(source: DataFrame, template: Template, reference: date) -> DataFrame:
    """``source``, a streaming DataFrame of source columns, mapped and validated row by row."""
    return validate(apply_mapping(source, template), template.entity, reference)


def write_stream(validated: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet split by is_valid; files and progress are committed together per batch."""
    return validated.writeStream.format("parquet").partitionBy("is_valid").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
