"""The webhook landing table: raw body, signature, provider id and content type of each call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardweir.operators.webhooks import MAXIMUM_BODY_BYTES

LANDING_SCHEMA = (
    "call_no bigint, provider_event_id string, content_type string, body string,"
    " received_at_ms bigint, signature string"
)


def within_size(calls: DataFrame, maximum_bytes: int = MAXIMUM_BODY_BYTES) -> DataFrame:
    """Calls whose body fits; larger ones stay in the landing table and are reported by screening."""
    return calls.filter(F.octet_length("body") <= maximum_bytes)


def read_webhook_landing(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(LANDING_SCHEMA).parquet(path)
