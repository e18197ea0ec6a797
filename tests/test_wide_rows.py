"""Feature vectors are computed once and dealt by their number, not by their compressed bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardweir.operators import joins, metrics
from cardweir.sources import files


def _vectors(spark, rows):
    return spark.range(rows).select(
        F.format_string("evt_%05d", "id").alias("event_id"), F.lit(7).cast("long").alias("occurred_at_ms"), (F.col("id") % 5).alias("x"), F.lit(0).cast("long").alias("y")
    )


def test_distributions_read_the_features_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def seen(x):
        computed.add(1)
        return x

    features = _vectors(spark, 100).withColumn("x", F.udf(seen, "long")("x"))
    got = {r.feature: tuple(r) for r in metrics.feature_distributions(features, ["x", "y"]).collect()}
    assert got == {"x": ("x", 0, 4, 2, 4, 4, 20), "y": ("y", 0, 0, 0, 0, 0, 100)}
    assert computed.value == 100


def test_labels_join_tasks_of_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(joins, "WIDE_ROWS_PER_TASK", 50)
    labels = _vectors(spark, 1000).select("event_id", "occurred_at_ms", F.lit("train").alias("split"))
    joined = joins.join_labels(_vectors(spark, 1000).drop("occurred_at_ms"), labels)
    assert joined.count() == 1000
    rows = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) == 20 and max(rows) < 150


def test_written_vectors_of_one_instant_go_to_several_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "WIDE_ROWS_PER_TASK", 50)
    for rows, name in ((None, "counted"), (1000, "given")):
        path = str(tmp_path / name)
        files.write_features(_vectors(spark, 1000), path, rows)
        written = spark.read.parquet(path)
        per_file = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
        assert written.distinct().count() == 1000 and len(per_file) >= 10 and max(per_file) < 200
