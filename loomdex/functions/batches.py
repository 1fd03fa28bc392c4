"""What one Arrow batch of texts may hold."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_ROWS, BATCH_BYTES = 500, 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, by rows and bytes, however long a partition is; lower settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(name, None)
        if held is None or not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(name, str(most))
