"""Intermediate tables in the shared folder, as the library makes them, and batches bounded by bytes."""

from pyspark.sql import SparkSession

from keystrand.plans.tables import deleted, dropped, folder, free, saved, shared_dir

__all__ = ["bounded_batches", "deleted", "dropped", "folder", "free", "saved", "shared_dir"]

#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 1 << 22
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, as texts may be long, unless they are bounded by fewer already."""
    if not 0 < int(spark.conf.get(BYTES_SETTING).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(BYTES_SETTING, str(BATCH_BYTES))
