"""Flights as they land: incremental quality control and season sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.qc import QCParams, flight_qc


def read_flights(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """A stream of pixel tables written below path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def qc_stream(pixels: DataFrame, bands: Sequence[str], out: str, checkpoint: str, params: QCParams = QCParams(), keys: Sequence[str] = ("flight",), trigger: dict | None = None, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """QC of the flights of each batch, appended to out with the batch's number.

    A flight must land whole in a batch. A batch that runs again replaces its own folder.
    """

    def each(batch: DataFrame, number: int) -> None:
        summary = flight_qc(batch, bands, params, keys)
        summary.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if then:
            then(batch.sparkSession.read.parquet(f"{out}/batch={number}"), number)

    return pixels.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_means(pixels: DataFrame, time: str, value: str, delay: str = "2 days", every: str = "1 day") -> DataFrame:
    """window, n and mean of value by event time, with late rows up to delay."""
    w = pixels.withWatermark(time, delay).groupBy(F.window(time, every))
    return w.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")
