"""The volume report as a stream: files that arrive are reported once, also over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators import volumes as V


def volume_report(volumes: DataFrame, key: str, labels: str, voxel: float, most: int) -> DataFrame:
    """key and the volume of each level from 1 to `most`, of a table or a stream of label volumes."""
    return volumes.select(key, *[V.level_volume(F.col(labels), k, voxel).alias(f"segment{k}_mm3") for k in range(1, most + 1)])


def report_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "vec_id", labels: str = "lab", voxel: float = 1.0, most: int = 3) -> StreamingQuery:
    """Report the Parquet files of `source` that no earlier run with this checkpoint has seen, then stop; rows are appended to `target`."""
    report = volume_report(spark.readStream.schema(schema).parquet(source), key, labels, voxel, most)
    return report.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)


def report_to_tables(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "vec_id", labels: str = "lab", voxel: float = 1.0, most: int = 3) -> StreamingQuery:
    """The same as tab-separated files: each batch is a folder `batch=n` of its own, so a batch that runs again after a failure replaces its rows."""
    report = volume_report(spark.readStream.schema(schema).parquet(source), key, labels, voxel, most)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{target}/batch={batch}")

    return report.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
