"""The current-flow table kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.flowtable import current_flows, expire_flows, merge_flows


class CurrentFlows:
    """Versions of the current-flow table in a folder, one written by each micro-batch.

    Batch k merges its newest statistics per flow into version k - 1 and drops flows not seen for `ttl_secs` before
    the newest packet so far. It overwrites the place k modulo `keep`, never the one it reads, so a batch that
    is run again after a failure gives the same version again. A version counts once its row in `commits` is
    written. The table holds the flows of one time-to-live, whatever the length of the stream.
    """

    def __init__(self, path: str, ttl_secs: int | None = 30, keep: int = 3):
        if keep < 2:
            raise ValueError("a version is written beside the one before")
        self.path, self.ttl_secs, self.keep = path, ttl_secs, keep

    def _place(self, version: int, kind: str) -> str:
        return f"{self.path}/{kind}/{version % self.keep}"

    def merge(self, stats: DataFrame, batch_id: int) -> None:
        """For `foreachBatch`: rows of `stream_flow_stats`, in any order and any number per flow."""
        spark, arrived = stats.sparkSession, f"{self.path}/arrived"
        newest = current_flows(stats)
        newest.write.mode("overwrite").parquet(arrived)  # the micro-batch runs once
        new = spark.read.schema(newest.schema).parquet(arrived)
        if batch_id > 0:
            held = spark.read.schema(newest.schema).parquet(self._place(batch_id - 1, "versions"))
            new = merge_flows(held, new)
        if self.ttl_secs is not None:
            # the newest flow of all is always held, so the table itself tells the time
            now = new.agg(F.max("last_seen")).scalar()
            new = expire_flows(new, now, self.ttl_secs)
        new.write.mode("overwrite").parquet(self._place(batch_id, "versions"))
        done = spark.createDataFrame([(batch_id,)], "version long")
        done.coalesce(1).write.mode("overwrite").parquet(self._place(batch_id, "commits"))

    def version(self, spark: SparkSession) -> int | None:
        """The newest complete version."""
        found = spark.read.schema("version long").option("recursiveFileLookup", True).parquet(f"{self.path}/commits")
        return found.agg(F.max("version")).first()[0]

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the newest complete version."""
        return spark.read.parquet(self._place(self.version(spark), "versions"))


def write_current_flows(stats: DataFrame, table: CurrentFlows, checkpoint: str, **trigger) -> StreamingQuery:
    """Start keeping `table` up to date with a stream of flow statistics."""
    writer = stats.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(table.merge)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
