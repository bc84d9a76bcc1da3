"""What sampling steps have matched so far, kept between the micro-batches of a stream.

The counts after each batch are a table of their own, named by the batch: a batch that runs again starts from the same counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SamplingState:
    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...]) -> None:
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def _path(self, batch: int, line: int) -> str:
        return f"{self.folder}/step={line}/batch={batch:019d}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def before(self, batch: int, line: int) -> DataFrame | None:
        """Counts by key set after the batch before; None at the start."""
        path = self._path(batch - 1, line)
        return self.spark.read.parquet(path) if batch > 0 and self._exists(path) else None

    def after(self, batch: int, line: int, records: DataFrame) -> None:
        """Adds what this batch matched, from records with the mark `_mr_matched<line>`."""
        keys = [F.col(f"`{k}`") for k in self.keys]
        now = records.filter(F.col(f"_mr_matched{line}")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_mr_seen"))
        old = self.before(batch, line)
        if old is not None:
            now = old.unionByName(now).groupBy(*keys).agg(F.sum("_mr_seen").alias("_mr_seen"))
        now.write.mode("overwrite").parquet(self._path(batch, line))
