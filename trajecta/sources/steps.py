"""Tables between the steps of one job, in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Steps:
    """Writes tables and reads them back, so that a loop's lineage stays short and a lost executor costs no earlier step."""

    def __init__(self, spark: SparkSession, name: str):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        self.spark, self.path, self.places = spark, f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}", []

    def table(self, df: DataFrame) -> DataFrame:
        place = f"{self.path}/{len(self.places)}"
        df.write.parquet(place)
        back = self.spark.read.schema(df.schema).parquet(place)
        self.places.append((back, place))
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for back, place in self.places:
            if any(back is t for t in tables):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
