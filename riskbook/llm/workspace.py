"""Tables that a job writes in the shared folder to cut lineage, and drops when done.

Inside ``run_folder`` they lie in the run's folder and go with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskbook.sources.staging import new_path


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Workspace:
    """One folder for the tables of one run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.names: set[str] = set()
        self.folder = new_path(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: later readers don't compute it again."""
        path = f"{self.folder}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables of this run that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            target = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            target.getFileSystem(conf).delete(target, True)
            self.names.discard(name)

    def keep_only(self, name: str) -> None:
        """Delete all tables of this run but one, which the caller goes on reading."""
        self.drop(*(self.names - {name}))
