"""Writing: tables as immutable snapshots, so nothing is overwritten while it is read, and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    """A folder of snapshots with a pointer table; works on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[tuple[int, str]]:
        try:
            return sorted((r.version, r.folder) for r in self.spark.read.schema("version long, folder string").json(f"{self.path}/log").collect())
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.path}/{v[-1][1]}") if v else None

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Write a new snapshot, then name it in the log. One writer at a time."""
        v = self.versions()
        version, folder = (v[-1][0] + 1 if v else 0), f"data-{uuid.uuid4().hex}"
        out = df.write.partitionBy(*partition_by) if partition_by else df.write
        out.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(version, folder)], "version long, folder string").coalesce(1).write.mode("append").json(f"{self.path}/log")
        return version


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_project(df: DataFrame, path: str, column: str = "project_id") -> None:
    """Overwrite only the partitions of the projects in df."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def export_json(df: DataFrame, path: str, kind: str = "json") -> None:
    if kind != "json":
        raise ValueError(f"no export as {kind}")
    df.write.mode("error").json(path)


def catalog_tables(spark: SparkSession) -> DataFrame:
    """(table_schema, table_name, column_name, data_type) of the session's tables and views."""
    rows = [(t.namespace[0] if t.namespace else "", t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, data_type string")
