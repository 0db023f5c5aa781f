"""Past scans and actions.

Writers may run at once. Each claims an id by a file that only one can create, writes its rows to folders of their own, and commits them by another
such file; readers see committed rows alone, so a scan that is seen has all of its actions, and a writer that dies leaves
nothing but an id that isn't used.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.model import ACTIONS, SCANS


class _Ids:
    """Numbers that are files of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        jvm = spark._jvm
        self.path = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join((folder, *names)))
        self.files = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def all(self) -> list[int]:
        return sorted(int(s.getPath().getName()) for s in self.files.listStatus(self.path())) if self.files.exists(self.path()) else []

    def create(self, number: int) -> bool:
        """Whether the number is new, and so the caller's."""
        try:
            self.files.create(self.path(str(number)), False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or self.files.exists(self.path(str(number))):
                return False
            raise
        return True


def read(spark: SparkSession, folder: str, table: str = "scans") -> DataFrame:
    """A history table; empty where none was written yet."""
    schema = {"scans": SCANS, "actions": ACTIONS}[table]
    committed = _Ids(spark, f"{folder}/commits").all()
    key = {"scans": "id", "actions": "scan_id"}[table]
    try:
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/{table}")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.join(spark.createDataFrame([(i,) for i in committed], f"{key} long"), key, "left_semi").select(*rows.columns)


def claimed(spark: SparkSession, folder: str) -> int:
    """An id that no other writer has."""
    ids = _Ids(spark, f"{folder}/claims")
    number = max(ids.all(), default=0) + 1
    while not ids.create(number):
        number += 1
    return number


def record(spark: SparkSession, folder: str, scan: dict, actions: DataFrame | None = None) -> int:
    """Adds a scan, and path, kind, bytes, succeeded, error of what it applied; gives its id. All of it is seen at once."""
    scan_id = claimed(spark, folder)
    if actions is not None:
        rows = actions.select(F.xxhash64(F.lit(scan_id), "path").alias("id"), F.lit(scan_id).cast("long").alias("scan_id"), "path", "kind", "bytes", "succeeded", "error")
        rows.write.parquet(f"{folder}/actions/{scan_id}")
    fields = [f.split()[0] for f in SCANS.split(", ")]
    spark.createDataFrame([tuple({**scan, "id": scan_id}.get(f) for f in fields)], SCANS).write.parquet(f"{folder}/scans/{scan_id}")
    _Ids(spark, f"{folder}/commits").create(scan_id)
    return scan_id


def latest(scans: DataFrame, limit: int = 20) -> DataFrame:
    """The newest scans first."""
    return scans.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def stats(scans: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Totals of the scans between two times, both included where given."""
    if since is not None:
        scans = scans.where(F.col("started_at") >= since)
    if until is not None:
        scans = scans.where(F.col("started_at") <= until)
    sums = ("files_scanned", "bytes_scanned", "duplicate_groups", "duplicate_files", "bytes_reclaimed", "files_acted_on")
    return scans.agg(F.count("*").alias("scans"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))


def exported(scans: DataFrame) -> list[str]:
    """The history as JSON documents, newest first."""
    return scans.orderBy(F.desc("started_at"), F.desc("id")).toJSON().collect()
