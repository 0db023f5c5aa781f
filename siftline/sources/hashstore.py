"""A hash cache in parts. A part counts once it is committed, so a scan that is killed loses only the part it was at."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.model import HASH_CACHE


class HashStore:
    """Parts below folder/parts, and the manifest: an empty file for each committed part in folder/commits.

    folder may be in any file system that Spark reaches. Writers don't disturb each other: each part has a name of its
    own, and of a path's rows the one of the part that began last counts.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *names: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def _files(self):  # noqa: ANN202
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Names of committed parts, in the order they began."""
        files, commits = self._files(), self._path("commits")
        return sorted(s.getPath().getName() for s in files.listStatus(commits)) if files.exists(commits) else []

    def rows(self, names: list[str]) -> DataFrame:
        schema = HASH_CACHE + ", part long"
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/parts/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The cache: of each path the row that was committed last."""
        last = F.max_by(F.struct("size", "mtime_ns", "hash"), F.struct("part", "mtime_ns"))
        return self.rows(self.committed()).groupBy("path").agg(last.alias("r")).select("path", "r.*")

    def append(self, rows: DataFrame) -> str:
        """Writes path, size, mtime_ns, hash as a part and commits it."""
        names = self.committed()
        number = int(names[-1].split("-")[0]) + 1 if names else 0
        name = f"{number:010d}-{uuid.uuid4().hex}"
        rows.select("path", "size", "mtime_ns", "hash", F.lit(number).cast("long").alias("part")).write.parquet(f"{self.folder}/parts/{name}")
        self._files().create(self._path("commits", name), False).close()
        return name

    def compact(self) -> None:
        """One part in place of all; for when no other scan reads or writes."""
        old = self.committed()
        self.append(self.read())
        for name in old:
            self._files().delete(self._path("commits", name), False)
            self._files().delete(self._path("parts", name), True)
