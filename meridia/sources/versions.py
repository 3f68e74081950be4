"""Tables in versions: a write is seen whole or not at all.

A version is a folder of parquet files, written beside the others under a name that no reader
looks at, and committed by one rename to the next number; the highest number is the table. A
writer that dies leaves its unnamed folder and nothing else; two that commit at once get one
number between them, and the second fails. A write of what is there already makes no
version, so that a job can be run again. ``upsert`` and ``replace_source`` are such writes."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import joins


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._at("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of the committed versions, in order."""
        fs, root = self._files(), self._at("")
        if not fs.exists(root):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(root))
        return sorted(int(m[1]) for m in map(re.compile(r"v([0-9]{8})").fullmatch, names) if m)

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version, the last if not said which; None where there is none."""
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.path}/v{version or known[-1]:08d}")

    @staticmethod
    def content(df: DataFrame) -> tuple:
        """What tells two contents apart: rows, and a sum of their hashes in any order."""
        row = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)])
        return tuple(df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()) + (tuple(sorted(df.dtypes)),)

    def write(self, df: DataFrame) -> int:
        """Commits df as the next version, unless it is what the last one holds; its number."""
        known = self.versions()
        staged = f"_staged-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{staged}")
        made = self.spark.read.parquet(f"{self.path}/{staged}")
        if known and self.content(made) == self.content(self.read(known[-1])):
            self._files().delete(self._at(staged), True)
            return known[-1]
        number = (known[-1] if known else 0) + 1
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        # without the option to overwrite: a number that another writer has taken is an error
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        to = self._at(f"v{number:08d}")
        if self._files().exists(to):
            raise FileExistsError(f"version {number} of {self.path} was committed meanwhile")
        context.rename(self._at(staged), to, none)
        return number

    def upsert(self, rows: DataFrame, key: str) -> int:
        old = self.read()
        return self.write(rows if old is None else joins.upsert(old, rows.select(*old.columns), key))

    def replace_source(self, rows: DataFrame, column: str, value: str) -> int:
        old = self.read()
        return self.write(rows if old is None else joins.replace_source(old, rows.select(*old.columns), column, value))

    def prune(self, keep: int = 2) -> None:
        """Deletes all but the last versions, and what dead writers have left."""
        fs, last = self._files(), {f"v{n:08d}" for n in self.versions()[-keep:]}
        for s in fs.listStatus(self._at("")):
            if s.getPath().getName() not in last:
                fs.delete(s.getPath(), True)


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that df has rows of, and leaves the others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
