"""A log of batches below one folder, for streams that write by foreachBatch.

Each batch has a folder named by its query and number, so replaying it changes nothing. A log
takes one query, the one of its checkpoint; another one, or a lost checkpoint, is refused,
for it would number its batches from zero again and overwrite or mix with the old ones.
Compaction merges old batches into a generation, a folder that counts only once Spark has
finished writing it; what it covers is removed by the compaction after the next, so readers
that began before still find their files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, types as T

from wattframe.functions.sizes import drop_folder, folder_names


class ForeignLog(ValueError):
    """A log that another query writes to."""


@dataclass(frozen=True)
class BatchLog:
    """Folders of one query: batches by number, generations by the last batch they cover."""

    spark: SparkSession
    path: str
    query: str
    partitions: tuple[str, ...] = ()

    @property
    def folder(self) -> str:
        return f"{self.path}/query={self.query}"

    def batch(self, number: int) -> str:
        return f"{self.folder}/batch={number}"

    def generation(self, last: int) -> str:
        return f"{self.folder}/generation={last}"

    def _numbers(self, kind: str) -> list[int]:
        names = folder_names(self.spark, self.folder)
        found = [int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}=")]
        done = [n for n in found if "_SUCCESS" in folder_names(self.spark, f"{self.folder}/{kind}={n}")]
        return sorted(done)

    def batches(self) -> list[int]:
        return self._numbers("batch")

    def generations(self) -> list[int]:
        return self._numbers("generation")

    def folders(self, before: int | None = None) -> list[str]:
        """What holds every batch once: the newest generation and the batches after it."""
        covered = [g for g in self.generations() if before is None or g < before]
        last = covered[-1] if covered else -1
        rest = [b for b in self.batches() if b > last and (before is None or b < before)]
        return [self.generation(last)] * bool(covered) + [self.batch(b) for b in rest]

    def read(self, schema: T.StructType | str, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before a number."""
        folders, read = self.folders(before), self.spark.read.schema(schema)
        if not folders:
            return self.spark.createDataFrame([], schema)
        if self.partitions:
            return reduce(DataFrame.unionByName, (read.parquet(folder) for folder in folders))
        return read.parquet(*folders)

    def write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").partitionBy(*self.partitions).parquet(folder)

    def compact(self, schema: T.StructType | str, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Merge all finished batches into a new generation and drop what the last one covered.

        Readers get the old folders until the new one is finished, and then the new one; a
        crash leaves an unfinished folder that nobody reads. The newest batch stays apart, as a
        query that restarts may write it again.
        """
        batches, generations = self.batches(), self.generations()
        last = batches[-2] if len(batches) > 1 else -1
        if last <= (generations[-1] if generations else -1):
            return
        self.write(merge(self.read(schema, before=last + 1)), self.generation(last))
        covered = generations[-1] if generations else -1
        for old in generations[:-1]:
            drop_folder(self.spark, self.generation(old))
        for old in batches:
            if old <= covered:
                drop_folder(self.spark, self.batch(old))


def own_log(spark: SparkSession, path: str, *partitions: str) -> BatchLog:
    """The log of the running query; refused if another query has written to it."""
    own = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    others = [q for q in _queries(spark, path) if q != own]
    if others:
        raise ForeignLog(f"{path} belongs to query {others[0]}")
    return BatchLog(spark, path, own, partitions)


def only_log(spark: SparkSession, path: str, *partitions: str) -> BatchLog:
    """The log at a path, for readers."""
    queries = _queries(spark, path)
    return BatchLog(spark, path, queries[0] if queries else "none", partitions)


def _queries(spark: SparkSession, path: str) -> list[str]:
    return [n.removeprefix("query=") for n in folder_names(spark, path) if n.startswith("query=")]
