"""Results that grow batch by batch and are whole at every moment.

Each micro-batch writes its results to a folder of its own and then its number to a
ledger.  What is read are the batches of the ledger, so a batch that broke off is not there,
one that is repeated (as a stream does that is taken up after a loss) replaces what it left, and one
that the ledger has is not worked on again.  Papers that have a result are left out beforehand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Results:
    """A table of results in a folder, with rows of ``schema``; ``key`` names what has one result."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "paper_id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def ledger(self) -> DataFrame:
        """(batch, n) of the batches that are whole."""
        if not self._there(f"{self.path}/ledger"):
            return self.spark.createDataFrame([], "batch long, n long")
        return self.spark.read.schema("batch long, n long").json(f"{self.path}/ledger/*.json")

    def read(self) -> DataFrame:
        if not self._there(f"{self.path}/rows"):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.path}/rows")
        return rows.join(F.broadcast(self.ledger().select("batch")), "batch", "left_semi").drop("batch")

    def put(self, rows: DataFrame, batch: int, work: Callable[[DataFrame], DataFrame]) -> None:
        """The results of a batch's rows that have none yet, once."""
        if self._there(f"{self.path}/ledger/{batch}.json"):
            return
        new = rows.dropDuplicates([self.key]).join(self.read().select(self.key), self.key, "left_anti")
        at = f"{self.path}/rows/batch={batch}"
        work(new).write.mode("overwrite").parquet(at)
        self._enter(batch, self.spark.read.parquet(at).count())

    def _enter(self, batch: int, n: int) -> None:
        """A line of the ledger, there as a whole or not at all."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        passing, line = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger/{x}") for x in (f"_{batch}.passing", f"{batch}.json"))
        store = passing.getFileSystem(conf)
        out = store.create(passing, True)
        out.write(f'{{"batch": {batch}, "n": {n}}}\n'.encode())
        out.close()
        if not store.rename(passing, line):
            raise OSError(f"the ledger does not take batch {batch}")

    def follow(self, stream: DataFrame, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
        """Everything that is there now; a later call goes on from the checkpoint."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.put(rows, batch, work)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
