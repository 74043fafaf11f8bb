"""Shared helpers: where intermediate tables go, and cheap size estimates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compact side tables up to this many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Tables up to this many bytes are dealt out to all cores.
SPREAD_BYTES = 64 << 20
#: Rows of texts in an Arrow batch.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and all of Spark is on this machine, as in tests, a
    temporary folder is made and recorded in the session; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("quillspark.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("quillspark.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: what is read later survives the loss of any executor, and
    costly work above it is not repeated by each consumer.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that no plan still to be run reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, for choosing partition counts; measured where it has none."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if found < 1 << 60:
        return found
    texts = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    row = F.lit(8 * len(df.columns)).cast("long")
    return df.agg(F.coalesce(F.sum(sum(texts, row)), F.lit(0))).first()[0]


def share(rows: int, of: int) -> int:
    """The largest 63-bit hash that draws about ``rows`` of ``of`` rows; fine enough for any number of rows."""
    return min((1 << 63) - 1, (rows << 63) // max(of, 1))


def drawn(largest: Column | int, *of: Column | str, seed: int) -> Column:
    """Whether a row's 63-bit hash is at most ``largest`` (see ``share``)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 1) <= (F.lit(largest) if isinstance(largest, int) else largest)


def bounded(spark: SparkSession) -> None:
    """Bound the rows that the session sends to Python at once.

    Spark's default of 10,000 rows is made for narrow rows; of texts of many kilobytes
    that is more than two workers of a small executor should hold beside its heap.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a query.

    A small one may be a single row group, which one task would read and work on alone;
    it is dealt out to all cores.  Larger tables are read in as many tasks as they have splits.
    """
    bounded(spark)
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return found.repartition(spark.sparkContext.defaultParallelism) if 1 << 20 < scan_bytes(found) < SPREAD_BYTES else found
