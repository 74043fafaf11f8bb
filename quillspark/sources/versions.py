"""A table of versions in order of ``seq``: a base and what came after it, merged when read.

Each append is a part, a folder of Parquet files of its own, whose rows are numbered on from
the last one.  A list of the parts with their first and last ``seq`` and their rows is the table's state: it
is written under a new number, whole and by a rename that replaces nothing, so an append that breaks off
leaves the table as it was, a reader sees one state, and of two writers at once the later one fails.  Parts do not overlap,
so the newest rows lie in the last parts, and only these are read for them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import latest
from ..operators.ranking import ranked
from .tables import stored


@dataclass(frozen=True)
class Part:
    path: str
    lo: int
    hi: int
    n: int


class Versions:
    """Rows of ``schema``, which has no ``seq``, with a version each; ``key`` names what a version is of.

    Rows without a key are in the log (``newest``) and are no version of anything (``current``).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"{schema}, seq long"

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _states(self) -> list[int]:
        store, folder = self._file("state")
        if not store.exists(folder):
            return []
        names = [f.getPath().getName() for f in store.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(("_", ".")))

    def parts(self) -> tuple[int, list[Part]]:
        """The number of the state and its parts, oldest first."""
        found = self._states()
        if not found:
            return 0, []
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/state/{found[-1]}.json").first()[0]
        return found[-1], [Part(**p) for p in json.loads(text)]

    def _enter(self, number: int, parts: list[Part]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        store, passing = self._file(f"state/_{uuid.uuid4().hex}.passing")
        _, whole = self._file(f"state/{number}.json")
        out = store.create(passing, True)
        try:
            out.write(bytearray(json.dumps([asdict(p) for p in parts]).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        one, other = store.makeQualified(passing), store.makeQualified(whole)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(other.toUri(), conf).rename(one, other, none)

    def _read(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p.path}" for p in parts))

    def append(self, rows: DataFrame, *order: Column | str) -> None:
        """Rows after the last one, numbered in their ``order``, which should leave no ties; none leave the state as it is."""
        number, parts = self.parts()
        last = parts[-1].hi if parts else 0
        name = f"rows/{uuid.uuid4().hex}"
        placed = ranked(rows, *order, name="_place").withColumn("seq", F.col("_place") + F.lit(last)).drop("_place")
        columns = self.spark.createDataFrame([], self.schema).columns
        placed.select(*columns).write.parquet(f"{self.path}/{name}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").count()
        if n:
            self._enter(number + 1, [*parts, Part(name, last + 1, last + n, n)])

    def log(self) -> DataFrame:
        """All rows of the state; after ``compact`` those that were replaced before it are gone."""
        return self._read(self.parts()[1])

    def newest(self, n: int) -> DataFrame:
        """The last n rows, newest first, read from the last parts that hold n."""
        held, need = [], n
        for p in reversed(self.parts()[1]):
            if need <= 0:
                break
            held.append(p)
            need -= p.n
        return self._read(held).orderBy(F.desc("seq")).limit(n)

    def current(self) -> DataFrame:
        """The last version of each key."""
        return latest(self.log().where(F.col(self.key).isNotNull()), self.key)

    def newest_current(self, n: int) -> DataFrame:
        """The n keys changed last, by their last versions, newest first.

        What replaces a row comes after it, so the last parts alone say which of their rows stand; more parts
        are read, twice as many each time, until n keys are found.
        """
        parts = self.parts()[1]
        take = 1
        while True:
            rows = latest(self._read(parts[-take:]).where(F.col(self.key).isNotNull()), self.key)
            found = rows.orderBy(F.desc("seq")).limit(n)
            if take >= len(parts) or found.count() >= n:
                return found
            take *= 2

    def compact(self, per: int = 1 << 22) -> None:
        """The current rows, and those without a key, as the base, in parts of ``per`` rows (more, where that would make over 1,000) in order of ``seq``.

        Rows keep their numbers.  Folders of states before are left to readers that have them.
        """
        number, parts = self.parts()
        if not parts:
            return
        name = f"rows/{uuid.uuid4().hex}"
        all_ = self._read(parts)
        rows = stored(latest(all_.where(F.col(self.key).isNotNull()), self.key).unionByName(all_.where(F.col(self.key).isNull())), "versions")
        per = max(per, -(-rows.count() // 1000))
        banded = ranked(rows, "seq", name="_place").withColumn("band", F.floor((F.col("_place") - 1) / per)).drop("_place")
        banded.write.partitionBy("band").parquet(f"{self.path}/{name}")
        bands = self.spark.read.parquet(f"{self.path}/{name}").groupBy("band").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n")).orderBy("band").collect()
        base = [Part(f"{name}/band={b['band']}", b["lo"], b["hi"], b["n"]) for b in bands]
        # numbers go on from the last one given, also where its row is gone
        base[-1] = Part(base[-1].path, base[-1].lo, parts[-1].hi, base[-1].n)
        self._enter(number + 1, base)
