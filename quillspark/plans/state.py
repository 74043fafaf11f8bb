"""Where a run stands: its settings, and what each phase has done, in a folder that Spark can write.

A phase's table is its own marker: Spark's committer leaves ``_SUCCESS`` only when
all of it is there, so a run that is taken up again reads finished phases and does the rest.
"""

from __future__ import annotations

import dataclasses
import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Phases in order (fixed values).
PHASES = ("A", "B1", "B2", "C", "D", "E", "F", "F2", "G")
#: Which phases a mode runs.
MODES = {"dry": ("A", "B1", "E", "F", "G"), "lite": ("A", "B1", "B2", "C", "D", "E", "F", "G"), "full": PHASES}


@dataclasses.dataclass
class Config:
    """Settings: defaults, then a JSON file, then the environment (``QUILLSPARK_`` and the name in capitals)."""

    query: str = ""
    mode: str = "dry"
    year_min: int = 2018
    year_max: int | None = None
    papers: int = 50
    top: int = 8
    searches: int = 4
    review_gate: float = 3.0
    now: int = 2026
    title_only: bool = False

    @classmethod
    def load(cls, path: str | None = None, environment: dict[str, str] | None = None, **given: Any) -> "Config":
        env = os.environ if environment is None else environment
        found: dict[str, Any] = {}
        if path:
            with open(path, encoding="utf-8") as f:
                # ${NAME} in a value is the environment's; unknown names stay as they are
                found = json.loads(re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), f.read()))
        fields = {f.name: f for f in dataclasses.fields(cls)}
        for name, f in fields.items():
            said = env.get(f"QUILLSPARK_{name.upper()}")
            if said is not None:
                kind = type(f.default) if f.default is not None else int
                found[name] = said.lower() in ("1", "true", "yes") if kind is bool else kind(said)
        unknown = set(found) - set(fields)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**found | given)


class Run:
    """The tables of a run under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def done(self, name: str) -> bool:
        system, path = self._file(f"{name}/_SUCCESS")
        return bool(system.exists(path))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def phase(self, name: str, make) -> DataFrame:
        """The phase's table: read if it is finished, else made and written."""
        if not self.done(name):
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.table(name)

    def note(self, name: str, text: str) -> None:
        """A short text, written whole or not at all (a temporary name, then a rename)."""
        system, path = self._file(name)
        _, part = self._file(f".{name}.part")
        out = system.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        # one rename that replaces: the old note or the new one is there at any time
        jvm, whole = self.spark._jvm, [system.makeQualified(p) for p in (part, path)]
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.valueOf("OVERWRITE")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole[1].toUri(), self.spark._jsc.hadoopConfiguration()).rename(*whole, how)

    def status(self) -> dict[str, str]:
        return {p: "done" if self.done(p) else "pending" for p in PHASES}
