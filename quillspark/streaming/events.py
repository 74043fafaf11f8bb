"""The event log as a stream: readers, per-phase counters, and (beyond the reference engine's scope) time windows.

Every transformation takes a batch or a stream alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import model
from ..operators import reports
from ..operators.screening import CORE
from ..functions.text import hits, text_or_empty

RAW = "value string"
#: Groups of keys that have one state in ``first_by_time``.
BUCKETS = 256


def parsed(lines: DataFrame) -> DataFrame:
    """JSON lines (value) to events (t, e, p, rest); lines that are no event go."""
    whole = F.from_json("value", "map<string,string>")
    rows = lines.select(F.get_json_object("value", "$.t").try_cast("timestamp").alias("t"), F.get_json_object("value", "$.e").alias("e"), F.get_json_object("value", "$.p").alias("p"), whole.alias("rest"))
    return rows.where("t IS NOT NULL AND e IS NOT NULL").withColumn("rest", F.map_filter("rest", lambda k, v: ~k.isin("t", "e", "p")))


def read(spark: SparkSession, path: str, stream: bool = False, files: int | None = None) -> DataFrame:
    """A log as a batch or a stream; ``files`` bounds what a micro-batch takes."""
    if not stream:
        return parsed(spark.read.text(path))
    source = spark.readStream.schema(RAW)
    return parsed((source.option("maxFilesPerTrigger", files) if files else source).text(path))


def append(events: DataFrame, path: str) -> None:
    """Events (t, e, p, rest) appended as JSON lines."""
    whole = F.map_concat(F.map_from_arrays(F.array(*map(F.lit, ("t", "e", "p"))), F.array(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "e", "p")), F.coalesce("rest", F.create_map().cast("map<string,string>")))
    events.select(F.to_json(F.map_filter(whole, lambda k, v: v.isNotNull())).alias("value")).write.mode("append").text(path)


def counters(events: DataFrame) -> DataFrame:
    return reports.phase_counters(events)


def keyword_pass(papers: DataFrame, least: int = 2) -> DataFrame:
    """Papers with enough core words, line by line: no state, so the same on a stream."""
    whole = F.lower(F.concat_ws(" ", text_or_empty(F.col("title")), text_or_empty(F.col("abstract"))))
    return papers.where(hits(whole, [w.lower() for w in CORE]) >= least)


def _watched(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark, which needs times with a zone; a batch as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, *, time: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, n, total) of tumbling windows; on a stream events later than ``late`` are dropped."""
    rows = _watched(events, time, late)
    out = rows.groupBy(F.window(time, width).alias("w"), F.col(kind)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def first_seen(events: DataFrame, keys: list[str], *, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first event of each key; on a stream, within the watermark."""
    return _watched(events, time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def first_by_time(events: DataFrame, keys: list[str], *, time: str = "ts", order: str = "event_id", late: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """(keys, order, time): each key's first event by time and ``order``.

    On a stream each key has a state, the first event so far; the states of a bucket of keys lie together, as a
    call of Python costs far more than a key.  An event that comes before it corrects
    it: the key is put out again, and ``settled`` takes the last word.  What comes after the watermark has passed its time
    counts no more.  A key that has had its last event a watermark ago keeps its state, so that it is never first twice.
    """
    rows = events.select(*keys, order, F.col(time).cast("timestamp").alias(time))
    if not events.isStreaming:
        return settled(rows, keys, time=time, order=order)
    kinds = {f.name: f.dataType for f in rows.schema}
    named = [f"_k{i}" for i in range(len(keys))]

    def run(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best: dict[tuple, tuple[int, int]] = pickle.loads(state.get[0]) if state.exists else {}
        new = {}
        for rows in frames:
            first = rows.sort_values(["_at", "_order"]).drop_duplicates(named)
            for key, now in zip(zip(*(first[k] for k in named), strict=True), zip(first["_at"].tolist(), first["_order"].tolist(), strict=True), strict=True):
                if key not in best or now < best[key]:
                    best[key] = new[key] = now
        if new:
            state.update((pickle.dumps(best),))
            yield pd.DataFrame([(*k, *v) for k, v in new.items()], columns=[*named, "_at", "_order"])

    # keys as texts, which keep their nulls in a frame of several keys
    watched = rows.withWatermark(time, late).select(time, *[F.col(k).cast("string").alias(n) for k, n in zip(keys, named, strict=True)], F.unix_micros(time).alias("_at"), F.col(order).cast("long").alias("_order"))
    watched = watched.withColumn("_bucket", F.pmod(F.xxhash64(*named), F.lit(buckets)))
    out = ", ".join([*(f"{n} string" for n in named), "_at long", "_order long"])
    found = watched.groupBy("_bucket").applyInPandasWithState(run, out, "best binary", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*[F.col(n).cast(kinds[k]).alias(k) for k, n in zip(keys, named, strict=True)], F.col("_order").cast(kinds[order]).alias(order), F.timestamp_micros("_at").alias(time))


def settled(found: DataFrame, keys: list[str], *, time: str = "ts", order: str = "event_id") -> DataFrame:
    """What ``first_by_time`` put out, a row a key."""
    return found.groupBy(*keys).agg(F.min(F.struct(time, order)).alias("_f")).select(*keys, F.col(f"_f.{order}").alias(order), F.col(f"_f.{time}").alias(time))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", form: str = "parquet") -> StreamingQuery:
    """Everything that is there now, exactly once: a run that is taken up again goes on from its checkpoint."""
    return stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
