"""Sessions as streams: windows that close after a time of inactivity, and lives of sessions with puts, gets and deletes."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of events in the order in which those of one moment count.
KINDS = ("delete", "put", "get")
LIFE = "session_key string, first_ts timestamp, last_ts timestamp, n bigint, deleted boolean"


def session_stream(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """``events`` (session_key, ts) as a stream: a row for each session once the watermark has passed its end."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = rows.groupBy("session_key", F.session_window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return found.select("session_key", F.col("w.start").alias("first_ts"), F.col("w.end").alias("expires_at"), "n")


class Lives(StatefulProcessor):
    """Keeps a session's life as a value, and events that the watermark has not passed yet as a list.

    Events wait until the watermark passes them and then count in order of time, so that out-of-order ones do no harm. A timer stands for each waiting
    moment and for the moment of expiry."""

    def __init__(self, seconds: int):
        self.us = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "first bigint, last bigint, n bigint")
        self.waiting = handle.getListState("waiting", "us bigint, kind int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["us"], r["kind"]) for r in rows]
        self.waiting.appendList(new)
        for ms in {us // 1_000 + 1 for us, _ in new}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1_000  # all events up to here are known
        held = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [e for e in held if e[0] <= now], [e for e in held if e[0] > now]
        life, out = (tuple(self.life.get()) if self.life.exists() else None), []
        for us, kind in due:
            if life and us - life[1] >= self.us:
                out.append(self.ended(key, life, False))
                life = None
            if KINDS[kind] == "delete":
                out += [self.ended(key, life, True)] if life else []
                life = None
            elif life:
                life = (life[0], us, life[2] + 1)
            elif KINDS[kind] == "put":
                life = (us, us, 1)
        if life and now >= life[1] + self.us and not any(us < life[1] + self.us for us, _ in later):
            out.append(self.ended(key, life, False))
            life = None
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if life:
            self.life.update(life)
            self.handle.registerTimer((life[1] + self.us) // 1_000 + 1)
        else:
            self.life.clear()
        return iter(out)

    @staticmethod
    def ended(key, life: tuple, deleted: bool) -> Row:
        at = lambda us: datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000)
        return Row(session_key=key[0], first_ts=at(life[0]), last_ts=at(life[1]), n=life[2], deleted=deleted)

    def close(self) -> None:
        pass


def life_stream(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """``operators.intake.session_lives`` of a stream of ``events`` (session_key, ts, kind): each life once the watermark has passed its end. Events later than ``late`` don't count.

    The session needs the state store for this, ``spark.sql.streaming.stateStore.providerClass`` of RocksDB (``use_rocksdb``)."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    rows = events.select(F.col("session_key").cast("string").alias("session_key"), F.col("ts").cast("timestamp").alias("ts"), order.alias("kind")).where("kind >= 0")
    rows = rows.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("session_key").transformWithState(Lives(seconds), outputStructType=LIFE, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_once(found: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; the folders must be shared by all executors."""
    found.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
