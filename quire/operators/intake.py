"""Uploads and sessions: kinds, budgets, merged lists, activity and capacity."""

from __future__ import annotations

from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

# Suffixes and MIME types.
PDF_SUFFIXES, PDF_TYPES = (".pdf",), ("application/pdf", "application/x-pdf")
IMAGE_SUFFIXES, IMAGE_TYPES = (".jpg", ".jpeg", ".png", ".webp"), ("image/jpeg", "image/jpg", "image/pjpeg", "image/png", "image/webp")


def upload_kind(name: Column, content_type: Column) -> Column:
    """pdf, image or null; PDF is tested first, and parameters of the type don't count."""
    lower, mime = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    ends = lambda suffixes: F.greatest(F.lit(False), *(F.endswith(lower, F.lit(s)) for s in suffixes))
    return F.when(ends(PDF_SUFFIXES) | mime.isin(*PDF_TYPES), "pdf").when(ends(IMAGE_SUFFIXES) | mime.isin(*IMAGE_TYPES), "image")


def over_budget(uploads: DataFrame, most_bytes: int) -> DataFrame:
    """Adds the running size in file order, whether it exceeds the shared budget, and the file's state: EMPTY_FILE, FILE_TOO_LARGE (all that is read past the budget) or OK."""
    running = F.sum("size").over(Window.partitionBy("case_id").orderBy("file_pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = uploads.withColumn("used", running).withColumn("too_large", F.col("used") > most_bytes)
    return rows.withColumn("state", F.when(F.col("too_large"), "FILE_TOO_LARGE").when(F.coalesce(F.col("size"), F.lit(0)) == 0, "EMPTY_FILE").otherwise("OK"))


def upload_checks(uploads: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """Each case's upload with its first fault: TOO_MANY_FILES, UNKNOWN_KIND, FILE_TOO_LARGE, EMPTY_FILE, or OK."""
    kind = upload_kind(F.col("filename"), F.col("content_type"))
    sums = uploads.groupBy("case_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(kind.isNull()).alias("unknown"), F.count_if(F.coalesce(F.col("size"), F.lit(0)) == 0).alias("empty"))
    state = (
        F.when(F.col("files") > most_files, "TOO_MANY_FILES").when(F.col("unknown") > 0, "UNKNOWN_KIND").when(F.col("bytes") > most_bytes, "FILE_TOO_LARGE")
        .when(F.col("empty") > 0, "EMPTY_FILE").otherwise("OK")
    )
    return sums.select("case_id", "files", "bytes", state.alias("state"))


def merged_files(files: DataFrame, key: tuple[str, ...] = ("filename", "size", "modified")) -> DataFrame:
    """Of files with the same name, size and time of change in a case, the first."""
    return files.withColumn("nth", F.row_number().over(Window.partitionBy("case_id", *key).orderBy("file_pos"))).where("nth = 1").drop("nth")


def page_starts(files: DataFrame) -> DataFrame:
    """Adds ``first_page``: the place of a file's first page in its case, by the pages of the files before."""
    before = F.sum("n_pages").over(Window.partitionBy("case_id").orderBy("file_pos").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("first_page", F.coalesce(before, F.lit(0)) + 1)


def assembled(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files`` (case_id, file_pos, n_pages, encrypted) as one document for each case: its pages in file order, and the files that spoil theirs (encrypted, or without pages), which give no document."""
    bad = F.col("encrypted") | (F.coalesce(F.col("n_pages"), F.lit(0)) < 1)
    rows = files.withColumn("bad", bad).withColumn("spoilt", F.max("bad").over(Window.partitionBy("case_id")))
    good = page_starts(rows.where("NOT spoilt")).select("case_id", "file_pos", "first_page", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page_pos"))
    pages = good.select("case_id", (F.col("first_page") + F.col("page_pos") - 1).alias("page_number"), "file_pos", "page_pos")
    return pages, rows.where("bad").select("case_id", "file_pos", F.lit("INVALID_PDF").alias("state"))


def sessions(events: DataFrame, seconds: int) -> DataFrame:
    """``events`` (session_key, ts): activity with gaps under ``seconds``; a gap of just that many has expired."""
    w = Window.partitionBy("session_key").orderBy("ts")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    rows = events.withColumn("new", F.coalesce((gap >= seconds * 1_000_000).cast("int"), F.lit(1)))
    numbered = rows.withColumn("session_no", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("session_key", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def session_lives(events: DataFrame, seconds: int) -> DataFrame:
    """``events`` (session_key, ts, kind: put, get or delete): a row for each life of a session, with first_ts, last_ts, n (its puts and gets that found it) and deleted.

    A put makes or renews a session, a get renews one that lives, a delete ends one. One that had neither for ``seconds`` has expired, at just that moment too.
    Events of one moment count in the order delete, put, get. A life begins with the first put after a gap, or after a delete; what comes before it finds nothing."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    order = F.when(F.col("kind") == "delete", 0).when(F.col("kind") == "put", 1).otherwise(2)
    rows = events.select("session_key", "kind", ts.alias("us"), order.alias("order"))
    w = Window.partitionBy("session_key").orderBy("us", "order")
    fresh = F.coalesce(F.col("us") - F.lag("us").over(w) >= seconds * 1_000_000, F.lit(True)) | (F.lag("kind").over(w) == "delete")
    blocks = rows.withColumn("fresh", fresh.cast("int")).withColumn("block", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("session_key", "block").orderBy("us", "order").rowsBetween(Window.unboundedPreceding, 0)
    alive = blocks.withColumn("begun", F.max((F.col("kind") == "put").cast("int")).over(own)).where("begun = 1")
    used = F.col("kind") != "delete"
    at = lambda f: F.timestamp_micros(f(F.when(used, F.col("us"))))
    found = alive.groupBy("session_key", "block").agg(at(F.min).alias("first_ts"), at(F.max).alias("last_ts"), F.count_if(used).alias("n"), F.max(~used).alias("deleted"))
    return found.drop("block")


def concurrency(found: DataFrame, seconds: int, per: str = "day") -> DataFrame:
    """The greatest number of live sessions on each day, by running sums of starts and ends; days are summed apart, with what was live at their start carried over."""
    start = found.select(F.unix_micros(F.col("first_ts").cast("timestamp")).alias("at"), F.lit(1).alias("d"))
    end = found.select((F.unix_micros(F.col("last_ts").cast("timestamp")) + seconds * 1_000_000).alias("at"), F.lit(-1).alias("d"))
    steps = start.union(end).withColumn("day", F.date_from_unix_date(F.floor(F.col("at") / 86_400_000_000).cast("int")))
    days = steps.groupBy("day").agg(F.sum("d").alias("change"))
    carried = days.withColumn("before", F.coalesce(F.sum("change").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    running = F.sum("d").over(Window.partitionBy("day").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("running", running).groupBy("day").agg(F.max("running").alias("peak")).join(carried, "day").select("day", (F.col("before") + F.greatest("peak", F.lit(0))).cast("bigint").alias("live"))


def latest_status(events: DataFrame) -> DataFrame:
    """``events`` (run_id, at, status): each run's last status, of an append-only log."""
    return events.groupBy("run_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max("at").alias("at"))


def expired(found: DataFrame, seconds: int, every: int = 60) -> DataFrame:
    """Adds when each session expires (microseconds, ``seconds`` past its last event) and the first sweep, one every ``every`` seconds, that finds it expired."""
    expires = F.unix_micros(F.col("last_ts").cast("timestamp")) + seconds * 1_000_000
    step = every * 1_000_000
    return found.withColumn("expires_us", expires).withColumn("swept_us", (F.ceil(F.col("expires_us") / F.lit(step)) * step).cast("bigint"))


def admitted(asked: DataFrame, most: int) -> DataFrame:
    """``asked`` (store, session, start_us, expires_us) with ``admitted``: a session is turned away while its store holds ``most`` live ones; none is put out for it.

    A store's sessions are cut where none is live, so a task gets one busy period, not a store's whole history."""
    order = Window.partitionBy("store").orderBy("start_us", "session")
    latest = F.max("expires_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = asked.withColumn("fresh", F.coalesce((F.col("start_us") >= latest).cast("int"), F.lit(1))).withColumn("period", F.sum("fresh").over(order)).drop("fresh")

    names = [*asked.columns, "admitted"]

    def admit(period: pd.DataFrame) -> pd.DataFrame:
        period = period.sort_values(["start_us", "session"])
        live: list[int] = []
        kept = []
        for start, end in zip(period["start_us"], period["expires_us"]):
            while live and live[0] <= start:
                heappop(live)
            kept.append(len(live) < most)
            if kept[-1]:
                heappush(live, end)
        return period.assign(admitted=kept)[names]

    schema = ", ".join(f"`{c}` {t}" for c, t in asked.dtypes) + ", admitted boolean"
    return rows.groupBy("store", "period").applyInPandas(admit, schema)


def paced(runs: DataFrame, per_minute: int) -> DataFrame:
    """``runs`` (queue, nth, calls, elapsed in seconds) one after the other at ``per_minute`` calls: the pause after each, and when each starts."""
    need = F.col("calls") * 60.0 / per_minute
    before = Window.partitionBy("queue").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("pause", F.greatest(need - F.col("elapsed"), F.lit(0.0)))
    return rows.withColumn("starts_at", F.coalesce(F.sum(F.col("elapsed") + F.col("pause")).over(before), F.lit(0.0)))


#: States of a run. A run is accepted first; from each state it may go on to these.
MOVES = {
    "accepted": ("processing", "failed", "discarded", "expired"), "processing": ("completed", "failed", "discarded", "expired"), "completed": ("discarded", "expired"), "failed": ("discarded", "expired"),
    "discarded": (), "expired": (),
}


def lifecycle(events: DataFrame, moves: dict[str, tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """Of a log (run_id, event_id, at, status), in which an event may stand twice: the allowed moves, with ``before`` (null at first), and the faults, with ``fault``.

    Pairs of a run's neighbouring states are joined with the table of allowed moves. A fault is a first state that is none, a state that is not known, or a move that is not allowed; the
    log goes on from the state as it stands in it."""
    allowed = moves or MOVES
    pairs = [(None, next(iter(allowed)))] + [(a, b) for a, after in allowed.items() for b in after]
    table = events.sparkSession.createDataFrame([(a or "", b, True) for a, b in pairs], "from_ string, status string, allowed boolean")  # a row a move
    once = events.groupBy("run_id", "event_id").agg(F.min_by(F.struct("at", "status"), F.struct("at", "status")).alias("e")).select("run_id", "event_id", "e.at", "e.status")
    before = F.lag("status").over(Window.partitionBy("run_id").orderBy("at", "event_id"))
    rows = once.withColumn("before", before).withColumn("from_", F.coalesce("before", F.lit(""))).join(F.broadcast(table), ["from_", "status"], "left").drop("from_")
    fault = F.when(~F.col("status").isin(*allowed) | F.col("status").isNull(), "unknown").when(F.col("before").isNull(), "start").otherwise("move")
    names = ("run_id", "event_id", "at", "before", "status")
    return rows.where("allowed").select(*names), rows.where("allowed IS NULL").select(*names, fault.alias("fault"))


def status_spans(events: DataFrame) -> DataFrame:
    """Every change of a run's status with the time it held, the last without an end; repeated statuses are one."""
    order = Window.partitionBy("run_id").orderBy("at", "event_id")
    changes = events.withColumn("before", F.lag("status").over(order)).where("before IS NULL OR before <> status").drop("before")
    return changes.withColumn("until", F.lead("at").over(order))
