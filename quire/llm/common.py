"""What the corpus operators share: written tables, Arrow batches, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that one slice of an Arrow batch holds at most (one longer text makes a slice of its own).
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20
#: A key with more rows than this is hot in a join; most hot keys that are broadcast; parts that a hot key's rows are dealt into.
HOT_ROWS, HOT_KEYS, SALTS = 10_000, 50_000, 64


#: Paths of the tables that ``written`` made inside ``scratch``, in order; each thread or context has its own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where that is unset, a local session (tests) gets a temporary one; a cluster has none, which is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``written`` makes inside: all but the last one, which must not need the others any more, or all where an error ends the block."""
    made: list[str] = []
    before = _made.set(made)
    kept = 0
    try:
        yield
        kept = 1
    finally:
        _made.reset(before)
        for name in made[: len(made) - kept]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; cuts the lineage. The files stay until ``scratch`` or their owner deletes them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted(rows: DataFrame, side: DataFrame, on: list[str], spread: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows``, and ``side`` (a written table with one row for each key ``on``, ``n`` of them in ``rows``), with a column ``salt_`` to join by as well.

    A key of more than ``HOT_ROWS`` rows is hot. Hot keys are broadcast (there are ``HOT_KEYS`` at most: the limit rises
    with the number of rows) only to deal their rows by a hash of ``spread`` into ``SALTS`` parts, to each of which the key's
    row of ``side`` goes; so no task gets all rows of a key, and ``rows`` is computed and shuffled once."""
    total = side.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = side.where(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select(*on, F.lit(True).alias("hot_"))
    part = F.when(F.col("hot_"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    mark = lambda df: df.join(F.broadcast(hot), on, "left")
    return mark(rows).withColumn("salt_", part).drop("hot_"), mark(side).withColumn("salt_", F.explode(salts)).drop("hot_", "n")


def salted_join(rows: DataFrame, side: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, a hot key's rows in many tasks (see ``salted``)."""
    dealt, held = salted(rows, side, on, spread)
    return dealt.join(held, [*on, "salt_"], how).drop("salt_")


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches of bounded size: ``SLICE_ROWS`` rows and ``SLICE_BYTES`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        at, rows, held = 0, 0, 0
        for size in sizes:
            if rows and (rows >= SLICE_ROWS or held + size > SLICE_BYTES):
                yield batch.slice(at, rows)
                at, rows, held = at + rows, 0, 0
            rows, held = rows + 1, held + size
        if rows:
            yield batch.slice(at, rows)


def by_slice(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text"):
    """A function for ``mapInArrow`` that applies ``f`` to each slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column):
            out = f(piece)
            if out is not None and out.num_rows:
                yield out

    return run


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` in UTF-8: ``bytes.split`` parts at just these six characters."""
    return text.encode().split() if text else []


class Memo(dict):
    """Results of ``make`` by piece of text. Holds two generations of ``kept`` pieces and bytes at most (a longer piece is not kept): what was not asked for in a generation goes."""

    def __init__(self, make: Callable[[str], bytes], kept: int = 400_000, size: int = 64 << 20, longest: int = 1 << 12):
        self.make, self.kept, self.size, self.longest, self.held, self.old = make, kept, size, longest, 0, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.old.pop(piece, None)
        if value is None:
            value = self.make(piece)
        if len(piece) <= self.longest:
            self[piece] = value
            self.held += len(piece) + len(value)
        return value

    def joined(self, pieces: Iterable[str]) -> bytes:
        if len(self) > self.kept or self.held > self.size:
            self.old, self.held = dict(self), 0
            self.clear()
        return b"".join(map(self.__getitem__, pieces))
